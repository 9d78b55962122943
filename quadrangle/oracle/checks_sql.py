"""Oracle SQL for conflicts (C1), validation (V*), checked appends
and orphans (W12)."""

ARMS = """((s.heure_debut <= c.heure_debut AND s.heure_fin > c.heure_debut) OR
        (s.heure_debut < c.heure_fin AND s.heure_fin >= c.heure_fin) OR
        (s.heure_debut >= c.heure_debut AND s.heure_fin <= c.heure_fin))"""

SESSION_CONFLICTS = f"""
WITH s AS (SELECT e.* FROM emplois_temps e JOIN cours co ON e.cours_id = co.id)
SELECT c.*, COUNT(s.id) AS nb_conflits, COUNT(s.id) > 0 AS hasConflits
FROM emplois_temps c
LEFT JOIN s
  ON s.salle = c.salle AND s.jour = c.jour AND s.id != c.id AND {ARMS}
GROUP BY ALL
"""

EXAM_CONFLICTS = f"""
SELECT c.id AS cand_id, s.*, co.nom AS cours_nom, co.code AS cours_code
FROM emplois_temps c
JOIN emplois_temps s
  ON s.salle = c.salle AND s.jour = c.jour AND s.id != c.id AND {ARMS}
JOIN cours co ON s.cours_id = co.id
WHERE c.type_seance = 'examen'
"""

INT = r"'^[-+]?[0-9]+$'"
FLOAT = r"'^[-+]?([0-9]+)?(\.[0-9]*)?([eE][-+]?[0-9]+)?$'"
DATE = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
TIME = r"'^([01]?[0-9]|2[0-3]):[0-5][0-9]$'"
EMAIL = r"'^[^\s@]+@[^\s@]+\.[^\s@]+$'"


def _fail(cond: str, code: str) -> str:
    return f"CASE WHEN COALESCE({cond}, FALSE) THEN NULL ELSE '{code}' END"


def req(c):
    return _fail(f"length(CAST({c} AS VARCHAR)) > 0", c)


def is_int(c, lo=None, hi=None):
    cond = f"regexp_matches(CAST({c} AS VARCHAR), {INT})"
    if lo is not None:
        cond += f" AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) >= {lo}"
    if hi is not None:
        cond += f" AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) <= {hi}"
    return _fail(cond, c)


def is_float(c, lo=None, hi=None):
    cond = (f"regexp_matches(CAST({c} AS VARCHAR), {FLOAT}) AND "
            f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL")
    if lo is not None:
        cond += f" AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) >= {lo}"
    if hi is not None:
        cond += f" AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) <= {hi}"
    return _fail(cond, c)


def is_date(c):
    return _fail(f"regexp_matches(CAST({c} AS VARCHAR), {DATE}) AND "
                 f"TRY_CAST(CAST({c} AS VARCHAR) AS DATE) IS NOT NULL", c)


def errors(*checks: str) -> str:
    return "concat_ws(',', " + ", ".join(checks) + ")"


GRADE_VALIDATION = f"""
SELECT id, {errors(is_int('etudiant_id'), is_int('cours_id'), req('type_evaluation'),
                   is_float('note', 0, 20), is_float('coefficient', 0.1),
                   is_date('date_evaluation'))} AS errors
FROM notes
"""

TIMETABLE_VALIDATION = f"""
SELECT id, {errors(is_int('cours_id'),
                   _fail("jour IN ('Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche')", 'jour'),
                   _fail(f"regexp_matches(heure_debut, {TIME})", 'heure_debut'),
                   _fail(f"regexp_matches(heure_fin, {TIME})", 'heure_fin'),
                   req('salle'),
                   _fail("type_seance IN ('cours','tp','td','examen')", 'type_seance'))} AS errors
FROM emplois_temps
"""

STUDENT_VALIDATION = f"""
SELECT id, {errors(req('matricule'), req('nom'), req('prenom'),
                   _fail(f"regexp_matches(email, {EMAIL})", 'email'),
                   is_int('departement_id'), req('niveau'),
                   is_int('annee_etude', 1, 5))} AS errors
FROM etudiants
"""

COURSE_VALIDATION = f"""
SELECT id, {errors(req('code'), req('nom'), is_int('credits', 1), is_int('heures_cours', 0),
                   is_int('heures_tp', 0), is_int('departement_id'), req('semestre'),
                   req('annee_academique'))} AS errors
FROM cours
"""

ABSENCE_VALIDATION = f"""
SELECT id, {errors(is_int('etudiant_id'), is_int('cours_id'), is_date('date_absence'),
                   _fail("lower(CAST(justifiee AS VARCHAR)) IN ('true','false','1','0')",
                         'justifiee'))} AS errors
FROM absences
"""

SCHOLARSHIP_VALIDATION = f"""
SELECT id, {errors(req('nom'), req('prenoms'), req('telephone'), req('email'), req('serieBac'),
                   _fail('moyenneBac IS NOT NULL', 'moyenneBac'))} AS errors
FROM demandes_bourse
"""

GRADE_APPEND_CHECK = f"""
WITH v AS (
  SELECT n.id, n.etudiant_id, n.cours_id,
         {errors(is_int('etudiant_id'), is_int('cours_id'), req('type_evaluation'),
                 is_float('note', 0, 20), is_float('coefficient', 0.1),
                 is_date('date_evaluation'))} AS errors
  FROM notes n),
es AS (SELECT DISTINCT id FROM etudiants),
cs AS (SELECT DISTINCT id FROM cours),
ins AS (SELECT DISTINCT etudiant_id, cours_id FROM inscriptions)
SELECT v.id,
       CASE WHEN v.errors <> '' THEN 'invalide'
            WHEN es.id IS NULL THEN 'etudiant_introuvable'
            WHEN cs.id IS NULL THEN 'cours_introuvable'
            WHEN ins.etudiant_id IS NULL THEN 'non_inscrit' END AS reason
FROM v
LEFT JOIN es ON v.etudiant_id = es.id
LEFT JOIN cs ON v.cours_id = cs.id
LEFT JOIN ins ON v.etudiant_id = ins.etudiant_id AND v.cours_id = ins.cours_id
"""

ENROL_CHECK = """
WITH batch AS (
  SELECT etudiant_id, cours_id, MIN(id) AS seq FROM notes GROUP BY etudiant_id, cours_id),
es AS (SELECT DISTINCT id FROM etudiants),
cs AS (SELECT DISTINCT id FROM cours),
ins AS (SELECT DISTINCT etudiant_id, cours_id FROM inscriptions)
SELECT b.seq, b.etudiant_id, b.cours_id,
       CASE WHEN cs.id IS NULL THEN 'cours_introuvable'
            WHEN es.id IS NULL THEN 'etudiant_introuvable'
            WHEN ins.etudiant_id IS NOT NULL THEN 'deja_inscrit' END AS reason
FROM batch b
LEFT JOIN cs ON b.cours_id = cs.id
LEFT JOIN es ON b.etudiant_id = es.id
LEFT JOIN ins ON b.etudiant_id = ins.etudiant_id AND b.cours_id = ins.cours_id
"""


def orphans(child: str, fk: str, parent: str) -> str:
    return f"""
SELECT x.* FROM {child} x
WHERE x.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = x.{fk})
"""


ENROLLED_COURSE_AVERAGE = """
WITH g AS (
  SELECT etudiant_id, cours_id,
         CASE WHEN SUM(COALESCE(coefficient, 0)) > 0
              THEN floor(SUM(note * COALESCE(coefficient, 0)) / SUM(COALESCE(coefficient, 0)) * 100 + 0.5) / 100
              ELSE CAST(0 AS DOUBLE) END AS moyenne,
         SUM(COALESCE(coefficient, 0)) AS totalCoefficients, COUNT(*) AS nb_notes
  FROM notes GROUP BY etudiant_id, cours_id)
SELECT i.etudiant_id, i.cours_id, g.moyenne, g.totalCoefficients, g.nb_notes
FROM inscriptions i LEFT JOIN g ON g.etudiant_id = i.etudiant_id AND g.cours_id = i.cours_id
"""

_CHILD_COUNTS = """
  SELECT d.id,
         (SELECT COUNT(*) FROM etudiants e WHERE e.departement_id = d.id) AS etudiants,
         (SELECT COUNT(*) FROM professeurs p WHERE p.departement_id = d.id) AS professeurs,
         (SELECT COUNT(*) FROM cours c WHERE c.departement_id = d.id) AS cours
  FROM departements d"""

DEPARTMENT_DELETE_BLOCKED = f"""
WITH k AS ({_CHILD_COUNTS})
SELECT id, etudiants, professeurs, cours, 'enfants' AS reason FROM k
WHERE etudiants > 0 OR professeurs > 0 OR cours > 0
"""

DEPARTMENT_DELETE_REMAINING = f"""
WITH k AS ({_CHILD_COUNTS})
SELECT d.* FROM departements d JOIN k ON k.id = d.id
WHERE k.etudiants > 0 OR k.professeurs > 0 OR k.cours > 0
"""

GRADES_WITHOUT_ORPHANS = """
SELECT n.* FROM notes n
WHERE n.cours_id IS NULL OR n.cours_id IN (SELECT id FROM cours)
"""

BILLS_AFTER_PAYMENTS = """
SELECT b.id, CASE WHEN p.billId IS NOT NULL THEN 'paid' ELSE b.status END AS status
FROM bills b LEFT JOIN (SELECT DISTINCT billId FROM payments) p ON b.id = p.billId
"""

ABSENCES_JUSTIFIED_WITH_MOTIF = """
SELECT id, CASE WHEN motif IS NOT NULL THEN TRUE ELSE justifiee END AS justifiee, motif
FROM absences
"""


PROFESSOR_VALIDATION = f"""
SELECT id, {errors(req('matricule'), req('nom'), req('prenom'),
                   _fail(f"regexp_matches(email, {EMAIL})", 'email'),
                   is_int('departement_id'), req('specialite'), req('grade'))} AS errors
FROM professeurs
"""

DEPARTMENT_VALIDATION = f"""
SELECT id, {errors(req('nom'))} AS errors FROM departements
"""

SCHOLARSHIP_STATUS_VALIDATION = f"""
SELECT id, {errors(req('statut'))} AS errors FROM demandes_bourse
"""

ABSENCE_APPEND_CHECK = f"""
WITH v AS (
  SELECT a.id AS seq, a.etudiant_id, a.cours_id, a.date_absence,
         {errors(is_int('etudiant_id'), is_int('cours_id'), is_date('date_absence'),
                 _fail("lower(CAST(justifiee AS VARCHAR)) IN ('true','false','1','0')",
                       'justifiee'))} AS errors
  FROM absences a WHERE a.justifiee = FALSE),
base AS (SELECT DISTINCT etudiant_id, cours_id, date_absence FROM absences
         WHERE justifiee = TRUE),
es AS (SELECT DISTINCT id FROM etudiants),
cs AS (SELECT DISTINCT id FROM cours),
ins AS (SELECT DISTINCT etudiant_id, cours_id FROM inscriptions),
r AS (
  SELECT v.*,
         CASE WHEN v.errors <> '' THEN 'invalide'
              WHEN es.id IS NULL THEN 'etudiant_introuvable'
              WHEN cs.id IS NULL THEN 'cours_introuvable'
              WHEN ins.etudiant_id IS NULL THEN 'non_inscrit' END AS r0,
         b.etudiant_id IS NOT NULL AS in_base
  FROM v
  LEFT JOIN es ON v.etudiant_id = es.id
  LEFT JOIN cs ON v.cours_id = cs.id
  LEFT JOIN ins ON v.etudiant_id = ins.etudiant_id AND v.cours_id = ins.cours_id
  LEFT JOIN base b ON v.etudiant_id = b.etudiant_id AND v.cours_id = b.cours_id
                  AND v.date_absence = b.date_absence),
firsts AS (
  SELECT etudiant_id, cours_id, date_absence, MIN(seq) AS min_seq FROM r
  WHERE r0 IS NULL AND NOT in_base GROUP BY ALL)
SELECT r.seq,
       COALESCE(r.r0, CASE WHEN r.in_base THEN 'doublon' END,
                CASE WHEN f.min_seq IS NOT NULL AND r.seq > f.min_seq THEN 'doublon_lot' END)
         AS reason
FROM r LEFT JOIN firsts f ON r.etudiant_id = f.etudiant_id AND r.cours_id = f.cours_id
                         AND r.date_absence = f.date_absence
"""


SCHOLARSHIP_SUBMISSION_CHECK = """
SELECT id AS seq,
       CASE WHEN NOT (COALESCE(length(nom), 0) > 0 AND COALESCE(length(prenoms), 0) > 0
                      AND COALESCE(length(telephone), 0) > 0 AND COALESCE(length(email), 0) > 0
                      AND COALESCE(length(serieBac), 0) > 0 AND moyenneBac IS NOT NULL)
            THEN 'invalide' END AS reason
FROM demandes_bourse
"""


SESSION_RESAVE_CHECK = f"""
SELECT c.id AS seq,
       CASE WHEN EXISTS (SELECT 1 FROM emplois_temps s
                         WHERE s.salle = c.salle AND s.jour = c.jour AND s.id != c.id
                           AND {ARMS})
            THEN 'conflit' END AS reason
FROM emplois_temps c
"""


def number(prefix: str, n: str) -> str:
    """A document number of 2024."""
    return f"'{prefix}-2024-' || CASE WHEN {n} < 100000 THEN lpad(CAST({n} AS VARCHAR), 6, '0') ELSE CAST({n} AS VARCHAR) END"


BILLS_ISSUED_TABLE = f"""
SELECT id, invoiceNumber, studentId, amount, description, issueDate, status FROM bills
UNION ALL
SELECT (SELECT max(id) FROM bills) + e.id, {number('FAC', 'e.id')}, e.id, e.id * CAST(1.5 AS DOUBLE),
       'frais', DATE '2024-01-01', 'pending'
FROM etudiants e WHERE e.id % 7 <> 0
"""

# An e-mail goes to the first row that asks for it; rows without one are out.
ADMIN_STAFF_ISSUE_REPORT = f"""
WITH batch AS (
  SELECT id AS seq, CASE WHEN id % 10 <> 0 THEN
           'a' || CAST(CASE WHEN id % 3 = 2 THEN id - 1 ELSE id END AS VARCHAR) || '@campus.fr' END AS email
  FROM professeurs)
SELECT (SELECT max(id) FROM admin_staff) + seq AS id, {number('ADM', 'seq')} AS "employeeId", email,
       'active' AS status,
       CASE WHEN email IS NULL THEN 'valeur_manquante'
            WHEN EXISTS (SELECT 1 FROM batch p WHERE p.email = b.email AND p.seq < b.seq) THEN 'doublon_lot'
       END AS reason
FROM batch b
"""

PAYMENTS_POSTED_TABLE = f"""
SELECT id, paymentNumber, billId, amount, method, date, status FROM payments
UNION ALL
SELECT (SELECT max(id) FROM payments) + b.id, {number('PAY', 'b.id')}, b.id, b.amount, 'cash',
       DATE '2024-01-01', 'completed'
FROM bills b WHERE b.status = 'pending' AND b.id % 9 <> 0
"""

BILLS_AFTER_POSTING = """
SELECT id, CASE WHEN status = 'pending' AND id % 9 <> 0 THEN 'paid' ELSE status END AS status FROM bills
"""

STUDENTS_AFTER_UPDATE = """
WITH asked AS (
  SELECT id AS seq, id, niveau, departement_id,
         CASE WHEN id % 10 = 0 THEN 'e' || CAST(id + 1 AS VARCHAR) || '@campus.fr'
              WHEN id % 25 = 1 THEN 'same' || CAST(id // 50 AS VARCHAR) || '@campus.fr'
              ELSE 'new' || CAST(id AS VARCHAR) || '@campus.fr' END AS email
  FROM etudiants
  UNION ALL
  SELECT id + 1000000000000, id, 'L9', departement_id,
         CASE WHEN id % 2 = 0 THEN email
              WHEN id % 25 = 1 THEN 'same' || CAST(id // 50 AS VARCHAR) || '@campus.fr'
              ELSE 'new' || CAST(id AS VARCHAR) || '@campus.fr' END
  FROM etudiants WHERE id % 15 = 0),
allowed AS (
  SELECT a.* FROM asked a
  WHERE a.departement_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM etudiants o WHERE o.email = a.email AND o.id <> a.id)),
latest AS (SELECT * FROM allowed QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
done AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY email ORDER BY seq) = 1)
SELECT e.id, COALESCE(d.email, e.email) AS email, COALESCE(d.niveau, e.niveau) AS niveau
FROM etudiants e LEFT JOIN done d ON d.id = e.id
"""

# Rows are taken in the order of seq; one is in unless its number or e-mail is
# taken by the table or by an earlier row that is in.  A number is shared by
# an even row and the odd one after it, an e-mail by a multiple of nine and
# the row before it, so a row depends on the one before it alone.
STUDENTS_APPENDED_TABLE = """
WITH RECURSIVE asked AS (
  SELECT id AS seq, row_number() OVER (ORDER BY id) AS k,
         CASE WHEN id % 4 = 0 THEN 'ETU-' || CAST(id AS VARCHAR)
              ELSE 'M-' || CAST(id - id % 2 AS VARCHAR) END AS matricule,
         'm' || CAST(CASE WHEN id % 9 = 0 THEN id - 1 ELSE id END AS VARCHAR) || '@campus.fr' AS email
  FROM professeurs),
free AS (
  SELECT a.*, a.matricule NOT IN (SELECT matricule FROM etudiants)
              AND a.email NOT IN (SELECT email FROM etudiants) AS ok
  FROM asked a),
taken AS (
  SELECT k, seq, matricule, email, ok AS inside FROM free WHERE k = 1
  UNION ALL
  SELECT f.k, f.seq, f.matricule, f.email,
         f.ok AND NOT (t.inside AND (t.matricule = f.matricule OR t.email = f.email))
  FROM taken t JOIN free f ON f.k = t.k + 1)
SELECT id, matricule, email, niveau, created_at FROM etudiants
UNION ALL
SELECT (SELECT max(id) FROM etudiants) + seq, matricule, email, 'L1', TIMESTAMP '2024-01-01 00:00:00'
FROM taken WHERE inside
"""

# Exam sessions are booked in the order of their ids against the others: one
# at a time within a room and day, carrying the slots taken so far.
BOOK_EXAM_SESSIONS = f"""
WITH RECURSIVE asked AS (
  SELECT id AS seq, cours_id, salle, jour, heure_debut, heure_fin,
         cours_id IN (SELECT id FROM cours) AS course_ok,
         {errors(is_int('cours_id'),
                 _fail("jour IN ('Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche')", 'jour'),
                 _fail(f"regexp_matches(heure_debut, {TIME})", 'heure_debut'),
                 _fail(f"regexp_matches(heure_fin, {TIME})", 'heure_fin'),
                 req('salle'))} AS errors
  FROM emplois_temps WHERE type_seance = 'examen'),
free AS (
  SELECT c.seq, c.salle, c.jour, c.heure_debut AS a, c.heure_fin AS b,
         row_number() OVER (PARTITION BY c.salle, c.jour ORDER BY c.seq) AS k
  FROM asked c
  WHERE c.errors = '' AND c.course_ok
    AND NOT EXISTS (SELECT 1 FROM emplois_temps s
                    WHERE s.type_seance <> 'examen' AND s.salle = c.salle AND s.jour = c.jour AND {ARMS})),
booked AS (
  SELECT seq, salle, jour, k, [struct_pack(a := a, b := b)] AS taken, TRUE AS inside FROM free WHERE k = 1
  UNION ALL
  SELECT seq, salle, jour, k,
         CASE WHEN hit THEN taken ELSE list_append(taken, struct_pack(a := a, b := b)) END, NOT hit
  FROM (SELECT f.*, p.taken,
               len(list_filter(p.taken, lambda t: (t.a <= f.a AND t.b > f.a) OR (t.a < f.b AND t.b >= f.b)
                                                  OR (t.a >= f.a AND t.b <= f.b))) > 0 AS hit
        FROM booked p JOIN free f ON f.salle = p.salle AND f.jour = p.jour AND f.k = p.k + 1) x)
SELECT v.seq, v.cours_id, v.salle, v.jour, v.heure_debut, v.heure_fin,
       COALESCE(r.inside, FALSE) AS accepted,
       CASE WHEN v.errors <> '' THEN 'invalide'
            WHEN NOT v.course_ok THEN 'cours_introuvable'
            WHEN NOT COALESCE(r.inside, FALSE) THEN 'conflit' END AS reason
FROM asked v LEFT JOIN booked r ON r.seq = v.seq
"""
