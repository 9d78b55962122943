"""Oracle SQL for the change sets as written tables (W1, W4, W6-W11), the
kept reports, stored pages and conflicts in bulk."""

from __future__ import annotations

from .checks_sql import ARMS, number

AT = "TIMESTAMP '2024-01-01 00:00:00'"

# -- conflicts in bulk (J9, C1) ---------------------------------------------------------
EXAM_CONFLICT_COUNTS = f"""
SELECT c.id AS cand_id, COUNT(co.id) AS nb_conflits, COUNT(co.id) > 0 AS "hasConflits"
FROM emplois_temps c
LEFT JOIN emplois_temps s ON s.salle = c.salle AND s.jour = c.jour AND s.id <> c.id AND {ARMS}
LEFT JOIN cours co ON s.cours_id = co.id
WHERE c.type_seance = 'examen'
GROUP BY c.id
"""

EXAM_CONFLICT_CLASSES = f"""
WITH asked AS (
  SELECT salle, jour, heure_debut, heure_fin, COUNT(*) AS n FROM emplois_temps
  WHERE type_seance = 'examen' GROUP BY ALL),
stored AS (
  SELECT salle, jour, heure_debut, heure_fin, COUNT(*) AS n FROM emplois_temps
  WHERE cours_id IN (SELECT id FROM cours) GROUP BY ALL)
SELECT c.salle, c.jour, c.heure_debut, c.heure_fin, s.heure_debut AS s_heure_debut, s.heure_fin AS s_heure_fin,
       c.n AS nb_candidats, s.n AS nb_seances
FROM asked c JOIN stored s ON s.salle = c.salle AND s.jour = c.jour AND {ARMS}
"""

# -- full updates (W4) -------------------------------------------------------------------
# A change whose unique value another row of the table holds is refused; of
# two that ask for one new value the first is in.
PROFESSORS_AFTER_UPDATE = """
WITH asked AS (
  SELECT id, CASE id % 4 WHEN 0 THEN 'p' || CAST(id + 1 AS VARCHAR) || '@campus.fr'
                         WHEN 1 THEN 'pair' || CAST(id // 8 AS VARCHAR) || '@campus.fr'
                         ELSE 'prof' || CAST(id AS VARCHAR) || '@campus.fr' END AS email
  FROM professeurs WHERE departement_id IS NOT NULL),
free AS (
  SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM professeurs p WHERE p.email = a.email AND p.id <> a.id)),
done AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY email ORDER BY id) = 1)
SELECT p.id, COALESCE(d.email, p.email) AS email, CASE WHEN d.id IS NULL THEN p.grade ELSE 'Emerite' END AS grade
FROM professeurs p LEFT JOIN done d ON d.id = p.id
"""

COURSES_AFTER_UPDATE = """
WITH asked AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN 'C-' || CAST(id + 1 AS VARCHAR) ELSE 'N-' || CAST(id - id % 2 AS VARCHAR) END AS code,
         CASE WHEN id % 7 = 0 THEN 0 ELSE credits + 1 END AS credits
  FROM cours),
free AS (
  SELECT * FROM asked a
  WHERE a.credits >= 1 AND NOT EXISTS (SELECT 1 FROM cours c WHERE c.code = a.code AND c.id <> a.id)),
done AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1)
SELECT c.id, COALESCE(d.code, c.code) AS code, COALESCE(d.credits, c.credits) AS credits,
       CASE WHEN d.id IS NULL THEN c.description END AS description
FROM cours c LEFT JOIN done d ON d.id = c.id
"""

DEPARTMENTS_AFTER_UPDATE = """
SELECT id, CASE WHEN id % 5 = 0 THEN nom ELSE 'Dept ' || CAST(id AS VARCHAR) END AS nom,
       CASE WHEN id % 5 = 0 THEN description END AS description
FROM departements
"""

GRADES_AFTER_UPDATE = """
SELECT id, CASE WHEN note + 4 <= 20 AND coefficient >= 0.1 THEN note + 4 ELSE note END AS note,
       CASE WHEN note + 4 <= 20 AND coefficient >= 0.1 THEN 'R' ELSE type_evaluation END AS type_evaluation
FROM notes
"""

ABSENCES_AFTER_UPDATE = """
SELECT id, CASE WHEN motif IS NULL THEN date_absence ELSE date_absence + 1 END AS date_absence,
       CASE WHEN motif IS NULL THEN justifiee ELSE TRUE END AS justifiee, motif
FROM absences
"""

STAFF_AFTER_UPDATE = """
SELECT id, CASE WHEN departmentId IS NULL THEN 'away' ELSE status END AS status, departmentId AS "departmentId"
FROM teaching_staff
"""

# Every session asks for the next room; it is refused where another stored
# session holds that slot.
SESSIONS_AFTER_UPDATE = f"""
WITH c AS (
  SELECT id, jour, heure_debut, heure_fin, salle AS old, 'S' || CAST((id + 1) % 500 AS VARCHAR) AS salle FROM emplois_temps),
refused AS (
  SELECT DISTINCT c.id FROM c JOIN emplois_temps s
    ON s.salle = c.salle AND s.jour = c.jour AND s.id <> c.id AND {ARMS})
SELECT c.id, CASE WHEN r.id IS NULL THEN c.salle ELSE c.old END AS salle
FROM c LEFT JOIN refused r ON r.id = c.id
"""

# -- appended tables (W1, W8, W11) ----------------------------------------------------------
COURSES_APPENDED_TABLE = f"""
WITH asked AS (
  SELECT id AS seq, CASE WHEN id % 5 = 0 THEN 'C-' || CAST(id AS VARCHAR) ELSE 'B-' || CAST(id // 3 AS VARCHAR) END AS code,
         CASE WHEN id % 4 = 0 THEN NULL ELSE nom END AS nom
  FROM professeurs),
free AS (
  SELECT * FROM asked WHERE nom IS NOT NULL AND code NOT IN (SELECT code FROM cours)
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq) = 1)
SELECT id, code, nom, credits, created_at FROM cours
UNION ALL
SELECT (SELECT max(id) FROM cours) + seq, code, nom, 3, {AT} FROM free
"""

DEPARTMENTS_APPENDED_TABLE = f"""
WITH asked AS (
  SELECT id AS seq, CASE WHEN id % 6 = 0 THEN (SELECT nom FROM departements WHERE id = 3)
                         WHEN id % 7 = 0 THEN '' ELSE 'Dept ' || CAST(id // 2 AS VARCHAR) END AS nom
  FROM professeurs),
free AS (
  SELECT * FROM asked WHERE nom <> '' AND nom NOT IN (SELECT nom FROM departements)
  QUALIFY row_number() OVER (PARTITION BY nom ORDER BY seq) = 1)
SELECT id, nom, created_at FROM departements
UNION ALL
SELECT (SELECT max(id) FROM departements) + seq, nom, {AT} FROM free
"""

_ABSENCE_BATCH = """
  SELECT a.*, row_number() OVER (PARTITION BY a.etudiant_id, a.cours_id, a.date_absence ORDER BY a.id) AS k
  FROM absences a
  WHERE NOT a.justifiee AND EXISTS (SELECT 1 FROM inscriptions i WHERE i.etudiant_id = a.etudiant_id AND i.cours_id = a.cours_id)
    AND a.cours_id IN (SELECT id FROM cours) AND a.etudiant_id IN (SELECT id FROM etudiants)
    AND NOT EXISTS (SELECT 1 FROM absences b WHERE b.justifiee AND b.etudiant_id = a.etudiant_id
                    AND b.cours_id = a.cours_id AND b.date_absence = a.date_absence)"""

ABSENCES_APPENDED_TABLE = f"""
SELECT id, etudiant_id, cours_id, date_absence, motif, justifiee, NULL::TIMESTAMP AS created_at FROM absences WHERE justifiee
UNION ALL
SELECT (SELECT max(id) FROM absences WHERE justifiee) + id, etudiant_id, cours_id, date_absence, motif, justifiee, {AT}
FROM ({_ABSENCE_BATCH}) x WHERE k = 1
"""

ENROLMENTS_TABLE = """
WITH batch AS (
  SELECT etudiant_id, cours_id FROM notes GROUP BY etudiant_id, cours_id)
SELECT etudiant_id, cours_id, CAST(date_inscription AS TIMESTAMP) AS date_inscription, statut FROM inscriptions
UNION ALL
SELECT b.etudiant_id, b.cours_id, TIMESTAMP '2024-01-01 00:00:00', 'active'
FROM batch b
WHERE b.cours_id IN (SELECT id FROM cours) AND b.etudiant_id IN (SELECT id FROM etudiants)
  AND NOT EXISTS (SELECT 1 FROM inscriptions i WHERE i.etudiant_id = b.etudiant_id AND i.cours_id = b.cours_id)
"""

SCHOLARSHIPS_SUBMITTED_TABLE = f"""
SELECT id, nom, telephone, statut, NULL::TIMESTAMP AS "dateSoumission" FROM demandes_bourse
UNION ALL
SELECT (SELECT max(id) FROM demandes_bourse) + id, nom, '06' || CAST(id AS VARCHAR), 'En attente', {AT}
FROM etudiants WHERE id % 4 <> 0 AND id % 9 <> 0
"""

# -- validation with both verdicts (V9-V11) ------------------------------------------------------
DEPARTMENTS_PROPOSED_VALIDATION = """
SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 1 THEN 'nom' ELSE '' END AS errors FROM departements
"""
SCHOLARSHIPS_PROPOSED_VALIDATION = """
SELECT id, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'telephone' END, CASE WHEN id % 3 = 0 THEN 'email' END,
                     CASE WHEN id % 7 = 0 THEN 'moyenneBac' END) AS errors
FROM demandes_bourse
"""
SCHOLARSHIP_STATUS_TABLE = """
SELECT id, CASE WHEN id % 3 = 0 THEN statut ELSE 'Acceptée' END AS statut FROM demandes_bourse
"""

# -- deletes that happen, over all levels (W6, W12) ------------------------------------------------
PROFESSORS_DELETE_REMAINING = """
SELECT p.id, p.matricule FROM professeurs p WHERE p.id IN (SELECT professeur_id FROM cours WHERE professeur_id IS NOT NULL)
"""
COURSES_DELETE_REPORT = """
WITH c AS (
  SELECT c.id,
         (SELECT COUNT(*) FROM notes n WHERE n.cours_id = c.id) AS notes,
         (SELECT COUNT(*) FROM emplois_temps e WHERE e.cours_id = c.id) AS emplois_temps
  FROM cours c)
SELECT id, notes, emplois_temps, CASE WHEN notes + emplois_temps > 0 THEN 'enfants' END AS reason FROM c
UNION ALL
SELECT id, NULL, NULL, 'introuvable' FROM etudiants e WHERE NOT EXISTS (SELECT 1 FROM cours c WHERE c.id = e.id)
"""
_PAID = """
  SELECT studentId AS root, id FROM payments
  UNION
  SELECT b.studentId, p.id FROM payments p JOIN bills b ON p.billId = b.id"""
STUDENTS_DELETE_REPORT = f"""
WITH paid AS ({_PAID}),
counts AS (
  SELECT e.id,
         (SELECT COUNT(*) FROM inscriptions x WHERE x.etudiant_id = e.id) AS inscriptions,
         (SELECT COUNT(*) FROM notes x WHERE x.etudiant_id = e.id) AS notes,
         (SELECT COUNT(*) FROM absences x WHERE x.etudiant_id = e.id) AS absences,
         (SELECT COUNT(*) FROM bills x WHERE x.studentId = e.id) AS bills,
         (SELECT COUNT(*) FROM paid x WHERE x.root = e.id) AS payments
  FROM etudiants e)
SELECT *, CASE WHEN inscriptions + notes + absences + bills + payments > 0 THEN 'enfants' END AS reason FROM counts
"""
# Payments whose student was taken out, after every student of one level went.
PAYMENTS_ORPHANED = """
SELECT p.id, p.studentId AS "studentId" FROM payments p
WHERE p.studentId IS NOT NULL
  AND p.studentId NOT IN (SELECT id FROM etudiants WHERE niveau IS NULL OR niveau <> 'BUILDING')
"""

# -- issued documents (W10) ------------------------------------------------------------------------------
EXPENSES_ISSUED_TABLE = f"""
SELECT id, expenseNumber AS "expenseNumber", amount, departmentId AS "departmentId", date, status FROM expenses
UNION ALL
SELECT (SELECT max(id) FROM expenses) + id, {number('EXP', 'id')}, id * CAST(2.5 AS DOUBLE), departement_id, DATE '2024-01-01', 'pending'
FROM professeurs WHERE id % 6 <> 0
"""
TEACHING_STAFF_ISSUE_REPORT = f"""
SELECT (SELECT max(id) FROM teaching_staff) + id AS id, {number('ENS', 'id')} AS "employeeId",
       CASE WHEN id % 4 = 0 THEN 'valeur_manquante' WHEN id % 5 = 1 AND id > 1 AND (id - 1) % 4 <> 0 THEN 'doublon_lot' END AS reason
FROM professeurs
"""

# -- positions (R18, R20, R27) ---------------------------------------------------------------------------------
SESSIONS_BY_DAY_ORDERED = """
SELECT row_number() OVER (ORDER BY jour NULLS FIRST) AS place, jour, COUNT(*) AS count FROM emplois_temps GROUP BY jour
"""
SESSIONS_BY_ROOM_ORDERED = """
SELECT row_number() OVER (ORDER BY COUNT(*) DESC, salle NULLS FIRST) AS place, salle, COUNT(*) AS count
FROM emplois_temps GROUP BY salle
"""
DEPARTMENT_BREAKDOWN_ORDERED = """
WITH heads AS (
  SELECT d.nom, d.id, (SELECT COUNT(*) FROM etudiants e WHERE e.departement_id = d.id) AS nb_etudiants FROM departements d)
SELECT row_number() OVER (ORDER BY nb_etudiants DESC, id) AS place, nom, nb_etudiants FROM heads
"""

# -- search and filters (F2, F4, L7, L9, L17) ----------------------------------------------------------------------
STUDENTS_INDEXED = """
SELECT id, nom, email FROM etudiants WHERE nom ILIKE '%r#0000001%' OR prenom ILIKE '%r#0000001%' OR matricule ILIKE '%r#0000001%' OR email ILIKE '%r#0000001%'
"""
COURSES_INDEXED = """
SELECT id, nom FROM cours WHERE nom ILIKE '%wid_et%' OR code ILIKE '%wid_et%' OR description ILIKE '%wid_et%'
"""
DEPARTMENTS_INDEXED = """
SELECT id, nom FROM departements WHERE nom ILIKE '%me%' OR description ILIKE '%me%'
"""

# -- insert or ignore (S4) ----------------------------------------------------------------------------------------------
STUDENTS_SEEDED = """
WITH seed AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN 'ETU-' || CAST(id AS VARCHAR) ELSE 'SEED-' || CAST(id // 4 AS VARCHAR) END AS number, nom
  FROM professeurs)
SELECT matricule, nom FROM etudiants
UNION ALL
SELECT number, nom FROM seed s
WHERE number NOT IN (SELECT matricule FROM etudiants) AND NOT EXISTS (SELECT 1 FROM seed t WHERE t.number = s.number AND t.id < s.id)
"""

# -- parameters (X9, X10) --------------------------------------------------------------------------------------------------
FLAGS_PARSED = """
SELECT id, CASE id % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END AS flag FROM etudiants
"""
SUMMARY_OF_NOTHING = """
SELECT 0::BIGINT AS count, 0::DOUBLE AS moyenne FROM (SELECT COUNT(*) FROM notes WHERE note > 1000) x
"""

STUDENTS_AS_JSON = "SELECT id, nom, departement_id FROM etudiants"
