"""The registered queries (one per SURVEY section 2 entry that has a
whole-table form).  Each reads the whole campus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import changes, grades, listing, quality, reports, schedule
from .oracle import checks_sql, grades_sql, listing_sql, reports_sql
from .registry import register


# -- grades ------------------------------------------------------------------
@register("grade_course_average", grades_sql.COURSE_AVERAGE)
def _g1(c):
    return grades.course_average(c.notes)


@register("grade_course_means", grades_sql.COURSE_MEANS)
def _g2(c):
    return grades.course_means(c.notes, c.cours)


@register("grade_general_average", grades_sql.GENERAL_AVERAGE)
def _g3(c):
    return grades.general_average(c.notes, c.cours, c.etudiants)


# -- overview reports (R1-R29) ---------------------------------------------------
def _reg_total(name, table):
    register(name, reports_sql.total(table))(lambda c: reports.total(c.table(table)))


def _reg_count_by(name, table, col):
    register(name, reports_sql.count_by(table, col))(
        lambda c: reports.count_by(c.table(table), col))


def _reg_per_dept(name, table):
    register(name, reports_sql.per_department(table))(
        lambda c: reports.children_per_parent(c.departements, c.table(table), "departement_id")
        .select("nom", "count"))


_reg_total("students_total", "etudiants")                                  # R1
_reg_per_dept("students_by_department", "etudiants")                       # R2
_reg_count_by("students_by_level", "etudiants", "niveau")                  # R3
_reg_count_by("students_by_year", "etudiants", "annee_etude")              # R4
_reg_total("professors_total", "professeurs")                              # R5
_reg_per_dept("professors_by_department", "professeurs")                   # R6
_reg_count_by("professors_by_grade", "professeurs", "grade")               # R7
_reg_count_by("professors_by_specialty", "professeurs", "specialite")      # R8
_reg_total("courses_total", "cours")                                       # R9
_reg_per_dept("courses_by_department", "cours")                            # R10
_reg_count_by("courses_by_semester", "cours", "semestre")                  # R11
_reg_count_by("courses_by_academic_year", "cours", "annee_academique")     # R12
register("grades_totals", reports_sql.GRADES_TOTALS)(                      # R13, R14
    lambda c: reports.grades_totals(c.notes))
register("grades_by_type", reports_sql.GRADES_BY_TYPE)(                    # R15
    lambda c: reports.grades_by_type(c.notes))
register("grade_bands", reports_sql.GRADE_BANDS)(                          # R16
    lambda c: reports.grade_bands(c.notes))
_reg_total("sessions_total", "emplois_temps")                              # R17
_reg_count_by("sessions_by_day", "emplois_temps", "jour")                  # R18
_reg_count_by("sessions_by_type", "emplois_temps", "type_seance")          # R19
_reg_count_by("sessions_by_room", "emplois_temps", "salle")                # R20
register("absences_totals", reports_sql.ABSENCES_TOTALS)(                  # R21-R23
    lambda c: reports.absences_totals(c.absences))
register("absences_by_month", reports_sql.ABSENCES_BY_MONTH)(              # R24
    lambda c: reports.absences_by_month(c.absences))
register("absences_top_courses", reports_sql.ABSENCES_BY_COURSE)(          # R25
    lambda c: reports.absences_by_course(c.absences, c.cours))
_reg_total("departments_total", "departements")                            # R26
register("department_breakdown", reports_sql.DEPARTMENT_BREAKDOWN)(        # R27
    lambda c: reports.department_breakdown(c.departements, c.etudiants, c.professeurs,
                                           c.cours).drop("id"))
register("accounting_summary", reports_sql.ACCOUNTING_SUMMARY)(            # R28
    lambda c: reports.accounting_summary(c.bills, c.payments, c.expenses))
register("staff_summary", reports_sql.STAFF_SUMMARY)(                      # R29
    lambda c: reports.staff_summary(c.teaching_staff, c.admin_staff))


# -- listings (L1-L24, O5) ------------------------------------------------------------
# Paged listings are registered as their first page (the page size is the
# feature) and the pagination totals over the whole filtered table.
S, Q = listing_sql, listing
PS = listing.PAGE_SIZE


def _reg_page(name, spark_fn, rows_sql, order_sql, base_sql, limit):
    register(f"{name}_page", S.page(rows_sql, order_sql, limit))(
        lambda c: spark_fn(c).rows)
    register(f"{name}_pagination", S.pagination(base_sql, limit))(
        lambda c: spark_fn(c).pagination)


_reg_page("students", lambda c: Q.list_students(c.etudiants, c.departements),       # L1
          S.STUDENTS, "e.nom NULLS FIRST, e.prenom NULLS FIRST, e.id",
          "SELECT * FROM etudiants", PS["students"])
_reg_page("students_search",                                                       # L1, F2
          lambda c: Q.list_students(c.etudiants, c.departements, search="customer#0000001",
                                    niveau="BUILDING"),
          S.STUDENTS + " WHERE (e.nom ILIKE '%customer#0000001%' OR e.prenom ILIKE "
          "'%customer#0000001%' OR e.matricule ILIKE '%customer#0000001%' OR e.email ILIKE "
          "'%customer#0000001%') AND e.niveau = 'BUILDING'",
          "e.nom NULLS FIRST, e.prenom NULLS FIRST, e.id",
          "SELECT * FROM etudiants e WHERE (e.nom ILIKE '%customer#0000001%' OR e.prenom ILIKE "
          "'%customer#0000001%' OR e.matricule ILIKE '%customer#0000001%' OR e.email ILIKE "
          "'%customer#0000001%') AND e.niveau = 'BUILDING'", PS["students"])
_reg_page("professors", lambda c: Q.list_professors(c.professeurs, c.departements),  # L2
          S.PROFESSORS, "p.nom NULLS FIRST, p.prenom NULLS FIRST, p.id",
          "SELECT * FROM professeurs", PS["professors"])
_reg_page("courses", lambda c: Q.list_courses(c.cours, c.departements, c.professeurs),  # L3
          S.COURSES, "c.nom NULLS FIRST, c.id", "SELECT * FROM cours", PS["courses"])
_reg_page("grades", lambda c: Q.list_grades(c.notes, c.etudiants, c.cours),           # L4
          S.GRADES, "n.date_evaluation DESC NULLS LAST, n.id", "SELECT * FROM notes",
          PS["grades"])
_reg_page("grades_by_type",                                                          # L4, F4
          lambda c: Q.list_grades(c.notes, c.etudiants, c.cours, type_evaluation="A"),
          S.GRADES + " WHERE n.type_evaluation = 'A'",
          "n.date_evaluation DESC NULLS LAST, n.id",
          "SELECT * FROM notes WHERE type_evaluation = 'A'", PS["grades"])
_reg_page("timetable", lambda c: Q.list_timetable(c.emplois_temps, c.cours, c.professeurs),  # L5
          S.TIMETABLE, "et.jour NULLS FIRST, et.heure_debut NULLS FIRST, et.id",
          "SELECT * FROM emplois_temps", PS["timetable"])
_reg_page("timetable_room_day",                                                      # L5, F3
          lambda c: Q.list_timetable(c.emplois_temps, c.cours, c.professeurs, jour="Lundi",
                                     salle="s1"),
          S.TIMETABLE + " WHERE et.jour = 'Lundi' AND et.salle ILIKE '%s1%'",
          "et.jour NULLS FIRST, et.heure_debut NULLS FIRST, et.id",
          "SELECT * FROM emplois_temps WHERE jour = 'Lundi' AND salle ILIKE '%s1%'",
          PS["timetable"])
_reg_page("absences", lambda c: Q.list_absences(c.absences, c.etudiants, c.cours),      # L6
          S.ABSENCES, "a.date_absence DESC NULLS LAST, a.id", "SELECT * FROM absences",
          PS["absences"])
_reg_page("absences_window",                                                         # L6, F5, F6
          lambda c: Q.list_absences(c.absences, c.etudiants, c.cours, date_debut="1994-01-01",
                                    date_fin="1995-06-30", justifiee="true"),
          S.ABSENCES + " WHERE a.date_absence >= DATE '1994-01-01' AND a.date_absence <= "
          "DATE '1995-06-30' AND a.justifiee = TRUE",
          "a.date_absence DESC NULLS LAST, a.id",
          "SELECT * FROM absences WHERE date_absence >= DATE '1994-01-01' AND date_absence <= "
          "DATE '1995-06-30' AND justifiee = TRUE", PS["absences"])
_reg_page("departments",                                                             # L8
          lambda c: Q.list_departments(c.departements, c.etudiants, c.professeurs, c.cours),
          S.DEPARTMENTS.format(where=""), "d.nom NULLS FIRST, d.id",
          "SELECT * FROM departements", PS["departments"])
_reg_page("departments_search",                                                      # L8, F2
          lambda c: Q.list_departments(c.departements, c.etudiants, c.professeurs, c.cours,
                                       search="me"),
          S.DEPARTMENTS.format(where="WHERE (d.nom ILIKE '%me%' OR d.description ILIKE '%me%')"),
          "d.nom NULLS FIRST, d.id",
          "SELECT * FROM departements WHERE nom ILIKE '%me%' OR description ILIKE '%me%'",
          PS["departments"])

register("student_courses", S.STUDENT_COURSES)(                                     # L12
    lambda c: Q.student_courses(c.cours, c.inscriptions, c.professeurs))
register("student_grades", S.STUDENT_GRADES)(                                       # L13
    lambda c: Q.student_grades(c.notes, c.cours))
register("professor_courses", S.PROFESSOR_COURSES)(                                 # L14
    lambda c: Q.professor_courses(c.cours.filter("professeur_id IS NOT NULL"), c.departements))
register("course_roster", S.COURSE_ROSTER)(                                         # L15
    lambda c: Q.course_roster(c.etudiants, c.inscriptions))
register("timetable_by_day", S.TIMETABLE)(                                          # L16
    lambda c: Q.timetable_of_day(c.emplois_temps, c.cours, c.professeurs))
register("timetable_by_course", S.TIMETABLE)(                                       # L17
    lambda c: Q.timetable_of_course(c.emplois_temps, c.cours, c.professeurs))
register("bills_listing", S.BILLS)(                                                 # L18
    lambda c: Q.bills_listing(c.bills, c.etudiants))
register("payments_listing", S.PAYMENTS)(                                           # L19
    lambda c: Q.payments_listing(c.payments, c.etudiants, c.bills))
register("expenses_listing", S.EXPENSES)(                                           # L20
    lambda c: Q.expenses_listing(c.expenses, c.departements))
register("teaching_staff_listing", S.TEACHING_STAFF)(                               # L21
    lambda c: Q.staff_listing(c.teaching_staff, c.departements))
register("admin_staff_listing", S.ADMIN_STAFF)(                                     # L22
    lambda c: Q.staff_listing(c.admin_staff, c.departements))
register("departments_listing", S.DEPARTMENTS_PLAIN)(                               # L23
    lambda c: Q.departments_plain(c.departements))
register("scholarship_requests", S.SCHOLARSHIPS)(                                   # L24
    lambda c: Q.scholarship_requests(c.demandes_bourse))


# -- timetable conflicts (J9, F11, C1) and booking (W13) ---------------------------------
register("session_conflicts", checks_sql.SESSION_CONFLICTS)(                        # C1
    lambda c: schedule.session_conflicts(c.emplois_temps, courses=c.cours))


def _exam_candidates(c):
    return (c.emplois_temps.filter(F.col("type_seance") == "examen")
            .select(F.col("id").alias("cand_id"), F.col("id").alias("emploi_id"),
                    *schedule.CLASS))


register("exam_conflicts", checks_sql.EXAM_CONFLICTS)(                              # C1, J9
    lambda c: schedule.conflicts(_exam_candidates(c), c.emplois_temps, c.cours))


def _book_exams(c):
    sessions = c.emplois_temps
    batch = sessions.filter(F.col("type_seance") == "examen").withColumn("seq", F.col("id"))
    base = sessions.filter(F.col("type_seance") != "examen")
    return schedule.book_sessions(base, batch, c.cours).select(
        "seq", "cours_id", *schedule.CLASS, "accepted", "reason")


register("book_exam_sessions", checks_sql.BOOK_EXAM_SESSIONS)(_book_exams)                                         # W13


# -- validation (V1-V11) -----------------------------------------------------------------
def _errors(df, rules):
    return quality.validate(df, quality.RULES[rules]).select(
        "id", F.array_join("errors", ",").alias("errors"))


register("grade_validation", checks_sql.GRADE_VALIDATION)(                          # V5
    lambda c: _errors(c.notes, "grade"))
register("timetable_validation", checks_sql.TIMETABLE_VALIDATION)(                  # V6
    lambda c: _errors(c.emplois_temps, "timetable"))
register("student_validation", checks_sql.STUDENT_VALIDATION)(                      # V1
    lambda c: _errors(c.etudiants, "student"))
register("course_validation", checks_sql.COURSE_VALIDATION)(                        # V3
    lambda c: _errors(c.cours, "course"))
register("absence_validation", checks_sql.ABSENCE_VALIDATION)(                      # V7
    lambda c: _errors(c.absences, "absence"))
register("scholarship_validation", checks_sql.SCHOLARSHIP_VALIDATION)(              # V10
    lambda c: _errors(c.demandes_bourse, "scholarship"))


# -- checked appends (W1, W2, W8) ----------------------------------------------------------
def _grade_append_check(c):
    v = quality.validate(c.notes, quality.RULES["grade"])
    prior = F.when(F.size("errors") > 0, F.lit("invalide"))
    out = quality.check_parents(v, [
        quality.ParentCheck("etudiant_introuvable", c.etudiants, ("etudiant_id",), ("id",), unique=True),
        quality.ParentCheck("cours_introuvable", c.cours, ("cours_id",), ("id",), unique=True),
        quality.ParentCheck("non_inscrit", c.inscriptions, ("etudiant_id", "cours_id"),
                            ("etudiant_id", "cours_id"), unique=True),
    ], prior=prior)
    return out.select("id", "reason")


register("grade_append_check", checks_sql.GRADE_APPEND_CHECK)(_grade_append_check)  # W1, W2


def _enrol_check(c):
    batch = (c.notes.groupBy("etudiant_id", "cours_id").agg(F.min("id").alias("seq")))
    return changes.enrol_check(c.inscriptions, batch, c.etudiants, c.cours,
                               materialize=False).select(
        "seq", "etudiant_id", "cours_id", "reason")


register("enrol_check", checks_sql.ENROL_CHECK)(_enrol_check)                       # W8, W3


# -- orphans (W12) --------------------------------------------------------------------------
register("orphan_grades", checks_sql.orphans("notes", "cours_id", "cours"))(
    lambda c: quality.orphans(c.notes, c.cours, "cours_id"))
register("orphan_absences", checks_sql.orphans("absences", "cours_id", "cours"))(
    lambda c: quality.orphans(c.absences, c.cours, "cours_id"))
register("orphan_sessions", checks_sql.orphans("emplois_temps", "cours_id", "cours"))(
    lambda c: quality.orphans(c.emplois_temps, c.cours, "cours_id"))
register("orphan_payments", checks_sql.orphans("payments", "studentId", "etudiants"))(
    lambda c: quality.orphans(c.payments, c.etudiants, "studentId"))


# -- bulk per-entity pages, details (L7, L9, D1-D8, A17) ---------------------------------
register("student_absences_first_pages", S.STUDENT_ABSENCES_FIRST_PAGES)(           # L7
    lambda c: Q.student_absences_first_pages(c.absences, c.cours))
register("department_students_first_pages", S.DEPARTMENT_STUDENTS_FIRST_PAGES)(     # L9
    lambda c: Q.department_children_first_pages(c.etudiants, c.departements))
register("billed_students_detail", S.BILLED_STUDENTS_DETAIL)(                       # D1, F7
    lambda c: Q.lookup(Q.students_rows(c.etudiants, c.departements), c.bills,
                       "id", "studentId"))
register("expense_departments_detail", S.EXPENSE_DEPARTMENTS_DETAIL)(               # D7
    lambda c: Q.lookup(Q.departments_rows(c.departements, c.etudiants, c.professeurs,
                                          c.cours), c.expenses, "id", "departmentId"))
register("expense_departments_missing", S.EXPENSE_DEPARTMENTS_MISSING)(             # D7 404s
    lambda c: Q.missing_keys(c.departements, c.expenses.filter("departmentId IS NOT NULL"),
                             "id", "departmentId"))
register("student_scholarships_detail", S.STUDENT_SCHOLARSHIPS_DETAIL)(             # D8
    lambda c: Q.lookup(c.demandes_bourse, c.etudiants, "id", "id"))
register("course_grades", S.COURSE_GRADES)(                                         # A17
    lambda c: grades.course_grades(c.notes))
register("enrolled_course_average", checks_sql.ENROLLED_COURSE_AVERAGE)(            # G1 pairs
    lambda c: grades.course_average(c.notes, c.inscriptions))


# -- change sets over table-derived batches (W5, W6, W7, W9) -----------------------------------
def _dept_delete(c):
    keys = c.departements.select("id")
    return changes.guarded_delete(c.departements, keys, {
        "etudiants": (c.etudiants, "departement_id"),
        "professeurs": (c.professeurs, "departement_id"),
        "cours": (c.cours, "departement_id")})


register("department_delete_blocked", checks_sql.DEPARTMENT_DELETE_BLOCKED)(         # W6
    lambda c: _dept_delete(c).rejected)
register("department_delete_remaining", checks_sql.DEPARTMENT_DELETE_REMAINING)(     # W6
    lambda c: _dept_delete(c).table)
register("grades_without_orphans", checks_sql.GRADES_WITHOUT_ORPHANS)(               # W7, W12
    lambda c: changes.delete(c.notes, quality.orphans(c.notes, c.cours, "cours_id")).table)


def _bills_after_payments(c):
    batch = c.payments.select(F.col("id").alias("seq"), "billId", "studentId", "amount",
                              "method", "reference")
    _, bills = changes.post_payments(c.bills, c.payments, batch, "2024-01-01 00:00:00")
    return bills.select("id", "status")


register("bills_after_payments", checks_sql.BILLS_AFTER_PAYMENTS)(_bills_after_payments)  # W9


def _justify(c):
    ch = (c.absences.filter(F.col("motif").isNotNull())
          .select(F.col("id").alias("seq"), "id", F.lit("true").alias("justifiee"), "motif",
                  F.lit(True).alias("motif_given")))
    return changes.justify_absences(c.absences, ch).table.select("id", "justifiee", "motif")


register("absences_justified_with_motif", checks_sql.ABSENCES_JUSTIFIED_WITH_MOTIF)(_justify)  # W5


register("professor_validation", checks_sql.PROFESSOR_VALIDATION)(                  # V2
    lambda c: _errors(c.professeurs, "professor"))
register("department_validation", checks_sql.DEPARTMENT_VALIDATION)(                # V9
    lambda c: _errors(c.departements, "department"))
register("scholarship_status_validation", checks_sql.SCHOLARSHIP_STATUS_VALIDATION)(  # V11
    lambda c: _errors(c.demandes_bourse, "scholarship_status"))


def _absence_append_check(c):
    """W1 for absences: unjustified absences as the incoming batch (arrival
    order = id) against the justified ones as the stored table."""
    a = c.absences
    batch = a.filter(~F.col("justifiee")).withColumn("seq", F.col("id")).drop("id")
    base = a.filter(F.col("justifiee"))
    cs = changes.add_absences(base, batch, c.etudiants, c.cours, c.inscriptions,
                              as_of="2024-01-01 00:00:00", materialize=False)
    return cs.report.select("seq", "reason")


register("absence_append_check", checks_sql.ABSENCE_APPEND_CHECK)(_absence_append_check)  # W1-W3


def _scholarship_submission(c):
    """Every stored request submitted again as a batch (V10 rules, then
    insert with 'En attente'); the report lists each row's verdict."""
    batch = c.demandes_bourse.withColumn("seq", F.col("id")).drop("id", "statut",
                                                                   "dateSoumission")
    cs = changes.submit_scholarships(c.demandes_bourse, batch, as_of="2024-01-01 00:00:00")
    return cs.report.select("seq", "reason")


register("scholarship_submission_check", checks_sql.SCHOLARSHIP_SUBMISSION_CHECK)(  # W11
    _scholarship_submission)


def _session_resave(c):
    """W4 for the timetable: every stored session re-saved unchanged as an
    update - rejected only where another stored session conflicts."""
    ch = c.emplois_temps.withColumn("seq", F.col("id"))
    return schedule.update_sessions(c.emplois_temps, ch).report.select("seq", "reason")


register("session_resave_check", checks_sql.SESSION_RESAVE_CHECK)(_session_resave)  # W4
register("department_professors_first_pages", S.DEPARTMENT_PROFESSORS_FIRST_PAGES)(  # L10
    lambda c: Q.department_professors_first_pages(c.professeurs, c.departements))
register("department_courses_first_pages", S.DEPARTMENT_COURSES_FIRST_PAGES)(        # L11
    lambda c: Q.department_courses_first_pages(c.cours, c.departements, c.professeurs))


# -- later pages (O5) -------------------------------------------------------------------
register("grades_page_3", S.page(S.GRADES, "n.date_evaluation DESC NULLS LAST, n.id",     # L4
                                 PS["grades"], 3))(
    lambda c: Q.list_grades(c.notes, c.etudiants, c.cours, page=3).rows)
register("students_page_7", S.page(S.STUDENTS, "e.nom NULLS FIRST, e.prenom NULLS FIRST, e.id",  # L1
                                   PS["students"], 7))(
    lambda c: Q.list_students(c.etudiants, c.departements, page=7).rows)
register("professors_filtered_page", S.page(                                               # L2, F2, F4
    S.PROFESSORS + " WHERE (p.nom ILIKE '%er#%' OR p.prenom ILIKE '%er#%' OR p.matricule ILIKE "
    "'%er#%' OR p.email ILIKE '%er#%') AND p.grade = 'Maitre'",
    "p.nom NULLS FIRST, p.prenom NULLS FIRST, p.id", PS["professors"]))(
    lambda c: Q.list_professors(c.professeurs, c.departements, search="er#",
                                grade="Maitre").rows)

# -- bulk details by key sets that miss (D2-D6) --------------------------------------------
register("professors_of_courses_detail", S.PROFESSORS_OF_COURSES_DETAIL)(                  # D2
    lambda c: Q.lookup(Q.students_rows(c.professeurs, c.departements),
                       c.cours.filter("credits = 3"), "id", "professeur_id"))
register("courses_missed_detail", S.COURSES_MISSED_DETAIL)(                                # D3
    lambda c: Q.lookup(Q.courses_rows(c.cours, c.departements, c.professeurs),
                       c.absences.filter("motif IS NULL AND justifiee"), "id", "cours_id"))
register("grades_of_absent_detail", S.GRADES_OF_ABSENT_DETAIL)(                            # D4
    lambda c: Q.lookup(Q.grades_rows(c.notes, c.etudiants, c.cours), c.absences, "id", "id"))
register("paid_sessions_detail", S.PAID_SESSIONS_DETAIL)(                                  # D5
    lambda c: Q.lookup(Q.timetable_rows(c.emplois_temps, c.cours, c.professeurs),
                       c.bills.filter("status = 'paid'"), "id", "id"))
register("absences_of_good_grades_detail", S.ABSENCES_OF_GOOD_GRADES_DETAIL)(              # D6
    lambda c: Q.lookup(Q.absences_rows(c.absences, c.etudiants, c.cours),
                       c.notes.filter("note >= 15"), "id", "id"))

# -- written tables (W1, W4, W9, W10) --------------------------------------------------------
_AS_OF = "2024-01-01 00:00:00"


def _issued_bills(c):
    """A bill for every student; every seventh has no amount (NOT NULL)."""
    batch = c.etudiants.select(
        F.col("id").alias("seq"), F.col("id").alias("studentId"), F.lit("frais").alias("description"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("amount"))
    return changes.issue("bill", c.bills, batch, _AS_OF).table.select(
        "id", "invoiceNumber", "studentId", "amount", "description", "issueDate", "status")


register("bills_issued_table", checks_sql.BILLS_ISSUED_TABLE)(_issued_bills)               # W10


def _issued_staff(c):
    """Administrative records for professors; every third shares the e-mail
    of the one before it, every tenth has none."""
    k = F.col("id")
    batch = c.professeurs.select(
        k.alias("seq"), F.col("prenom").alias("firstName"), F.col("nom").alias("lastName"),
        F.when(k % 10 != 0, F.concat(F.lit("a"), F.when(k % 3 == 2, k - 1).otherwise(k).cast("string"),
                                     F.lit("@campus.fr"))).alias("email"))
    return changes.issue("admin_staff", c.admin_staff, batch, _AS_OF).report.select(
        "id", "employeeId", "email", "status", "reason")


register("admin_staff_issue_report", checks_sql.ADMIN_STAFF_ISSUE_REPORT)(_issued_staff)   # W10


def _posted(c):
    """A payment for every pending bill; those of orders 0, 9, 18 ... lack an
    amount and are refused, so their bills stay pending."""
    batch = c.bills.filter("status = 'pending'").select(
        F.col("id").alias("seq"), F.col("id").alias("billId"), "studentId",
        F.when(F.col("id") % 9 != 0, F.col("amount")).alias("amount"), F.lit("cash").alias("method"),
        F.lit(None).cast("string").alias("reference"))
    return changes.post_payments(c.bills, c.payments, batch, _AS_OF)


register("payments_posted_table", checks_sql.PAYMENTS_POSTED_TABLE)(                       # W9
    lambda c: _posted(c)[0].table.select("id", "paymentNumber", "billId", "amount", "method",
                                         "date", "status"))
register("bills_after_posting", checks_sql.BILLS_AFTER_POSTING)(                           # W9
    lambda c: _posted(c)[1].select("id", "status"))

_STUDENT_COLS = ["matricule", "nom", "prenom", "email", "departement_id", "niveau", "annee_etude"]


def _student_changes(c):
    """Every student gets a new e-mail: ids 10, 20, ... one that another
    student holds; ids 1 and 26, 51 and 76, ... the same one; the others one
    of their own.  Ids 15, 30, ... are changed twice."""
    e, k = c.etudiants, F.col("id")
    email = (F.when(k % 10 == 0, F.concat(F.lit("e"), (k + 1).cast("string"), F.lit("@campus.fr")))
             .when(k % 25 == 1, F.concat(F.lit("same"), F.expr("id DIV 50").cast("string"), F.lit("@campus.fr")))
             .otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@campus.fr"))))
    times = F.explode(F.when(k % 15 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    again = F.col("_time") == 1
    return e.withColumn("_time", times).select(
        F.when(again, k + 1_000_000_000_000).otherwise(k).alias("seq"), "id", "matricule", "nom", "prenom",
        F.when(again & (k % 2 == 0), F.col("email")).otherwise(email).alias("email"), "departement_id",
        F.when(again, F.lit("L9")).otherwise(F.col("niveau")).alias("niveau"), "annee_etude")


register("students_after_update", checks_sql.STUDENTS_AFTER_UPDATE)(                       # W4
    lambda c: changes.full_update(c.etudiants, _student_changes(c), _STUDENT_COLS, "etudiants",
                                  rules="student").table.select("id", "email", "niveau"))


def _students_appended(c):
    """Professors entered as students: every fourth with a number that is
    taken, the others in pairs that share a number, every ninth e-mail
    shared with the row before."""
    k = F.col("id")
    batch = c.professeurs.select(
        k.alias("seq"), "nom", "prenom", F.lit("L1").alias("niveau"), F.lit(1).alias("annee_etude"),
        F.lit(1).cast("bigint").alias("departement_id"),
        F.when(k % 4 == 0, F.concat(F.lit("ETU-"), k.cast("string")))
         .otherwise(F.concat(F.lit("M-"), (k - k % 2).cast("string"))).alias("matricule"),
        F.concat(F.lit("m"), F.when(k % 9 == 0, k - 1).otherwise(k).cast("string"),
                 F.lit("@campus.fr")).alias("email"))
    return changes.add_students(c.etudiants, batch, as_of=_AS_OF).table.select(
        "id", "matricule", "email", "niveau", "created_at")


register("students_appended_table", checks_sql.STUDENTS_APPENDED_TABLE)(_students_appended)  # W1, W3
