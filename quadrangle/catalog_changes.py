"""Registered queries of the change sets as written tables (W1, W4-W12), of
kept reports, stored indexes and pages, and of conflicts in bulk.  Batches
come from the campus tables, every row of them; ``when`` on the id makes the
cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _AS_OF, PS, Q, S, _errors, _exam_candidates, _reg_page, _students_appended
from .functions.expr import parse_bool
from .operators import changes, quality, reports, schedule, search_index, upkeep
from .oracle import changes_sql as O
from .oracle import checks_sql, reports_sql
from .plans.materialize import fresh_path
from .registry import register
from .sources.key_filters import KeyFilteredTable


def _k():
    return F.col("id")


def _text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def _mail(*parts):
    return _text(*parts, "@campus.fr")


# -- conflicts in bulk (J9, C1) -------------------------------------------------------------
register("exam_conflict_counts", O.EXAM_CONFLICT_COUNTS)(
    lambda c: schedule.has_conflicts(_exam_candidates(c), c.emplois_temps, c.cours))
register("exam_conflict_classes", O.EXAM_CONFLICT_CLASSES)(
    lambda c: schedule.conflict_classes(_exam_candidates(c), c.emplois_temps, c.cours))


# -- full updates (W4) -------------------------------------------------------------------------
def _professors_updated(c):
    """Every professor: a quarter ask for an e-mail that another one holds, a
    quarter for one that the next of them asks for, too."""
    email = (F.when(_k() % 4 == 0, _mail("p", _k() + 1)).when(_k() % 4 == 1, _mail("pair", F.expr("id DIV 8")))
             .otherwise(_mail("prof", _k())))
    batch = c.professeurs.withColumn("email", email).withColumn("grade", F.lit("Emerite")).withColumn("seq", _k())
    cols = ["matricule", "nom", "prenom", "email", "telephone", "specialite", "grade", "departement_id"]
    return changes.full_update(c.professeurs, batch, cols, "professeurs", rules="professor").table.select("id", "email", "grade")


register("professors_after_update", O.PROFESSORS_AFTER_UPDATE)(_professors_updated)


def _courses_updated(c):
    """Every course: a third ask for another one's code, the others for one
    of pairs; every seventh has no credits.  Descriptions are left out."""
    code = F.when(_k() % 3 == 0, _text("C-", _k() + 1)).otherwise(_text("N-", _k() - _k() % 2))
    batch = (c.cours.withColumn("code", code).withColumn("credits", F.when(_k() % 7 == 0, 0).otherwise(F.col("credits") + 1))
             .withColumn("description", F.lit(None).cast("string")).withColumn("seq", _k()))
    cols = ["code", "nom", "description", "credits", "heures_cours", "heures_tp", "departement_id", "professeur_id",
            "semestre", "annee_academique"]
    return changes.full_update(c.cours, batch, cols, "cours", rules="course").table.select("id", "code", "credits", "description")


register("courses_after_update", O.COURSES_AFTER_UPDATE)(_courses_updated)


def _departments_updated(c):
    batch = (c.departements.withColumn("nom", F.when(_k() % 5 == 0, F.lit("")).otherwise(_text("Dept ", _k())))
             .withColumn("description", F.lit(None).cast("string")).withColumn("seq", _k()))
    return changes.full_update(c.departements, batch, ["nom", "description"], "departements",
                               rules="department").table.select("id", "nom", "description")


register("departments_after_update", O.DEPARTMENTS_AFTER_UPDATE)(_departments_updated)


def _grades_updated(c):
    batch = c.notes.withColumn("note", F.col("note") + 4).withColumn("type_evaluation", F.lit("R")).withColumn("seq", _k())
    cols = ["type_evaluation", "note", "coefficient", "date_evaluation", "commentaire"]
    return changes.full_update(c.notes, batch, cols, "notes", rules="grade").table.select("id", "note", "type_evaluation")


register("grades_after_update", O.GRADES_AFTER_UPDATE)(_grades_updated)


def _absences_updated(c):
    given = F.col("motif").isNotNull()
    batch = (c.absences.withColumn("date_absence", F.when(given, F.date_add("date_absence", 1)).otherwise(F.col("date_absence")))
             .withColumn("justifiee", given | F.col("justifiee")).withColumn("seq", _k()))
    return changes.full_update(c.absences, batch, ["date_absence", "motif", "justifiee"], "absences",
                               rules="absence").table.select("id", "date_absence", "justifiee", "motif")


register("absences_after_update", O.ABSENCES_AFTER_UPDATE)(_absences_updated)


def _staff_updated(c):
    batch = (c.teaching_staff.withColumn("status", F.when(F.col("departmentId").isNull(), F.lit("away")).otherwise(F.col("status")))
             .withColumn("seq", _k()))
    cols = ["firstName", "lastName", "email", "phone", "departmentId", "status"]
    return changes.full_update(c.teaching_staff, batch, cols, "teaching_staff").table.select("id", "status", "departmentId")


register("staff_after_update", O.STAFF_AFTER_UPDATE)(_staff_updated)
register("sessions_after_update", O.SESSIONS_AFTER_UPDATE)(
    lambda c: schedule.update_sessions(c.emplois_temps, c.emplois_temps.withColumn("salle", _text("S", (_k() + 1) % 500))
                                       .withColumn("seq", _k())).table.select("id", "salle"))


# -- appended tables (W1, W8, W11) ---------------------------------------------------------------
def _courses_appended(c):
    """Courses named after professors: every fifth with a code that is taken,
    the others in threes that share one; every fourth has no name."""
    batch = c.professeurs.select(
        _k().alias("seq"), F.when(_k() % 5 == 0, _text("C-", _k())).otherwise(_text("B-", F.expr("id DIV 3"))).alias("code"),
        F.when(_k() % 4 != 0, F.col("nom")).alias("nom"), F.lit(3).alias("credits"), F.lit(10).alias("heures_cours"),
        F.lit(5).alias("heures_tp"), F.lit(1).alias("departement_id"), F.lit("S1").alias("semestre"), F.lit("2024").alias("annee_academique"))
    return changes.add_courses(c.cours, batch, as_of=_AS_OF).table.select("id", "code", "nom", "credits", "created_at")


register("courses_appended_table", O.COURSES_APPENDED_TABLE)(_courses_appended)


def _departments_appended(c):
    taken = c.departements.filter("id = 3").select("nom").scalar()
    batch = c.professeurs.select(_k().alias("seq"), F.when(_k() % 6 == 0, taken).when(_k() % 7 == 0, F.lit(""))
                                 .otherwise(_text("Dept ", F.expr("id DIV 2"))).alias("nom"))
    return changes.add_departments(c.departements, batch, as_of=_AS_OF).table.select("id", "nom", "created_at")


register("departments_appended_table", O.DEPARTMENTS_APPENDED_TABLE)(_departments_appended)


def _absences_appended(c):
    batch = c.absences.filter(~F.col("justifiee")).withColumn("seq", _k()).drop("id")
    base = c.absences.filter(F.col("justifiee"))
    return changes.add_absences(base, batch, c.etudiants, c.cours, c.inscriptions, as_of=_AS_OF, materialize=True).table.select(
        "id", "etudiant_id", "cours_id", "date_absence", "motif", "justifiee", "created_at")


register("absences_appended_table", O.ABSENCES_APPENDED_TABLE)(_absences_appended)


def _enrolled(c):
    batch = c.notes.groupBy("etudiant_id", "cours_id").agg(F.min("id").alias("seq"))
    return changes.enrol(c.inscriptions, batch, c.etudiants, c.cours, as_of=_AS_OF).table.select(
        "etudiant_id", "cours_id", "date_inscription", "statut")


register("enrolments_table", O.ENROLMENTS_TABLE)(_enrolled)


def _scholarships_submitted(c):
    """A request of every student; every fourth without a telephone number,
    every ninth with an empty e-mail."""
    batch = c.etudiants.select(
        _k().alias("seq"), "nom", F.col("prenom").alias("prenoms"), F.when(_k() % 4 != 0, _text("06", _k())).alias("telephone"),
        F.when(_k() % 9 == 0, F.lit("")).otherwise(F.col("email")).alias("email"), F.lit("S").alias("serieBac"), F.lit(12.0).alias("moyenneBac"))
    return changes.submit_scholarships(c.demandes_bourse, batch, as_of=_AS_OF).table.select(
        "id", "nom", "telephone", "statut", "dateSoumission")


register("scholarships_submitted_table", O.SCHOLARSHIPS_SUBMITTED_TABLE)(_scholarships_submitted)


# -- validation with both verdicts (V9-V11) ----------------------------------------------------------
register("departments_proposed_validation", O.DEPARTMENTS_PROPOSED_VALIDATION)(
    lambda c: _errors(c.departements.withColumn("nom", F.when(_k() % 3 == 0, F.lit("")).when(_k() % 4 != 1, F.col("nom"))), "department"))
register("scholarships_proposed_validation", O.SCHOLARSHIPS_PROPOSED_VALIDATION)(
    lambda c: _errors(c.demandes_bourse.withColumn("telephone", F.when(_k() % 5 == 0, F.lit("")).otherwise(_text("06", _k())))
                      .withColumn("email", F.when(_k() % 3 != 0, _mail("e", _k())))
                      .withColumn("moyenneBac", F.when(_k() % 7 != 0, F.col("moyenneBac"))), "scholarship"))
register("scholarship_status_table", O.SCHOLARSHIP_STATUS_TABLE)(
    lambda c: changes.set_scholarship_status(c.demandes_bourse, c.demandes_bourse.select(
        "id", _k().alias("seq"), F.when(_k() % 3 == 0, F.lit("")).otherwise(F.lit("Acceptée")).alias("statut"))).table.select("id", "statut"))

# -- deletes that happen, over all levels (W6, W7, W12) -------------------------------------------------
register("professors_delete_remaining", O.PROFESSORS_DELETE_REMAINING)(
    lambda c: changes.guarded_delete(c.professeurs, c.professeurs.select("id"), {"cours": (c.cours, "professeur_id")}).table.select(
        "id", "matricule"))
register("courses_delete_report", O.COURSES_DELETE_REPORT)(
    lambda c: changes.guarded_delete(c.cours, c.cours.select("id").unionByName(c.etudiants.select("id")), {
        "notes": (c.notes, "cours_id"), "emplois_temps": (c.emplois_temps, "cours_id")}).report)
register("students_delete_report", O.STUDENTS_DELETE_REPORT)(
    lambda c: changes.guarded_delete_deep({t: c.table(t) for t in ("etudiants", "inscriptions", "notes", "absences", "bills", "payments")},
                                          "etudiants", c.etudiants.select("id")).report)
register("payments_orphaned", O.PAYMENTS_ORPHANED)(
    lambda c: quality.orphans(c.payments, changes.delete(c.etudiants, c.etudiants.filter("niveau = 'BUILDING'")).table,
                              "studentId").select("id", "studentId"))


# -- issued documents (W10) ---------------------------------------------------------------------------------
def _expenses_issued(c):
    batch = c.professeurs.select(_k().alias("seq"), F.lit("achat").alias("description"), F.when(_k() % 6 != 0, _k() * 2.5).alias("amount"),
                                 F.col("departement_id").alias("departmentId"))
    return changes.issue("expense", c.expenses, batch, _AS_OF).table.select(
        "id", "expenseNumber", "amount", "departmentId", "date", "status")


register("expenses_issued_table", O.EXPENSES_ISSUED_TABLE)(_expenses_issued)


def _teachers_issued(c):
    email = F.when(_k() % 4 != 0, _mail("a", F.when((_k() % 5 == 1) & (_k() > 1), _k() - 1).otherwise(_k())))
    batch = c.professeurs.select(_k().alias("seq"), F.col("prenom").alias("firstName"), F.col("nom").alias("lastName"), email.alias("email"))
    return changes.issue("teaching_staff", c.teaching_staff, batch, _AS_OF).report.select("id", "employeeId", "reason")


register("teaching_staff_issue_report", O.TEACHING_STAFF_ISSUE_REPORT)(_teachers_issued)

# -- order as a column (O4, R18, R20, R27) ----------------------------------------------------------------------
register("sessions_by_day_ordered", O.SESSIONS_BY_DAY_ORDERED)(
    lambda c: Q.with_place(reports.count_by(c.emplois_temps, "jour"), [F.col("jour").asc_nulls_first()]))
register("sessions_by_room_ordered", O.SESSIONS_BY_ROOM_ORDERED)(
    lambda c: Q.with_place(reports.count_by(c.emplois_temps, "salle"), [F.desc("count"), F.col("salle").asc_nulls_first()]))
register("department_breakdown_ordered", O.DEPARTMENT_BREAKDOWN_ORDERED)(
    lambda c: Q.with_place(reports.department_breakdown(c.departements, c.etudiants, c.professeurs, c.cours),
                           [F.desc("nb_etudiants"), F.col("id")]).select("place", "nom", "nb_etudiants"))


# -- stored pages and indexes (O5, F2) ----------------------------------------------------------------------------
def _deep_grades(c):
    """Page 2,501 (offset 50,000) of the stored listing of all grades."""
    path = fresh_path(c.spark, "grades-ranked")
    Q.store_ranked(Q.grades_rows(c.notes, c.etudiants, c.cours), Q._grade_order(), path)
    return Q.ranked_page(c.spark, path, 2501, PS["grades"])


register("grades_page_2501", S.page(S.GRADES, "n.date_evaluation DESC NULLS LAST, n.id", PS["grades"], 2501))(_deep_grades)


def _indexed(table, cols, term, out):
    def run(c):
        df, path = c.table(table), fresh_path(c.spark, f"{table}-pieces")
        search_index.store_index(df, cols, path)
        return search_index.indexed_search(df, c.spark.read.parquet(path), term, cols).select(*out)
    return run


register("students_search_indexed", O.STUDENTS_INDEXED)(_indexed("etudiants", Q.STUDENT_SEARCH, "r#0000001", ["id", "nom", "email"]))
register("courses_search_indexed", O.COURSES_INDEXED)(_indexed("cours", Q.COURSE_SEARCH, "wid_et", ["id", "nom"]))
register("departments_search_indexed", O.DEPARTMENTS_INDEXED)(_indexed("departements", Q.DEPARTMENT_SEARCH, "me", ["id", "nom"]))

# -- filters of the listings (F2, F4, F5, F6) --------------------------------------------------------------------------
_LIKE = "({a}.nom ILIKE '%red%' OR {a}.code ILIKE '%red%' OR {a}.description ILIKE '%red%')"
_reg_page("courses_search", lambda c: Q.list_courses(c.cours, c.departements, c.professeurs, search="red", departement_id="3"),
          S.COURSES + f" WHERE {_LIKE.format(a='c')} AND c.departement_id = 3", "c.nom NULLS FIRST, c.id",
          f"SELECT * FROM cours c WHERE {_LIKE.format(a='c')} AND departement_id = 3", PS["courses"])
_reg_page("grades_of_student", lambda c: Q.list_grades(c.notes, c.etudiants, c.cours, etudiant_id="7"),
          S.GRADES + " WHERE n.etudiant_id = 7", "n.date_evaluation DESC NULLS LAST, n.id",
          "SELECT * FROM notes WHERE etudiant_id = 7", PS["grades"])
_reg_page("grades_of_no_course", lambda c: Q.list_grades(c.notes, c.etudiants, c.cours, cours_id="abc"),
          S.GRADES + " WHERE n.cours_id = TRY_CAST('abc' AS BIGINT)", "n.date_evaluation DESC NULLS LAST, n.id",
          "SELECT * FROM notes WHERE cours_id = TRY_CAST('abc' AS BIGINT)", PS["grades"])
_reg_page("timetable_of_one_course", lambda c: Q.list_timetable(c.emplois_temps, c.cours, c.professeurs, cours_id="5"),
          S.TIMETABLE + " WHERE et.cours_id = 5", "et.jour NULLS FIRST, et.heure_debut NULLS FIRST, et.id",
          "SELECT * FROM emplois_temps WHERE cours_id = 5", PS["timetable"])
_reg_page("absences_of_student", lambda c: Q.list_absences(c.absences, c.etudiants, c.cours, etudiant_id="7"),
          S.ABSENCES + " WHERE a.etudiant_id = 7", "a.date_absence DESC NULLS LAST, a.id",
          "SELECT * FROM absences WHERE etudiant_id = 7", PS["absences"])
_WINDOW = "a.etudiant_id = 7 AND a.date_absence >= DATE '1993-01-01' AND a.justifiee = TRUE"
_reg_page("student_absences_window", lambda c: Q.student_absences(c.absences, c.cours, 7, date_debut="1993-01-01", justifiee="true"),
          f"SELECT a.*, c.nom AS cours_nom, c.code AS cours_code FROM absences a JOIN cours c ON a.cours_id = c.id WHERE {_WINDOW}",
          "a.date_absence DESC NULLS LAST, a.id", f"SELECT * FROM absences a WHERE {_WINDOW}", PS["absences"])
_reg_page("students_of_department", lambda c: Q.list_students(c.etudiants, c.departements, departement_id="3"),
          S.STUDENTS + " WHERE e.departement_id = 3", "e.nom NULLS FIRST, e.prenom NULLS FIRST, e.id",
          "SELECT * FROM etudiants WHERE departement_id = 3", PS["students"])


# -- insert or ignore (S4), JSON (S6), flags (X9), nothing to report (X12) -------------------------------------------------
def _seeded(c):
    """Professors as seed students, half of them with a number that is there
    and the others in fours that share one, into the stored table by its key
    filters."""
    t = KeyFilteredTable(c.spark, fresh_path(c.spark, "students-filtered"), ["matricule"])
    t.append(c.etudiants.select("matricule", "nom").repartitionByRange(4, "matricule"))
    seed = c.professeurs.select(F.when(_k() % 2 == 0, _text("ETU-", _k())).otherwise(_text("SEED-", F.expr("id DIV 4"))).alias("matricule"), "nom",
                                _k().alias("seq"))
    t.insert_ignore(seed, "seq")
    return t.read()


register("students_seeded", O.STUDENTS_SEEDED)(_seeded)


def _as_json(c):
    path = fresh_path(c.spark, "students-json")
    changes.to_json(c.etudiants.select("id", "nom", "departement_id"), path)
    return c.spark.read.schema("id long, nom string, departement_id long").json(path)


register("students_as_json", O.STUDENTS_AS_JSON)(_as_json)
register("flags_parsed", O.FLAGS_PARSED)(
    lambda c: c.etudiants.withColumn("_f", F.when(_k() % 5 == 0, F.lit(" TRUE")).when(_k() % 5 == 1, F.lit("1")).when(_k() % 5 == 2, F.lit("false"))
                                     .when(_k() % 5 == 3, F.lit("0")).otherwise(F.lit("oui"))).select("id", parse_bool("_f").alias("flag")))
register("grades_totals_of_nothing", O.SUMMARY_OF_NOTHING)(lambda c: reports.grades_totals(c.notes.filter("note > 1000")))


# -- reports kept by signed changes (R3, R15, R16, R25) -----------------------------------------------------------------------
def _levels_kept(c):
    added = _students_appended(c).join(c.etudiants.select("id"), "id", "left_anti")
    kept = upkeep.STUDENTS_BY_LEVEL
    return kept.counts(kept.apply(kept.state(c.etudiants), added=added))


def _after_orphans(c, kept):
    gone = quality.orphans(c.notes, c.cours, "cours_id")
    return kept.apply(kept.state(c.notes), removed=gone)


register("students_by_level_kept", f"SELECT niveau, COUNT(*) AS count FROM ({checks_sql.STUDENTS_APPENDED_TABLE}) x GROUP BY niveau")(_levels_kept)
register("grades_by_type_kept", reports_sql.GRADES_BY_TYPE.replace("FROM notes", f"FROM ({checks_sql.GRADES_WITHOUT_ORPHANS}) x"))(
    lambda c: upkeep.GRADES_BY_TYPE.counts_and_means(_after_orphans(c, upkeep.GRADES_BY_TYPE)))
register("grade_bands_kept", reports_sql.GRADE_BANDS.replace("FROM notes", f"FROM ({checks_sql.GRADES_WITHOUT_ORPHANS}) x"))(
    lambda c: upkeep.GRADE_BANDS.counts(_after_orphans(c, upkeep.GRADE_BANDS)))


def _top_courses_kept(c):
    """The top courses after the absences without a reason were deleted."""
    kept = upkeep.ABSENCES_BY_COURSE
    gone = c.absences.filter("motif IS NULL")
    return upkeep.top_courses(kept.apply(kept.state(c.absences), removed=gone), c.cours)


register("absences_top_courses_kept", reports_sql.ABSENCES_BY_COURSE.replace(
    "FROM absences a", "FROM (SELECT * FROM absences WHERE motif IS NOT NULL) a"))(_top_courses_kept)
