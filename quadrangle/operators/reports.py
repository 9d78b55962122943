"""Overview reports.

Plan shapes chosen here rather than left to the literal SQL:

* counts of children per parent (R2, R6, R10, R27) aggregate the child by
  its foreign key first (map-side partial aggregation) and only then join
  the small per-parent result to the parent, instead of joining first and
  counting over the fan-out product;
* single-row panels (R21-R23, R28, R29) are one aggregation over a tagged
  union of the tables, so each table is scanned once and no cross join of
  one-row frames is needed;
* top-k (R24, R25) is ``orderBy().limit()`` -> TakeOrderedAndProject, with
  the primary key as the last sort key so ties are deterministic (T13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import grade_band, month_of, round2, weekday_rank


def _cnt(name: str = "count"):
    return F.count(F.lit(1)).alias(name)


def total(df: DataFrame) -> DataFrame:
    """A1: one-row row count."""
    return df.agg(_cnt())


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """A3: count per category; NULL is a group of its own."""
    return df.groupBy(*cols).agg(_cnt())


def children_per_parent(parent: DataFrame, child: DataFrame, fk: str,
                        out: str = "count", label: str = "nom",
                        distinct_id: bool = False) -> DataFrame:
    """Every parent with the number of its children, zeros kept.
    The child is reduced to one row per key before the join."""
    agg = F.countDistinct("id") if distinct_id else F.count("id")
    per = child.groupBy(F.col(fk).alias("_k")).agg(agg.alias("_n"))
    return (parent.select("id", label)
            .join(per, parent["id"] == per["_k"], "left")
            .select("id", label, F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias(out)))


# -- students / professors / courses (R1-R12) ---------------------------------
def students_by_department(depts: DataFrame, students: DataFrame) -> DataFrame:
    return children_per_parent(depts, students, "departement_id").select("nom", "count")


def professors_by_department(depts: DataFrame, profs: DataFrame) -> DataFrame:
    return children_per_parent(depts, profs, "departement_id").select("nom", "count")


def courses_by_department(depts: DataFrame, courses: DataFrame) -> DataFrame:
    return children_per_parent(depts, courses, "departement_id").select("nom", "count")


def students_overview(depts, students) -> dict[str, DataFrame]:
    return {"total": total(students),
            "parDepartement": students_by_department(depts, students),
            "parNiveau": count_by(students, "niveau"),
            "parAnnee": count_by(students, "annee_etude")}


def professors_overview(depts, profs) -> dict[str, DataFrame]:
    return {"total": total(profs),
            "parDepartement": professors_by_department(depts, profs),
            "parGrade": count_by(profs, "grade"),
            "parSpecialite": count_by(profs, "specialite")}


def courses_overview(depts, courses) -> dict[str, DataFrame]:
    return {"total": total(courses),
            "parDepartement": courses_by_department(depts, courses),
            "parSemestre": count_by(courses, "semestre"),
            "parAnnee": count_by(courses, "annee_academique")}


# -- grades (R13-R16) ------------------------------------------------------------
def grades_totals(notes: DataFrame) -> DataFrame:
    """R13 + R14 in one pass: count and the rounded mean (0 when empty, T22)."""
    return notes.agg(_cnt(), F.coalesce(round2(F.avg("note")), F.lit(0.0)).alias("moyenne"))


def grades_by_type(notes: DataFrame) -> DataFrame:
    """Count and rounded mean per evaluation type."""
    return notes.groupBy("type_evaluation").agg(
        _cnt(), F.coalesce(round2(F.avg("note")), F.lit(0.0)).alias("moyenne"))


def grade_bands(notes: DataFrame) -> DataFrame:
    """Count per grade band."""
    return notes.groupBy(grade_band("note").alias("niveau")).agg(_cnt())


def grades_overview(notes) -> dict[str, DataFrame]:
    return {"totals": grades_totals(notes), "parType": grades_by_type(notes),
            "repartition": grade_bands(notes)}


# -- timetable (R17-R20) -----------------------------------------------------------
def sessions_by_day(sessions: DataFrame, weekday_order: bool = False) -> DataFrame:
    """Per day, days in text order (T14); ``weekday_order=True`` sorts
    Monday to Sunday instead."""
    out = count_by(sessions, "jour")
    if weekday_order:
        return out.orderBy(weekday_rank("jour"), F.col("jour").asc_nulls_first())
    return out.orderBy(F.col("jour").asc_nulls_first())


def sessions_by_room(sessions: DataFrame) -> DataFrame:
    """Per room, largest first (room as tie-break)."""
    return count_by(sessions, "salle").orderBy(F.col("count").desc(),
                                               F.col("salle").asc_nulls_first())


def sessions_overview(sessions) -> dict[str, DataFrame]:
    return {"total": total(sessions), "parJour": sessions_by_day(sessions),
            "parType": count_by(sessions, "type_seance"),
            "parSalle": sessions_by_room(sessions)}


# -- absences (R21-R25) --------------------------------------------------------------
def absences_totals(absences: DataFrame) -> DataFrame:
    """R21-R23 in one pass: total, justified, unjustified (NULL in neither)."""
    j = F.col("justifiee")
    return absences.agg(_cnt("total"), F.count_if(j).alias("justifiees"),
                        F.count_if(~j).alias("nonJustifiees"))


def absences_by_month(absences: DataFrame, k: int = 12) -> DataFrame:
    """The k most recent months that have rows (T21); the
    NULL month (unparsable date) is a group and sorts last (T7, T12)."""
    return (absences.groupBy(month_of("date_absence").alias("mois")).agg(_cnt())
            .orderBy(F.col("mois").desc_nulls_last()).limit(k))


def absences_by_course(absences: DataFrame, courses: DataFrame, k: int = 10) -> DataFrame:
    """The k courses with most absences (course id breaks
    ties, T13).  Counted per course id before the join."""
    per = absences.groupBy("cours_id").agg(F.count("id").alias("count"))
    c = courses.select(F.col("id").alias("cours_id"), F.col("nom").alias("cours_nom"))
    return (per.join(c, "cours_id", "inner")
            .orderBy(F.col("count").desc(), F.col("cours_id").asc())
            .limit(k).select("cours_nom", "count"))


def absences_overview(absences, courses) -> dict[str, DataFrame]:
    return {"totals": absences_totals(absences), "parMois": absences_by_month(absences),
            "parCours": absences_by_course(absences, courses)}


# -- departments (R26, R27) -----------------------------------------------------------
def department_breakdown(depts: DataFrame, students: DataFrame, profs: DataFrame,
                         courses: DataFrame) -> DataFrame:
    """Distinct students, professors and courses per
    department.  Each child is counted by department once - its id is a
    primary key, so a plain count is the distinct one - then three joins of
    per-department rows.  (A three-way left join would count over the product
    of the children.)"""
    out = depts.select("id", "nom")
    for child, name in ((students, "nb_etudiants"), (profs, "nb_professeurs"),
                        (courses, "nb_cours")):
        per = (child.groupBy(F.col("departement_id").alias("_dept"))
               .agg(F.count("id").alias(name))
               .withColumnRenamed("_dept", "id"))
        out = out.join(per, "id", "left")
    return out.select("id", "nom", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
                                     for n in ("nb_etudiants", "nb_professeurs", "nb_cours")])


def departments_overview(depts, students, profs, courses) -> dict[str, DataFrame]:
    rep = department_breakdown(depts, students, profs, courses)
    return {"total": total(depts),
            "repartition": rep.orderBy(F.col("nb_etudiants").desc(), F.col("id"))}


# -- panels (R28, R29) -----------------------------------------------------------------
def _money(c) -> F.Column:
    """Money is summed as decimal(18,2) so the total is exact in any order."""
    return F.col(c).cast("decimal(18,2)")


def accounting_summary(bills: DataFrame, payments: DataFrame, expenses: DataFrame) -> DataFrame:
    """Seven figures over three tables, one aggregation over
    a tagged union (each table scanned once, no cross join).  Empty
    sums are 0 (X6, X12)."""
    u = (bills.select(F.lit("b").alias("src"), "status", _money("amount").alias("amt"))
         .unionByName(payments.select(F.lit("p").alias("src"), "status",
                                      _money("amount").alias("amt")))
         .unionByName(expenses.select(F.lit("e").alias("src"), "status",
                                      _money("amount").alias("amt"))))
    src, st = F.col("src"), F.col("status")

    def money_sum(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("amt"))),
                          F.lit(0).cast("decimal(28,2)")).cast("double")

    return u.agg(
        F.count_if(src == "b").alias("totalBills"),
        F.count_if((src == "b") & (st == "paid")).alias("paidBills"),
        money_sum((src == "b") & (st == "paid")).alias("totalPaid"),
        F.count_if(src == "p").alias("totalPayments"),
        money_sum((src == "p") & (st == "completed")).alias("totalReceived"),
        F.count_if(src == "e").alias("totalExpenses"),
        money_sum((src == "e") & (st == "approved")).alias("totalExpensesApproved"))


def staff_summary(teaching: DataFrame, admin: DataFrame) -> DataFrame:
    """Active and total heads and distinct departments of both
    staff tables.  Rows are first reduced to (table, department) counts, so
    the distinct count needs no Expand and the union carries few rows."""
    u = (teaching.select(F.lit("t").alias("src"), "departmentId", "status")
         .unionByName(admin.select(F.lit("a").alias("src"), "departmentId", "status")))
    per = u.groupBy("src", "departmentId").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("n_active"))
    src = F.col("src")

    def s(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")

    return per.agg(
        s(src == "t", "n_active").alias("activeTeachers"),
        s(src == "a", "n_active").alias("activeAdmin"),
        s(src == "t", "n").alias("totalTeachers"),
        s(src == "a", "n").alias("totalAdmin"),
        F.count_if((src == "t") & F.col("departmentId").isNotNull()).alias("teachingDepartments"),
        F.count_if((src == "a") & F.col("departmentId").isNotNull()).alias("adminDepartments"))
