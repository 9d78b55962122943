"""Grade arithmetic (A10, A11, A13, A18, G1-G3) for all students at once.

Plan shape: grades are pre-aggregated to one row per (student, course)
*before* any join (partial + final hash aggregation, so a hot student or
course is combined map-side), then joined to the course dimension, then
aggregated per student.  The join therefore sees at most one row per pair
instead of one row per grade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hundredths, nz, round2

PAIR = ["etudiant_id", "cours_id"]


def pair_sums(notes: DataFrame) -> DataFrame:
    """Per (student, course): the sums that both averages need.

    ``s_nc``/``n_nc`` and ``s_c``/``n_c`` are sum/count of note*coef and coef
    (NULLs skipped, as SQL AVG does); ``tp``/``tc`` are the loop form where a
    NULL weight counts as 0 (T4)."""
    nc = F.col("note") * F.col("coefficient")
    return notes.groupBy(*PAIR).agg(
        F.sum(nc).alias("s_nc"), F.count(nc).alias("n_nc"),
        F.sum("coefficient").alias("s_c"), F.count("coefficient").alias("n_c"),
        F.sum(F.col("note") * nz("coefficient", 0.0)).alias("tp"),
        F.sum(nz("coefficient", 0.0)).alias("tc"),
        F.count(F.lit(1)).alias("nb_notes"))


def course_average(notes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """G1 / A10: weighted mean of each (student, course) pair.

    ``moyenne = round2(sum(note*coef) / sum(coef))``, 0 when the weight sum
    is not positive (T3); ``totalCoefficients`` beside it (A18).  With
    ``pairs`` given, every requested pair is returned and a pair without
    grades gets NULLs (the single-pair answer "no grades").  The grade list
    itself is :func:`course_grades` (long form, never collected per pair)."""
    s = pair_sums(notes)
    out = s.select(
        *PAIR,
        F.when(F.col("tc") > 0, round2(F.col("tp") / F.col("tc"))).otherwise(F.lit(0.0))
         .alias("moyenne"),
        F.col("tc").alias("totalCoefficients"),
        F.col("nb_notes"))
    if pairs is not None:
        out = pairs.select(*PAIR).join(out, PAIR, "left")
    return out


def course_grades(notes: DataFrame) -> DataFrame:
    """A17 in long form: every grade with its pair keys, newest first within
    the pair (ties by id).  Kept as rows, so no pair is ever gathered into
    one array or one task."""
    return (notes.select(*PAIR, "id", "note", "coefficient", "type_evaluation",
                         "date_evaluation")
            .orderBy(*PAIR, F.col("date_evaluation").desc_nulls_last(), F.col("id")))


def course_means(notes: DataFrame, cours: DataFrame) -> DataFrame:
    """G2 / A11 level 1: per (student, course) the SQL form
    ``AVG(note*coef) / AVG(coef)``, rounded (T1); NULL ratio -> 0 (T3).
    Orphan courses drop out (inner join), as in the reference."""
    s = pair_sums(notes)
    c = cours.select(F.col("id").alias("cours_id"), F.col("nom").alias("cours_nom"),
                     F.col("code").alias("cours_code"), "credits")
    ratio = F.try_divide(F.try_divide(F.col("s_nc"), F.col("n_nc")),
                         F.try_divide(F.col("s_c"), F.col("n_c")))
    return (s.join(c, "cours_id", "inner")
            .filter(F.col("nb_notes") > 0)  # A13: HAVING COUNT(n.id) > 0
            .select("etudiant_id", "cours_id", "cours_nom", "cours_code", "credits",
                    F.coalesce(round2(ratio), F.lit(0.0)).alias("moyenne_cours")))


def general_average(notes: DataFrame, cours: DataFrame,
                    students: DataFrame | None = None) -> DataFrame:
    """G3 / A11 level 2: credit-weighted mean of the rounded course means,
    rounded again (T2).  NULL credits count 0 (T4); zero credits -> 0 (T3).

    The weighted sum is taken in exact integer hundredths so the result does
    not depend on row order.  With ``students`` given, every student is
    returned and one without grades gets NULLs."""
    m = course_means(notes, cours)
    per = m.groupBy("etudiant_id").agg(
        F.sum(hundredths("moyenne_cours") * nz("credits")).alias("_tp100"),
        F.sum(nz("credits")).alias("totalCredits"))
    out = per.select(
        "etudiant_id",
        F.when(F.col("totalCredits") > 0,
               round2(F.col("_tp100") / 100.0 / F.col("totalCredits"))).otherwise(F.lit(0.0))
         .alias("moyenneGenerale"),
        "totalCredits")
    if students is not None:
        out = students.select(F.col("id").alias("etudiant_id")).join(out, "etudiant_id", "left")
    return out
