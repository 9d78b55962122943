"""Reports kept up to date by signed changes (R1-R25 after W1-W9).

A report's state is one row for each group with its count and, where the
report has a mean, the exact sum of its values.  What a change set put in
counts plus, what it took out counts minus; the new state is the sum of both,
so the changed table isn't read.  An update is its old rows taken out and its
new ones put in.  The top courses of R25 need the counts of all courses, and
those are the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import grade_band, month_of, round2

_EXACT = "decimal(38,6)"


@dataclass(frozen=True)
class Kept:
    """A report by ``by`` (column names, or functions that make an
    expression), with the sum of ``value`` if it shows a mean."""
    by: dict[str, str | Callable[[], Column]] = field(default_factory=dict)
    value: str | None = None

    def state(self, rows: DataFrame) -> DataFrame:
        """Group columns, ``n`` and ``total`` of ``rows``."""
        cols = [(F.col(e) if isinstance(e, str) else e()).alias(name) for name, e in self.by.items()]
        value = F.col(self.value).cast(_EXACT) if self.value else F.lit(None).cast(_EXACT)
        return (rows.select(*cols, value.alias("_v")).groupBy(*self.by)
                .agg(F.count(F.lit(1)).alias("n"), (F.count("_v") if self.value else F.lit(0).cast("bigint")).alias("nv"), F.sum("_v").cast(_EXACT).alias("total")))

    def apply(self, state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """The state after rows were put in and taken out."""
        parts = [state]
        if added is not None:
            parts.append(self.state(added))
        if removed is not None:
            parts.append(self.state(removed).select(*self.by, *[(-F.col(c)).cast(t).alias(c) for c, t in (("n", "bigint"), ("nv", "bigint"), ("total", _EXACT))]))
        out = reduce(DataFrame.unionByName, parts).groupBy(*self.by).agg(
            F.sum("n").alias("n"), F.sum("nv").alias("nv"), F.sum("total").cast(_EXACT).alias("total"))
        return out.filter("n > 0") if self.by else out  # a total stays, even at 0

    def counts(self, state: DataFrame) -> DataFrame:
        return state.select(*self.by, F.col("n").alias("count"))

    def counts_and_means(self, state: DataFrame) -> DataFrame:
        mean = F.when(F.col("nv") > 0, F.col("total").cast("double") / F.col("nv"))
        return state.select(*self.by, F.col("n").alias("count"), F.coalesce(round2(mean), F.lit(0.0)).alias("moyenne"))


def top_courses(state: DataFrame, courses: DataFrame, k: int = 10) -> DataFrame:
    """R25 from the state by ``cours_id``."""
    c = courses.select(F.col("id").alias("cours_id"), F.col("nom").alias("cours_nom"))
    return (state.join(c, "cours_id").orderBy(F.desc("n"), "cours_id").limit(k).select("cours_nom", F.col("n").alias("count")))


#: Reports by one column, as they are kept.
STUDENTS_BY_LEVEL = Kept({"niveau": "niveau"})
GRADES_BY_TYPE = Kept({"type_evaluation": "type_evaluation"}, "note")
GRADE_BANDS = Kept({"niveau": lambda: grade_band("note")})
ABSENCES_BY_MONTH = Kept({"mois": lambda: month_of("date_absence")})
ABSENCES_BY_COURSE = Kept({"cours_id": "cours_id"})
