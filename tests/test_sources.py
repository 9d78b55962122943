"""Stored tables round-trip; queries over stored tables equal the
fixture-derived ones."""

import re
import tempfile

from quadrangle.operators import grades, reports
from quadrangle.sources import fixtures
from quadrangle.sources.schemas import SCHEMAS
from quadrangle.sources.tables import CampusTables, materialize

from .conftest import SF_SMALL


def test_materialize_and_read_back(spark, campus):
    root = tempfile.mkdtemp(prefix="quad-tables-") + "/campus"
    materialize(campus, root, ["departements", "etudiants", "professeurs", "cours", "notes"])
    t = CampusTables(spark, root)
    assert t.notes.schema == SCHEMAS["notes"]
    assert t.etudiants.count() == campus.etudiants.count()
    a = sorted(map(tuple, grades.general_average(t.notes, t.cours, t.etudiants).collect()))
    b = sorted(map(tuple, grades.general_average(campus.notes, campus.cours,
                                                 campus.etudiants).collect()))
    assert a == b
    r1 = sorted(map(tuple, reports.department_breakdown(
        t.departements, t.etudiants, t.professeurs, t.cours).collect()))
    r2 = sorted(map(tuple, reports.department_breakdown(
        campus.departements, campus.etudiants, campus.professeurs, campus.cours).collect()))
    assert r1 == r2


def test_scale_settings_for_100_tb():
    from quadrangle.session import scale_settings
    s = scale_settings(100 * 1024 ** 4, total_cores=8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 819200
    assert scale_settings(10 * 1024 ** 2, total_cores=8)["spark.sql.shuffle.partitions"] == "16"


def test_bucketed_facts_join_without_shuffle(spark, campus):
    from pyspark.sql import functions as F
    root = tempfile.mkdtemp(prefix="quad-bucketed-") + "/campus"
    materialize(campus, root, ["notes", "absences", "cours"], buckets=8, database="campus_b")
    t = CampusTables(spark, root, database="campus_b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_student = t.notes.groupBy("etudiant_id").agg(F.count(F.lit(1)).alias("n_notes"))
        abs_student = t.absences.groupBy("etudiant_id").agg(F.count(F.lit(1)).alias("n_abs"))
        j = per_student.join(abs_student, "etudiant_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan          # co-partitioned: no shuffle at all
        a = sorted(map(tuple, j.collect()))
        n = campus.notes.groupBy("etudiant_id").agg(F.count(F.lit(1)).alias("n_notes"))
        b = campus.absences.groupBy("etudiant_id").agg(F.count(F.lit(1)).alias("n_abs"))
        assert a == sorted(map(tuple, n.join(b, "etudiant_id").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_every_registered_plan_runs_on_stored_tables(spark, campus):
    """S1 end to end: each registered plan over the stored tables (fixed
    schemas, read back from parquet) equals the same plan over the tables
    derived from the driver files."""
    from quadrangle import registry
    from tools.oracle_check import digest
    root = tempfile.mkdtemp(prefix="quad-stored-") + "/campus"
    materialize(campus, root)
    stored = CampusTables(spark, root)
    for name, plan in registry.campus_queries().items():
        a = plan(campus)
        b = plan(stored)
        assert a.columns == b.columns, name
        ra = [tuple(r) for r in a.collect()]
        rb = [tuple(r) for r in b.collect()]
        assert digest(a.columns, ra)[0] == digest(b.columns, rb)[0], name


def test_partitioned_table_prunes_partitions(spark, campus):
    from quadrangle.operators import listing
    root = tempfile.mkdtemp(prefix="quad-parts-") + "/campus"
    materialize(campus, root, ["absences"], partition_by={"absences": "justifiee"})
    t = CampusTables(spark, root)
    base = listing.absences_base(t.absences, justifiee="true")
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(justifiee" in plan
    assert base.count() == campus.absences.filter("justifiee").count()


def _exchanges(df) -> set[str]:
    return set(re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString()))


def test_tasks_of_the_line_join_go_by_the_lines(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    plain = fixtures.Campus(spark, SF_SMALL)
    assert not _exchanges(plain.notes)  # few lines: AQE's choice
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", lines // 20)
    spread = fixtures.Campus(spark, SF_SMALL)
    n = str(-(-lines // (lines // 20)))
    for name in ("notes", "inscriptions", "absences", "payments"):
        assert _exchanges(spread.table(name)) == {n}, name
        rows = lambda c: sorted(map(str, c.table(name).collect()))  # noqa: B023, E731
        assert rows(plain) == rows(spread), name
    monkeypatch.setattr(fixtures, "UNBUFFERED_TASKS", 10)
    monkeypatch.setattr(fixtures, "MOST_LINES_PER_TASK", lines)
    assert _exchanges(fixtures.Campus(spark, SF_SMALL).notes) == {"10"}
