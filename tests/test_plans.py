"""Plan-shape tests and properties (5.3)."""

import pytest
from pyspark.sql import functions as F

from quadrangle import registry
from quadrangle.operators import listing, reports

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def department_breakdown_literal(depts, students, profs, courses):
    """R27 by a fan-out join and distinct counts, to compare with."""
    d, e, p, c = depts.alias("d"), students.alias("e"), profs.alias("p"), courses.alias("c")
    return (d.join(e, F.col("d.id") == F.col("e.departement_id"), "left")
            .join(p, F.col("d.id") == F.col("p.departement_id"), "left")
            .join(c, F.col("d.id") == F.col("c.departement_id"), "left")
            .groupBy(F.col("d.id").alias("id"), F.col("d.nom").alias("nom"))
            .agg(F.countDistinct("e.id").alias("nb_etudiants"),
                 F.countDistinct("p.id").alias("nb_professeurs"),
                 F.countDistinct("c.id").alias("nb_cours")))


def test_department_breakdown_has_no_expand(campus):
    c = campus
    ours = reports.department_breakdown(c.departements, c.etudiants, c.professeurs, c.cours)
    literal = department_breakdown_literal(c.departements, c.etudiants,
                                                   c.professeurs, c.cours)
    assert "Expand" not in optimized(ours)
    assert "Expand" in optimized(literal)
    key = ["id", "nom", "nb_etudiants", "nb_professeurs", "nb_cours"]
    assert sorted(map(tuple, ours.select(key).collect())) == \
        sorted(map(tuple, literal.select(key).collect()))


@pytest.mark.parametrize("name", ["accounting_summary", "staff_summary"])
def test_panels_have_no_cartesian_product(spark, name):
    df = registry.queries()[name](spark, SF_SMALL)
    assert "Join Cross" not in optimized(df)
    assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)


def test_panel_scans_each_source_once(spark):
    df = registry.queries()["staff_summary"](spark, SF_SMALL)
    p = optimized(df)
    assert p.count("supplier.parquet") <= 1 or p.count("Relation") <= 2


@pytest.mark.parametrize("name", ["session_conflicts", "exam_conflicts", "book_exam_sessions"])
def test_conflicts_have_no_nested_loop(spark, name):
    p = plan(registry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    df = registry.queries()["grades_by_type_pagination"](spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)" in p


def test_column_pruning_in_general_average(spark):
    p = plan(registry.queries()["grade_general_average"](spark, SF_SMALL))
    scans = [line for line in p.splitlines() if "lineitem.parquet" in line or "ReadSchema" in line]
    text = "\n".join(scans)
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_no_python_in_sql_expressible_queries(spark):
    for name, fn in registry.queries().items():
        if name == "book_exam_sessions":
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "InPandas" not in p, name


def test_page_concatenation_is_the_whole_listing(campus):
    c = campus
    full = listing.students_rows(c.etudiants, c.departements).orderBy(
        *listing._student_order()).select("id").collect()
    n = len(full)
    pages = []
    for p in range(1, n // 40 + 2):
        pages += listing.list_students(c.etudiants, c.departements, page=p, limit=40) \
            .rows.select("id").collect()
    assert [r.id for r in pages] == [r.id for r in full]


def test_breakdown_sums_to_total(campus):
    c = campus
    by = reports.count_by(c.etudiants, "niveau").agg(F.sum("count")).first()[0]
    assert by == reports.total(c.etudiants).first()["count"]


def test_accepted_plus_rejected_is_input(spark):
    df = registry.queries()["grade_append_check"](spark, SF_SMALL)
    total = df.count()
    ok = df.filter(F.col("reason").isNull()).count()
    bad = df.filter(F.col("reason").isNotNull()).count()
    assert ok + bad == total and bad > 0 and ok > 0


def test_first_pages_limit_before_the_shuffle(spark):
    p = plan(registry.queries()["student_absences_first_pages"](spark, SF_SMALL))
    partial = p.find("row_number(), 20, Partial")
    exchange = p.rfind("Exchange hashpartitioning(etudiant_id")
    assert partial > exchange > 0   # the partial limit sits below (after, in text) the exchange


def test_keyset_page_equals_offset_page(campus):
    c = campus
    rows = listing.students_rows(c.etudiants, c.departements)
    order = listing._student_order()
    first = listing.page_of(rows, order, 1, 10).collect()
    last = first[-1]
    nxt = listing.after_key(rows, order, ["nom", "prenom", "id"],
                            (last.nom, last.prenom, last.id), 10).collect()
    assert [r.id for r in nxt] == [r.id for r in listing.page_of(rows, order, 2, 10).collect()]


def test_deep_page_equals_offset_page(spark):
    from quadrangle.operators.listing import deep_page
    rows = spark.range(0, 5000).select((F.col("id") % 97).alias("k"), F.col("id"))
    order = [F.col("k").asc(), F.col("id").asc()]
    want = [r.id for r in rows.orderBy(*order).offset(3210).limit(25).collect()]
    got = [r.id for r in deep_page(rows, order, 3210, 25, partitions=7).collect()]
    assert got == want
    assert deep_page(rows, order, 4990, 25, partitions=7).count() == 10
    assert deep_page(rows, order, 6000, 25, partitions=7).count() == 0


def test_grade_page_is_cut_before_wide_columns_are_joined(spark):
    # the page's keys are cut from narrow rows: no name of a student or a
    # course is read below the top-k
    p = plan(registry.queries()["grades_page"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    cut = p[p.rindex("TakeOrderedAndProject"):]
    assert "c_name" not in cut.split("ReadSchema: ")[1].split("\n")[0] and "p_name" not in cut


def test_page_behind_many_rows_without_parents(spark):
    n = 3000  # all but the last ten rows refer to no student
    rows = spark.range(n).selectExpr("id", "IF(id >= 2990, 1L, 99L) AS etudiant_id", "1L AS cours_id",
                                     "date_sub(DATE '2024-01-01', CAST(id AS INT)) AS date_evaluation")
    parent = spark.createDataFrame([(1,)], "id long")
    order = [F.col("date_evaluation").desc_nulls_last(), F.col("id")]
    for page, want in ((1, [2990, 2991, 2992, 2993]), (3, [2998, 2999])):
        got = listing.page_then_enrich(rows, order, ["date_evaluation"], [("etudiant_id", parent), ("cours_id", parent)],
                                       lambda b: b, page, 4)
        assert [r.id for r in got.collect()] == want


def test_keyset_page_of_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b")], "id long, nom string")
    up = [F.col("nom").asc_nulls_first(), F.col("id")]
    down = [F.col("nom").desc_nulls_last(), F.col("id")]
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(listing.after_key(rows, up, ["nom", "id"], (None, 1), 2)) == [2, 3]
    assert ids(listing.after_key(rows, up, ["nom", "id"], ("a", 3), 9)) == [4]
    assert ids(listing.after_key(rows, down, ["nom", "id"], ("b", 4), 9, ("nom",))) == [3, 1, 2]
    assert ids(listing.after_key(rows, down, ["nom", "id"], (None, 1), 9, ("nom",))) == [2]
