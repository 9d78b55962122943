"""Stored layouts beside the plain way: key filters, ranked listings, search
pieces, sketches, kept reports, deletes over all levels."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quadrangle.operators import changes, listing, reports, search_index, sketches, upkeep
from quadrangle.sources.key_filters import BLOCK, KeyFilteredTable


def fresh(name):
    return f"{tempfile.mkdtemp(prefix='quad-store-')}/{name}"


def test_insert_ignore_reads_few_files_and_equals_the_plain_anti_join(spark):
    t = KeyFilteredTable(spark, fresh("t"), ["k"])
    base = spark.range(8000).selectExpr("concat('k', lpad(id, 6, '0')) AS k", "id AS v")
    t.append(base.repartitionByRange(16, "k"))
    files = len(t.read().inputFiles())
    batch = spark.createDataFrame([(1, "k000010", -1), (2, "k000011", -2), (3, "new", -3), (5, "new", -5), (4, "new2", -4), (6, None, -6), (7, None, -7)],
                                  "seq long, k string, v long")
    got = t.insert_ignore(batch, "seq")
    assert (got.rows, got.files) == (4, files) and files >= 8 and got.files_read <= 3
    want = {(r.k, r.v) for r in base.collect()} | {("new", -3), ("new2", -4), (None, -6), (None, -7)}
    assert {(r.k, r.v) for r in t.read().collect()} == want
    again = t.insert_ignore(batch.filter("k IS NOT NULL"), "seq")  # the filters of the new files are there
    assert again.rows == 0 and {(r.k, r.v) for r in t.read().collect()} == want


def test_a_full_filter_and_a_file_without_one_let_everything_through(spark):
    t = KeyFilteredTable(spark, fresh("t"), ["a", "b"], bits=BLOCK)
    t.append(spark.range(200_000).selectExpr("id AS a", "id AS b").coalesce(1))  # 32,768 bits, all set
    assert t.candidates(spark.createDataFrame([(-5, -5)], "a long, b long")).count() == 1
    spark.createDataFrame([(-7, -7)], "a long, b long").coalesce(1).write.mode("append").parquet(f"{t.path}/data/other")
    assert t.insert_ignore(spark.createDataFrame([(1, -7, -7), (2, -8, -8), (3, 5, 5)], "seq long, a long, b long"), "seq").rows == 1


def test_insert_into_a_table_that_is_not_there(spark):
    t = KeyFilteredTable(spark, fresh("t"), ["k"])
    assert t.insert_ignore(spark.createDataFrame([(1, "x"), (2, "x")], "seq long, k string"), "seq").rows == 1


@pytest.mark.parametrize("page", [1, 2, 26, 27, 40])
def test_ranked_page_reads_one_range(spark, page):
    path = fresh("listing")
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", None])) for i in range(523)]
    order = [F.col("v").asc_nulls_first(), F.col("id")]
    listing.store_ranked(spark.createDataFrame(rows, "id long, v string"), order, path, partitions=9)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))[(page - 1) * 20:page * 20]
    got = listing.ranked_page(spark, path, page, 20)
    assert [tuple(x) for x in got.collect()] == want
    if want:
        assert got.select(F.input_file_name()).distinct().count() <= 2


def test_places_are_global(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(300)], "a long, id long")
    got = {r.id: r.place for r in listing.with_place(df, [F.desc("a"), F.col("id")]).collect()}
    want = sorted(((-(i % 7), i) for i in range(300)))
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}


@pytest.mark.parametrize("term", ["Dup", "ont", "O%T", "x", "", "é_e", "a%b", "zzz", "l\\", "50%", "ÉTÉ", "ab", "%abc%def%"])
def test_indexed_search_equals_the_scan(spark, term):
    rows = [(1, "Dupont", "été 50% l\\x"), (2, "DURAND", None), (3, "abxxcdef", "O-T abc def"), (4, "", "ab"), (5, "a%b", "Éte"), (6, "İstanbul", "x")]
    df = spark.createDataFrame(rows, "id long, nom string, d string")
    cols = ["nom", "d"]
    index = search_index.pieces_index(df, cols)
    got = {r.id for r in search_index.indexed_search(df, index, term, cols).collect()}
    assert got == {r.id for r in df.filter(listing.search_cond(term, cols)).collect()}


def test_sketches_add_up_within_two_percent(spark, campus):
    from quadrangle.sources.fixtures import Campus

    c = Campus(spark, "/root/testdata/sf0.1")
    days = sketches.distinct_sketches(c.bills, [F.col("issueDate")], "studentId")
    for lo, hi in (("1993-01-01", "1993-12-31"), ("1992-01-01", "1998-12-31"), ("1995-03-01", "1995-03-31")):
        span = F.col("issueDate").between(lo, hi)
        got = sketches.estimate(sketches.merge_sketches(days.filter(span))).first().nb
        exact = c.bills.filter(span).agg(F.count_distinct("studentId")).first()[0]
        assert abs(got - exact) <= 0.02 * exact


def test_kept_reports_equal_the_full_ones(spark):
    r = random.Random(5)
    row = lambda i: (i, r.choice(["A", "B", None]), r.choice([0.5, 12.25, 19.0, None]), r.randrange(40))
    rows = [row(i) for i in range(400)]
    frame = lambda x: spark.createDataFrame(x, "id long, type_evaluation string, note double, cours_id long")
    gone, new = rows[:150], [row(1000 + i) for i in range(60)]
    after = frame([x for x in rows if x not in gone] + new)
    kept = upkeep.GRADES_BY_TYPE
    state = kept.apply(kept.state(frame(rows)), added=frame(new), removed=frame(gone))
    assert sorted(map(str, kept.counts_and_means(state).collect())) == sorted(map(str, reports.grades_by_type(after).collect()))
    total = upkeep.Kept(value="note")
    state = total.apply(total.state(frame(rows)), added=frame(new), removed=frame(gone))
    assert tuple(total.counts_and_means(state).first()) == tuple(reports.grades_totals(after).first())
    empty = total.apply(total.state(frame(rows)), removed=frame(rows))
    assert tuple(total.counts_and_means(empty).first()) == (0, 0.0)
    courses = spark.createDataFrame([(i, f"c{i}") for i in range(35)], "id long, nom string")
    by = upkeep.ABSENCES_BY_COURSE
    state = by.apply(by.state(frame(rows)), added=frame(new), removed=frame(gone))
    assert upkeep.top_courses(state, courses).collect() == reports.absences_by_course(after, courses).collect()


def test_a_group_that_goes_to_zero_is_gone(spark):
    rows = spark.createDataFrame([(1, "L1"), (2, "L2")], "id long, niveau string")
    kept = upkeep.STUDENTS_BY_LEVEL
    state = kept.apply(kept.state(rows), removed=rows.filter("niveau = 'L2'"))
    assert [tuple(x) for x in kept.counts(state).collect()] == [("L1", 1)]


def test_deep_delete_counts_all_levels_once(spark):
    t = {"departements": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
         "etudiants": spark.createDataFrame([(10, 1), (11, 1), (12, None)], "id long, departement_id long"),
         "professeurs": spark.createDataFrame([(5, 1)], "id long, departement_id long"),
         "cours": spark.createDataFrame([(7, 1, 5), (8, 2, 5)], "id long, departement_id long, professeur_id long"),
         "inscriptions": spark.createDataFrame([(10, 7), (12, 8)], "etudiant_id long, cours_id long"),
         "bills": spark.createDataFrame([(20, 10)], "id long, studentId long"),
         "payments": spark.createDataFrame([(30, 20, 10), (31, 20, 11), (32, None, 12)], "id long, billId long, studentId long")}
    keys = spark.createDataFrame([(1,), (2,), (3,), (9,), (1,)], "id long")
    cs = changes.guarded_delete_deep(t, "departements", keys)
    got = {r.id: r.asDict() for r in cs.report.collect()}
    # course 8 is below department 1 by its professor, enrolment (12, 8) by that course
    assert got[1] == {"id": 1, "etudiants": 2, "professeurs": 1, "cours": 2, "inscriptions": 2, "bills": 1, "payments": 2, "reason": "enfants"}
    assert got[2] == {"id": 2, "etudiants": 0, "professeurs": 0, "cours": 1, "inscriptions": 1, "bills": 0, "payments": 0, "reason": "enfants"}
    assert got[3]["reason"] is None and got[9]["reason"] == "introuvable" and got[9]["cours"] is None
    assert sorted(r.id for r in cs.table.collect()) == [1, 2]
