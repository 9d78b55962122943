"""Filtered, paged listings.

A listing is three parts:

* ``base``  - the entity table with the optional filters applied (F1);
* ``rows``  - ``base`` joined to its dimensions and sorted;
* a page   - ``rows.orderBy(...).offset().limit()`` (TakeOrderedAndProject:
  each task keeps only offset+limit rows, no global sort), plus a one-row
  ``pagination`` frame whose ``total`` counts ``base`` *before* the joins,
  as the reference does (T8: rows dropped by an inner join still count).

Every sort ends with the primary key, so a page is deterministic (T13).
Listings marked "all" in the reference return whole, sorted frames; per-
entity listings (a student's courses, ...) are given in bulk - for every
entity at once, keyed by the entity id - with an optional id filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ascii_lower, ceil_div, like_term, param_long, weekday_rank

_ASCII_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Default page sizes (fixed values of the reference's listings).
PAGE_SIZE = {"students": 10, "professors": 10, "courses": 10, "departments": 10,
             "grades": 20, "absences": 20, "department_children": 20, "timetable": 50}


# -- filters (F1-F8) --------------------------------------------------------------
def _given(v) -> bool:
    """A filter is skipped when its value is absent or empty."""
    return v is not None and v != ""


def search_cond(term: str, cols: list[str], ascii_only: bool = False) -> Column:
    """F2/F3 (T5): OR of substring matches over ``cols``.  Default is
    ``ilike`` (Unicode case folding); ``ascii_only=True`` folds A-Z only,
    as SQLite's LIKE does.  ``%`` and ``_`` in the term stay wildcards."""
    pat = like_term(term)
    if ascii_only:
        folded = pat.translate(_ASCII_FOLD)
        conds = [ascii_lower(F.col(c)).like(folded) for c in cols]
    else:
        conds = [F.col(c).ilike(pat) for c in cols]
    return reduce(lambda a, b: a | b, conds)


def equals_cond(col: str, v, integer: bool = False) -> Column:
    """F4 (T15): equality; an integer key compared with a text parameter
    uses ``try_cast``, so a non-number matches nothing."""
    return F.col(col) == (param_long(v) if integer else F.lit(v))


def date_range_cond(col: str, lo=None, hi=None) -> Column | None:
    """inclusive range, each bound optional; a bound that is not a date
    matches nothing (``try_cast``) instead of raising."""
    conds = []
    if _given(lo):
        conds.append(F.col(col) >= F.lit(str(lo)).try_cast("date"))
    if _given(hi):
        conds.append(F.col(col) <= F.lit(str(hi)).try_cast("date"))
    return reduce(lambda a, b: a & b, conds) if conds else None


def flag_cond(col: str, v) -> Column | None:
    """F6 (T16): tri-state boolean; only ``None`` means no filter, and any
    value other than true / 'true' means false."""
    if v is None:
        return None
    want = v is True or (isinstance(v, str) and v == "true")
    return F.col(col) == F.lit(want)


def apply_filters(df: DataFrame, conds: list[Column | None]) -> DataFrame:
    """AND of the conditions that are present (``WHERE 1=1 AND ...``)."""
    conds = [c for c in conds if c is not None]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def lookup(df: DataFrame, keys: DataFrame, key: str = "id", keys_col: str | None = None
           ) -> DataFrame:
    """Rows whose key is in ``keys`` (bulk detail view) - a left
    semi join against the *distinct* keys (partial aggregation first, so a
    key requested many times neither duplicates rows nor piles up in one
    task)."""
    k = keys.select(F.col(keys_col or key).alias("_k")).distinct()
    return df.join(k, df[key] == k["_k"], "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, key: str = "id",
                 keys_col: str | None = None) -> DataFrame:
    """The requested keys that match no row ("not found")."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    return k.join(df.select(key), key, "left_anti")


# -- paging (O5) ---------------------------------------------------------------------
@dataclass
class Page:
    rows: DataFrame
    pagination: DataFrame


def _check_page(page: int, limit: int):
    if not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be an integer >= 1, got {limit!r}")
    if not isinstance(page, int) or page < 1:
        raise ValueError(f"page must be an integer >= 1, got {page!r}")


def page_of(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Rows ``(page-1)*limit .. page*limit`` of ``rows`` in ``order``: a top-k
    in which each task keeps offset+limit rows.  For pages far into a large
    listing there are :func:`deep_page` and :func:`after_key`."""
    _check_page(page, limit)
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def deep_page(rows: DataFrame, order: list[Column], offset: int, limit: int,
              partitions: int | None = None) -> DataFrame:
    """A page far into a large listing, without gathering the skipped rows:
    the rows are range-partitioned on the sort order and written once to the
    shared checkpoint folder (so the partitioning is fixed), rows are counted
    per partition (one row per partition through the driver), and only the
    partitions overlapping ``[offset, offset+limit)`` are read, numbered
    within the partition and cut.  The sort ends with the primary key, so
    range boundaries never split equal keys unevenly."""
    from pyspark.sql import Window

    from ..plans.materialize import materialize
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_pid", F.spark_partition_id()), "deep-page")
    counts = sorted((r["_pid"], r["n"]) for r in
                    ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    start, wanted = 0, []
    for pid, cnt in counts:
        lo, hi = start, start + cnt
        if hi > offset and lo < offset + limit:
            wanted.append((pid, lo))
        start = hi
    if not wanted:
        return rows.limit(0)
    base = F.create_map(*[x for pid, lo in wanted for x in (F.lit(pid), F.lit(lo))])
    w = Window.partitionBy("_pid").orderBy(*order)
    part = (ranged.filter(F.col("_pid").isin([p for p, _ in wanted]))
            .withColumn("_pos", base[F.col("_pid")] + F.row_number().over(w) - 1))
    return (part.filter((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit))
            .orderBy("_pos").drop("_pid", "_pos"))


def numbered(rows: DataFrame, order: list[Column], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their key range ``_range`` and their position ``_pos`` in
    ``order`` from 0 on, and a sample of ranks: the position that each range
    begins at and how many rows it has.  A row is numbered within its range;
    only the sample, one row for each range, is summed up in one task."""
    from pyspark.sql import Window

    from ..plans.materialize import materialize
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranks = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    ranks = materialize(ranks.withColumn("first", F.sum("n").over(Window.orderBy("_range")) - F.col("n")), "ranks")
    within = Window.partitionBy("_range").orderBy(*order)
    placed = (ranged.withColumn("_pos", F.row_number().over(within) - 1).join(ranks.select("_range", "first"), "_range")
              .withColumn("_pos", F.col("_pos") + F.col("first")).drop("first"))
    return placed, ranks


def with_place(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 1 on, as a column, so
    that the order outlives shuffles and files."""
    return numbered(rows, order)[0].withColumn(name, (F.col("_pos") + 1).cast("bigint")).drop("_pos", "_range")


def store_ranked(rows: DataFrame, order: list[Column], path: str, partitions: int | None = None) -> None:
    """Store a sorted listing with the position of each row, in key ranges,
    and its sample of ranks beside it.  :func:`ranked_page` then reads the
    ranges of a page alone, whatever its offset."""
    placed, ranks = numbered(rows, order, partitions)
    ranks.write.parquet(f"{path}/ranks")
    placed.repartition("_range").sortWithinPartitions("_range", "_pos").write.partitionBy("_range").parquet(f"{path}/rows")


def ranked_page(spark, path: str, page: int, limit: int) -> DataFrame:
    """A page of a listing stored by :func:`store_ranked`: the ranges that it
    lies in come from the sample (one or two of them), the rest of the
    listing isn't read."""
    _check_page(page, limit)
    offset = (page - 1) * limit
    ranges = [r["_range"] for r in spark.read.parquet(f"{path}/ranks")
              .filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset) & (F.col("n") > 0)).collect()]
    return (spark.read.parquet(f"{path}/rows").filter(F.col("_range").isin(ranges))
            .filter((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit)).orderBy("_pos").drop("_pos", "_range"))


def pagination(base: DataFrame, page: int, limit: int) -> DataFrame:
    """One row: page, limit, total (of the filtered base, T8), pages."""
    _check_page(page, limit)
    return base.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total",
        ceil_div("total", limit).alias("pages"))


def paginate(rows: DataFrame, base: DataFrame, order: list[Column], page: int = 1,
             limit: int = 10) -> Page:
    return Page(page_of(rows, order, page, limit), pagination(base, page, limit))


def restrict(dim: DataFrame, rows: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """``dim`` reduced to the keys ``rows`` refers to.  Whether the keys are
    sent to all tasks is left to AQE, which measures them."""
    return dim.join(rows.select(F.col(fk).alias(key)).distinct(), key, "left_semi")


def page_then_enrich(base: DataFrame, order: list[Column], sort_cols: list[str],
                     parents: list[tuple[str, DataFrame]], enrich, page: int, limit: int,
                     key: str = "id") -> DataFrame:
    """A page of ``enrich(base)`` where ``enrich`` inner-joins the ``parents``
    (by primary key) and left-joins other dimensions.

    Narrow rows (key, sort columns, foreign keys) are semi-joined to the
    parents, the page's keys are cut from what is left, and only the page's
    rows are fetched and enriched.  One path at every size, and no bound on
    how many rows without parents stand before the page."""
    narrow = base.select(*dict.fromkeys([key, *sort_cols, *[fk for fk, _ in parents]]))
    for fk, parent in parents:
        narrow = narrow.join(parent.select(F.col("id").alias(fk)), fk, "left_semi")
    ids = page_of(narrow, order, page, limit).select(key)
    return enrich(base.join(ids, key, "left_semi")).orderBy(*order)


def after_key(rows: DataFrame, order: list[Column], keys: list[str], after: tuple,
              limit: int, descending: tuple[str, ...] = ()) -> DataFrame:
    """Keyset page: the ``limit`` rows that follow ``after`` (values of the
    sort ``keys``) - each task filters then keeps ``limit`` rows, so deep
    pages cost no more than the first one.  Ascending keys sort NULLs first,
    those in ``descending`` NULLs last, as the listings do; ``after`` may
    hold NULLs."""
    cond = F.lit(False)
    for i, k in enumerate(keys):
        c, v = F.col(k), after[i]
        if k in descending:
            follows = F.lit(False) if v is None else (c < F.lit(v)) | c.isNull()
        else:
            follows = c.isNotNull() if v is None else c > F.lit(v)
        for j in range(i):
            follows = F.col(keys[j]).eqNullSafe(F.lit(after[j])) & follows
        cond = cond | F.coalesce(follows, F.lit(False))
    return rows.filter(cond).orderBy(*order).limit(limit)


# -- dimension helpers --------------------------------------------------------------------
def _dept_name(depts: DataFrame, alias: str = "departement_nom") -> DataFrame:
    return depts.select(F.col("id").alias("_d_id"), F.col("nom").alias(alias))


def _prof_name(profs: DataFrame) -> DataFrame:
    return profs.select(F.col("id").alias("_p_id"), F.col("nom").alias("professeur_nom"),
                        F.col("prenom").alias("professeur_prenom"))


def _student_name(students: DataFrame) -> DataFrame:
    return students.select(F.col("id").alias("_e_id"), F.col("nom").alias("etudiant_nom"),
                           F.col("prenom").alias("etudiant_prenom"),
                           F.col("matricule").alias("etudiant_matricule"))


def _course_name(courses: DataFrame) -> DataFrame:
    return courses.select(F.col("id").alias("_c_id"), F.col("nom").alias("cours_nom"),
                          F.col("code").alias("cours_code"))


def _join(df: DataFrame, dim: DataFrame, fk: str, dim_key: str, how: str) -> DataFrame:
    return df.join(dim, df[fk] == dim[dim_key], how).drop(dim_key)


def _asc(*cols):
    return [F.col(c).asc_nulls_first() for c in cols]


def _desc(c):
    return F.col(c).desc_nulls_last()


# -- L1 students -------------------------------------------------------------------------
STUDENT_SEARCH = ["nom", "prenom", "matricule", "email"]
PROFESSOR_SEARCH = ["nom", "prenom", "matricule", "email"]
COURSE_SEARCH = ["nom", "code", "description"]
DEPARTMENT_SEARCH = ["nom", "description"]


def students_base(students, search=None, departement_id=None, niveau=None, ascii_only=False):
    return apply_filters(students, [
        search_cond(search, STUDENT_SEARCH, ascii_only) if _given(search) else None,
        equals_cond("departement_id", departement_id, True) if _given(departement_id) else None,
        equals_cond("niveau", niveau) if _given(niveau) else None])


def students_rows(base, depts):
    """``e.*, d.nom AS departement_nom``."""
    return _join(base, _dept_name(depts), "departement_id", "_d_id", "left")


def _student_order():
    return _asc("nom", "prenom", "id")


def page_then_left_join(base: DataFrame, order: list[Column], enrich, page: int, limit: int
                        ) -> DataFrame:
    """A page of ``enrich(base)`` when ``enrich`` only left-joins unique-key
    dimensions (no row dropped or repeated, sort keys from ``base``): the
    page is cut from ``base`` and only its rows are joined."""
    return enrich(page_of(base, order, page, limit)).orderBy(*order)


def list_students(students, depts, page=1, limit=PAGE_SIZE["students"], **filters) -> Page:
    base = students_base(students, **filters)
    rows = page_then_left_join(base, _student_order(), lambda b: students_rows(b, depts),
                               page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L2 professors -------------------------------------------------------------------------
def professors_base(profs, search=None, departement_id=None, grade=None, ascii_only=False):
    return apply_filters(profs, [
        search_cond(search, PROFESSOR_SEARCH, ascii_only) if _given(search) else None,
        equals_cond("departement_id", departement_id, True) if _given(departement_id) else None,
        equals_cond("grade", grade) if _given(grade) else None])


def list_professors(profs, depts, page=1, limit=PAGE_SIZE["professors"], **filters) -> Page:
    base = professors_base(profs, **filters)
    rows = page_then_left_join(
        base, _asc("nom", "prenom", "id"),
        lambda b: _join(b, _dept_name(depts), "departement_id", "_d_id", "left"), page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L3 courses ------------------------------------------------------------------------------
def courses_base(courses, search=None, departement_id=None, professeur_id=None,
                 semestre=None, ascii_only=False):
    return apply_filters(courses, [
        search_cond(search, COURSE_SEARCH, ascii_only) if _given(search) else None,
        equals_cond("departement_id", departement_id, True) if _given(departement_id) else None,
        equals_cond("professeur_id", professeur_id, True) if _given(professeur_id) else None,
        equals_cond("semestre", semestre) if _given(semestre) else None])


def courses_rows(base, depts, profs):
    """``c.*, d.nom, p.nom, p.prenom`` (two left joins)."""
    rows = _join(base, _dept_name(depts), "departement_id", "_d_id", "left")
    return _join(rows, _prof_name(profs), "professeur_id", "_p_id", "left")


def list_courses(courses, depts, profs, page=1, limit=PAGE_SIZE["courses"], **filters) -> Page:
    base = courses_base(courses, **filters)
    rows = page_then_left_join(base, _asc("nom", "id"),
                               lambda b: courses_rows(b, depts, profs), page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L4 grades ---------------------------------------------------------------------------------
def grades_base(notes, etudiant_id=None, cours_id=None, type_evaluation=None):
    return apply_filters(notes, [
        equals_cond("etudiant_id", etudiant_id, True) if _given(etudiant_id) else None,
        equals_cond("cours_id", cours_id, True) if _given(cours_id) else None,
        equals_cond("type_evaluation", type_evaluation) if _given(type_evaluation) else None])


def grades_rows(base, students, courses):
    """Two inner joins (orphan grades are dropped from the rows)."""
    rows = _join(base, _student_name(students), "etudiant_id", "_e_id", "inner")
    return _join(rows, _course_name(courses), "cours_id", "_c_id", "inner")


def _grade_order():
    return [_desc("date_evaluation"), F.col("id").asc()]


def list_grades(notes, students, courses, page=1, limit=PAGE_SIZE["grades"], **filters) -> Page:
    base = grades_base(notes, **filters)
    rows = page_then_enrich(base, _grade_order(), ["date_evaluation"],
                            [("etudiant_id", students), ("cours_id", courses)],
                            lambda b: grades_rows(b, restrict(students, b, "etudiant_id"),
                                                  restrict(courses, b, "cours_id")),
                            page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L5, L16, L17 timetable -----------------------------------------------------------------------
def timetable_base(sessions, cours_id=None, jour=None, salle=None, ascii_only=False):
    return apply_filters(sessions, [
        equals_cond("cours_id", cours_id, True) if _given(cours_id) else None,
        equals_cond("jour", jour) if _given(jour) else None,
        search_cond(salle, ["salle"], ascii_only) if _given(salle) else None])


def timetable_rows(base, courses, profs):
    """Inner join to the course, then left join to its professor."""
    c = courses.select(F.col("id").alias("_c_id"), F.col("nom").alias("cours_nom"),
                       F.col("code").alias("cours_code"), F.col("professeur_id").alias("_c_prof"))
    rows = _join(base, c, "cours_id", "_c_id", "inner")
    return _join(rows, _prof_name(profs), "_c_prof", "_p_id", "left").drop("_c_prof")


def _timetable_order(weekday_order: bool = False):
    if weekday_order:
        return [weekday_rank("jour"), *_asc("jour", "heure_debut", "id")]
    return _asc("jour", "heure_debut", "id")


def list_timetable(sessions, courses, profs, page=1, limit=PAGE_SIZE["timetable"],
                   weekday_order=False, **filters) -> Page:
    """L5; days sort as text (T14) unless ``weekday_order``."""
    base = timetable_base(sessions, **filters)
    rows = page_then_enrich(base, _timetable_order(weekday_order), ["jour", "heure_debut"],
                            [("cours_id", courses)],
                            lambda b: timetable_rows(b, restrict(courses, b, "cours_id"), profs),
                            page, limit)
    return Page(rows, pagination(base, page, limit))


def timetable_of_day(sessions, courses, profs, jour=None) -> DataFrame:
    """Sessions of a day (all days when ``jour`` is None), by start."""
    rows = timetable_rows(timetable_base(sessions, jour=jour), courses, profs)
    return rows.orderBy(*_asc("jour", "heure_debut", "id"))


def timetable_of_course(sessions, courses, profs, cours_id=None, weekday_order=False
                        ) -> DataFrame:
    """Sessions of a course (all courses when None), by day, start."""
    rows = timetable_rows(timetable_base(sessions, cours_id=cours_id), courses, profs)
    return rows.orderBy(F.col("cours_id").asc_nulls_first(), *_timetable_order(weekday_order))


# -- L6, L7 absences ---------------------------------------------------------------------------------
def absences_base(absences, etudiant_id=None, cours_id=None, date_debut=None, date_fin=None,
                  justifiee=None):
    return apply_filters(absences, [
        equals_cond("etudiant_id", etudiant_id, True) if _given(etudiant_id) else None,
        equals_cond("cours_id", cours_id, True) if _given(cours_id) else None,
        date_range_cond("date_absence", date_debut, date_fin),
        flag_cond("justifiee", justifiee)])


def _absence_order():
    return [_desc("date_absence"), F.col("id").asc()]


def absences_rows(base, students, courses):
    rows = _join(base, _student_name(students), "etudiant_id", "_e_id", "inner")
    return _join(rows, _course_name(courses), "cours_id", "_c_id", "inner")


def list_absences(absences, students, courses, page=1, limit=PAGE_SIZE["absences"],
                  **filters) -> Page:
    base = absences_base(absences, **filters)
    rows = page_then_enrich(base, _absence_order(), ["date_absence"],
                            [("etudiant_id", students), ("cours_id", courses)],
                            lambda b: absences_rows(b, restrict(students, b, "etudiant_id"),
                                                    restrict(courses, b, "cours_id")),
                            page, limit)
    return Page(rows, pagination(base, page, limit))


def student_absences(absences, courses, etudiant_id, page=1, limit=PAGE_SIZE["absences"],
                     **filters) -> Page:
    """One student's absences with the course name."""
    base = absences_base(absences, etudiant_id=etudiant_id, **filters)
    rows = page_then_enrich(
        base, _absence_order(), ["date_absence"], [("cours_id", courses)],
        lambda b: _join(b, _course_name(restrict(courses, b, "cours_id")), "cours_id", "_c_id",
                        "inner"), page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L8 departments with headcounts ------------------------------------------------------------------
def departments_base(depts, search=None, ascii_only=False):
    return apply_filters(depts, [
        search_cond(search, DEPARTMENT_SEARCH, ascii_only) if _given(search) else None])


def departments_rows(base, students, profs, courses, of_page: bool = False):
    """``d.*`` plus three child counts (J8, pre-aggregated; the children's ids
    are primary keys, so plain counts are the distinct ones).  With
    ``of_page`` each child is first semi-joined to the page's ids, so only
    the page's children are counted."""
    out = base
    ids = base.select(F.col("id").alias("departement_id")) if of_page else None
    for child, name in ((students, "nb_etudiants"), (profs, "nb_professeurs"),
                        (courses, "nb_cours")):
        if ids is not None:
            child = child.join(ids, "departement_id", "left_semi")
        per = child.groupBy(F.col("departement_id").alias("_dept")).agg(
            F.count("id").alias(name))
        out = out.join(per, out["id"] == per["_dept"], "left").drop("_dept")
    return out.fillna(0, ["nb_etudiants", "nb_professeurs", "nb_cours"])


def list_departments(depts, students, profs, courses, page=1,
                     limit=PAGE_SIZE["departments"], **filters) -> Page:
    base = departments_base(depts, **filters)
    order = _asc("nom", "id")
    rows = page_then_left_join(
        base, order, lambda b: departments_rows(b, students, profs, courses, of_page=True),
        page, limit)
    return Page(rows, pagination(base, page, limit))


# -- L9-L11 a department's children ---------------------------------------------------------------------
def department_students(students, depts, departement_id, page=1,
                        limit=PAGE_SIZE["department_children"]) -> Page:
    base = students_base(students, departement_id=departement_id)
    rows = page_then_left_join(base, _student_order(), lambda b: students_rows(b, depts),
                               page, limit)
    return Page(rows, pagination(base, page, limit))


def department_professors(profs, depts, departement_id, page=1,
                          limit=PAGE_SIZE["department_children"]) -> Page:
    return list_professors(profs, depts, page, limit, departement_id=departement_id)


def department_courses(courses, depts, profs, departement_id, page=1,
                       limit=PAGE_SIZE["department_children"]) -> Page:
    return list_courses(courses, depts, profs, page, limit, departement_id=departement_id)


# -- L12-L15 bridges ----------------------------------------------------------------------------------------
def student_courses(courses, enrolments, profs, etudiant_id=None) -> DataFrame:
    """Each student's courses through the enrolments, with the
    professor (left) and the enrolment date and status (P4).  All students
    at once unless ``etudiant_id`` is given; sorted by student, course name."""
    i = enrolments.select(F.col("etudiant_id"), F.col("cours_id").alias("_i_c"),
                          "date_inscription", "statut")
    if _given(etudiant_id):
        i = i.filter(equals_cond("etudiant_id", etudiant_id, True))
    c = courses
    rows = c.join(i, c["id"] == i["_i_c"], "inner").drop("_i_c")
    rows = _join(rows, _prof_name(profs), "professeur_id", "_p_id", "left")
    return rows.orderBy(*_asc("etudiant_id", "nom", "id"))


def student_grades(notes, courses, etudiant_id=None) -> DataFrame:
    """Grades with course name and code, newest first."""
    base = grades_base(notes, etudiant_id=etudiant_id)
    rows = _join(base, _course_name(courses), "cours_id", "_c_id", "inner")
    return rows.orderBy(F.col("etudiant_id"), _desc("date_evaluation"), F.col("id"))


def professor_courses(courses, depts, professeur_id=None) -> DataFrame:
    """A professor's courses with the department name."""
    base = courses_base(courses, professeur_id=professeur_id)
    rows = _join(base, _dept_name(depts), "departement_id", "_d_id", "left")
    return rows.orderBy(*_asc("professeur_id", "nom", "id"))


def course_roster(students, enrolments, cours_id=None) -> DataFrame:
    """Each course's enrolled students (``e.*`` plus enrolment
    date and status)."""
    i = enrolments.select(F.col("etudiant_id").alias("_i_e"), "cours_id",
                          "date_inscription", "statut")
    if _given(cours_id):
        i = i.filter(equals_cond("cours_id", cours_id, True))
    rows = students.join(i, students["id"] == i["_i_e"], "inner").drop("_i_e")
    return rows.orderBy(*_asc("cours_id", "nom", "prenom", "id"))


# -- L18-L24 accounting, staff, scholarship --------------------------------------------------------------------
def bills_listing(bills, students) -> DataFrame:
    """L18 / P3 (T9): ``b.*`` with ``studentId`` replaced by the student's
    matricule, plus name columns; inner join; newest first."""
    e = students.select(F.col("id").alias("_e_id"), F.col("nom").alias("studentName"),
                        F.col("prenom").alias("studentFirstName"),
                        F.col("matricule").alias("_matricule"))
    rows = bills.join(e, bills["studentId"] == e["_e_id"], "inner")
    rows = rows.drop("studentId", "_e_id").withColumnRenamed("_matricule", "studentId")
    return rows.orderBy(_desc("issueDate"), F.col("id"))


def payments_listing(payments, students, bills) -> DataFrame:
    """L19 / J3 + P3: payments with student names, matricule as studentId,
    and the bill's invoice number; inner joins; newest first."""
    e = students.select(F.col("id").alias("_e_id"), F.col("nom").alias("studentName"),
                        F.col("prenom").alias("studentFirstName"),
                        F.col("matricule").alias("_matricule"))
    b = bills.select(F.col("id").alias("_b_id"), "invoiceNumber")
    rows = payments.join(e, payments["studentId"] == e["_e_id"], "inner")
    rows = rows.join(b, rows["billId"] == b["_b_id"], "inner")
    rows = rows.drop("studentId", "_e_id", "_b_id").withColumnRenamed("_matricule", "studentId")
    return rows.orderBy(_desc("date"), F.col("id"))


def expenses_listing(expenses, depts) -> DataFrame:
    """Expenses with department name (inner), newest first."""
    rows = _join(expenses, _dept_name(depts, "departmentName"), "departmentId", "_d_id", "inner")
    return rows.orderBy(_desc("date"), F.col("id"))


def staff_listing(staff, depts) -> DataFrame:
    """Staff with department name (inner), by last, first name."""
    rows = _join(staff, _dept_name(depts, "departmentName"), "departmentId", "_d_id", "inner")
    return rows.orderBy(*_asc("lastName", "firstName", "id"))


def departments_plain(depts) -> DataFrame:
    """L23."""
    return depts.orderBy(*_asc("nom", "id"))


def scholarship_requests(requests) -> DataFrame:
    """Newest submission first."""
    return requests.orderBy(_desc("dateSoumission"), F.col("id"))


# -- per-entity first pages in bulk ------------------------------------------------------------
def first_page_per(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first page of every entity at once (e.g. each student's 20 latest
    absences): ``row_number() <= limit`` per key.  Spark plans the rank
    filter as a partial WindowGroupLimit before the shuffle, so each map
    task forwards at most ``limit`` rows per key - a hot key cannot pile up
    in one task."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(*order)
    return (rows.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= limit).drop("_rn"))


def absences_with_course(absences, courses) -> DataFrame:
    """L7 rows for every student: absences with course name and code."""
    return _join(absences, _course_name(courses), "cours_id", "_c_id", "inner")


def student_absences_first_pages(absences, courses, limit=PAGE_SIZE["absences"]) -> DataFrame:
    """L7 in bulk: page one of every student's absences (date desc, id)."""
    return first_page_per(absences_with_course(absences, courses), "etudiant_id",
                          _absence_order(), limit)


def department_children_first_pages(students, depts, limit=PAGE_SIZE["department_children"]
                                    ) -> DataFrame:
    """L9 in bulk: page one of every department's students (nom, prenom)."""
    rows = students_rows(students.filter(F.col("departement_id").isNotNull()), depts)
    return first_page_per(rows, "departement_id", _student_order(), limit)


def department_professors_first_pages(profs, depts, limit=PAGE_SIZE["department_children"]
                                      ) -> DataFrame:
    """L10 in bulk: page one of every department's professors (nom, prenom)."""
    rows = _join(profs.filter(F.col("departement_id").isNotNull()), _dept_name(depts),
                 "departement_id", "_d_id", "left")
    return first_page_per(rows, "departement_id", _asc("nom", "prenom", "id"), limit)


def department_courses_first_pages(courses, depts, profs,
                                   limit=PAGE_SIZE["department_children"]) -> DataFrame:
    """L11 in bulk: page one of every department's courses (nom)."""
    rows = courses_rows(courses.filter(F.col("departement_id").isNotNull()), depts, profs)
    return first_page_per(rows, "departement_id", _asc("nom", "id"), limit)
