"""Table changes as bulk change sets.

Parquet tables take no UPDATE / DELETE / MERGE, so every change is a
join-based rewrite: each function takes the current table and a batch and
returns a :class:`ChangeSet` - the new table, the accepted rows and the
rejected rows with their reason (the first failing check, in the
reference's order).  The caller writes ``table`` to a *fresh* path
(:func:`write_version`); Spark cannot overwrite a path it is reading.

New ids follow AUTOINCREMENT: ``max(id) + seq`` where ``seq`` is the
batch's positive arrival number - unique and increasing in arrival order,
with gaps where rows were rejected (as failed inserts leave in SQLite), and
computed without a global window or a single-partition sort.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import doc_number, doc_tail, parse_bool
from ..plans.materialize import materialize as write_table
from ..plans.skew import annotate
from ..sources.schemas import FOREIGN_KEYS, NOT_NULL, UNIQUE_KEYS, conform, typed, with_defaults
from .quality import (RULES, ParentCheck, check_parents, check_unique, check_unique_multi,
                      validate)


@dataclass
class ChangeSet:
    """``table``: the new table; ``accepted`` / ``rejected``: the two halves
    of the batch; ``report``: every batch row with its ``reason`` (NULL when
    accepted), one pass.  When several of them are written, checkpoint the
    report first (``plans.materialize.materialize``, into the shared
    checkpoint dir) so
    the checks are not recomputed per output."""
    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame | None = None


def assign_ids(accepted: DataFrame, base: DataFrame, seq: str = "seq") -> DataFrame:
    """AUTOINCREMENT ids for accepted rows (see module doc).  ``max(id)`` of
    the table is a scalar subquery (partial + final aggregate, evaluated
    once when the plan runs) - nothing is computed while the plan is built."""
    top = F.coalesce(base.agg(F.max("id")).scalar(), F.lit(0).cast("bigint"))
    return accepted.withColumn("id", top + F.col(seq).cast("bigint"))


def _split(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()), df.filter(F.col(reason).isNotNull())


def _require_values(rows: DataFrame, name: str, reason: str = "reason") -> DataFrame:
    """Rows without a value in a NOT NULL column are ``valeur_manquante``,
    unless they have a reason already."""
    missing = None
    for c in NOT_NULL.get(name, ()):
        null = F.col(c).isNull() if c in rows.columns else F.lit(True)
        missing = null if missing is None else missing | null
    if missing is None:
        return rows
    return rows.withColumn(reason, F.coalesce(F.col(reason), F.when(missing, F.lit("valeur_manquante"))))


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add the rows of ``new`` whose unique ``keys`` are not present
    (``INSERT OR IGNORE``).  Without a unique key every row goes in - the
    seed departments duplicate on a second run (T20)."""
    if not keys:
        return base.unionByName(new, allowMissingColumns=True)
    fresh = new.join(base.select(*keys).distinct(), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def append(base: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The table with ``rows`` appended (schema of ``name``)."""
    return conform(base, name).unionByName(conform(rows, name))


def write_version(df: DataFrame, root: str, name: str, version: str | None = None) -> str:
    """Write ``df`` as a new immutable version ``root/name/v=<version>`` and
    return its path; readers switch to it once the write has succeeded."""
    version = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{root.rstrip('/')}/{name}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def to_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON records."""
    df.write.mode("errorifexists").json(path)


# -- W1: checked append ----------------------------------------------------------------
def append_valid(base: DataFrame, batch: DataFrame, name: str, rules: str | None,
                 parents: list[ParentCheck] = (), unique: list[list[str]] | None = None,
                 seq: str = "seq", as_of=None, materialize: bool = False) -> ChangeSet:
    """Validate -> parents exist -> no duplicate (vs the table and earlier
    rows of the batch) -> insert with defaults and ids.

    The duplicate check reads the checked batch twice (per-key first row,
    then the join back).  With ``materialize=True`` the checked batch, and
    then the report, is written once as a table in the shared
    ``spark.checkpoint.dir`` so the upstream scans and joins are not run twice
    and lineage is cut."""
    v = validate(batch, RULES[rules]) if rules else batch.withColumn("errors", F.array())
    v = typed(v, name)
    prior = F.when(F.size("errors") > 0, F.lit("invalide"))
    checked = check_parents(v, list(parents), prior=prior)
    checked = _require_values(checked, name)
    keys = UNIQUE_KEYS.get(name, []) if unique is None else unique
    keys = [list(k) for k in keys]
    if materialize and keys:
        checked = write_table(checked, "checked-batch")
    if len(keys) == 1:
        checked = check_unique(checked, keys[0], base, seq)
    elif len(keys) > 1:
        checked = check_unique_multi(checked, keys, base, seq)
    if materialize:
        checked = write_table(checked, "checked-report")
    ok, bad = _split(checked)
    rows = with_defaults(assign_ids(ok, base, seq), name, as_of, keep=(seq,))
    return ChangeSet(append(base, rows, name), rows, bad, checked)


def add_grades(notes, batch, students, courses, enrolments, seq="seq", as_of=None) -> ChangeSet:
    """W1 for grades: rules, student, course, enrolment (no duplicate rule)."""
    return append_valid(notes, batch, "notes", "grade", [
        ParentCheck("etudiant_introuvable", students, ("etudiant_id",), ("id",), unique=True),
        ParentCheck("cours_introuvable", courses, ("cours_id",), ("id",), unique=True),
        ParentCheck("non_inscrit", enrolments, ("etudiant_id", "cours_id"),
                    ("etudiant_id", "cours_id"), unique=True)], unique=[], seq=seq, as_of=as_of)


def add_absences(absences, batch, students, courses, enrolments, seq="seq",
                 as_of=None, materialize=False) -> ChangeSet:
    """W1 for absences: rules, student, course, enrolment, then no other
    absence of the same student, course and date."""
    batch = batch.withColumn("justifiee", parse_bool("justifiee")) \
        if dict(batch.dtypes).get("justifiee") == "string" else batch
    return append_valid(absences, batch, "absences", "absence", [
        ParentCheck("etudiant_introuvable", students, ("etudiant_id",), ("id",), unique=True),
        ParentCheck("cours_introuvable", courses, ("cours_id",), ("id",), unique=True),
        ParentCheck("non_inscrit", enrolments, ("etudiant_id", "cours_id"),
                    ("etudiant_id", "cours_id"), unique=True)],
        unique=[["etudiant_id", "cours_id", "date_absence"]], seq=seq, as_of=as_of,
        materialize=materialize)


def add_students(students, batch, seq="seq", as_of=None) -> ChangeSet:
    """W1 for students: rules, then matricule and email unique (strict
    first-come over both keys)."""
    return append_valid(students, batch, "etudiants", "student", [], seq=seq, as_of=as_of)


def add_professors(profs, batch, seq="seq", as_of=None) -> ChangeSet:
    return append_valid(profs, batch, "professeurs", "professor", [], seq=seq, as_of=as_of)


def add_courses(courses, batch, seq="seq", as_of=None) -> ChangeSet:
    return append_valid(courses, batch, "cours", "course", [], seq=seq, as_of=as_of)


def add_departments(depts, batch, seq="seq", as_of=None) -> ChangeSet:
    """W1 for departments: the route refuses a name already used."""
    return append_valid(depts, batch, "departements", "department", [],
                        unique=[["nom"]], seq=seq, as_of=as_of)


# -- W8: enrolment -------------------------------------------------------------------------
def enrol_check(enrolments, batch, students, courses, seq="seq", materialize=False
                ) -> DataFrame:
    """W8 checks: student id rule, course exists, student exists, not
    already enrolled (vs the table and earlier rows of the batch).
    ``materialize`` checkpoints the checked batch before the duplicate check
    reads it twice (see :func:`append_valid`)."""
    v = typed(validate(batch, RULES["enrolment"]), "inscriptions")
    prior = F.when(F.size("errors") > 0, F.lit("invalide"))
    out = check_parents(v, [
        ParentCheck("cours_introuvable", courses, ("cours_id",), ("id",), unique=True),
        ParentCheck("etudiant_introuvable", students, ("etudiant_id",), ("id",), unique=True)], prior=prior)
    if materialize:
        out = write_table(out, "checked-batch")
    out = check_unique(out, ["etudiant_id", "cours_id"], enrolments, seq,
                       base_reason="deja_inscrit", batch_reason="deja_inscrit")
    return out.drop("errors")


def enrol(enrolments, batch, students, courses, seq="seq", as_of=None) -> ChangeSet:
    checked = enrol_check(enrolments, batch, students, courses, seq)
    ok, bad = _split(checked)
    rows = with_defaults(assign_ids(ok, enrolments, seq), "inscriptions", as_of, keep=(seq,))
    return ChangeSet(append(enrolments, rows, "inscriptions"), rows, bad, checked)


# -- W4, W5: updates -------------------------------------------------------------------------
def _latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """When a batch updates a row twice, the last change wins (applied in
    order): one ``max_by`` aggregation per key (partial + final, so a key
    changed many times is combined map-side) - no join back."""
    others = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_last"))
    return last.select(key, *[F.col("_last")[c].alias(c) for c in others])


def full_update(base: DataFrame, changes: DataFrame, cols: list[str], name: str,
                key: str = "id", seq: str = "seq", rules: str | None = None,
                unique: list[list[str]] | None = None, require_exists: bool = True
                ) -> ChangeSet:
    """W4 (T19): replace every listed column of the matched rows - an
    omitted (NULL) value overwrites with NULL, as binding ``undefined`` does.
    Checks in order: rules, the row exists, unique keys not held by another
    row of the table as it stands before the batch.  A row changed twice takes
    its last change that passes these; of different rows that then share a
    key, the first by ``seq`` wins (strictly first-come over all keys).  A
    rejected change blocks nobody.  ``accepted`` has the changes that take
    effect."""
    v = validate(changes, RULES[rules]) if rules else changes.withColumn("errors", F.array())
    v = typed(v, name)
    reason = F.when(F.size("errors") > 0, F.lit("invalide"))
    if require_exists:
        ids = base.select(F.col(key).alias("_exists"))  # primary key: no distinct needed
        v = v.join(ids, v[key] == ids["_exists"], "left")
        reason = F.coalesce(reason, F.when(F.col("_exists").isNull(), F.lit("introuvable")))
        v = v.withColumn("reason", reason).drop("_exists")
    else:
        v = v.withColumn("reason", reason)
    keys = [list(k) for k in (UNIQUE_KEYS.get(name, []) if unique is None else unique)]
    for k in keys:  # held by another row of the table
        notnull = F.lit(True)
        for c in k:
            notnull = notnull & F.col(c).isNotNull()
        held = base.filter(notnull).groupBy(*k).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
        asked = v.filter(notnull).groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).join(held, k)
        v = annotate(v, asked, k, "_n", F.col(seq)).withColumn("reason", F.coalesce(F.col("reason"), F.when(
            (F.col("_first") != F.col(key)) | (F.col("_last") != F.col(key)), F.lit("doublon")))).drop("_first", "_last")
    ok, bad = _split(v)
    last = _latest(ok, key, seq)
    if keys:  # between the rows that are left, each by its last change
        last = check_unique_multi(last, keys, None, seq, batch_reason="doublon") if len(keys) > 1 else \
            check_unique(last, keys[0], None, seq, batch_reason="doublon")
        ok, twice = _split(last)
        bad = bad.unionByName(twice, allowMissingColumns=True)
    else:
        ok = last
    new = ok.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in cols],
                    F.lit(True).alias("_m"))
    t = base.join(new, base[key] == new["_k"], "left")
    t = t.select(*[(F.when(F.col("_m"), F.col(f"_n_{c}").cast(base.schema[c].dataType))
                    .otherwise(F.col(c)).alias(c)) if c in cols else F.col(c)
                   for c in base.columns])
    return ChangeSet(t, ok, bad)


def partial_update(base: DataFrame, changes: DataFrame, cols: list[str], key: str = "id",
                   seq: str = "seq", present: dict[str, Column] | None = None,
                   rules: str | None = None) -> ChangeSet:
    """Set only the columns that are *given*.  ``present[c]`` says whether
    ``c`` was given (default: not NULL) - the justification of an absence
    sets ``justifiee`` always and ``motif`` only when sent; a scholarship
    status change sets ``statut``.  Unknown keys are rejected."""
    present = present or {}
    v = validate(changes, RULES[rules]) if rules else changes.withColumn("errors", F.array())
    ids = base.select(F.col(key).alias("_exists"))  # primary key: no distinct needed
    v = v.join(ids, v[key] == ids["_exists"], "left")
    v = v.withColumn("reason", F.coalesce(
        F.when(F.size("errors") > 0, F.lit("invalide")),
        F.when(F.col("_exists").isNull(), F.lit("introuvable")))).drop("_exists")
    ok, bad = _split(v)
    ok = _latest(ok, key, seq)
    new = ok.select(F.col(key).alias("_k"),
                    *[F.col(c).alias(f"_n_{c}") for c in cols],
                    *[(present.get(c, F.col(c).isNotNull())).alias(f"_p_{c}") for c in cols])
    t = base.join(new, base[key] == new["_k"], "left")
    t = t.select(*[(F.when(F.coalesce(F.col(f"_p_{c}"), F.lit(False)),
                           F.col(f"_n_{c}").cast(base.schema[c].dataType))
                    .otherwise(F.col(c)).alias(c)) if c in cols else F.col(c)
                   for c in base.columns])
    return ChangeSet(t, ok, bad)


def justify_absences(absences: DataFrame, changes: DataFrame, seq: str = "seq") -> ChangeSet:
    """W5 for absences: ``justifiee`` parsed as a real boolean (T18);
    ``motif`` set only when the change carries a ``motif_given`` flag or a
    non-NULL motif."""
    ch = changes
    present = {"justifiee": F.lit(True)}
    if "motif_given" in ch.columns:
        present["motif"] = F.col("motif_given")
    out = partial_update(absences, ch, ["justifiee", "motif"], "id", seq, present,
                         rules="justification")
    return out


def set_scholarship_status(requests: DataFrame, changes: DataFrame, seq: str = "seq"
                           ) -> ChangeSet:
    """New status for existing requests (V11: non-empty status)."""
    return partial_update(requests, changes, ["statut"], "id", seq,
                          rules="scholarship_status")


# -- W6, W7: deletes ---------------------------------------------------------------------------
def delete(base: DataFrame, keys: DataFrame, key: str = "id", keys_col: str | None = None
           ) -> ChangeSet:
    """Unguarded delete; ``rejected`` lists the keys that were not found.
    Children are left in place (foreign keys are off): see ``orphans``."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    table = base.join(k, key, "left_anti")
    found = k.join(base.select(key).distinct(), key, "left_semi")
    missing = k.join(base.select(key).distinct(), key, "left_anti").withColumn(
        "reason", F.lit("introuvable"))
    return ChangeSet(table, found, missing)


def guarded_delete(base: DataFrame, keys: DataFrame, children: dict[str, tuple[DataFrame, str]],
                   key: str = "id") -> ChangeSet:
    """Delete only keys with no children; a blocked key is reported with
    its child counts (as the department delete does), a missing key as
    ``introuvable``.  Each child is aggregated once by its foreign key
    (partial + final), then the requested keys are left-joined to the
    existing keys and to each child's counts - one report, from which the
    table and both halves are filtered."""
    k = keys.select(F.col(key)).distinct()
    exists = base.select(F.col(key)).distinct().withColumn("_exists", F.lit(True))
    report = k.join(exists, key, "left")
    for name, (child, fk) in children.items():
        per = (child.filter(F.col(fk).isNotNull())
               .groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name)))
        report = report.join(per, key, "left")
    any_child = None
    for name in children:
        c = F.coalesce(F.col(name), F.lit(0)) > 0
        any_child = c if any_child is None else (any_child | c)
    report = report.select(
        key, *[F.when(F.col("_exists").isNotNull(), F.coalesce(F.col(n), F.lit(0)))
               .alias(n) for n in children],
        F.when(F.col("_exists").isNull(), F.lit("introuvable"))
         .when(any_child, F.lit("enfants")).alias("reason"))
    deletable = report.filter(F.col("reason").isNull()).select(key)
    table = base.join(deletable, key, "left_anti")
    return ChangeSet(table, deletable, report.filter(F.col("reason").isNotNull()), report)


def dependents(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> DataFrame:
    """Rows at all levels below the rows of table ``name`` with the given
    ``id``s: (root, table, n), only tables with some.  The foreign-key graph
    is walked from parents to children; a row that is reached over several
    ways, as a payment is by its bill and by its student, counts once.  Only
    a root and a row's key move from level to level."""
    reached = {name: keys.select(F.col("id").alias("root"), F.col("id").cast("string").alias("key")).distinct()}
    counts = None
    for child, fks in FOREIGN_KEYS.items():
        if child not in tables or child == name:
            continue
        # Enrolments have no id of their own; their pair is the key.
        own = F.concat_ws("/", *[F.col(c).cast("string") for c in UNIQUE_KEYS["inscriptions"][0]]) \
            if child == "inscriptions" else F.col("id").cast("string")
        rows = None
        for fk, parent in fks.items():
            if parent in reached:
                hit = (tables[child].select(F.col(fk).cast("string").alias("key"), own.alias("_own"))
                       .join(reached[parent], "key").select("root", F.col("_own").alias("key")))
                rows = hit if rows is None else rows.unionByName(hit)
        if rows is not None:
            reached[child] = write_table(rows.distinct(), "dependents")
            n = reached[child].groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.lit(child).alias("table"), "n")
            counts = n if counts is None else counts.unionByName(n)
    return counts


def guarded_delete_deep(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> ChangeSet:
    """W6 over all levels: a key goes only if nothing is below it; a blocked
    one is reported as ``enfants`` with the counts of every table below, a
    missing one as ``introuvable``."""
    below = [t for t in FOREIGN_KEYS if t in tables and t != name]
    k = keys.select("id").distinct().join(tables[name].select("id").withColumn("_exists", F.lit(True)), "id", "left")
    found = dependents(tables, name, k.filter("_exists"))
    per = found.groupBy("root").pivot("table", below).agg(F.sum("n"))
    report = k.join(per, k["id"] == per["root"], "left").select(
        "id", *[F.when(F.col("_exists").isNotNull(), F.coalesce(F.col(t), F.lit(0))).cast("bigint").alias(t) for t in below],
        F.when(F.col("_exists").isNull(), F.lit("introuvable")).when(F.col("root").isNotNull(), F.lit("enfants")).alias("reason"))
    gone = report.filter(F.col("reason").isNull()).select("id")
    return ChangeSet(tables[name].join(gone, "id", "left_anti"), gone, report.filter(F.col("reason").isNotNull()), report)


def delete_enrolments(enrolments: DataFrame, pairs: DataFrame) -> ChangeSet:
    """W7 by (student, course) pair."""
    k = pairs.select("etudiant_id", "cours_id").distinct()
    table = enrolments.join(k, ["etudiant_id", "cours_id"], "left_anti")
    cur = enrolments.select("etudiant_id", "cours_id").distinct()
    found = k.join(cur, ["etudiant_id", "cours_id"], "left_semi")
    missing = k.join(cur, ["etudiant_id", "cours_id"], "left_anti").withColumn(
        "reason", F.lit("introuvable"))
    return ChangeSet(table, found, missing)


# -- W9, W10, W11: accounting, staff, scholarships ------------------------------------------------
def issue(kind: str, base: DataFrame, batch: DataFrame, as_of, seq: str = "seq") -> ChangeSet:
    """New bills, expenses or staff records: document number (X8, with
    the batch sequence as tail), today's date, initial status; no field
    rules exist for these, only the table's NOT NULL / UNIQUE."""
    name, num_col, date_col, status = {
        "bill": ("bills", "invoiceNumber", "issueDate", "pending"),
        "expense": ("expenses", "expenseNumber", "date", "pending"),
        "teaching_staff": ("teaching_staff", "employeeId", None, "active"),
        "admin_staff": ("admin_staff", "employeeId", None, "active"),
    }[kind]
    ts = F.lit(as_of).cast("timestamp")
    rows = _numbered(batch, base, num_col, kind, ts, seq)
    if date_col:
        rows = rows.withColumn(date_col, ts.cast("date"))
    rows = rows.withColumn("status", F.lit(status))
    return _insert(base, rows, name, as_of, seq)


def _numbered(batch: DataFrame, base: DataFrame, num_col: str, kind: str, ts, seq: str) -> DataFrame:
    """Document numbers that go on from the greatest one of the kind and year
    in the table, as the ids do: one scalar subquery."""
    top = F.coalesce(base.agg(F.max(doc_tail(num_col, kind, ts))).scalar(), F.lit(0).cast("bigint"))
    return batch.withColumn(num_col, doc_number(kind, ts, top + F.col(seq).cast("bigint")))


def _insert(base: DataFrame, rows: DataFrame, name: str, as_of, seq: str) -> ChangeSet:
    """Ids and defaults, then NOT NULL and all unique keys together."""
    rows = with_defaults(assign_ids(rows, base, seq), name, as_of, keep=(seq,))
    rows = _require_values(rows.withColumn("reason", F.lit(None).cast("string")), name)
    keys = [list(k) for k in UNIQUE_KEYS.get(name, [])]
    if len(keys) > 1:
        rows = check_unique_multi(rows, keys, base, seq)
    elif keys:
        rows = check_unique(rows, keys[0], base, seq)
    ok, bad = _split(rows)
    ok = conform(ok, name)
    return ChangeSet(append(base, ok, name), ok, bad, rows)


def post_payments(bills: DataFrame, payments: DataFrame, batch: DataFrame, as_of,
                  seq: str = "seq") -> tuple[ChangeSet, DataFrame]:
    """Append the payments (number, today, 'completed'), then mark every
    bill that received an accepted payment as 'paid' - whatever the amount,
    as the reference does.  Returns the payments change set and the new bills."""
    ts = F.lit(as_of).cast("timestamp")
    rows = (_numbered(batch, payments, "paymentNumber", "payment", ts, seq)
            .withColumn("date", ts.cast("date")).withColumn("status", F.lit("completed")))
    posted = _insert(payments, rows, "payments", as_of, seq)
    paid = posted.accepted.select(F.col("billId").alias("_paid")).distinct()
    new_bills = bills.join(paid, bills["id"] == paid["_paid"], "left").select(
        *[(F.when(F.col("_paid").isNotNull(), F.lit("paid")).otherwise(F.col("status"))
           .alias("status")) if c == "status" else F.col(c) for c in bills.columns])
    return posted, new_bills


def submit_scholarships(requests: DataFrame, batch: DataFrame, seq: str = "seq",
                        as_of=None) -> ChangeSet:
    """All six fields present (V10), then insert with status
    'En attente' and the submission time."""
    return append_valid(requests, batch, "demandes_bourse", "scholarship", [], unique=[],
                        seq=seq, as_of=as_of)
