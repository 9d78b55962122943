"""Batch validation (V1-V11), referential checks (W2), uniqueness (W3) and
orphan audit (W12).

``validate`` adds ``errors: array<string>`` - the codes (field names) of
every failing rule, in rule order, all failures kept - as built-in Column
expressions, so validation is a single projection inside whole-stage
codegen.  Whether a parent exists is a left join with its keys; whether a key
is already stored, or asked for twice, is decided per key - the batch reduced
to its distinct keys, joined to the table's - and the verdict is joined back
onto the rows with hot keys salted.  So the first failing check can be
reported as the reason without row fan-out or a single-task hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.materialize import materialize
from ..plans.skew import annotate, annotate_many

TIME_PATTERN = r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
INT_PATTERN = r"^[-+]?[0-9]+$"
FLOAT_PATTERN = r"^[-+]?([0-9]+)?(\.[0-9]*)?([eE][-+]?[0-9]+)?$"
DATE_PATTERN = r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}$"

# Fixed values of the rules.
WEEKDAYS = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
SESSION_TYPES = ["cours", "tp", "td", "examen"]


@dataclass(frozen=True)
class Rule:
    field: str
    kind: str          # required | email | int | float | date | enum | pattern | bool | string
    lo: float | None = None
    hi: float | None = None
    values: tuple = ()
    optional: bool = False


def _text(c: Column) -> Column:
    return c.cast("string")


_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_FRACTIONAL = {"float", "double"}


def _typed_ok(r: Rule, c: Column, dtype: str) -> Column | None:
    """Shortcut for rules on typed columns, equal to the text rule: the text
    form of a non-NULL integer always matches the integer pattern, of a
    finite double the float pattern, of a date the date pattern - so the
    cast to text and the regular expression can be skipped."""
    if r.kind in ("int", "float") and dtype in _INTEGRAL | _FRACTIONAL:
        if r.kind == "int" and dtype not in _INTEGRAL:
            return None
        ok = c.isNotNull()
        if dtype in _FRACTIONAL:
            ok = ok & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        if r.lo is not None:
            ok = ok & (c >= r.lo)
        if r.hi is not None:
            ok = ok & (c <= r.hi)
        return ok
    if r.kind == "date" and dtype == "date":
        return c.isNotNull() & (F.year(c).between(1000, 9999))
    return None


def rule_ok(r: Rule, df_cols: set[str] | dict[str, str]) -> Column:
    """The Column that is true when the rule holds (NULL counts as failing)."""
    dtypes = df_cols if isinstance(df_cols, dict) else {}
    c = F.col(r.field) if r.field in df_cols else F.lit(None).cast("string")
    fast = _typed_ok(r, c, dtypes[r.field]) if r.field in dtypes else None
    if fast is not None:
        ok = F.coalesce(fast, F.lit(False))
        return (c.isNull() | ok) if r.optional else ok
    t = _text(c)
    if r.kind == "required":
        ok = F.length(t) > 0
    elif r.kind == "truthy":  # JS truthiness of a required text field
        ok = F.length(t) > 0
    elif r.kind == "present":  # anything but absent (0 allowed)
        ok = c.isNotNull()
    elif r.kind == "email":
        ok = t.rlike(EMAIL_PATTERN)
    elif r.kind == "int":
        ok = t.rlike(INT_PATTERN)
        v = t.try_cast("double")
        if r.lo is not None:
            ok = ok & (v >= r.lo)
        if r.hi is not None:
            ok = ok & (v <= r.hi)
    elif r.kind == "float":
        v = t.try_cast("double")
        ok = t.rlike(FLOAT_PATTERN) & v.isNotNull()
        if r.lo is not None:
            ok = ok & (v >= r.lo)
        if r.hi is not None:
            ok = ok & (v <= r.hi)
    elif r.kind == "date":
        ok = t.rlike(DATE_PATTERN) & F.try_to_date(
            F.regexp_replace(t, "/", "-"), "yyyy-MM-dd").isNotNull()
    elif r.kind == "enum":
        ok = t.isin(*r.values)
    elif r.kind == "pattern":
        ok = t.rlike(r.values[0])
    elif r.kind == "bool":
        ok = F.lower(t).isin("true", "false", "1", "0")
    elif r.kind == "string":
        ok = F.lit(True)  # typed string columns always hold text
    else:
        raise ValueError(r.kind)
    ok = F.coalesce(ok, F.lit(False))
    if r.optional:
        ok = c.isNull() | ok
    return ok


def validate(df: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """Append the array of failing rule codes (empty when valid)."""
    cols = dict(df.dtypes)
    checks = [F.when(~rule_ok(r, cols), F.lit(r.field)) for r in rules]
    return df.withColumn(out, F.array_compact(F.array(*checks)))


def split(validated: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Accepted / rejected halves of a validated batch."""
    bad = F.size(errors) > 0
    return validated.filter(~bad), validated.filter(bad)


# Rule sets (fixed values of the reference's request validators).
RULES: dict[str, list[Rule]] = {
    "student": [  # V1
        Rule("matricule", "required"),
        Rule("nom", "required"),
        Rule("prenom", "required"),
        Rule("email", "email"),
        Rule("departement_id", "int"),
        Rule("niveau", "required"),
        Rule("annee_etude", "int", lo=1, hi=5),
    ],
    "professor": [  # V2
        Rule("matricule", "required"),
        Rule("nom", "required"),
        Rule("prenom", "required"),
        Rule("email", "email"),
        Rule("departement_id", "int"),
        Rule("specialite", "required"),
        Rule("grade", "required"),
    ],
    "course": [  # V3
        Rule("code", "required"),
        Rule("nom", "required"),
        Rule("credits", "int", lo=1),
        Rule("heures_cours", "int", lo=0),
        Rule("heures_tp", "int", lo=0),
        Rule("departement_id", "int"),
        Rule("semestre", "required"),
        Rule("annee_academique", "required"),
    ],
    "enrolment": [  # V4
        Rule("etudiant_id", "int"),
    ],
    "grade": [  # V5
        Rule("etudiant_id", "int"),
        Rule("cours_id", "int"),
        Rule("type_evaluation", "required"),
        Rule("note", "float", lo=0, hi=20),
        Rule("coefficient", "float", lo=0.1),
        Rule("date_evaluation", "date"),
    ],
    "timetable": [  # V6
        Rule("cours_id", "int"),
        Rule("jour", "enum", values=tuple(WEEKDAYS)),
        Rule("heure_debut", "pattern", values=(TIME_PATTERN,)),
        Rule("heure_fin", "pattern", values=(TIME_PATTERN,)),
        Rule("salle", "required"),
        Rule("type_seance", "enum", values=tuple(SESSION_TYPES)),
    ],
    "absence": [  # V7
        Rule("etudiant_id", "int"),
        Rule("cours_id", "int"),
        Rule("date_absence", "date"),
        Rule("motif", "string", optional=True),
        Rule("justifiee", "bool"),
    ],
    "justification": [  # V8
        Rule("justifiee", "bool"),
        Rule("motif", "string", optional=True),
    ],
    "department": [  # V9
        Rule("nom", "required"),
        Rule("description", "string", optional=True),
    ],
    "scholarship": [  # V10
        Rule("nom", "truthy"), Rule("prenoms", "truthy"), Rule("telephone", "truthy"),
        Rule("email", "truthy"), Rule("serieBac", "truthy"), Rule("moyenneBac", "present"),
    ],
    "scholarship_status": [  # V11
        Rule("statut", "truthy"),
    ],
}


# -- W2: referential checks with a reason ---------------------------------------------
@dataclass(frozen=True)
class ParentCheck:
    reason: str
    parent: DataFrame
    batch_cols: tuple[str, ...]
    parent_cols: tuple[str, ...]
    unique: bool = False  # the parent's columns are a primary or UNIQUE key: no distinct is needed


def check_parents(batch: DataFrame, checks: list[ParentCheck], reason_col: str = "reason",
                  prior: Column | None = None) -> DataFrame:
    """Report the first failing parent check per batch row
    (``prior``, e.g. the validation verdict, takes precedence).

    Each check is one left join with the parent's key columns, read once and
    without a pass over the batch before: a plain shuffle on both sides, so
    AQE splits the partition of a hot key or of NULL keys.  A parent is made
    distinct first unless its columns are said to be a key (``unique=True``),
    so repeated parent keys never multiply batch rows.
    Integer keys coming as text are ``try_cast``."""
    out = batch
    reason = prior if prior is not None else F.lit(None).cast("string")
    for i, ch in enumerate(checks):
        for b, pcol in zip(ch.batch_cols, ch.parent_cols):
            t = ch.parent.schema[pcol].dataType
            if out.schema[b].dataType != t:
                out = out.withColumn(b, F.col(b).try_cast(t))
        keys = ch.parent.select(*[F.col(p).alias(b) for p, b in zip(ch.parent_cols, ch.batch_cols)])
        if not ch.unique:
            keys = keys.distinct()
        out = out.join(keys.withColumn(f"_hit{i}", F.lit(True)), list(ch.batch_cols), "left")
        reason = F.coalesce(reason, F.when(F.col(f"_hit{i}").isNull(), F.lit(ch.reason)))
    return out.withColumn(reason_col, reason).drop(*[f"_hit{i}" for i in range(len(checks))])


# -- W3: uniqueness, first by seq wins ----------------------------------------------------
def check_unique(batch: DataFrame, key: list[str], base: DataFrame | None = None,
                 seq: str = "seq", reason_col: str = "reason",
                 base_reason: str = "doublon", batch_reason: str = "doublon_lot",
                 eligible: Column | None = None, skew_safe: bool = True) -> DataFrame:
    """W3 for one unique key: rejected when the key exists in ``base`` or an
    earlier *eligible* row of the batch has it.  Rows that already carry a
    reason are not eligible (they will not be inserted, so they block
    nobody).  NULL keys never collide (SQL UNIQUE).

    The first eligible ``seq`` per key is a partial+final aggregation; it is
    joined back with hot keys salted (:func:`plans.skew.annotate`)."""
    if reason_col not in batch.columns:
        batch = batch.withColumn(reason_col, F.lit(None).cast("string"))
    elig = F.col(reason_col).isNull() if eligible is None else eligible
    notnull = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    out = batch
    # one row per key: first eligible seq, row count, and whether the table
    # already holds the key (a key-level property, joined at the key level)
    firsts = out.filter(notnull).groupBy(*key).agg(
        F.min(F.when(elig, F.col(seq))).alias("_min_seq"), F.count(F.lit(1)).alias("_n"))
    if base is not None:
        bk = base.select(*key).distinct().withColumn("_in_base", F.lit(True))
        firsts = firsts.join(bk, key, "left")
    else:
        firsts = firsts.withColumn("_in_base", F.lit(None).cast("boolean"))
    out = annotate(out, firsts, key, "_n", F.col(seq), skew_safe)
    reason = F.coalesce(
        F.col(reason_col),
        F.when(notnull & F.col("_in_base").isNotNull(), F.lit(base_reason)),
        F.when(notnull & F.col("_min_seq").isNotNull() & (F.col(seq) > F.col("_min_seq")),
               F.lit(batch_reason)))
    return out.withColumn(reason_col, reason).drop("_in_base", "_min_seq")


def _notnull(k: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k])


#: Rounds in which rows that are first at all their keys are taken.
FIRST_ROUNDS = 2


def _first_come(batches):
    """Rows of each component by arrival: one is accepted unless a key of it
    belongs to an accepted one."""
    import pyarrow as pa

    component, taken = None, set()
    for batch in batches:
        seqs, accepted = batch.column("_row").to_pylist(), []
        keys = [batch.column(n).to_pylist() for n in batch.schema.names if n.startswith("_key")]
        for i, here in enumerate(batch.column("_component").to_pylist()):
            if here != component:
                component, taken = here, set()
            mine = [(k, col[i]) for k, col in enumerate(keys) if col[i] is not None]
            free = taken.isdisjoint(mine)
            if free:
                taken.update(mine)
            accepted.append(free)
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(accepted, pa.bool_())], names=["_row", "_accepted"])


def _take_firsts(work: DataFrame, keys: list[list[str]], seq: str) -> DataFrame:
    """One round over undecided rows: ``_state`` 1 (accepted) for a row that
    is the first at each of its keys, 2 (refused) for one that shares a key
    with such a row, else 0."""
    firsts = [(work.filter(_notnull(k)).groupBy(*k).agg(F.min(seq).alias(f"_m{i}"), F.count(F.lit(1)).alias("_n")), k)
              for i, k in enumerate(keys)]
    step = annotate_many(work, firsts, "_n", F.col(seq), checkpoint=False)
    own = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_m{i}") == F.col(seq), F.lit(True)) for i in range(len(keys))])
    step = materialize(step.select(*work.columns, own.alias("_own")), "unique-rounds")
    out = step
    for i, k in enumerate(keys):
        # A key has one accepted row at most; both sides are plain shuffles, so AQE splits a hot key.
        taken = step.filter(F.col("_own") & _notnull(k)).select(*k).withColumn(f"_t{i}", F.lit(True))
        out = out.join(taken, k, "left")
    hit = reduce(lambda a, b: a | b, [F.col(f"_t{i}").isNotNull() for i in range(len(keys))])
    state = F.when(F.col("_own"), 1).when(hit, 2).otherwise(0)
    return materialize(out.select(*work.columns, state.alias("_state")), "unique-rounds")


def check_unique_multi(batch: DataFrame, keys: list[list[str]], base: DataFrame | None = None,
                       seq: str = "seq", reason_col: str = "reason",
                       base_reason: str = "doublon", batch_reason: str = "doublon_lot"
                       ) -> DataFrame:
    """W3 over several unique keys with strict first-come semantics: a row is
    accepted iff no key is in ``base`` and no *accepted* earlier row shares
    any key with it (a rejected row blocks nobody).

    Rows whose every key is unique among the eligible rows of the batch are
    settled at once (one count per key, joined back).  Of the colliding ones,
    ``FIRST_ROUNDS`` rounds of joins and aggregations take the rows that are
    first at all their keys and refuse those that share a key with them: that
    settles large groups around a key.  What is left are chains, in which a
    row waits for one that waits for another.  They are labelled by the
    component of the row-key graph they are in (:mod:`plans.components`, a
    number of rounds that goes with the logarithm of the longest chain), and
    each component is decided in one pass by arrival that holds its accepted
    keys; components are dealt over the tasks.  ``seq`` is unique."""
    if reason_col not in batch.columns:
        batch = batch.withColumn(reason_col, F.lit(None).cast("string"))
    # per key: whether the table holds it, and whether several rows ask for it
    eligible, frames = F.col(reason_col).isNull(), []
    for i, k in enumerate(keys):
        per = batch.filter(_notnull(k)).groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), (F.count_if(eligible) > 1).alias(f"_s{i}"))
        if base is not None:
            per = per.join(base.select(*k).distinct().withColumn(f"_b{i}", F.lit(True)), k, "left")
        frames.append((per, k))
    cur = annotate_many(batch, frames, "_n", F.col(seq))
    if base is not None:
        held = reduce(lambda a, b: a | b, [F.col(f"_b{i}").isNotNull() for i in range(len(keys))])
        cur = cur.withColumn(reason_col, F.coalesce(F.col(reason_col), F.when(held, F.lit(base_reason))))
    # Rows with a key that others ask for, too, take part in the rounds; one
    # whose others are refused already is taken in the first.
    shared = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_s{i}"), F.lit(False)) for i in range(len(keys))])
    cur = materialize(cur.select(*batch.columns, (F.col(reason_col).isNull() & shared).alias("_collides")), "unique-batch")
    settled = [cur.filter(~F.col("_collides")).drop("_collides")]
    work = cur.filter(F.col("_collides")).drop("_collides")
    for _ in range(FIRST_ROUNDS):
        if work.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), settled)
        step = _take_firsts(work, keys, seq)
        settled.append(step.filter("_state > 0").withColumn(reason_col, F.when(F.col("_state") == 2, F.lit(batch_reason))).drop("_state"))
        work = step.filter("_state = 0").drop("_state")
    if not work.isEmpty():
        settled.append(_by_component(work, keys, seq, reason_col, batch_reason))
    return reduce(lambda a, b: a.unionByName(b), settled)


def _by_component(work: DataFrame, keys: list[list[str]], seq: str, reason_col: str, batch_reason: str) -> DataFrame:
    from ..session import ship_package

    ship_package(work.sparkSession)
    links = None
    for k in keys:  # each row to the first one at its key
        first = work.filter(_notnull(k)).groupBy(*k).agg(F.min(seq).alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        edge = annotate(work.select(seq, *k), first, k, "_n", F.col(seq), checkpoint=False).filter("_m IS NOT NULL").select(F.col(seq).alias("a"), F.col("_m").alias("b"))
        links = edge if links is None else links.unionByName(edge)
    of = components(links).withColumnRenamed("node", seq)
    rows = (work.join(of, seq, "left").select(
        F.coalesce("component", seq).cast("long").alias("_component"), F.col(seq).cast("long").alias("_row"),
        *[F.when(_notnull(k), F.to_json(F.struct(*k))).alias(f"_key{i}") for i, k in enumerate(keys)]))
    decided = (rows.repartition("_component").sortWithinPartitions("_component", "_row")
               .mapInArrow(_first_come, "_row long, _accepted boolean"))
    return (work.join(decided, work[seq] == decided["_row"]).drop("_row")
            .withColumn(reason_col, F.when(~F.col("_accepted"), F.lit(batch_reason))).drop("_accepted"))


# -- W12: orphans ---------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose (non-NULL) foreign key has no parent - what deleting
    with foreign keys off leaves behind.  A left anti join."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == p["_pk"], "left_anti")
