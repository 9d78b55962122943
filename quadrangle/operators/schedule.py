"""Timetable conflicts (J9, F11, C1) and batch booking.

Skew-safe shape.  The conflict rule compares a stored session with a
candidate on the same room and day.  Joining sessions to sessions on
(room, day) would compare every pair of a busy room-day - quadratic in the
hottest key.  Instead every session is reduced to its *interval class*
``(salle, jour, heure_debut, heure_fin)`` with a count, and the three-arm
test runs between classes.  Clock times are ``H:MM`` / ``HH:MM`` texts, so
a room-day holds at most a fixed number of distinct classes however many
sessions it has, and the per-session answer is a join of each session to its
class total.

Counts between proper classes (start before end) come from an event sweep:
two of them conflict exactly when each starts before the other ends, so the
stored ones that conflict with (a, b) are those started before b less those
ended by a - two running sums over the distinct times of the room-day, with
no pair of classes.  Only where a class isn't proper (start at or after end,
which text order makes of 9:00-10:00) is the three-arm test run between
classes.

The test is kept literal (T6, T23): times are compared as text - binary
collation in Spark, as in the reference - so ``'9:00' > '10:00'``.  Pass
``numeric=True`` to compare minutes of day instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import conflict_cond, time_minutes
from ..plans.skew import annotate

ROOM_DAY = ["salle", "jour"]
CLASS = ["salle", "jour", "heure_debut", "heure_fin"]


def _keys(df: DataFrame, numeric: bool) -> DataFrame:
    """Add the comparable start/end keys ``_a``/``_b`` (text or minutes)."""
    if numeric:
        return df.withColumn("_a", time_minutes("heure_debut")).withColumn(
            "_b", time_minutes("heure_fin"))
    return df.withColumn("_a", F.col("heure_debut")).withColumn("_b", F.col("heure_fin"))


def interval_classes(sessions: DataFrame, numeric: bool = False) -> DataFrame:
    """One row per (room, day, start, end) with the number of sessions."""
    return _keys(sessions.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n")), numeric)


def class_matches(cand_classes: DataFrame, stored_classes: DataFrame) -> DataFrame:
    """Pairs (candidate class, stored class) of the same room and day that
    pass the three-arm test (stored = s, candidate = c).  Rows with a NULL
    room or day match nothing, as ``salle = ?`` does."""
    c = cand_classes.select(*[F.col(k).alias(f"c_{k}") for k in CLASS],
                            F.col("_a").alias("c_a"), F.col("_b").alias("c_b"))
    s = stored_classes.select(*[F.col(k).alias(f"s_{k}") for k in CLASS],
                              F.col("_a").alias("s_a"), F.col("_b").alias("s_b"), "n")
    on = ((c["c_salle"] == s["s_salle"]) & (c["c_jour"] == s["s_jour"])
          & conflict_cond(s["s_a"], s["s_b"], c["c_a"], c["c_b"]))
    return c.join(s, on, "inner")


def _proper(a: str = "_a", b: str = "_b") -> Column:
    return F.coalesce(F.col(a) < F.col(b), F.lit(False))


#: Events of a room-day at one time, in the order in which the sweep meets
#: them: ends, how many have ended by a candidate's start, how many have
#: started before a candidate's end, starts.
_END, _ASK_ENDED, _ASK_STARTED, _START = range(4)


def _sweep(cand: DataFrame, stored: DataFrame) -> DataFrame:
    """CLASS and ``_hits`` of the proper candidate classes against the proper
    stored ones, from running sums over the events of each room-day."""
    def events(df: DataFrame, at: str, kind: int, n: Column) -> DataFrame:
        return df.select(*ROOM_DAY, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), n.alias("n"))

    none = F.lit(0).cast("bigint")
    kinds = [events(stored, "_b", _END, F.col("n")), events(stored, "_a", _START, F.col("n")),
             events(cand, "_a", _ASK_ENDED, none), events(cand, "_b", _ASK_STARTED, none)]
    # one row for each time and kind: as many as the clock has times
    times = reduce(DataFrame.unionByName, kinds).groupBy(*ROOM_DAY, "_t", "_kind").agg(F.sum("n").alias("n"))
    until = Window.partitionBy(*ROOM_DAY).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = times.select(*ROOM_DAY, "_t", "_kind", *[
        F.sum(F.when(F.col("_kind") == kind, F.col("n")).otherwise(0)).over(until).alias(name)
        for kind, name in ((_START, "_started"), (_END, "_ended"))])
    ended = seen.filter(F.col("_kind") == _ASK_ENDED).select(*ROOM_DAY, F.col("_t").alias("_a"), "_ended")
    started = seen.filter(F.col("_kind") == _ASK_STARTED).select(*ROOM_DAY, F.col("_t").alias("_b"), "_started")
    return (cand.join(ended, [*ROOM_DAY, "_a"]).join(started, [*ROOM_DAY, "_b"])
            .select(*CLASS, (F.col("_started") - F.col("_ended")).alias("_hits")))


def class_hits(cand_classes: DataFrame, stored_classes: DataFrame) -> DataFrame:
    """CLASS and ``_hits``: the number of stored sessions that each candidate
    class conflicts with; classes without any may be missing."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ROOM_DAY])
    cand, stored = cand_classes.filter(known), stored_classes.filter(known)
    swept = _sweep(cand.filter(_proper()), stored.filter(_proper()))
    sums = [swept]
    for c, s in ((cand.filter(_proper()), stored.filter(~_proper())), (cand.filter(~_proper()), stored)):
        sums.append(class_matches(c, s).select(*[F.col(f"c_{k}").alias(k) for k in CLASS], F.col("n").alias("_hits")))
    return reduce(DataFrame.unionByName, sums).groupBy(*CLASS).agg(F.sum("_hits").alias("_hits")).filter("_hits > 0")


def session_conflicts(sessions: DataFrame, numeric: bool = False, skew_safe: bool = True,
                      courses: DataFrame | None = None) -> DataFrame:
    """C1 for every stored session at once: the number of *other* sessions
    it conflicts with (as a candidate, ``emploi_id`` = itself) and the flag.

    With ``courses`` given, only stored sessions whose course exists count,
    as the checker lists conflicts through an inner join to the course.
    Every non-NULL session matches its own class (arm three), so one is
    taken off for the session itself when it is among the stored ones."""
    s = _keys(sessions, numeric)
    if courses is not None:
        ids = courses.select(F.col("id").alias("cours_id")).withColumn("_own", F.lit(True))
        s = s.join(ids, "cours_id", "left")
        stored = s.filter(F.col("_own").isNotNull())
        own_stored = F.col("_own").isNotNull()
    else:
        stored = s
        own_stored = F.lit(True)
    cand_classes = interval_classes(sessions, numeric)
    per_class = class_hits(cand_classes, interval_classes(stored, numeric))
    per_class = cand_classes.select(*CLASS, F.col("n").alias("_n")).join(per_class, CLASS, "left")
    self_hit = conflict_cond(F.col("_a"), F.col("_b"), F.col("_a"), F.col("_b"))
    # a class holding many sessions is joined back with its rows salted
    out = annotate(s, per_class, CLASS, "_n", F.col("id"), skew_safe)
    nb = (F.coalesce(F.col("_hits"), F.lit(0))
          - F.when(F.coalesce(self_hit, F.lit(False)) & own_stored
                   & F.col("_hits").isNotNull(), 1).otherwise(0)).cast("bigint")
    return (out.withColumn("nb_conflits", nb)
            .withColumn("hasConflits", F.col("nb_conflits") > 0)
            .drop("_hits", "_a", "_b", "_own"))


#: Stored sessions of a class in one block, and candidates in one list.
BLOCK_ROWS = 4096
#: About as many candidates, of all classes, meet a session in one block: a task
#: holds the rows that it makes of one session.
BLOCK_CANDIDATES = 8 * BLOCK_ROWS


def _blocks(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size)).cast("int")


def _candidate_lists(cand: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates of each class (``c_`` before its columns) in lists
    ``_cands`` of at most ``BLOCK_ROWS``, however often an id comes.  A large
    class is first spread over tasks by ``cand_id``."""
    key = [f"c_{k}" for k in CLASS]
    spread = classes.select(*[F.col(k).alias(f"c_{k}") for k in CLASS], _blocks(F.col("n"), BLOCK_ROWS).alias("_lists"))
    c = cand.select("cand_id", "emploi_id", *[F.col(k).alias(f"c_{k}") for k in CLASS]).join(spread, key)
    c = c.withColumn("_list", F.pmod(F.xxhash64("cand_id"), F.col("_lists")).cast("int"))
    place = F.row_number().over(Window.partitionBy(*key, "_list").orderBy("cand_id", "emploi_id"))
    return (c.withColumn("_part", F.floor((place - 1) / F.lit(BLOCK_ROWS)))
            .groupBy(*key, "_list", "_part").agg(F.collect_list(F.struct("cand_id", "emploi_id")).alias("_cands")))


def conflicts(candidates: DataFrame, sessions: DataFrame, courses: DataFrame,
              numeric: bool = False) -> DataFrame:
    """C1 for a batch of candidate slots: for each candidate (``cand_id``,
    salle, jour, heure_debut, heure_fin, optional ``emploi_id`` to exclude),
    the stored sessions it conflicts with, with course name and code
    (inner join, J5).  Matching runs between classes; only the matching
    classes are expanded back to candidates and sessions.

    The pairs of a room-day grow with the square of its sessions, so they are
    made last, by a join after which no row is shuffled: each session meets
    lists of candidates, its columns are read once, and only the candidate
    changes from pair to pair.  The sessions must be the side that the join
    reads row by row, as a task holds the pairs of one such row; so it is a
    merge join, also where one side could be broadcast.  A block is about
    ``BLOCK_ROWS`` sessions of one class and ``BLOCK_CANDIDATES`` candidates of
    the classes that conflict with it; only where there are more are sessions or
    lists copied, to all blocks of the other side.  Blocks are dealt over all
    shuffle partitions (by number: AQE would merge them by the bytes of what
    goes in)."""
    cand = candidates
    if "emploi_id" not in cand.columns:
        cand = cand.withColumn("emploi_id", F.lit(None).cast("bigint"))
    ckey, skey = [f"c_{k}" for k in CLASS], [f"s_{k}" for k in CLASS]
    cclasses = interval_classes(cand, numeric)
    m = class_matches(cclasses, interval_classes(sessions, numeric)).select(*ckey, *skey, "n")
    met = m.join(cclasses.select(*[F.col(k).alias(f"c_{k}") for k in CLASS], F.col("n").alias("_met")), ckey)
    asked = met.groupBy(*skey).agg(_blocks(F.sum("_met"), BLOCK_CANDIDATES).alias("_nc"), _blocks(F.max("n"), BLOCK_ROWS).alias("_ns"))
    block = [*skey, "_cb", "_sb"]
    lists = _candidate_lists(cand, cclasses).join(m.drop("n"), ckey).join(asked, skey)
    lists = (lists.withColumn("_cb", F.pmod(F.xxhash64(*ckey, "_list", "_part"), F.col("_nc")).cast("int"))
             .withColumn("_sb", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1))).select(*block, "_cands"))
    others = [x for x in sessions.columns if x not in CLASS]
    crs = courses.select(F.col("id").alias("_c_id"), F.col("nom").alias("cours_nom"),
                         F.col("code").alias("cours_code"))
    s = sessions.select(*[F.col(k).alias(f"s_{k}") for k in CLASS], *others).join(asked, skey)
    s = s.join(crs, s["cours_id"] == crs["_c_id"], "inner").drop("_c_id")
    s = (s.withColumn("_sb", F.pmod(F.xxhash64("id"), F.col("_ns")).cast("int"))
         .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1))).select(*block, *others, "cours_nom", "cours_code"))
    n = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = s.repartition(n, *block).hint("merge").join(lists.repartition(n, *block), block)
    rows = rows.select(F.inline("_cands").alias("cand_id", "emploi_id"), *skey, *others, "cours_nom", "cours_code")
    rows = rows.filter(F.col("emploi_id").isNull() | (F.col("id") != F.col("emploi_id")))
    return rows.select("cand_id", *[F.col(f"s_{k}").alias(k) for k in CLASS], *others, "cours_nom", "cours_code")


def _checkable(sessions: DataFrame, courses: DataFrame) -> DataFrame:
    """Sessions whose course exists: the checker lists conflicts through an
    inner join to the course."""
    return sessions.join(courses.select(F.col("id").alias("cours_id")), "cours_id", "left_semi")


def conflict_classes(candidates: DataFrame, sessions: DataFrame, courses: DataFrame,
                     numeric: bool = False) -> DataFrame:
    """The conflicts of :func:`conflicts` between classes: a row for each
    candidate class and stored class (``s_`` before its times) of one room
    and day that conflict, with the number of candidates and of stored
    sessions in them.  Sessions and candidates carry their class in their own
    columns, so this and the two tables hold all pairs without expanding
    them; a candidate's own stored row is still among them."""
    cand = interval_classes(candidates, numeric)
    m = class_matches(cand, interval_classes(_checkable(sessions, courses), numeric))
    n = cand.select(*[F.col(k).alias(f"c_{k}") for k in CLASS], F.col("n").alias("nb_candidats"))
    return (m.join(n, [f"c_{k}" for k in CLASS])
            .select(*[F.col(f"c_{k}").alias(k) for k in CLASS], F.col("s_heure_debut"), F.col("s_heure_fin"),
                    "nb_candidats", F.col("n").alias("nb_seances")))


def has_conflicts(candidates: DataFrame, sessions: DataFrame, courses: DataFrame,
                  numeric: bool = False) -> DataFrame:
    """``nb_conflits`` and ``hasConflits`` per candidate (``cand_id``), from
    class totals: no pair of sessions is made.  A candidate's own stored row
    (``emploi_id``) is taken off where it is among the matches."""
    cand = candidates
    if "emploi_id" not in cand.columns:
        cand = cand.withColumn("emploi_id", F.lit(None).cast("bigint"))
    stored = _checkable(sessions, courses)
    classes = interval_classes(cand, numeric)
    per_class = (classes.select(*CLASS, F.col("n").alias("_n"))
                 .join(class_hits(classes, interval_classes(stored, numeric)), CLASS, "left"))
    own = _keys(stored, numeric).select(F.col("id").alias("emploi_id"), F.col("salle").alias("_o_salle"),
                                        F.col("jour").alias("_o_jour"), F.col("_a").alias("_o_a"), F.col("_b").alias("_o_b"))
    out = annotate(_keys(cand, numeric), per_class, CLASS, "_n", F.col("cand_id")).join(own, "emploi_id", "left")
    mine = F.coalesce((F.col("_o_salle") == F.col("salle")) & (F.col("_o_jour") == F.col("jour"))
                      & conflict_cond(F.col("_o_a"), F.col("_o_b"), F.col("_a"), F.col("_b")), F.lit(False))
    nb = (F.coalesce(F.col("_hits"), F.lit(0)) - F.when(mine, 1).otherwise(0)).cast("bigint")
    return out.select("cand_id", nb.alias("nb_conflits"), (nb > 0).alias("hasConflits"))


# -- W13: booking a batch of sessions ---------------------------------------------
def _first_come(contenders: DataFrame) -> DataFrame:
    """(seq, accepted): first-come over the contenders of each room-day, in
    SQL.  A room-day has at most one contender for each interval class, as
    many as the clock has times, so its ordered array is bounded by that and
    not by the data; folding it, a slot is taken unless it conflicts with one
    that was."""
    slots = F.array_sort(F.collect_list(F.struct("seq", "_a", "_b")))
    nothing = F.filter("_slots", lambda _: F.lit(False))
    taken = F.aggregate("_slots", nothing, lambda acc, c: F.when(
        F.exists(acc, lambda s: F.coalesce(conflict_cond(s["_a"], s["_b"], c["_a"], c["_b"]), F.lit(False))), acc)
        .otherwise(F.concat(acc, F.array(c))))
    return (contenders.groupBy(*ROOM_DAY).agg(slots.alias("_slots"))
            .select(F.explode(taken).alias("_s")).select(F.col("_s.seq").alias("seq"), F.lit(True).alias("accepted")))


def book_sessions(sessions: DataFrame, batch: DataFrame, courses: DataFrame,
                  numeric: bool = False) -> DataFrame:
    """Check a batch of new sessions (with a unique ``seq``, the arrival
    order) as if posted one by one: course must exist, then no conflict with
    a stored session or with an earlier accepted row of the batch.

    Returns the batch with ``accepted`` and ``reason`` (first failing check:
    ``invalide`` (V6 rules, see quality), ``cours_introuvable``,
    ``conflit``).  Exact and skew-safe: all rows of one interval class share
    their conflicts, so only the first row of a class can be accepted; the
    ordered pass runs over those contenders only, per room-day."""
    from .quality import RULES, ParentCheck, check_parents, validate

    v = validate(batch, RULES["timetable"])
    v = check_parents(v, [ParentCheck("cours_introuvable", courses, ("cours_id",), ("id",), unique=True)],
                      reason_col="_course_reason")
    v = v.withColumn("_course_ok", F.col("_course_reason").isNull()).drop("_course_reason")
    ok = v.filter((F.size("errors") == 0) & F.col("_course_ok"))

    classes = interval_classes(ok, numeric)
    base_hit = (class_hits(classes, interval_classes(sessions, numeric))
                .select(*CLASS).withColumn("_base_conflict", F.lit(True)))
    contenders = ok.groupBy(*CLASS).agg(F.min("seq").alias("seq"))
    contenders = (contenders.join(base_hit, CLASS, "left")
                  .filter(F.col("_base_conflict").isNull()).drop("_base_conflict"))
    contenders = _keys(contenders, numeric)
    decided = _first_come(contenders)
    out = v.join(decided, "seq", "left")
    reason = (F.when(F.size("errors") > 0, F.lit("invalide"))
              .when(~F.col("_course_ok"), F.lit("cours_introuvable"))
              .when(~F.coalesce(F.col("accepted"), F.lit(False)), F.lit("conflit")))
    return (out.withColumn("reason", reason)
            .withColumn("accepted", F.col("reason").isNull())
            .drop("_course_ok"))


def update_sessions(sessions: DataFrame, changes: DataFrame, seq: str = "seq",
                    numeric: bool = False):
    """W4 for the timetable: rules (V6), the row exists, then the new slot
    must not conflict with any *other* stored session (``id != ?``, F8);
    accepted changes replace all slot columns (T19).  Checked against the
    table as it stands before the batch.

    Class-level as in :func:`session_conflicts`: the new slot's class is
    matched against the stored classes, and the row's own stored slot is
    taken off when it is among the matches."""
    from .changes import ChangeSet, full_update
    from .quality import RULES, validate

    v = validate(changes, RULES["timetable"])
    ids = sessions.select(F.col("id").alias("_exists"), F.col("salle").alias("_o_salle"),
                          F.col("jour").alias("_o_jour"), F.col("heure_debut").alias("_o_a"),
                          F.col("heure_fin").alias("_o_b"))
    v = v.join(ids, v["id"] == ids["_exists"], "left")
    ok = v.filter((F.size("errors") == 0) & F.col("_exists").isNotNull())
    cand = _keys(ok.select(*CLASS).distinct(), numeric)
    hits = class_hits(cand, interval_classes(sessions, numeric))
    counts = ok.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("_n"))
    per_class = counts.join(hits, CLASS, "left")
    v = annotate(v, per_class, CLASS, "_n", F.col(seq))
    if numeric:
        oa, ob = time_minutes("_o_a"), time_minutes("_o_b")
        na, nb = time_minutes("heure_debut"), time_minutes("heure_fin")
    else:
        oa, ob, na, nb = (F.col("_o_a"), F.col("_o_b"), F.col("heure_debut"),
                          F.col("heure_fin"))
    own = ((F.col("_o_salle") == F.col("salle")) & (F.col("_o_jour") == F.col("jour"))
           & conflict_cond(oa, ob, na, nb))
    others = F.coalesce(F.col("_hits"), F.lit(0)) - F.when(F.coalesce(own, F.lit(False)), 1) \
        .otherwise(0)
    reason = (F.when(F.size("errors") > 0, F.lit("invalide"))
              .when(F.col("_exists").isNull(), F.lit("introuvable"))
              .when(others > 0, F.lit("conflit")))
    v = v.withColumn("reason", reason).drop("_exists", "_o_salle", "_o_jour", "_o_a", "_o_b",
                                             "_hits")
    accepted = v.filter(F.col("reason").isNull()).drop("errors", "reason")
    cols = ["cours_id", "jour", "heure_debut", "heure_fin", "salle", "type_seance"]
    upd = full_update(sessions, accepted, cols, "emplois_temps", seq=seq, unique=[])
    return ChangeSet(upd.table, upd.accepted, v.filter(F.col("reason").isNotNull()), v)
