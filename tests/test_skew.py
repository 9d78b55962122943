"""Hot keys: one student with a third of the grades, one room-day with a
third of the sessions, one key with a third of a batch.  Results must equal
the brute-force answer, with AQE forced to split skewed partitions."""

import contextlib
import datetime as dt
import random
from collections import defaultdict


from quadrangle.operators import grades, quality, schedule
from quadrangle.plans.inspect import physical


@contextlib.contextmanager
def forced_skew(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _r2(x):
    import math
    return math.floor(x * 100 + 0.5) / 100


def test_hot_student_general_average(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        e = 1 if i % 3 == 0 else rng.randint(2, 200)
        rows.append((i, e, rng.randint(1, 20), float(rng.randint(0, 20)),
                     float(rng.randint(0, 3)), "A", dt.date(2024, 1, 1)))
    notes = spark.createDataFrame(rows, "id long, etudiant_id long, cours_id long, note double, "
                                        "coefficient double, type_evaluation string, "
                                        "date_evaluation date")
    courses = spark.createDataFrame([(c, f"C{c}", f"c{c}", 1 + c % 4) for c in range(1, 21)],
                                    "id long, nom string, code string, credits int")
    with forced_skew(spark):
        got = {r.etudiant_id: r.moyenneGenerale
               for r in grades.general_average(notes, courses).collect()}
    # brute force: literal per-student computation
    per = defaultdict(lambda: [0.0, 0, 0.0, 0])
    for _, e, c, n, w, _, _ in rows:
        p = per[(e, c)]
        p[0] += n * w; p[1] += 1; p[2] += w; p[3] += 1
    acc = defaultdict(lambda: [0, 0])
    for (e, c), (snw, k1, sw, k2) in per.items():
        avg_w = sw / k2
        m = 0.0 if avg_w == 0 else _r2((snw / k1) / avg_w)
        acc[e][0] += int(round(m * 100)) * (1 + c % 4)
        acc[e][1] += 1 + c % 4
    want = {e: (_r2(tp / 100.0 / tc) if tc > 0 else 0.0) for e, (tp, tc) in acc.items()}
    assert got == want


def test_hot_key_uniqueness_splits_and_stays_exact(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "seq long, k string")
    with forced_skew(spark):
        out = quality.check_unique(df, ["k"])
        res = out.groupBy("reason").count().collect()
        p = physical(out)
    counts = {r.reason: r["count"] for r in res}
    assert counts == {None: 2000 + 1, "doublon_lot": 999}
    assert "AdaptiveSparkPlan" in p


def test_hot_room_day_conflicts(spark):
    rng = random.Random(3)
    times = [f"{h}:{m:02d}" for h in range(8, 19) for m in (0, 30)]
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        a, b = sorted(rng.sample(times, 2))
        rows.append((i, "S0" if hot else f"S{rng.randint(1, 60)}",
                     "Lundi" if hot else rng.choice(["Mardi", "Jeudi"]), a, b))
    s = spark.createDataFrame(rows, "id long, salle string, jour string, heure_debut string, "
                                    "heure_fin string")
    with forced_skew(spark):
        got = {r.id: r.nb_conflits for r in schedule.session_conflicts(s).collect()}

    def arms(sa, sb, ca, cb):
        return (sa <= ca and sb > ca) or (sa < cb and sb >= cb) or (sa >= ca and sb <= cb)

    by = defaultdict(list)
    for r in rows:
        by[(r[1], r[2])].append(r)
    want = {}
    for group in by.values():
        for c in group:
            want[c[0]] = sum(1 for x in group if x[0] != c[0] and arms(x[3], x[4], c[3], c[4]))
    assert got == want


@contextlib.contextmanager
def low_hot_threshold(spark, rows=50):
    spark.conf.set("quadrangle.skew.minRows", str(rows))
    try:
        yield
    finally:
        spark.conf.unset("quadrangle.skew.minRows")


def test_salted_uniqueness_equals_plain(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "seq long, k string")
    plain = {r.seq: r.reason for r in quality.check_unique(df, ["k"], skew_safe=False).collect()}
    with low_hot_threshold(spark):
        out = quality.check_unique(df, ["k"])
        salted = {r.seq: r.reason for r in out.collect()}
        p = physical(out)
    assert salted == plain
    assert "_salt" in p and "xxhash64" in p


def test_heavy_hitters_is_bounded(spark):
    from quadrangle.plans.skew import heavy_hitters
    counts = spark.createDataFrame([(f"k{i}", 1000 if i < 5 else 1) for i in range(2000)],
                                   "k string, n long")
    hot = heavy_hitters(counts, ["k"], "n", max_keys=10, min_rows=10)
    assert sorted(r.k for r in hot.collect()) == ["k0", "k1", "k2", "k3", "k4"]
    # no more than max_keys keys can exceed total / max_keys
    flat = spark.createDataFrame([(f"k{i}", 100) for i in range(2000)], "k string, n long")
    assert heavy_hitters(flat, ["k"], "n", max_keys=10, min_rows=1) is None


def test_hot_key_over_two_unique_keys(spark):
    from tests.test_sequential import simulate_unique
    rng = random.Random(11)
    rows = [{"seq": i, "matricule": f"m{rng.randint(1, 400)}",
             "email": "hot@x.fr" if i % 3 == 0 else f"e{rng.randint(1, 900)}"}
            for i in range(1, 1201)]
    df = spark.createDataFrame(rows, "seq long, matricule string, email string")
    with low_hot_threshold(spark, 20), forced_skew(spark):
        got = {r.seq: r.reason for r in quality.check_unique_multi(
            df, [["matricule"], ["email"]]).collect()}
    assert got == simulate_unique(rows, ["matricule", "email"], [set(), set()])


def test_booking_with_a_hot_room_day(spark):
    from tests.test_sequential import SCHEMA, simulate_booking
    rng = random.Random(5)
    times = [f"{h}:{m:02d}" for h in range(8, 19) for m in (0, 30)]

    def slot(i, hot):
        a, b = sorted(rng.sample(times, 2))
        return {"id": i, "seq": i, "cours_id": rng.choice([1, 2, 3, 99]),
                "jour": "Lundi" if hot else rng.choice(["Mardi", "Jeudi"]),
                "heure_debut": a, "heure_fin": b,
                "salle": "S0" if hot else f"S{rng.randint(1, 20)}", "type_seance": "cours"}

    base = [slot(i, i % 3 == 0) for i in range(1, 31)]
    batch = [slot(i, i % 3 == 0) for i in range(100, 400)]
    courses = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    with low_hot_threshold(spark, 20), forced_skew(spark):
        got = {r.seq: r.reason for r in schedule.book_sessions(
            spark.createDataFrame(base, SCHEMA), spark.createDataFrame(batch, SCHEMA),
            courses).collect()}
    assert got == simulate_booking(base, batch, {1, 2, 3})
