"""Order-dependent batch operators against a brute-force one-row-at-a-time
simulation on small random fixtures (the reference handles one request at
a time, so the simulation *is* its semantics)."""

import random

import pytest
from pyspark.sql import functions as F

from quadrangle.operators import quality, schedule

DAYS = ["Lundi", "Mardi"]
TIMES = ["8:00", "9:00", "9:30", "10:00", "10:30", "11:00", "12:00", "14:00"]


def arms(s, c):
    (sa, sb), (ca, cb) = s, c
    return (sa <= ca and sb > ca) or (sa < cb and sb >= cb) or (sa >= ca and sb <= cb)


def simulate_booking(base, batch, courses):
    stored = [dict(r) for r in base]
    out = {}
    for r in sorted(batch, key=lambda r: r["seq"]):
        if r["cours_id"] not in courses:
            out[r["seq"]] = "cours_introuvable"
            continue
        hit = any(s["salle"] == r["salle"] and s["jour"] == r["jour"]
                  and arms((s["heure_debut"], s["heure_fin"]), (r["heure_debut"], r["heure_fin"]))
                  for s in stored)
        if hit:
            out[r["seq"]] = "conflit"
            continue
        out[r["seq"]] = None
        stored.append(r)
    return out


def _sessions(rng, n, id0):
    rows = []
    for i in range(n):
        a, b = sorted(rng.sample(TIMES, 2)) if rng.random() < 0.8 else rng.sample(TIMES, 2)
        rows.append({"id": id0 + i, "seq": id0 + i, "cours_id": rng.choice([1, 2, 3, 99]),
                     "jour": rng.choice(DAYS), "heure_debut": a, "heure_fin": b,
                     "salle": rng.choice(["S1", "S2"]), "type_seance": "cours"})
    return rows


SCHEMA = ("id long, seq long, cours_id long, jour string, heure_debut string, "
          "heure_fin string, salle string, type_seance string")


@pytest.mark.parametrize("seed", range(6))
def test_book_sessions_matches_sequential(spark, seed):
    rng = random.Random(seed)
    base = _sessions(rng, 6, 1)
    batch = _sessions(rng, 25, 100)
    courses = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.seq: r.reason for r in schedule.book_sessions(
        spark.createDataFrame(base, SCHEMA), spark.createDataFrame(batch, SCHEMA),
        courses).collect()}
    assert got == simulate_booking(base, batch, {1, 2, 3})


def simulate_unique(rows, keys, base_vals):
    taken = [set(v) for v in base_vals]
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        vals = [r[k] for k in keys]
        if any(v is not None and v in t for v, t in zip(vals, base_vals)):
            out[r["seq"]] = "doublon"
        elif any(v is not None and v in t for v, t in zip(vals, taken)):
            out[r["seq"]] = "doublon_lot"
        else:
            out[r["seq"]] = None
            for v, t in zip(vals, taken):
                if v is not None:
                    t.add(v)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_over_two_keys_matches_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [{"seq": i, "matricule": rng.choice(["m1", "m2", "m3", "m4", "m5", None]),
             "email": rng.choice(["a", "b", "c", "d", "e", "f", None])} for i in range(1, 30)]
    base = spark.createDataFrame([("m5", "z"), ("m9", "f")], "matricule string, email string")
    df = spark.createDataFrame(rows, "seq long, matricule string, email string")
    got = {r.seq: r.reason for r in quality.check_unique_multi(
        df, [["matricule"], ["email"]], base).collect()}
    assert got == simulate_unique(rows, ["matricule", "email"], [{"m5", "m9"}, {"z", "f"}])


def test_unique_single_key_first_wins(spark):
    df = spark.createDataFrame([(3, "k"), (1, "k"), (2, None), (4, "x"), (5, None)],
                               "seq long, k string")
    base = spark.createDataFrame([("x",)], "k string")
    got = {r.seq: r.reason for r in quality.check_unique(df, ["k"], base).collect()}
    assert got == {1: None, 3: "doublon_lot", 2: None, 4: "doublon", 5: None}


def brute_conflicts(rows):
    out = {}
    for c in rows:
        out[c["id"]] = sum(1 for s in rows if s["id"] != c["id"] and s["salle"] == c["salle"]
                           and s["jour"] == c["jour"]
                           and arms((s["heure_debut"], s["heure_fin"]),
                                    (c["heure_debut"], c["heure_fin"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_session_conflicts_match_pairwise(spark, seed):
    rng = random.Random(seed)
    rows = _sessions(rng, 40, 1)
    got = {r.id: r.nb_conflits for r in schedule.session_conflicts(
        spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_conflicts(rows)


def test_conflict_listing_excludes_the_session_itself(spark):
    rows = [{"id": 1, "seq": 1, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
             "heure_fin": "9:00", "salle": "S1", "type_seance": "tp"},
            {"id": 2, "seq": 2, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
             "heure_fin": "9:00", "salle": "S1", "type_seance": "tp"}]
    s = spark.createDataFrame(rows, SCHEMA)
    courses = spark.createDataFrame([(1, "Algo", "C-1")], "id long, nom string, code string")
    cand = s.select(F.col("id").alias("cand_id"), F.col("id").alias("emploi_id"),
                    *schedule.CLASS)
    pairs = {(r.cand_id, r.id) for r in schedule.conflicts(cand, s, courses).collect()}
    assert pairs == {(1, 2), (2, 1)}
    flags = {r.cand_id: r.hasConflits for r in schedule.has_conflicts(cand, s, courses).collect()}
    assert flags == {1: True, 2: True}


def test_update_sessions_checks_other_rows_only(spark):
    base = [
        {"id": 1, "seq": 0, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
         "heure_fin": "10:00", "salle": "S1", "type_seance": "tp"},
        {"id": 2, "seq": 0, "cours_id": 1, "jour": "Lundi", "heure_debut": "10:00",
         "heure_fin": "12:00", "salle": "S1", "type_seance": "tp"},
    ]
    changes = [
        # moves within its own slot: conflicts only with itself -> accepted
        {"id": 1, "seq": 1, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:30",
         "heure_fin": "9:30", "salle": "S1", "type_seance": "td"},
        # moves onto session 1 -> conflict with another row
        {"id": 2, "seq": 2, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
         "heure_fin": "9:00", "salle": "S1", "type_seance": "tp"},
        # unknown row
        {"id": 9, "seq": 3, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
         "heure_fin": "9:00", "salle": "S2", "type_seance": "tp"},
        # invalid day
        {"id": 2, "seq": 4, "cours_id": 1, "jour": "lundi", "heure_debut": "8:00",
         "heure_fin": "9:00", "salle": "S2", "type_seance": "tp"},
    ]
    cs = schedule.update_sessions(spark.createDataFrame(base, SCHEMA),
                                  spark.createDataFrame(changes, SCHEMA))
    assert {r.seq: r.reason for r in cs.report.collect()} == {
        1: None, 2: "conflit", 3: "introuvable", 4: "invalide"}
    t = {r.id: (r.heure_debut, r.type_seance) for r in cs.table.collect()}
    assert t == {1: ("8:30", "td"), 2: ("10:00", "tp")}


def test_session_conflicts_ignore_sessions_of_missing_courses(spark):
    rows = [{"id": 1, "seq": 1, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:00",
             "heure_fin": "9:00", "salle": "S1", "type_seance": "tp"},
            {"id": 2, "seq": 2, "cours_id": 99, "jour": "Lundi", "heure_debut": "8:00",
             "heure_fin": "9:00", "salle": "S1", "type_seance": "tp"},
            {"id": 3, "seq": 3, "cours_id": 1, "jour": "Lundi", "heure_debut": "8:30",
             "heure_fin": "9:30", "salle": "S1", "type_seance": "tp"}]
    s = spark.createDataFrame(rows, SCHEMA)
    courses = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r.nb_conflits for r in schedule.session_conflicts(s, courses=courses).collect()}
    assert got == {1: 1, 2: 2, 3: 1}   # session 2 (no course) is never counted as a conflict


@pytest.mark.parametrize("numeric", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_conflict_counts_and_classes_match_the_listing(spark, seed, numeric):
    rng = random.Random(50 + seed)
    rows = _sessions(rng, 60, 1) + [{"id": 900, "seq": 900, "cours_id": 1, "jour": None, "heure_debut": "8:00", "heure_fin": "9:00",
                                     "salle": "S1", "type_seance": "tp"}]
    s = spark.createDataFrame(rows, SCHEMA)
    courses = spark.createDataFrame([(i, f"C{i}", f"c{i}") for i in (1, 2, 3)], "id long, nom string, code string")
    cand = s.filter("id % 3 = 0 OR id = 900").select(F.col("id").alias("cand_id"), F.col("id").alias("emploi_id"), *schedule.CLASS)
    listed = schedule.conflicts(cand, s, courses, numeric).collect()
    counted = {r.cand_id: r.nb_conflits for r in schedule.has_conflicts(cand, s, courses, numeric).collect()}
    assert counted == {r.cand_id: sum(x.cand_id == r.cand_id for x in listed) for r in cand.collect()}
    # with the candidates' own rows, the classes hold as many pairs as the listing
    free = schedule.conflicts(cand.drop("emploi_id"), s, courses, numeric).count()
    assert schedule.conflict_classes(cand, s, courses, numeric).selectExpr("sum(nb_candidats * nb_seances)").first()[0] == free


def test_conflict_pairs_are_made_in_blocks_behind_the_last_shuffle(spark, monkeypatch):
    monkeypatch.setattr(schedule, "BLOCK_ROWS", 3)
    rows = [(i, i % 3, "S1", "Lundi", f"1{i % 2}:00", f"1{i % 2 + 1}:30") for i in range(40)]
    rows += [(i, i % 4, "S2", "Mardi", "10:00", "11:00") for i in range(40, 47)] + [(47, 1, None, "Lundi", "10:00", "11:00")]
    rows += rows[:2]  # rows that come twice, courses too
    s = spark.createDataFrame(rows, "id long, cours_id long, salle string, jour string, heure_debut string, heure_fin string")
    courses = spark.createDataFrame([(i % 3, f"n{i % 3}", f"c{i % 3}") for i in range(4)], "id long, nom string, code string")
    cand = s.filter("id % 2 = 0 OR id = 47").select(F.col("id").alias("cand_id"), F.col("id").alias("emploi_id"), *schedule.CLASS)
    got = schedule.conflicts(cand, s, courses)
    held = [0, 1, 2, 0]
    test = lambda x, c: (x[4] <= c[4] < x[5]) or (x[4] < c[5] <= x[5]) or (x[4] >= c[4] and x[5] <= c[5])
    want = sorted((c[0], x[0], f"c{x[1]}") for c in rows if c[0] % 2 == 0 or c[0] == 47 for x in rows for h in held
                  if h == x[1] and x[2:4] == c[2:4] and c[2] and x[0] != c[0] and test(x, c))
    assert sorted((r.cand_id, r.id, r.cours_code) for r in got.collect()) == want
    # courses are joined to the sessions, not to the pairs: both sides of the
    # last join are dealt out by number, and nothing is shuffled after it
    plan = schedule.conflicts(cand, s, courses)._jdf.queryExecution().executedPlan().toString()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert "Exchange" not in plan[:plan.index("Join")] and plan.count(f", {n}), REPARTITION_BY_NUM") == 2


def test_conflict_pairs_come_from_lists_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(schedule, "BLOCK_ROWS", 4)
    monkeypatch.setattr(schedule, "BLOCK_CANDIDATES", 10)
    s_rows = [(i if i % 9 else None, i % 3, "S1", "Lundi", f"1{i % 3}:00", f"1{i % 3 + 1}:30") for i in range(1, 31)]
    s = spark.createDataFrame(s_rows, "id long, cours_id long, salle string, jour string, heure_debut string, heure_fin string")
    courses = spark.createDataFrame([(i, f"n{i}", f"c{i}") for i in range(2)], "id long, nom string, code string")
    # ids that come often or are null, exclusions that are null or another row's
    c_rows = [(None if i % 4 == 0 else 7, i % 5 or None, "S1", "Lundi", f"1{i % 2}:00", f"1{i % 2 + 1}:00") for i in range(60)]
    c_rows += [(8, 1, "S2", "Lundi", "10:00", "11:00"), (9, 1, None, "Lundi", "10:00", "11:00")]
    cand = spark.createDataFrame(c_rows, "cand_id long, emploi_id long, salle string, jour string, heure_debut string, heure_fin string")
    test = lambda x, c: (x[4] <= c[4] < x[5]) or (x[4] < c[5] <= x[5]) or (x[4] >= c[4] and x[5] <= c[5])
    want = sorted((str(c[0]), str(x[0]), x[4], f"c{x[1]}") for c in c_rows for x in s_rows if x[1] < 2 and x[2:4] == c[2:4] and test(x, c)
                  and (c[1] is None or (x[0] is not None and x[0] != c[1])))
    got = schedule.conflicts(cand, s, courses)
    assert sorted((str(r.cand_id), str(r.id), r.heure_debut, r.cours_code) for r in got.collect()) == want and len(want) > 500
    sizes = [len(r._cands) for r in schedule._candidate_lists(cand, schedule.interval_classes(cand)).collect()]
    assert sum(sizes) == len(c_rows) - 1 and max(sizes) == 4
    # sessions are read row by row, lists are what waits for them; a pair is
    # made behind the join, from one session and one entry of a list
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline(_cands") < plan.index("SortMergeJoin")
    first = plan.index("REPARTITION_BY_NUM")
    second = plan.index("REPARTITION_BY_NUM", first + 1)
    assert "cours_nom" in plan[first:second] and "collect_list" in plan[second:] and "collect_list" not in plan[:second]
