"""foreachBatch wrapper: two micro-batches of absences, the second sees the
table written by the first."""

import datetime as dt
import tempfile

from quadrangle.operators import changes
from quadrangle.sources.deltas import DeltaTable
from quadrangle.streaming.batches import checked_append_stream, latest_version

SCHEMA = ("seq long, etudiant_id long, cours_id long, date_absence date, motif string, "
          "justifiee boolean")


def test_checked_append_stream(spark):
    root = tempfile.mkdtemp(prefix="quad-stream-")
    students = spark.createDataFrame([(1,)], "id long")
    courses = spark.createDataFrame([(10,)], "id long")
    enrol = spark.createDataFrame([(1, 10)], "etudiant_id long, cours_id long")
    base = spark.createDataFrame([(1, 1, 10, dt.date(2024, 1, 1), None, False)],
                                 "id long, etudiant_id long, cours_id long, date_absence date, "
                                 "motif string, justifiee boolean")
    base.write.parquet(f"{root}/base")
    spark.createDataFrame([(1, 1, 10, dt.date(2024, 1, 2), None, False),
                           (2, 1, 10, dt.date(2024, 1, 1), None, False)], SCHEMA) \
        .write.parquet(f"{root}/in/part1")

    def rule(table, batch):
        return changes.add_absences(table, batch, students, courses, enrol,
                                    as_of=dt.datetime(2024, 2, 1), materialize=True)

    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/part1")
    q = checked_append_stream(stream, f"{root}/base", f"{root}/out", "absences", rule,
                              f"{root}/ckpt")
    q.awaitTermination(120)
    table = DeltaTable(spark, f"{root}/out", "absences")
    got = sorted((r.date_absence, r.id) for r in table.read().collect())
    assert spark.read.parquet(f"{root}/out/absences/delta=0/added").count() == 1  # what changed, not the table
    assert got == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)]
    rej = spark.read.parquet(f"{root}/out/absences_rejected").collect()
    assert [(r.seq, r.reason) for r in rej] == [(2, "doublon")]


def test_replayed_epoch_does_not_build_on_itself(spark):
    root = tempfile.mkdtemp(prefix="quad-replay-")
    df = spark.createDataFrame([(1,)], "id long")
    for e in (0, 1, 2):
        df.write.parquet(f"{root}/out/t/epoch={e}")
    assert latest_version(spark, f"{root}/out", "t").endswith("epoch=2")
    assert latest_version(spark, f"{root}/out", "t", before=2).endswith("epoch=1")
    assert latest_version(spark, f"{root}/out", "t", before=0) is None


def test_delta_table_against_a_dictionary(spark):
    """Random appends, replacements and deletes; every epoch replayed once,
    after a failed attempt; compacted and vacuumed on the way."""
    import random

    r, root = random.Random(8), tempfile.mkdtemp(prefix="quad-delta-")
    t = DeltaTable(spark, root, "t", compact_every=3)
    want = {i: "base" for i in range(20)}
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    t.create(frame(list(want.items())))
    history = [dict(want)]
    for e in range(7):
        gone = r.sample(sorted(want), 3)
        added = {**{k: f"e{e}" for k in gone[:2]}, 100 + e: f"new{e}"}  # two replaced, one deleted
        deleted = frame([(k, None) for k in gone]) if e != 2 else None
        if e == 2:
            added = {102: "new2"}
        for attempt in (0, 1):
            if not attempt and e == 4:  # written, but not committed
                t._write(frame([(999, "lost")]), f"delta={e}", "/added")
                assert {x.id: x.v for x in t.read().collect()} == want
            t.commit(e, frame(list(added.items())), deleted)
        want = {k: v for k, v in want.items() if deleted is None or k not in gone} | added
        history.append(dict(want))
        assert {x.id: x.v for x in t.read().collect()} == want
    assert t.epochs("base") == [-1, 2, 5]
    for e, then in enumerate(history):  # as it was before epoch e
        assert {x.id: x.v for x in t.read(before=e).collect()} == then
    assert t.vacuum(replayable=7) and t.epochs("base") == [5] and t.epochs("delta") == [6]
    assert {x.id: x.v for x in t.read().collect()} == want
