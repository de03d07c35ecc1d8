"""Bursts across micro-batches, late events, and state that forgets, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_store import EVENT, T0
from test_store import bursts as bursts_by_hand

from chunkloom.streaming import changes
from chunkloom.streaming.bursts import Bursts

GAP = dt.timedelta(minutes=6)
KINDS = ["create", "modify", "remove", "access"]


def feed(seed, n):
    """Batches of events, some of which come a batch late."""
    draw = random.Random(seed)
    out = [[] for _ in range(5)]
    for k in range(n):
        at = T0 + dt.timedelta(seconds=k * 97, microseconds=k)
        turn = min(4, k * 5 // n + (draw.random() < 0.08))
        out[turn].append((k, draw.choice("abc"), draw.choice(KINDS), at))
    return out


def by_hand(batches, delay):
    limit, on_time, late = None, [], []
    for number, batch in enumerate(batches):
        for event in batch:
            if event[2] in changes.ACCEPTED:
                (late if limit is not None and event[3] < limit else on_time).append((*event, number))
        times = [e[3] for e in batch]
        if times:
            limit = max([max(times) - delay, *([limit] if limit else [])])
    return on_time, late, limit


def frame(spark, events):
    return spark.createDataFrame(events, "event_id long, path string, kind string, ts timestamp")


def test_batches_give_the_bursts_of_the_whole(spark, tmp_path):
    batches = feed(1, 400)
    delay = dt.timedelta(minutes=10)
    on_time, late, limit = by_hand(batches, delay)
    state = Bursts(spark, str(tmp_path / "state"), "6 minutes")
    closed = []
    for number, batch in enumerate(batches):
        for _ in range(2 if number == 2 else 1):  # one replay
            got = [tuple(r) for r in state.step(frame(spark, batch), number).collect()]
        closed += got
    want = bursts_by_hand([(e[0], e[1], e[2], e[3]) for e in on_time], GAP)
    ended = sorted(b for b in want if b[2] + GAP < limit)
    strip = lambda r: (r[0], r[1].replace(tzinfo=None), r[2].replace(tzinfo=None), r[3], r[4])
    assert sorted(map(strip, closed)) == sorted(strip(b) for b in ended) and len(ended) > 20
    assert sorted(r.event_id for r in state.late().collect()) == sorted(e[0] for e in late) and late
    # a heartbeat closes the rest, and state of batches that no replay needs is gone
    rest = state.step(frame(spark, [(None, None, None, T0 + dt.timedelta(days=9))]), 5)
    assert len(closed) + rest.count() == len(want)
    assert len(list((tmp_path / "state" / "open").iterdir())) == 2
    assert state.step(frame(spark, []), 6).count() == 0


def test_no_late_events_yet(spark, tmp_path):
    assert Bursts(spark, str(tmp_path / "none"), "1 minute").late().collect() == []


def test_state_forgets_removed_and_silent_paths(spark, tmp_path):
    day = dt.timedelta(days=1)
    batches = [
        [(1, "a", "create", T0), (2, "b", "create", T0), (3, "b", "remove", T0 + day), (4, "c", "create", T0)],
        [(5, "a", "modify", T0 + 2 * day), (6, "d", "create", T0 + 9 * day)],
        [(7, "b", "create", T0 + 10 * day), (8, "c", "modify", T0 + 10 * day), (9, "d", "modify", T0 + 10 * day)],
        [(10, "x", "create", T0 + 30 * day), (11, "x", "remove", T0 + 30 * day + GAP), (12, "y", "create", T0 + 30 * day)],
    ]
    folder, seen, sizes = str(tmp_path / "feed"), {}, []
    for number, batch in enumerate(batches):
        events = [(i, p, k, t) for i, p, k, t in batch]
        spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(folder)
        state = changes.path_state_ttl(changes.read_feed(spark, folder, EVENT, files_per_trigger=1), "3 days")

        def keep(df, _):
            seen.update({r.path: (r.present, r.last_kind, r.changes) for r in df.collect()})

        run = state.writeStream.option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
        sizes.append(run.lastProgress.stateOperators[0].numRowsTotal)
    assert seen["a"] == (True, "modify", 2)
    assert seen["b"] == (True, "create", 1)  # counted anew after its removal
    assert seen["c"] == (True, "modify", 1)  # and after ten silent days
    assert seen["d"] == (True, "modify", 2) and seen["x"] == (False, "remove", 2)
    assert sizes[-1] == 1  # of six paths, only y lives


def test_columns_of_the_state(spark, tmp_path):
    spark.createDataFrame([(1, "p", "modify", T0)], EVENT).write.parquet(str(tmp_path / "f"))
    state = changes.path_state_ttl(changes.read_feed(spark, str(tmp_path / "f"), EVENT), "1 day")
    changes.drain(state, str(tmp_path / "o"), str(tmp_path / "c"), "update")
    found = changes.newest(spark, str(tmp_path / "o"), "path").where(F.col("present"))
    assert [tuple(r) for r in found.select("path", "last_kind", "changes").collect()] == [("p", "modify", 1)]
