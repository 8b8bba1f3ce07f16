"""Streams in the order of time against plain loops, in parts that restart from their checkpoint."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from heron.operators.runtime import spend
from heron.plans.streams import in_parts
from heron.streaming import ordered

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def cut(spark, rows, schema, times, borders):
    """Rows in parts by time, each part in disorder and over several files."""
    parts, rng = [], random.Random(1)
    for lo, hi in zip([None, *borders], [*borders, None], strict=True):
        own = [r for r in rows if (lo is None or r[times] >= lo) and (hi is None or r[times] < hi)]
        rng.shuffle(own)
        parts.append(spark.createDataFrame(own, schema).repartition(2))
    return parts


def plain_budget(events, cost, beat_cost):
    out = []
    for user in sorted({e[0] for e in events}):
        energy, day, sleep, spill = 100, None, None, []
        for place, (_, event_id, ts, beat, payload) in enumerate(sorted((e for e in events if e[0] == user), key=lambda e: (e[2], e[1]))):
            if day is not None and ts.date() > day:
                energy = min(200, energy + 100 * (ts.date() - day).days)
            day = ts.date() if day is None else max(day, ts.date())
            while spill:
                i, _, p = spill[0]
                try:
                    ok = isinstance(json.loads(p or ""), dict)
                except ValueError:
                    ok = False
                if ok and energy < cost:
                    break
                energy -= cost if ok else 0
                spill.pop(0)
                out.append((user, i, "replayed" if ok else "deleted", event_id, energy, len(spill), sleep))
            sleep = sleep if spill else None
            c = beat_cost if beat else cost
            if energy >= c:
                energy -= c
                what = "processed"
            elif beat:
                what = "dropped"
            else:
                spill = sorted([*spill, (event_id, place, payload)])
                sleep, what = sleep or ts, "buffered"
            out.append((user, event_id, what, None, energy, len(spill), sleep))
    return out


def test_a_spill_is_drained_in_order(spark):
    """Ids that don't follow time, equal times, payloads that are no objects, and users of one event."""
    rng = random.Random(7)
    payload = lambda: rng.choice(['{"k": 1}', '{"k"', "[1]", None, "", '{"x": "\\u00e9 \\" \\n"}'])
    events = [(u, i, at(rng.randrange(0, 6 * 1440, 30)), rng.random() < 0.2, payload()) for u, n in ((1, 60), (2, 1), (3, 25)) for i in rng.sample(range(1000), n)]
    parts = cut(spark, events, "user_id long, event_id long, ts timestamp, beat boolean, payload string", 2, [at(2000), at(2001), at(5000)])
    out = in_parts(spark, parts, lambda s: ordered.budget_stream(s, F.col("beat"), F.col("payload"), 40, 90))
    # What has the last time of all is known, as the watermark has reached it.
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, plain_budget(events, 40, 90)))


def test_ticks_follow_each_other_until_something_comes(spark):
    events = [(1, 1, at(0)), (1, 2, at(95)), (1, 3, at(95)), (1, 4, at(2000)), (2, 5, at(10)), (2, 6, at(2030))]
    parts = cut(spark, events, "user_id long, event_id long, ts timestamp", 2, [at(96), at(1000)])
    got = in_parts(spark, [p for p in parts if p.count()], lambda s: ordered.heartbeat_stream(s, ordered.Heartbeat(base=30, most=240)))
    want = []
    for user in (1, 2):
        mine = sorted(e[2] for e in events if e[0] == user)
        for a, b in zip(mine, [*mine[1:], at(2030) + dt.timedelta(milliseconds=1)], strict=True):
            when, idle = a + dt.timedelta(minutes=30), 0
            while when < b:
                idle += 1
                minutes = min(240, 30 * 2 ** (idle - 1))
                want.append((user, when, idle, minutes))
                when += dt.timedelta(minutes=minutes)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert (1, at(30), 1, 30) in want and (1, at(2030), 1, 30) in want  # at the mark itself


def test_alarms_fire_if_they_are_still_pending(spark):
    """Set twice, moved, cancelled in time and too late, overdue, at one time, and of no person."""
    changes = [
        (1, 0, at(0), 10, at(60), 0), (1, 0, at(0), 11, at(60), 0), (1, 0, at(1), 12, at(90), 0), (1, 0, at(20), 12, at(30), 0),  # moved to an earlier time
        (1, 0, at(30), 13, at(20), 0), (1, 0, at(40), 14, at(200), 0), (1, 0, at(150), 14, at(200), 2), (1, 0, at(70), 10, at(60), 2),  # 10 has fired before
        (2, 0, at(5), 20, at(100), 0), (2, 0, at(50), 20, at(300), 0), (2, 0, at(50), 21, at(100), 3), (2, 0, at(60), 22, None, 0), (None, 0, at(0), 30, at(10), 0), (0, 0, at(250), None, None, None),
    ]
    schema = "person_id long, shard int, changed_at timestamp, alarm_id long, trigger_at timestamp, status int"
    want = [(1, 10, at(60), at(60)), (1, 11, at(60), at(60)), (1, 12, at(30), at(30)), (1, 13, at(20), at(30))]
    for borders in ([], [at(35), at(100)]):
        out = in_parts(spark, cut(spark, changes, schema, 2, borders), ordered.alarm_stream)
        assert sorted(tuple(r) for r in out.drop("shard").collect()) == want
    more = [*changes, (0, 0, at(300), None, None, None)]
    out = in_parts(spark, cut(spark, more, schema, 2, [at(251)]), ordered.alarm_stream)
    assert sorted(tuple(r) for r in out.drop("shard").collect()) == [*want, (2, 20, at(300), at(300))]


def test_rows_wait_for_late_ones(spark):
    """With a lateness rows of a later batch come into their place; those behind the watermark are dropped."""
    schema = "conv_id long, message_id long, created_at timestamp, n long"
    first = [(1, 1, at(0), 1), (1, 3, at(20), 10), (1, 9, at(200), 1), (2, 1, at(200), 1)]
    second = [(1, 4, at(150), 100), (1, 2, at(10), 1000), (1, 10, at(205), 1), (2, 2, at(400), 1)]
    parts = [spark.createDataFrame(x, schema) for x in (first, second, [(3, 1, at(900), 1)])]
    out = in_parts(spark, parts, lambda s: ordered.window_stream(s, F.col("n"), window=2, most_tokens=10**6, lateness="60 minutes"))
    # 2 is behind the watermark of the first batch (at 140), 4 isn't, and comes in front of 9.
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, 2, 11, 0), (1, 4, 3, 2, 101, 2), (2, 2, 1, 2, 2, 0)]


@pytest.mark.parametrize("days", [1, 30])
def test_a_stretch_of_any_length_gives_the_same(spark, days):
    events = [(1, i, at(37 * i), i % 5 == 0, "{}") for i in range(120)]
    parts = cut(spark, events, "user_id long, event_id long, ts timestamp, beat boolean, payload string", 2, [at(1500)])
    out = in_parts(spark, parts, lambda s: ordered.energy_gate(s, F.col("beat"), 40, 90, days=days)).collect()
    state, want = (100, None, 0), []
    for _, i, ts, beat, _ in events:
        state, (processed, buffered, _, _) = spend(state, ts.date(), beat, 40, 90)
        want.append((i, "processed" if processed else "buffered" if buffered else "dropped", state[0], state[2]))
    assert sorted((r.event_id, r.outcome, r.energy, r.waiting) for r in out) == want
