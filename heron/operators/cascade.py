"""Memory replayed in the order of time: observations come up, hits score them, and activation spreads through a session.

The fold's state is the whole table of a person's session: importance, time of the last scoring, and vectors. Rows of a
session stream through it in order of time; they are dealt by key and sorted on Spark, and never put into one frame.

At a time, its observations come first. Then all hits of that time score themselves, from the least event on: one within its
cooldown is an access and nothing else. Then each that counted spreads to the others of its session that exist by then, by
the first of four rules: next to it 0.5 of its gain, two places away 0.2, similar 0.2, the rest of the session 0.15. A
target within its own cooldown gets nothing; so what was hit, or reached, at a time is not reached again at that time.

The last rule reaches all that are open, and stamps them. So the open ones are always those that were stamped before some
time, and as times only grow, the state keeps its observations in runs of one stamp, oldest first: a hit takes the runs that
have become open, and puts them back as one run behind the others. The work is that of the values which change, not of all
observations for each hit. Rows are read and told by columns, many sessions together: most sessions are short.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType, TimestampNTZType

from heron.functions.scalars import GAIN

COOLDOWN_MINUTES, SIMILAR = 10, 0.8
NEXT, SECOND, NEAR, REST = 0.5, 0.2, 0.2, 0.15
#: Before any time, in microseconds.
NEVER = np.iinfo(np.int64).min // 2
#: Rows that are put out together.
STEP = 10_000


class Session:
    """A session's observations, by place in the order of their coming."""

    def __init__(self, cooldown: int, similar: float):
        self.cooldown, self.similar = cooldown, similar
        self.ids: list[int] = []
        self.sorted: list[int] = []
        self.place: dict[int, int] = {}
        self.importance = np.zeros(8)
        self.scored = np.full(8, NEVER, np.int64)
        self.accessed = np.full(8, NEVER, np.int64)
        self.counted = np.zeros(8, bool)  # true for the hits that count, while they are settled
        self.size = np.zeros(8, np.int64)  # of the vector, 0 without one
        self.units: dict[int, np.ndarray] = {}  # unit vectors by size, a row for each place
        self.runs: deque[tuple[int, list[int] | np.ndarray]] = deque()
        self.now, self.hits = NEVER, []

    def come(self, event_id: int, importance: float, scored: int, vector: np.ndarray | None) -> None:
        """An observation comes up, with its unit vector; one that was scored before it came keeps that time."""
        if event_id in self.place:
            return
        k = len(self.ids)
        self.place[event_id] = k
        self.ids.append(event_id)
        insort(self.sorted, event_id)
        if k == len(self.importance):
            self.importance, self.scored, self.accessed, self.counted, self.size = (np.concatenate([x, np.full(k, fill, x.dtype)]) for x, fill in ((self.importance, 0), (self.scored, NEVER), (self.accessed, NEVER), (self.counted, False), (self.size, 0)))
            self.units = {n: np.concatenate([x, np.zeros_like(x)]) for n, x in self.units.items()}
        self.importance[k], self.scored[k] = importance, scored
        if vector is not None:
            n = self.size[k] = len(vector)
            if n not in self.units:
                self.units[n] = np.zeros((len(self.importance), n))
            self.units[n][k] = vector
        if self.runs and scored < self.runs[-1][0]:  # stamped before others: into its place
            at = next((i for i, (t, _) in enumerate(self.runs) if t > scored), len(self.runs))
            self.runs.insert(at, (scored, [k]))
        elif self.runs and scored == self.runs[-1][0] and isinstance(self.runs[-1][1], list):
            self.runs[-1][1].append(k)
        else:
            self.runs.append((scored, [k]))

    def hit(self, at: int, event_id: int) -> None:
        if at != self.now:
            self.settle()
            self.now = at
        k = self.place.get(event_id)
        if k is not None:
            self.hits.append(k)

    def settle(self) -> None:
        """All hits of one time."""
        if not self.hits:
            return
        at, hits = self.now, self.hits
        if len(hits) > 1:
            hits = sorted(set(hits), key=self.ids.__getitem__)
        self.hits = []
        importance, scored = self.importance, self.scored
        for k in hits:
            self.accessed[k] = at
        open_ = [k for k in hits if at - scored[k] >= self.cooldown]
        if not open_:
            return
        first, gain = open_[0], GAIN * (1 - importance[open_[0]])
        for k in open_:
            importance[k] += GAIN * (1 - importance[k])
        self.counted[open_] = True
        close = [(k, min(1.0, importance[k] + gain * share)) for k, share in self.close(first) if at - scored[k] >= self.cooldown and not self.counted[k]]
        loose: list[int] = []
        taken = []
        while self.runs and at - self.runs[0][0] >= self.cooldown:
            run = self.runs.popleft()[1]
            if isinstance(run, list):
                loose += run
            else:
                taken.append(run)
        reached = np.concatenate([*taken, np.array(loose, np.int64)]) if taken else np.array(loose, np.int64)
        scored[reached] = at
        self.runs.append((at, reached))
        targets = reached[~self.counted[reached]]  # the first hit reaches them all, so the others reach none
        self.counted[open_] = False
        for a in range(0, len(targets), STEP):
            part = targets[a : a + STEP]
            importance[part] = np.minimum(1.0, importance[part] + gain * self.shares(first, part))
        for k, value in close:
            importance[k] = value

    def close(self, hit: int) -> list[tuple[int, float]]:
        """What lies up to two places from a hit in the order of ids, and its share."""
        p = bisect_left(self.sorted, self.ids[hit])
        return [(self.place[self.sorted[i]], share) for i, share in ((p - 2, SECOND), (p - 1, NEXT), (p + 1, NEXT), (p + 2, SECOND)) if 0 <= i < len(self.sorted)]

    def shares(self, hit: int, targets: np.ndarray) -> np.ndarray:
        """Of targets that are further away."""
        n = int(self.size[hit])
        if not n:
            return np.full(len(targets), REST)
        units = self.units[n]
        return np.where((units[targets] @ units[hit] > self.similar) & (self.size[targets] == n), NEAR, REST)


def _units(v: pa.Array) -> list[np.ndarray | None]:
    """Vectors as unit vectors; None for one that is null, empty, zero, or has a null or what is not finite."""
    if v.null_count == len(v):
        return [None] * len(v)
    some = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    own = v.drop_null()
    size = own.value_lengths().to_numpy(zero_copy_only=False)
    flat = own.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
    begin = np.cumsum(size) - size
    out: list[np.ndarray | None] = [None] * len(v)
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        x = flat[begin[at][:, None] + np.arange(n)]
        with np.errstate(all="ignore"):
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / length
        good = (length[:, 0] > 0) & np.isfinite(length[:, 0])
        for k, row, ok in zip(some[at].tolist(), x, good.tolist(), strict=True):
            out[k] = row if ok else None
    return out


def _micros(times: pa.Array) -> list[int]:
    return times.cast(pa.int64()).fill_null(NEVER).to_pylist()


def _replay(batches: Iterable[pa.RecordBatch], keys: int, cooldown: int, similar: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, session = None, None
    done: list[tuple[tuple, Session]] = []
    waiting = 0

    def told() -> Iterator[pa.RecordBatch]:
        """The sessions that are done, in pieces of STEP rows."""
        sizes = [len(s.ids) for _, s in done]
        own = [pa.array([k[i] for k, _ in done], schema.field(i).type) for i in range(keys)]
        of = np.repeat(np.arange(len(done)), sizes)
        ids = np.concatenate([np.array(s.ids, np.int64) for _, s in done])
        importance, scored, accessed = (np.concatenate([getattr(s, name)[:n] for (_, s), n in zip(done, sizes, strict=True)]) for name in ("importance", "scored", "accessed"))
        for a in range(0, len(ids), STEP):
            at = slice(a, a + STEP)
            times = [pa.array(x[at], pa.int64(), mask=x[at] == NEVER).cast(pa.timestamp("us")) for x in (scored, accessed)]
            yield pa.record_batch([*(c.take(pa.array(of[at])) for c in own), pa.array(ids[at]), pa.array(importance[at]), *times], schema=schema)

    for b in batches:
        at, scored, vectors = _micros(b.column(keys)), _micros(b.column(keys + 4)), _units(b.column(keys + 5))
        names = zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True)
        for own, when, kind, event_id, importance, stamp, vector in zip(names, at, *(b.column(keys + i).to_pylist() for i in (1, 2, 3)), scored, vectors, strict=True):
            if own != key or session is None:
                if session is not None:
                    session.settle()
                    done.append((key, session))
                    waiting += len(session.ids)
                    if waiting >= STEP:
                        yield from told()
                        done, waiting = [], 0
                key, session = own, Session(cooldown, similar)
            if kind:
                session.hit(when, event_id)
            else:
                session.settle()
                session.come(event_id, importance, stamp, vector)
    if session is not None:
        session.settle()
        done.append((key, session))
        yield from told()


def replay(observations: DataFrame, hits: DataFrame, keys: list[str], cooldown_minutes: int = COOLDOWN_MINUTES, similar: float = SIMILAR) -> DataFrame:
    """keys, event_id, importance, last_scored_at, last_accessed_at of every observation after all hits.

    observations: keys (a person and a session, say), event_id, created_at, importance, last_scored_at (null: never),
    embedding (null: no similar ones); hits: keys, event_id, at. Hits of one event at one time are one; a hit of what does
    not exist by then hits nothing. Of observations with one id in a session the first counts. Rows with a null time or
    event are left out; null keys are keys like others. An empty table of observations gives an empty result.
    """
    none = lambda kind: F.lit(None).cast(kind)
    given = observations.schema["embedding"].dataType
    vector = given if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else ArrayType(DoubleType())  # half the bytes to sort
    come = observations.where("created_at is not null and event_id is not null").select(
        *keys, F.col("created_at").cast("timestamp_ntz").alias("at"), F.lit(0).alias("kind"), F.col("event_id").cast("long"), F.col("importance").cast("double"), F.col("last_scored_at").cast("timestamp_ntz"), F.col("embedding").cast(vector)
    )
    hit = hits.where("at is not null and event_id is not null").select(*keys, F.col("at").cast("timestamp_ntz"), F.lit(1).alias("kind"), F.col("event_id").cast("long"), none("double").alias("importance"), none("timestamp_ntz").alias("last_scored_at"), none(vector).alias("embedding"))
    rows = come.unionByName(hit).repartition(*keys).sortWithinPartitions(*keys, "at", "kind", "event_id")
    told = StructType([*[StructField(k, come.schema[k].dataType) for k in keys], StructField("event_id", LongType()), StructField("importance", DoubleType()), StructField("last_scored_at", TimestampNTZType()), StructField("last_accessed_at", TimestampNTZType())])
    return rows.mapInArrow(partial(_replay, keys=len(keys), cooldown=cooldown_minutes * 60_000_000, similar=similar, schema=to_arrow_schema(told)), told)
