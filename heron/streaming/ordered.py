"""Keyed processing in the order of event time, whatever micro-batches the rows come in, on transformWithState.

Keys are dealt into buckets, and a bucket is what Spark groups by: a call for each key, with its frames and round trips to
the state store, costs more than the rows of most keys. The rows of a bucket wait in map state, by stretches of time, until
the watermark has passed them; a timer then takes them in the order of (time, id), each with the state of its own key. A
task holds the rows of a bucket and a stretch and the states of the bucket's keys, whatever a batch brings, and the result
does not depend on how the stream was cut or where it was restarted. Rows behind the watermark are dropped by Spark; the
lateness that a stream grants decides how long rows wait.

What goes on by itself between rows (ticks of a heartbeat, alarms) is told by the processor (`until`), which also says when
it wants to be woken next. A bucket has one timer, for the earliest of its rows and of these. State is kept as JSON; a key
whose state is that of the start again is forgotten.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from datetime import date
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heron.operators.conversation import WINDOW, WINDOW_TOKENS
from heron.operators.runtime import DAILY, MOST, START, spend

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE, DAY = 60_000_000, 86_400_000_000
#: Rows that are put out together.
STEP = 10_000
#: Groups of keys that share a state.
BUCKETS = 1024
EPOCH = date(1970, 1, 1).toordinal()


class InOrder(StatefulProcessor):
    """Sub-classes have `out` (their columns behind the key; those in `times` become timestamps), `start` (a key's state,
    lists and maps as JSON has them), `take` for a row, `until` for what happens by itself up to a time, and `wakes` for
    when to look again; times are microseconds."""

    out = ""
    times: tuple[str, ...] = ()
    stretch = DAY

    def start(self) -> list:
        return []

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        raise NotImplementedError

    def until(self, state: list, at: int) -> list[tuple]:
        return []

    def wakes(self, state: list) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, part long", "rows string")
        self.value = handle.getValueState("state", "states string")
        self.next = handle.getValueState("next", "part long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows come as JSON and are put away as they are."""
        part, timer = self.next.get() or (0, None)
        first = timer
        for frame in rows:
            least = int(frame["micros"].min()) // 1000
            first = least if first is None else min(first, least)
            new: dict[int, list[str]] = {}
            for k, row in zip((frame["micros"] // self.stretch).tolist(), frame["row"].tolist(), strict=True):
                new.setdefault(k, []).append(row)
            for k, more in new.items():
                self.waiting.updateValue((k, part), ("[" + ",".join(more) + "]",))
                part += 1
        self._wake(part, timer, first)
        return iter([])

    def _wake(self, part: int, timer: int | None, first: int | None) -> None:
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.next.update((part, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, n = timerValues.getCurrentWatermarkInMs(), len(self.key_names)
        part, timer = self.next.get()
        held = self.value.get()
        states = {tuple(k): state for k, state in json.loads(held[0])} if held else {}
        out: list[tuple] = []
        first = None
        stretches = sorted(tuple(k) for k in self.waiting.keys())
        for k, parts in groupby(stretches, lambda x: x[0]):
            if k * self.stretch > mark * 1000:
                first = k * self.stretch // 1000 if first is None else min(first, k * self.stretch // 1000)
                break
            own = list(parts)
            rows = [list(r.values()) for p in own for r in json.loads(self.waiting.getValue(p)[0])]
            later = [r for r in rows if r[n] // 1000 > mark]
            now = [r for r in rows if r[n] // 1000 <= mark] if later else rows
            for row in sorted(now, key=lambda r: (r[n], r[n + 1] is not None, r[n + 1])):
                of, at = tuple(row[:n]), row[n]
                state = states.get(of)
                if state is None:
                    state = states[of] = self.start()
                out += [(*of, *x) for x in self.until(state, at)]
                out += [(*of, *x) for x in self.take(state, at, row[n + 1 :])]
                if len(out) >= STEP:
                    yield self._frame(out)
                    out = []
            for p in own if not later else own[1:]:
                self.waiting.removeKey(p)
            if later:
                self.waiting.updateValue(own[0], (json.dumps([dict(enumerate(r)) for r in later]),))
                first = min(r[n] for r in later) // 1000
                break  # no other stretch is sooner
        for of, state in states.items():
            out += [(*of, *x) for x in self.until(state, mark * 1000 + 999)]
            if len(out) >= STEP:
                yield self._frame(out)
                out = []
            again = self.wakes(state)
            if again is not None:
                first = -(-again // 1000) if first is None else min(first, -(-again // 1000))
        begun = self.start()
        self.value.update((json.dumps([(of, state) for of, state in states.items() if state != begun]),))
        self._wake(part, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, first)
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [x.split()[0] for x in self.out.split(", ")]
        frame = pd.DataFrame(rows, columns=[*self.key_names, *names])
        whole = [x.split()[0] for x in self.out.split(", ") if x.endswith(" long")]
        return frame.astype(dict.fromkeys(whole, "Int64"))  # whole numbers with nulls

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, processor: InOrder, keys: dict[str, str], at: str, values: list[Column], lateness: str = "0 seconds", days: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The processor's rows over a stream: `keys` names the key columns and their types (whole numbers or texts), `at` the
    time (timestamp), `days` how long a stretch is whose rows of a bucket are taken together, `buckets` into how many the
    keys are dealt by their hash (fixed for a checkpoint; the more, the less a task holds), and `values` what a row is, its
    id first (whole numbers, flags or texts). Rows with a null key or time are left out. Run it with the state store of
    ROCKS (run_to_table's `timers`)."""
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), processor.out])
    processor.key_names, processor.stretch = list(keys), days * DAY
    own = stream.where(" and ".join(f"{c} is not null" for c in [*keys, at]))
    row = F.to_json(F.struct(*[F.col(k).cast(t).alias(f"k{i}") for i, (k, t) in enumerate(keys.items())], F.unix_micros(at).alias("t"), *[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = own.select(bucket.alias("bucket"), F.col(at).alias("at"), F.unix_micros(at).alias("micros"), row.alias("row")).withWatermark("at", lateness)
    told = rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in processor.times})


class Budget(InOrder):
    """Energy that whole days recover. What it doesn't cover is spilled with its payload into a heap, in the order of
    (event, place); a row that finds a sleep mark drains the spill first: what cannot be decoded is deleted, the rest is
    replayed until energy runs short, and the mark is cleared when nothing is left. Heartbeats are never spilled."""

    out, times = "event_id long, outcome string, by_event long, energy long, waiting long, sleep_since long", ("sleep_since",)

    def __init__(self, cost: int, heartbeat_cost: int):
        self.cost, self.heartbeat_cost = cost, heartbeat_cost

    def start(self) -> list:
        return [START, None, None, 0, []]  # energy, day, sleeping since, next place, spill

    def row(self, event_id: int, outcome: str, by: int | None, state: list) -> tuple:
        return event_id, outcome, by, state[0], len(state[4]), state[2]

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        event_id, heartbeat, payload, day = row
        if state[1] is None or day > state[1]:
            state[0] = state[0] if state[1] is None else min(MOST, state[0] + DAILY * (day - state[1]))
            state[1] = day
        out = self.drain(state, event_id) if state[2] is not None else []
        cost = self.heartbeat_cost if heartbeat else self.cost
        if state[0] >= cost:
            state[0] -= cost
            return [*out, self.row(event_id, "processed", None, state)]
        if heartbeat:
            return [*out, self.row(event_id, "dropped", None, state)]
        place = state[3]
        state[3] += 1
        heapq.heappush(state[4], [event_id, place, payload])
        state[2] = at if state[2] is None else state[2]
        return [*out, self.row(event_id, "buffered", None, state)]

    def drain(self, state: list, by: int) -> list[tuple]:
        out, spill = [], state[4]
        while spill:
            event_id, _, payload = spill[0]
            if not decodes(payload):
                outcome = "deleted"
            elif state[0] >= self.cost:
                state[0] -= self.cost
                outcome = "replayed"
            else:
                break
            heapq.heappop(spill)
            out.append(self.row(event_id, outcome, by, state))
        if not spill:
            state[2] = None
        return out


def decodes(payload: str | None) -> bool:
    """A JSON object."""
    try:
        return isinstance(json.loads(payload or ""), dict)
    except ValueError:
        return False


class Gate(InOrder):
    """What becomes of each event, with the buffer as a number only."""

    out = "event_id long, outcome string, energy long, waiting long"

    def __init__(self, cost: int, heartbeat_cost: int):
        self.cost, self.heartbeat_cost = cost, heartbeat_cost

    def start(self) -> list:
        return [START, None, 0]  # energy, day, waiting

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        event_id, heartbeat, day = row
        before = (state[0], None if state[1] is None else date.fromordinal(state[1] + EPOCH), state[2])
        (energy, last, waiting), (processed, buffered, _, _) = spend(before, date.fromordinal(day + EPOCH), heartbeat, self.cost, self.heartbeat_cost)
        state[:] = [energy, last.toordinal() - EPOCH, waiting]
        return [(event_id, "processed" if processed else "buffered" if buffered else "dropped", energy, waiting)]


class Heartbeat(InOrder):
    """Ticks that set their successor: `base` minutes after an external event, then by the backoff of the ticks since it;
    an external event resets them, also one at the very time of a tick."""

    out, times = "tick_at long, idle long, minutes long", ("tick_at",)

    def __init__(self, base: int = 30, most: int = 360, shifts: int = 8):
        self.base, self.most, self.shifts = base, most, shifts

    def start(self) -> list:
        return [0, None]  # ticks since the last external event, the next one's time

    def pause(self, idle: int) -> int:
        """Minutes to the next tick after so many; none or one: the base."""
        return min(self.most, self.base << min(max(idle - 1, 0), self.shifts))

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        state[:] = [0, at + self.pause(0) * MINUTE]
        return []

    def until(self, state: list, at: int) -> list[tuple]:
        out = []
        while state[1] is not None and state[1] < at:
            state[0] += 1
            minutes = self.pause(state[0])
            out.append((state[1], state[0], minutes))
            state[1] += minutes * MINUTE
        return out

    def wakes(self, state: list) -> int | None:
        return state[1]


class Alarms(InOrder):
    """Alarms: a change sets an alarm's time and status, and at its time the status is read again, so that only what is still
    pending fires. A pending alarm whose time has passed when it comes fires at once; several in the order of their times.
    One that was due before a change has fired by then, however late the change is processed."""

    out, times = "alarm_id long, trigger_at long, fired_at long", ("trigger_at", "fired_at")
    PENDING = 0

    def start(self) -> list:
        return [{}, []]  # the time of each pending alarm, and a heap of all times that were set

    def until(self, state: list, at: int) -> list[tuple]:
        pending, due = state
        out = []
        while due and due[0][0] <= at:
            trigger, alarm_id = heapq.heappop(due)
            if pending.get(str(alarm_id)) == trigger:
                del pending[str(alarm_id)]
                out.append((alarm_id, trigger, trigger))
        return out

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        alarm_id, trigger, status = row
        if alarm_id is None or trigger is None:
            return []
        pending, due = state
        pending.pop(str(alarm_id), None)
        if status != self.PENDING:
            return []
        if trigger <= at:
            return [(alarm_id, trigger, at)]
        pending[str(alarm_id)] = trigger  # keys of JSON are texts
        heapq.heappush(due, [trigger, alarm_id])
        return []

    def wakes(self, state: list) -> int | None:
        return state[1][0][0] if state[1] else None


class Windows(InOrder):
    """Summary windows that close at a number of messages or beyond a number of tokens; the open one outlives the batch. Each
    version is put out once, with the version that its summary builds on."""

    out = "version long, first_seq long, n_messages long, tokens long, base long"

    def __init__(self, window: int = WINDOW, most_tokens: int = WINDOW_TOKENS):
        self.window, self.most = window, most_tokens

    def start(self) -> list:
        return [0, 0, 0]  # messages seen, in the window, its tokens

    def take(self, state: list, at: int, row: list) -> list[tuple]:
        state[:] = [state[0] + 1, state[1] + 1, state[2] + row[1]]
        seen, n, used = state
        if n < self.window and used <= self.most:
            return []
        state[1:] = [0, 0]
        return [(seen, seen - n + 1, n, used, seen - n)]


def budget_stream(events: DataFrame, heartbeat: Column, payload: Column, cost: int = 1, heartbeat_cost: int = 5, **when) -> DataFrame:
    """events (user_id, event_id, ts): user_id, event_id, outcome (processed, buffered, dropped; replayed and deleted, with
    by_event), energy, waiting and sleep_since after it."""
    return in_order(events, Budget(cost, heartbeat_cost), {"user_id": "long"}, "ts", [F.col("event_id").cast("long"), heartbeat, payload, F.unix_date(F.to_date("ts"))], **when)


def energy_gate(events: DataFrame, heartbeat: Column, cost: int = 1, heartbeat_cost: int = 5, **when) -> DataFrame:
    """events (user_id, event_id, ts): user_id, event_id, outcome, energy and waiting after it."""
    return in_order(events, Gate(cost, heartbeat_cost), {"user_id": "long"}, "ts", [F.col("event_id").cast("long"), heartbeat, F.unix_date(F.to_date("ts"))], **when)


def heartbeat_stream(events: DataFrame, processor: Heartbeat | None = None, **when) -> DataFrame:
    """events (user_id, event_id, ts) are external ones: user_id, tick_at, idle, and the minutes to the tick behind it."""
    return in_order(events, processor or Heartbeat(), {"user_id": "long"}, "ts", [F.col("event_id").cast("long")], **when)


def alarm_stream(changes: DataFrame, **when) -> DataFrame:
    """changes (person_id, shard, changed_at, alarm_id, trigger_at, status; 0: pending): person_id, shard, alarm_id,
    trigger_at, fired_at. A person of very many alarms is dealt into shards by a hash of the alarm; a row without an alarm
    only moves time on."""
    trigger = F.unix_micros(F.col("trigger_at").cast("timestamp"))
    return in_order(changes, Alarms(), {"person_id": "long", "shard": "int"}, "changed_at", [F.col("alarm_id").cast("long"), trigger, F.col("status").cast("int")], **when)


def window_stream(messages: DataFrame, tokens: Column, window: int = WINDOW, most_tokens: int = WINDOW_TOKENS, **when) -> DataFrame:
    """messages (conv_id, message_id, created_at): conv_id, version, first_seq, n_messages, tokens, base of each window that
    has closed."""
    return in_order(messages, Windows(window, most_tokens), {"conv_id": "long"}, "created_at", [F.col("message_id").cast("long"), F.coalesce(tokens, F.lit(0)).cast("long")], **when)
