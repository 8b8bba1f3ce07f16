"""Batch forms of keyed event processing: budgets with buffering and replay, timers, runs, and context limits."""

from __future__ import annotations

from datetime import date, datetime
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions.text import shortened, trimmed
from heron.operators.folds import ordered_fold
from heron.operators.relational import last_n, with_names

START, DAILY, MOST = 100, 100, 200
WARN, BLOCK = 3, 8


def spend(state: tuple, day: date, heartbeat: bool, cost: int, heartbeat_cost: int) -> tuple[tuple, tuple[int, int, int, int]]:
    """One event against a budget: state (energy, day, buffered) -> the next, and what happened to it and the buffer
    (processed, buffered, dropped, replayed).

    Whole days recover energy first. Then buffered events are replayed in order as far as energy goes; an event is
    processed only behind an empty buffer, else it joins it. A heartbeat that energy doesn't cover is dropped.
    """
    energy, last, waiting = state
    if last is not None and (days := (day - last).days) > 0:
        energy = min(MOST, energy + DAILY * days)
    last = day if last is None or day > last else last
    replayed = min(waiting, energy // cost)
    energy, waiting = energy - replayed * cost, waiting - replayed
    if heartbeat:
        if energy >= heartbeat_cost:
            return (energy - heartbeat_cost, last, waiting), (1, 0, 0, replayed)
        return (energy, last, waiting), (0, 0, 1, replayed)
    if not waiting and energy >= cost:
        return (energy - cost, last, waiting), (1, 0, 0, replayed)
    return (energy, last, waiting + 1), (0, 1, 0, replayed)


def _budget_start() -> tuple:
    return START, None, 0, (0, 0, 0, 0)


def _budget_step(state: tuple, day: date, heartbeat: bool, cost: int, heartbeat_cost: int) -> tuple:
    inner, done = spend(state[:3], day, heartbeat, cost, heartbeat_cost)
    return (*inner, tuple(a + b for a, b in zip(state[3], done, strict=True))), ()


def _budget_done(state: tuple) -> list[tuple]:
    energy, _, waiting, done = state
    return [(energy, waiting, *done)]


def energy_replay(events: DataFrame, heartbeat: Column, key: str = "user_id", at: str = "ts", id_column: str = "event_id", cost: int = 1, heartbeat_cost: int = 5) -> DataFrame:
    """key, energy, waiting, n_processed, n_buffered, n_dropped, n_replayed after all events of a key in order."""
    rows = events.select(F.col(key).cast("long").alias(key), at, id_column, F.col(at).cast("date").alias("_day"), heartbeat.alias("_beat"))
    step = partial(_budget_step, cost=cost, heartbeat_cost=heartbeat_cost)
    return ordered_fold(rows, [key], [at, id_column], ["_day", "_beat"], _budget_start, step, f"{key} long, energy long, waiting long, n_processed long, n_buffered long, n_dropped long, n_replayed long", _budget_done)


def _timeline_step(state: tuple, at: datetime, event_id: int, day: date, heartbeat: bool, cost: int, heartbeat_cost: int) -> tuple:
    inner, (processed, buffered, _, replayed) = spend(state, day, heartbeat, cost, heartbeat_cost)
    return inner, [(event_id, at, "processed" if processed else "buffered" if buffered else "dropped", inner[0], inner[2], replayed)]


def energy_timeline(events: DataFrame, heartbeat: Column, key: str = "user_id", at: str = "ts", id_column: str = "event_id", cost: int = 1, heartbeat_cost: int = 5) -> DataFrame:
    """Each event against its key's budget: outcome, energy and waiting after it, n_replayed (how many waiting ones it set
    free), sleep_since (when the buffer last became non-empty; null while it is empty), and replayed_by: the event at
    which a buffered one was replayed, null if it still waits. Events are replayed in the order in which they were
    buffered, so the n-th replay is that of the n-th buffered event, and the state is three numbers a key."""
    rows = events.select(F.col(key).cast("long").alias(key), F.col(at).alias("at"), F.col(id_column).alias("id"), F.col(at).cast("date").alias("_day"), heartbeat.alias("_beat"))
    step = partial(_timeline_step, cost=cost, heartbeat_cost=heartbeat_cost)
    told = ordered_fold(rows, [key], ["at", "id"], ["at", "id", "_day", "_beat"], lambda: (START, None, 0), step, f"{key} long, {id_column} long, {at} timestamp_ntz, outcome string, energy long, waiting long, n_replayed long")
    w = Window.partitionBy(key).orderBy(at, id_column)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    slept = (F.col("waiting") > 0) & (F.coalesce(F.lag("waiting").over(w), F.lit(0)) == F.col("n_replayed"))
    told = told.withColumn("_slept", F.when(slept, F.col(at)))
    told = told.withColumn("sleep_since", F.when(F.col("waiting") > 0, F.last("_slept", ignorenulls=True).over(upto)))
    told = told.withColumn("_n", F.when(F.col("outcome") == "buffered", F.count_if(F.col("outcome") == "buffered").over(upto))).withColumn("_r", F.sum("n_replayed").over(upto))
    freed = told.where("n_replayed > 0").select(key, F.col(id_column).alias("replayed_by"), F.explode(F.sequence(F.col("_r") - F.col("n_replayed") + 1, F.col("_r"))).alias("_n"))
    return told.join(freed, [key, "_n"], "left").drop("_n", "_r", "_slept")


def due_timers(timers: DataFrame, now: Column, trigger: str, pending: Column) -> tuple[DataFrame, DataFrame]:
    """Pending timers that are due, and those to be registered again."""
    open_ = timers.where(pending)
    return open_.where(F.col(trigger) <= now), open_.where(F.col(trigger) > now)


def signature_runs(events: DataFrame, key: str, order: list[str], signature: Column, warn: int = WARN, block: int = BLOCK) -> DataFrame:
    """How often the same signature came before in a row (cycle_count), with warned and blocked; a block stays for the
    key's later events."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = events.withColumn("_s", signature).withColumn("_new", (F.lag("_s").over(w).isNull() | (F.lag("_s").over(w) != F.col("_s"))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.withColumn("cycle_count", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - 1)
    hit = (F.col("cycle_count") >= block).cast("int")
    out = counted.withColumn("blocked", F.max(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return out.withColumn("warned", ~F.col("blocked") & (F.col("cycle_count") >= warn)).drop("_s", "_new", "_run")


def bulk_shrink(entries: DataFrame, key: str, order: list[str], limit: int = 100, keep: int = 10) -> DataFrame:
    """What is shown of a key's entries, none of which is ever dropped: all up to `limit`, else the last `keep`."""
    placed = entries.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    placed = placed.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return placed.where((F.col("_n") <= limit) | (F.col("_i") <= keep)).drop("_n", "_i")


def note_due(steps: DataFrame, key: str, order: list[str], note: Column, every: int = 10) -> DataFrame:
    """Steps at least `every` places behind the last note (or the start)."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = steps.withColumn("_i", F.row_number().over(w))
    last = F.last(F.when(note, F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("distance", F.col("_i") - F.coalesce(last, F.lit(0))).where(F.col("distance") >= every).drop("_i")


def trim_notes(notes: DataFrame, key: str, order: list[str], size: Column, most: int) -> DataFrame:
    """The newest notes of a key that fit into `most`; one stays in any case."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    sized = notes.withColumn("_used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w))
    return sized.where((F.col("_used") <= most) | (F.col("_i") == 1)).drop("_used", "_i")


def recovered(works: DataFrame, drafts: DataFrame, participants: DataFrame, running: int = 0, abandoned: int = -1, discarded: int = -1, idle: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next snapshots after a restart: works that ran are given up, their drafts are discarded, and their person is
    idle in their session. Works: work_id, person_id, session_id, draft_id, status; drafts: draft_id, status;
    participants: session_id, person_id, status."""
    ran = works.where(F.col("status") == running)

    def marked(df: DataFrame, keys: list[str], value: int) -> DataFrame:
        own = ran.select(*keys).distinct().withColumn("_ran", F.lit(True))
        out = df.join(own, keys, "left").withColumn("status", F.when(F.col("_ran"), F.lit(value)).otherwise(F.col("status")))
        return out.select(df.columns)

    done = works.withColumn("status", F.when(F.col("status") == running, F.lit(abandoned)).otherwise(F.col("status")))
    return done, marked(drafts, ["draft_id"], discarded), marked(participants, ["session_id", "person_id"], idle)


#: Kinds of work, and the kind of event that a reply can answer.
CHAT, TASK, PRIVATE_MESSAGE = 1, 2, 0


def action_error(heartbeat: Column, private: Column, target_type: Column, prefix: str = "") -> Column:
    """Why a decided action is not valid, null if it is. Columns of the action: type, guidance, reason, work_type,
    delivery_target, session_id, recipient_id, trigger_at, message, alarm_action, alarm_content; target_type is the kind
    of the work that it names, null if there is none in the same session."""
    c = lambda name: F.col(prefix + name)
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    none = lambda name: F.coalesce(c(name), F.lit(0)) == 0
    kind = lambda k: c("type") == k
    target = F.coalesce(c("delivery_target"), F.lit(""))
    work = F.coalesce(c("work_type"), F.lit(0))  # a missing one is neither chat nor task, and judged
    told = F.when(blank("guidance"), "no guidance").when(blank("reason"), "no reason").when(target_type.isNull(), "no such work")
    route = F.when(heartbeat, "not on a heartbeat").otherwise(F.coalesce(told, F.when(target_type != TASK, "not a task")))
    cancel = F.when(heartbeat, "not on a heartbeat").otherwise(told)
    reply = F.when(heartbeat, "no session to reply in").when(~private, "no private message")
    sent = F.when(target.isin("", "reply"), reply).when(target == "send_to_session", F.when(none("session_id"), "no session")).when(target == "create_and_send", F.when(none("recipient_id"), "no recipient")).otherwise(F.lit("unknown target"))
    create = F.when(blank("guidance"), "no guidance").when(heartbeat & (work != CHAT), "chat only on a heartbeat").when(work != TASK, sent)
    alarm = F.when(blank("trigger_at"), "no time").when(blank("message"), "no message").when((c("alarm_action") == "send_message") & blank("alarm_content"), "no content")
    return F.when(kind("route"), route).when(kind("create"), create).when(kind("cancel"), cancel).when(kind("create_alarm"), alarm).otherwise(F.lit("unknown type"))


def valid_actions(actions: DataFrame, works: DataFrame) -> DataFrame:
    """actions (action_error's columns, source: event or heartbeat, event_type, in_session, target_work_id) with `error`;
    works: work_id, session_id, work_type."""
    known = works.select(F.col("work_id").alias("target_work_id"), F.col("session_id").alias("in_session"), F.col("work_type").alias("_target"))
    joined = actions.join(known, ["target_work_id", "in_session"], "left")
    error = action_error(F.col("source") == "heartbeat", F.col("event_type") == PRIVATE_MESSAGE, F.col("_target"))
    return joined.withColumn("error", error).drop("_target")


def idle_ticks(events: DataFrame, key: str, order: list[str], external: Column) -> DataFrame:
    """How many heartbeats of a key there were since its last external event (idle), which is what the backoff counts."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("_x", external.cast("int")).withColumn("_run", F.sum("_x").over(w))
    inside = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("idle", F.sum(F.lit(1) - F.col("_x")).over(inside)).drop("_x", "_run")


def checks_at(ticks: DataFrame, tick: str = "tick", every: dict[str, int] | None = None) -> DataFrame:
    """Which periodic checks a heartbeat tick runs."""
    every = every or {"memory": 6, "alarm": 1, "work": 1}
    return ticks.withColumns({f"run_{n}": F.col(tick) % k == 0 for n, k in every.items()})


#: Kinds of interactions.
REQUEST, RESPONSE, GUIDANCE = 1, 2, 3
_RESPONSE = "content string, tool_calls array<struct<function: struct<name: string, arguments: string>>>"


def first_argument(arguments: Column, keys: list[str]) -> Column:
    """The first of these arguments (a JSON object) that is not empty, as text; else empty."""
    found = [F.when(x != "", x) for x in (F.get_json_object(arguments, f"$.{k}") for k in keys)]
    return F.coalesce(*found, F.lit(""))


def activity_rows(interactions: DataFrame, works: DataFrame, arguments: dict[str, list[str]]) -> DataFrame:
    """session_id, at, interaction_id, place, kind, tool, label: what happened in the task works of a session, to be read
    in the order of (at, interaction_id, place). A response gives its thought, if it has one, and a row for each tool
    call, labelled by the first argument of `arguments` for that tool; guidance gives its text; requests give nothing.
    interactions: interaction_id, work_id, kind, data (JSON), created_at; works: work_id, session_id, work_type."""
    tasks = works.where(F.col("work_type") == TASK).select("work_id", "session_id")
    j = F.from_json("data", _RESPONSE)
    row = lambda kind, tool, label: F.struct(F.lit(kind).alias("kind"), tool.alias("tool"), label.alias("label"))
    none, empty = F.lit(None).cast("string"), F.lit([]).cast("array<struct<kind: string, tool: string, label: string>>")

    def call(x: Column) -> Column:
        label = F.lit("")
        for tool, keys in arguments.items():
            label = F.when(x["function"]["name"] == tool, first_argument(x["function"]["arguments"], keys)).otherwise(label)
        return row("tool_call", x["function"]["name"], label)

    thought = F.when(F.col("j.content") != "", F.array(row("thinking", none, trimmed(F.col("j.content")))))
    response = F.concat(F.coalesce(thought, empty), F.coalesce(F.transform("j.tool_calls", call), empty))
    guidance = F.array(row("guidance", none, F.coalesce(F.get_json_object("data", "$.guidance"), F.lit(""))))
    out = F.when(F.col("kind") == RESPONSE, response).when(F.col("kind") == GUIDANCE, guidance).otherwise(empty)
    rows = interactions.join(tasks, "work_id").withColumn("j", j).select("session_id", F.col("created_at").alias("at"), "interaction_id", F.posexplode(out).alias("place", "a"))
    return rows.select("session_id", "at", "interaction_id", "place", "a.kind", "a.tool", "a.label")


def sessions_overview(participants: DataFrame, names: DataFrame, profiles: DataFrame, messages: DataFrame, n: int = 5, most: int = 200) -> DataFrame:
    """For each participant and session: the names of the others, the person's narrative of the session, and its last n
    messages in order as lines `speaker [time]: content` (own ones by "you"), cut at `most` characters.
    participants: session_id, person_id; names: person_id, name; profiles: person_id, session_id, narrative; messages:
    session_id, message_id, sender, content, created_at."""
    named = with_names(participants.select("session_id", "person_id"), names, "person_id", "name")
    every = F.array_sort(F.collect_list(F.struct("person_id", "name")))
    members = named.groupBy("session_id").agg(every.alias("_m"))
    recent = with_names(last_n(messages, "session_id", "message_id", n), names.withColumnRenamed("person_id", "sender"), "sender", "name")
    line = F.concat(F.lit(" ["), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("]: "), shortened(F.col("content"), most))
    lines = recent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "sender", "name", line.alias("line")))).alias("_l"))
    own = participants.select("session_id", "person_id").join(members, "session_id").join(lines, "session_id", "left").join(profiles, ["person_id", "session_id"], "left")
    others = F.array_join(F.transform(F.filter("_m", lambda x: x["person_id"] != F.col("person_id")), lambda x: x["name"]), ", ")
    told = F.transform(F.coalesce("_l", F.array().cast("array<struct<message_id: bigint, sender: int, name: string, line: string>>")), lambda x: F.concat(F.when(x["sender"] == F.col("person_id"), "you").otherwise(x["name"]), x["line"]))
    return own.select("person_id", "session_id", others.alias("others"), F.coalesce("narrative", F.lit("")).alias("narrative"), F.array_join(told, "\n").alias("recent"))
