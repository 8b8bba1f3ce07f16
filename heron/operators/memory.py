"""Forgetting memory: hits, decay, spreading activation, density and evidence."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import scalars as S
from heron.functions import vectors as V
from heron.operators.folds import ordered_fold
from heron.operators.relational import upsert
from heron.operators.vectors import similar_to_set

COOLDOWN_MINUTES = 10
#: Shares of a hit's gain, by rule in the order of precedence.
RULES = {1: 0.5, 2: 0.2, 3: 0.2, 4: 0.15}


#: Kinds of events; only a message's leads to a session.
MESSAGE = 1
#: An observation's importance when it is made; kinds of entities that profiles are about.
IMPORTANCE, PERSON, SESSION = 0.5, 1, 2
TRIGGER, TOP, RATE_MINUTES = 10, 50, 360


def message_events(messages: DataFrame, id_column: str = "message_id", at: str = "created_at") -> DataFrame:
    """One event for each message: event_type, ref_id, created_at. None is dropped, however many come."""
    return messages.select(F.lit(MESSAGE).alias("event_type"), F.col(id_column).alias("ref_id"), F.col(at).alias("created_at"))


def new_observations(consumed: DataFrame, existing: DataFrame, at: Column) -> DataFrame:
    """person_id, event_id, importance, last_accessed_at, last_scored_at: an observation for each event that a person
    consumed and hasn't observed yet; one of a (person, event), however often it is delivered."""
    keys = ["person_id", "event_id"]
    new = consumed.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    return new.select(*keys, F.lit(IMPORTANCE).alias("importance"), at.alias("last_accessed_at"), at.alias("last_scored_at"))


def observed_messages(observations: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Observations with the message behind their event (message_id, session_id, sender, content). Those of other kinds
    of events, or whose event or message is gone, are left out."""
    refs = events.where(F.col("event_type") == MESSAGE).select("event_id", F.col("ref_id").alias("message_id"))
    return observations.join(refs, "event_id").join(messages.select("message_id", "session_id", "sender", "content"), "message_id")


def routed_hits(recalled: DataFrame, events: DataFrame, observations: DataFrame) -> DataFrame:
    """recalled (person_id, message_id, at): messages that a search brought back. The observations of those persons that
    are hit: person_id, event_id, at; a message that a person never observed hits nothing."""
    refs = events.where(F.col("event_type") == MESSAGE).select("event_id", F.col("ref_id").alias("message_id"))
    return recalled.join(refs, "message_id").join(observations.select("person_id", "event_id"), ["person_id", "event_id"], "left_semi").select("person_id", "event_id", "at")


def decay(observations: DataFrame, now: Column, importance: str = "importance", scored_at: str = "last_scored_at") -> DataFrame:
    return observations.withColumn("decayed", S.decayed(F.col(importance), F.datediff(now, F.col(scored_at))))


def _first() -> tuple:
    return None, None, None, 0, 0


def _hit(state: tuple, at: datetime, start: float, scored_before: datetime | None, cooldown: timedelta) -> tuple:
    importance, scored, _, hits, counted = state
    if not hits:
        importance, scored = start, scored_before
    if scored is None or at - scored >= cooldown:
        importance, scored, counted = importance + S.GAIN * (1 - importance), at, counted + 1
    return (importance, scored, at, hits + 1, counted), ()


def _done(state: tuple) -> list[tuple]:
    return [state]


def hits(events: DataFrame, key: str = "user_id", at: str = "ts", cooldown_minutes: int = COOLDOWN_MINUTES, importance: Column | None = None, scored_at: Column | None = None) -> DataFrame:
    """key, importance, last_scored_at, last_accessed_at, n_hits, n_counted after all hits of an observation, from the
    importance and the time that it has (0.5 and never by default). Every hit is an access; one within the cooldown of
    the last one that counted counts for nothing else. The cooldown's anchor depends on what counted, so this is a fold."""
    start = F.lit(IMPORTANCE) if importance is None else importance
    before = (F.lit(None) if scored_at is None else scored_at).cast("timestamp_ntz")
    step = partial(_hit, cooldown=timedelta(minutes=cooldown_minutes))
    rows = events.select(key, at, "event_id", start.cast("double").alias("_start"), before.alias("_before"))
    schema = f"{key} long, importance double, last_scored_at timestamp_ntz, last_accessed_at timestamp_ntz, n_hits long, n_counted long"
    return ordered_fold(rows, [key], [at, "event_id"], [at, "_start", "_before"], _first, step, schema, _done)


#: What observations reach each other in: a session, or where several persons observe one, the person too.
Scope = str | list[str]


def _keys(scope: Scope) -> list[str]:
    return [scope] if isinstance(scope, str) else list(scope)


def positions(observations: DataFrame, session: Scope = "session_id", order: str = "event_id") -> DataFrame:
    return observations.withColumn("pos", F.row_number().over(Window.partitionBy(*_keys(session)).orderBy(order)))


def temporal_neighbours(observations: DataFrame, hit: Column, session: Scope = "session_id") -> DataFrame:
    """hit_id, event_id, rule: 1 for the rows next to a hit in its session, 2 for those two away. One window, no join."""
    w = Window.partitionBy(*_keys(session)).orderBy("event_id")
    around = F.array(*[F.struct(F.when(F.lag(hit, d).over(w) if d > 0 else F.lead(hit, -d).over(w), F.lag("event_id", d).over(w) if d > 0 else F.lead("event_id", -d).over(w)).alias("hit_id"), F.lit(abs(d)).alias("rule")) for d in (1, -1, 2, -2)])
    placed = observations.select("event_id", around.alias("around"))  # the windows first, then the rows that they make
    return placed.select("event_id", F.explode("around").alias("a")).where("a.hit_id is not null").select("a.hit_id", "event_id", "a.rule")


def similar_neighbours(observations: DataFrame, hit: Column, vectors: DataFrame | None = None, threshold: float = 0.8, session: Scope = "session_id") -> DataFrame:
    """hit_id, event_id, rule 3: observations of a hit's session whose vector is similar to the hit's; an observation
    without a vector has no such neighbours. The vectors are those of the observations (embedding), or of a table
    (event_id, embedding)."""
    keys = _keys(session)
    scope = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    own = ["event_id", scope.alias("_scope"), hit.alias("_hit")]
    placed = observations.select(*own, "embedding") if vectors is None else observations.select(*own).join(vectors, "event_id")
    near = similar_to_set(placed, placed.where("_hit"), threshold, "event_id", "embedding", "_scope")
    return near.select("hit_id", F.col("vec_id").alias("event_id"), F.lit(3).alias("rule"))


def session_share(observations: DataFrame, hit: Column, closer: DataFrame, session: Scope = "session_id") -> DataFrame:
    """hit_id, n: how many others of its session a hit reaches by rule 4, which are all that none of the closer links
    (hit_id, event_id) has. A number for each hit instead of a row for each pair: a session of many hits stays linear."""
    keys = _keys(session)
    sizes = observations.groupBy(*keys).agg(F.count("*").alias("_all"))
    own = observations.where(hit).select(*keys, F.col("event_id").alias("hit_id")).join(sizes, keys)
    reached = closer.groupBy("hit_id").agg(F.count("*").alias("_closer"))
    return own.join(reached, "hit_id", "left").select("hit_id", (F.col("_all") - 1 - F.coalesce("_closer", F.lit(0))).alias("n")).where("n > 0")


def first_rule(neighbours: DataFrame) -> DataFrame:
    """A target takes the first rule that reaches it from a hit; the hit itself takes none."""
    return neighbours.where("hit_id <> event_id").groupBy("hit_id", "event_id").agg(F.min("rule").alias("rule"))


def spread(neighbours: DataFrame, deltas: DataFrame, *more: str) -> DataFrame:
    """neighbours (hit_id, event_id, rule, and `more`) and deltas (hit_id, delta) -> what each target gains from each hit."""
    share = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    return neighbours.join(deltas, "hit_id").select("hit_id", "event_id", "rule", *more, (share * F.col("delta")).alias("gain"))


def _target_start() -> tuple:
    return None


def _target(state, importance: float, scored: datetime | None, gain: float, at: datetime, cooldown: timedelta) -> tuple:
    now = state or (importance, scored)
    if now[1] is None or at - now[1] >= cooldown:
        now = (min(1.0, now[0] + gain), at)
    return now, ()


def _target_done(state) -> list[tuple]:
    return [state]


def apply_gains(observations: DataFrame, gains: DataFrame, at: str = "at", cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """event_id, importance, last_scored_at of the targets: gains (hit_id, event_id, gain, at) in the order of time and hit;
    one within the cooldown is lost."""
    rows = gains.join(observations.select("event_id", "importance", "last_scored_at"), "event_id")
    return ordered_fold(rows, ["event_id"], [at, "hit_id"], ["importance", "last_scored_at", "gain", at], _target_start, partial(_target, cooldown=timedelta(minutes=cooldown_minutes)), "event_id long, importance double, last_scored_at timestamp_ntz", _target_done)


def scored_at_once(observations: DataFrame, hit: Column, now: Column, session: Scope = "session_id", threshold: float = 0.8, cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """The observations (with embedding, null: none) after hits that all come at one time: `importance` and
    `last_scored_at` anew, and `rule`: 0 for a hit that counted, 1 to 4 for what it reached, null for the others.

    Every hit scores itself before anything spreads, so what counted is no target; a hit within its cooldown does
    nothing. The least hit that counted reaches all of its session that are open, and stamps them, so that the others
    reach none. That is one window and a join of a row for each session; `replay` of the module cascade goes through time."""
    keys = _keys(session)
    free = F.col("last_scored_at").isNull() | (F.col("last_scored_at") <= now - F.make_dt_interval(mins=F.lit(cooldown_minutes)))
    w = Window.partitionBy(*keys)
    placed = observations.withColumn("_open", free).withColumn("_hit", F.coalesce(hit, F.lit(False)) & F.col("_open"))
    placed = placed.withColumn("_pos", F.row_number().over(w.orderBy("event_id"))).withColumn("_first", F.min(F.when(F.col("_hit"), F.struct("_pos", "event_id"))).over(w))
    source = placed.where(F.col("_first.event_id") == F.col("event_id")).select(*keys, (S.gained(F.col("importance")) - F.col("importance")).alias("_delta"), F.col("embedding").alias("_v"))
    joined = placed.join(source, keys, "left")
    away = F.abs(F.col("_pos") - F.col("_first._pos"))
    similarity = V.cosine_similarity("embedding", "_v")
    similar = F.coalesce(~F.isnan(similarity) & (similarity > threshold), F.lit(False))
    rule = F.when(F.col("_hit"), 0).when(F.col("_open") & F.col("_delta").isNotNull(), F.when(away <= 2, away).when(similar, 3).otherwise(4))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    scored = F.when(F.col("rule") == 0, S.gained(F.col("importance"))).when(F.col("rule") > 0, F.least(F.lit(1.0), F.col("importance") + share * F.col("_delta")))
    out = joined.withColumn("rule", rule.cast("int"))
    changed = {"importance": F.coalesce(scored, F.col("importance")), "last_scored_at": F.when(F.col("rule").isNotNull(), now).otherwise(F.col("last_scored_at"))}
    return out.withColumns(changed).select(*observations.columns, "rule")


def in_directions(observed: DataFrame) -> DataFrame:
    """Each row of observed_messages twice: for the sender (entity_type 1) and for the session (2)."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), F.col(c).cast("long").alias("entity_id"))
    return observed.withColumn("_e", F.explode(F.array(pair(PERSON, "sender"), pair(SESSION, "session_id")))).select("_e.*", *observed.columns)


def directions(observations: DataFrame, observed: DataFrame, least: int = TRIGGER) -> DataFrame:
    """person_id, entity_type, entity_id, n: the directions in which a person has enough distinct observations, of the
    persons who have enough of any kind. `observed`: those with a message (observed_messages)."""
    ready = observations.groupBy("person_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("person_id")
    counts = in_directions(observed).groupBy("person_id", "entity_type", "entity_id").agg(F.count_distinct("event_id").alias("n"))
    return counts.where(F.col("n") >= least).join(ready, "person_id", "left_semi")


def due_directions(found: DataFrame, profiles: DataFrame, now: Column, minutes: int = RATE_MINUTES) -> DataFrame:
    """Directions without a profile updated within the limit."""
    keys = ["person_id", "entity_type", "entity_id"]
    recent = profiles.where(F.col("last_updated_at") > now - F.make_dt_interval(mins=F.lit(minutes))).select(*keys)
    return found.join(recent, keys, "left_anti")


def evidence(observed: DataFrame, k: int = TOP) -> DataFrame:
    """The k most important observations of a person in each direction, later events first among ties, with their rank.
    Spark cuts each task's rows to k a group before the shuffle."""
    w = Window.partitionBy("person_id", "entity_type", "entity_id").orderBy(F.desc("importance"), F.desc("event_id"))
    return in_directions(observed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def labelled(rows: DataFrame, names: DataFrame, own: str = "person_id") -> DataFrame:
    """`line`: [name] content by the sender's name (person_id, name); without one, the name of the agent itself."""
    sender = names.select(F.col("person_id").alias("sender"), F.col("name").alias("_sender"))
    agent = names.select(F.col("person_id").alias(own), F.col("name").alias("_own"))
    out = rows.join(sender, "sender", "left").join(agent, own, "left")
    return out.withColumn("line", F.format_string("[%s] %s", F.coalesce("_sender", "_own", F.lit("")), "content")).drop("_sender", "_own")


def evidence_texts(ranked: DataFrame) -> DataFrame:
    """person_id, entity_type, entity_id, evidence_count, input: the lines of each direction in the order of their rank.
    At most k lines are put together."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return ranked.groupBy("person_id", "entity_type", "entity_id").agg(F.count("*").cast("int").alias("evidence_count"), F.array_join(lines, "\n").alias("input"))


def profile_upsert(profiles: DataFrame, inputs: DataFrame, narrate: Callable[[Column], Column], now: Column) -> DataFrame:
    """The next profiles: an input whose MD5 is the stored one changes nothing; the others get a narrative by `narrate`
    (a column function of the input), evidence_count, the MD5 and the time."""
    keys = ["person_id", "entity_type", "entity_id"]
    own = inputs.withColumn("input_md5", F.md5("input"))
    same = profiles.select(*keys, "input_md5")
    new = own.join(same, [*keys, "input_md5"], "left_anti").select(*keys, narrate(F.col("input")).alias("narrative"), "evidence_count", "input_md5", now.alias("last_updated_at"))
    return upsert(profiles.select(new.columns), new, keys)


def profile_of(asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """asked (person_id, entity_type, entity_id) with the narrative, empty where there is no profile."""
    keys = ["person_id", "entity_type", "entity_id"]
    return asked.join(profiles.select(*keys, "narrative"), keys, "left").withColumn("narrative", F.coalesce("narrative", F.lit("")))


def due(profiles: DataFrame, now: Column, minutes: int = 360) -> DataFrame:
    """Profiles not updated within the limit."""
    return profiles.where(F.col("last_updated_at").isNull() | (F.col("last_updated_at") <= now - F.make_dt_interval(mins=F.lit(minutes))))


def changed_inputs(inputs: DataFrame, previous: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose MD5 differs from the one stored (column input_md5), and new ones."""
    own = inputs.withColumn("input_md5", F.md5(F.col(text)))
    old = previous.select(key, F.col("input_md5").alias("_old"))
    return own.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("input_md5"))).drop("_old")
