"""Memory queries: observations are events (importance 0.5 + (event_id mod 50) / 100), a session is a user's day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heron.functions import scalars as S
from heron.operators import cascade, memory
from heron.plans.base import Plans, at, shared_root, table
from heron.plans.conversations import _MESSAGES, messages
from heron.sources.files import write_snapshot

PLANS = Plans()

_OBS = "obs AS (SELECT *, 0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS importance, user_id * 100 + day(ts) AS session_id FROM events)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = F.lit(0.5) + (F.col("event_id") % 50) / F.lit(100.0)
    return table(spark, sf_dir, "events").withColumn("importance", importance).withColumn("last_scored_at", F.col("ts")).withColumn("session_id", F.col("user_id") * 100 + F.dayofmonth("ts"))


@PLANS.query(
    f"""WITH {_OBS}, d AS (SELECT event_id, importance, date_diff('day', CAST(ts AS DATE), DATE '2024-12-31') AS days FROM obs)
    SELECT event_id, round(CASE WHEN importance <= 1e-6 THEN importance ELSE importance * pow(0.98, least(greatest(days, 0), greatest(ceil(ln(1e-6 / importance) / ln(0.98)), 0))) END, 6) AS decayed FROM d"""
)
def memory_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.decay(observations(spark, sf_dir), at("2024-12-31 00:00:00")).select("event_id", F.round("decayed", 6).alias("decayed"))


@PLANS.query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (
      SELECT DISTINCT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS importance, NULL::TIMESTAMP AS scored, 0::BIGINT AS counted FROM e
      UNION ALL
      SELECT e.user_id, e.n,
        CASE WHEN scored IS NULL OR e.ts - scored >= INTERVAL 360 MINUTE THEN importance + 0.1 * (1 - importance) ELSE importance END,
        CASE WHEN scored IS NULL OR e.ts - scored >= INTERVAL 360 MINUTE THEN e.ts ELSE scored END,
        CASE WHEN scored IS NULL OR e.ts - scored >= INTERVAL 360 MINUTE THEN counted + 1 ELSE counted END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, round(importance, 6) AS importance, scored AS last_scored_at, (SELECT max(ts) FROM events x WHERE x.user_id = f.user_id) AS last_accessed_at, n AS n_hits, counted AS n_counted FROM f
    WHERE n = (SELECT max(n) FROM e WHERE e.user_id = f.user_id)"""
)
def memory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cooldown of six hours, so that it matters at the rate of these events."""
    return memory.hits(table(spark, sf_dir, "events"), cooldown_minutes=360).withColumn("importance", F.round("importance", 6))


_HIT = "event_type = 'purchase'"
_TEMPORAL = f"""placed AS (SELECT event_id, session_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS pos FROM obs),
temporal AS (SELECT h.event_id AS hit_id, o.event_id AS event_id, CAST(abs(h.pos - o.pos) AS INTEGER) AS rule
  FROM placed h JOIN placed o ON o.session_id = h.session_id AND abs(h.pos - o.pos) BETWEEN 1 AND 2 WHERE h.{_HIT})"""


@PLANS.query(f"WITH {_OBS}, {_TEMPORAL} SELECT hit_id, event_id, rule FROM temporal")
def memory_propagate_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.temporal_neighbours(observations(spark, sf_dir), F.expr(_HIT))


_NEAR = f"""placed_v AS (SELECT o.*, v.embedding::DOUBLE[] AS v FROM obs o JOIN embeddings v ON v.vec_id = o.event_id % (SELECT count(*) FROM embeddings)),
semantic AS (SELECT h.event_id AS hit_id, o.event_id AS event_id, 3 AS rule FROM placed_v h JOIN placed_v o ON o.session_id = h.session_id AND o.event_id <> h.event_id
  WHERE h.{_HIT} AND list_cosine_similarity(o.v, h.v) > 0.1)"""
_DELTA = f"deltas AS (SELECT event_id AS hit_id, importance + 0.1 * (1 - importance) - importance AS delta FROM obs WHERE {_HIT})"
_CLOSER = f"""{_TEMPORAL}, {_NEAR}, {_DELTA}, closer AS (SELECT hit_id, event_id, min(rule) AS rule FROM (SELECT * FROM temporal UNION ALL SELECT * FROM semantic) GROUP BY ALL)"""
_SHARE = "CASE rule WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 WHEN 3 THEN 0.2 ELSE 0.15 END::DOUBLE"


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each event, by its id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return observations(spark, sf_dir).withColumn("vec_id", F.col("event_id") % v.count()).join(v, "vec_id").drop("vec_id")


def _deltas(obs: DataFrame) -> DataFrame:
    return obs.where(F.expr(_HIT)).select(F.col("event_id").alias("hit_id"), (S.gained(F.col("importance")) - F.col("importance")).alias("delta"))


def _closer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules 1 to 3, a row for each hit and target; the threshold is low, as these vectors are far apart. Written, as it is
    read twice."""
    hit = F.expr(_HIT)
    near = memory.similar_neighbours(_with_vectors(spark, sf_dir), hit, threshold=0.1)
    found = memory.first_rule(memory.temporal_neighbours(observations(spark, sf_dir), hit).unionByName(near))
    return write_snapshot(found, f"{shared_root(spark)}/closer-{uuid.uuid4().hex}")


@PLANS.query(f"WITH {_OBS}, {_NEAR}, {_DELTA} SELECT hit_id, event_id, round(0.2::DOUBLE * delta, 6) AS gain FROM semantic JOIN deltas USING (hit_id)")
def memory_propagate_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are the hits; a vector's targets are those of the hit's session."""
    obs = _with_vectors(spark, sf_dir)
    near = memory.similar_neighbours(obs, F.expr(_HIT), threshold=0.1)
    return memory.spread(near, _deltas(observations(spark, sf_dir))).select("hit_id", "event_id", F.round("gain", 6).alias("gain"))


@PLANS.query(
    f"""WITH {_OBS}, {_CLOSER},
    rest AS (SELECT h.event_id AS hit_id, count(*) - 1 - (SELECT count(*) FROM closer c WHERE c.hit_id = h.event_id) AS n FROM obs h JOIN obs o ON o.session_id = h.session_id WHERE h.{_HIT} GROUP BY h.event_id),
    every AS (SELECT hit_id, event_id, rule, 1::BIGINT AS n FROM closer UNION ALL SELECT hit_id, NULL, 4, n FROM rest WHERE n > 0)
    SELECT hit_id, event_id, CAST(rule AS INTEGER) AS rule, n, round({_SHARE} * delta, 6) AS gain FROM every JOIN deltas USING (hit_id)"""
)
def memory_propagate_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hit gives to each target by the first of the rules 1 to 3, and for rule 4, which has all others of the
    session, to how many it gives what."""
    obs = observations(spark, sf_dir)
    closer = _closer(spark, sf_dir)
    rest = memory.session_share(obs, F.expr(_HIT), closer).select("hit_id", F.lit(None).cast("long").alias("event_id"), F.lit(4).alias("rule"), "n")
    every = closer.withColumn("n", F.lit(1).cast("long")).unionByName(rest)
    return memory.spread(every, _deltas(obs), "n").withColumn("gain", F.round("gain", 6))


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@PLANS.query(
    f"""WITH {_OBS}, v AS (SELECT o.*, v.embedding::DOUBLE[] AS v, ts <= {_NOW} - INTERVAL 600 MINUTE AS free FROM obs o JOIN embeddings v ON v.vec_id = o.event_id % (SELECT count(*) FROM embeddings) WHERE ts <= {_NOW}),
    p AS (SELECT *, free AND {_HIT} AS counted, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM v),
    f AS (SELECT user_id, min(event_id) AS hit_id FROM p WHERE counted GROUP BY user_id),
    h AS (SELECT p.user_id, pos, v, 0.1::DOUBLE * (1 - importance) AS delta FROM p JOIN f ON f.hit_id = p.event_id),
    r AS (SELECT p.*, h.delta, CASE WHEN counted THEN 0 WHEN free AND h.delta IS NOT NULL THEN CASE WHEN abs(p.pos - h.pos) <= 2 THEN abs(p.pos - h.pos) WHEN list_cosine_similarity(p.v, h.v) > 0.1 THEN 3 ELSE 4 END END AS rule FROM p LEFT JOIN h USING (user_id))
    SELECT event_id, CAST(rule AS INTEGER) AS rule, round(CASE WHEN rule = 0 THEN importance + 0.1 * (1 - importance) WHEN rule > 0 THEN least(1.0, importance + {_SHARE} * delta) ELSE importance END, 6) AS importance,
      CASE WHEN rule IS NULL THEN ts ELSE {_NOW} END AS last_scored_at FROM r"""
)
def memory_apply_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All purchases before a time are hit at that time, a user being a session; what came up in the ten hours before is in
    its cooldown. The first hit that counts reaches what no hit is, and that is open."""
    obs = _with_vectors(spark, sf_dir).where(F.col("ts") <= at("2024-01-20 00:00:00"))
    done = memory.scored_at_once(obs, F.expr(_HIT), at("2024-01-20 00:00:00"), "user_id", threshold=0.1, cooldown_minutes=600)
    return done.select("event_id", "rule", F.round("importance", 6).alias("importance"), "last_scored_at")


_REPLAY = f"""{_OBS}, o AS (SELECT user_id, user_id * 10 + day(ts) // 8 AS session_id, event_id, ts, 0.5::DOUBLE + (event_id % 50) / 113.0::DOUBLE AS importance, v.embedding::DOUBLE[] AS v FROM obs JOIN embeddings v ON v.vec_id = event_id % (SELECT count(*) FROM embeddings)),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS pos FROM o),
hit0 AS (SELECT e.session_id, e.ts + to_minutes(30) AS hit_at, t.event_id FROM (SELECT o.session_id, o.ts, o.event_id, row_number() OVER (PARTITION BY o.session_id ORDER BY o.ts, o.event_id) AS i FROM o) e
  JOIN (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i FROM o) t ON t.session_id = e.session_id AND (t.i = 1 + e.event_id % e.i OR t.i = 1 + e.event_id // 7 % e.i)),
hits AS (SELECT session_id, hit_at, list(DISTINCT event_id) AS ids FROM hit0 GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hit_at) AS n FROM hits),
f AS (
  SELECT session_id, event_id, ts, pos, v, importance, NULL::TIMESTAMP AS scored, NULL::TIMESTAMP AS accessed, 0::BIGINT AS n FROM placed
  UNION ALL
  SELECT session_id, event_id, ts, pos, v, CASE WHEN counted THEN importance + 0.1::DOUBLE * (1 - importance)
      WHEN free AND src.event_id IS NOT NULL THEN least(1.0::DOUBLE, importance + 0.1::DOUBLE * (1 - src.importance) * CASE WHEN abs(pos - src.pos) = 1 THEN 0.5::DOUBLE WHEN abs(pos - src.pos) = 2 THEN 0.2::DOUBLE WHEN list_cosine_similarity(v, src.v) > 0.1 THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END)
      ELSE importance END,
    CASE WHEN free AND src.event_id IS NOT NULL THEN hit_at ELSE scored END, CASE WHEN hit THEN hit_at ELSE accessed END, n
  FROM (SELECT *, min(CASE WHEN counted THEN {{'event_id': event_id, 'pos': pos, 'importance': importance, 'v': v}} END) OVER (PARTITION BY session_id) AS src FROM (
    SELECT f.session_id, f.event_id, f.ts, f.pos, f.v, f.importance, f.scored, f.accessed, s.n, s.hit_at, list_contains(s.ids, f.event_id) AND f.ts <= s.hit_at AS hit,
      f.ts <= s.hit_at AND (f.scored IS NULL OR s.hit_at - f.scored >= INTERVAL 1440 MINUTE) AS free, list_contains(s.ids, f.event_id) AND f.ts <= s.hit_at AND (f.scored IS NULL OR s.hit_at - f.scored >= INTERVAL 1440 MINUTE) AS counted
    FROM f JOIN steps s ON s.session_id = f.session_id AND s.n = f.n + 1)))"""


@PLANS.query(
    f"""WITH RECURSIVE {_REPLAY} SELECT session_id, event_id, round(importance, 6) AS importance, scored AS last_scored_at, accessed AS last_accessed_at FROM f
    WHERE n = (SELECT count(*) FROM steps s WHERE s.session_id = f.session_id)"""
)
def memory_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's week is a session. Half an hour after each event the session's search brings back two of the events up to
    it; the cooldown is a day, so that it matters at the rate of these events."""
    start = F.lit(0.5) + (F.col("event_id") % 50) / F.lit(113.0)  # no decimal that rounding could tie on
    obs = _with_vectors(spark, sf_dir).withColumn("importance", start).withColumn("session_id", F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 8)).withColumn("created_at", F.col("ts")).withColumn("last_scored_at", F.lit(None).cast("timestamp_ntz"))
    placed = obs.select("user_id", "session_id", "event_id", "ts", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).alias("i"))
    asked = placed.select("session_id", (F.col("ts") + F.make_dt_interval(mins=F.lit(30))).alias("at"), F.explode(F.array(F.col("event_id") % F.col("i") + 1, F.floor(F.col("event_id") / 7) % F.col("i") + 1)).alias("i"))
    hits = asked.join(placed.select("user_id", "session_id", "i", "event_id"), ["session_id", "i"])
    done = cascade.replay(obs, hits, ["user_id", "session_id"], cooldown_minutes=1440, similar=0.1)
    importance = F.floor(F.col("importance") * 1e6 + 0.5) / 1e6  # as SQL rounds: F.round takes a tie by its shortest decimals
    return done.select("session_id", "event_id", importance.alias("importance"), "last_scored_at", "last_accessed_at")


# The chain from an observation to its message: every member of a conversation observes its messages (events of even ids)
# and as many events of another kind (odd ids).

_CHAIN = f"""{_MESSAGES}, members AS (SELECT DISTINCT conv_id, person_id FROM messages), twice AS (SELECT unnest([0, 1]) AS x),
ev AS (SELECT message_id * 2 + x AS event_id, 1 + x AS event_type, message_id AS ref_id FROM messages, twice),
seen AS (SELECT p.person_id, m.message_id * 2 + x AS event_id, 0.5::DOUBLE + (m.message_id % 50) / 100.0::DOUBLE AS importance FROM messages m JOIN members p ON p.conv_id = m.conv_id, twice),
observed AS (SELECT s.person_id, s.event_id, s.importance, m.message_id, m.conv_id AS session_id, m.person_id AS sender, m.text AS content
  FROM seen s JOIN ev e ON e.event_id = s.event_id JOIN messages m ON m.message_id = e.ref_id WHERE e.event_type = 1)"""
_BOTH = f"{_CHAIN}, both_ways AS (SELECT *, 1 AS entity_type, sender::BIGINT AS entity_id FROM observed UNION ALL SELECT *, 2, session_id FROM observed)"
_INPUTS = f"""{_BOTH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id, entity_type, entity_id ORDER BY importance DESC, event_id DESC) AS rank FROM both_ways),
named AS (SELECT *, '[' || CASE sender WHEN 1 THEN 'system' WHEN 2 THEN 'user' ELSE CASE person_id WHEN 1 THEN 'system' WHEN 2 THEN 'user' ELSE '' END END || '] ' || content AS line FROM ranked WHERE rank <= 3),
inputs AS (SELECT person_id, entity_type, entity_id, CAST(count(*) AS INTEGER) AS evidence_count, string_agg(line, chr(10) ORDER BY rank) AS input FROM named GROUP BY ALL)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """messages, events, observations."""
    m = messages(spark, sf_dir).select("message_id", F.col("conv_id").alias("session_id"), F.col("person_id").alias("sender"), F.col("text").alias("content"))
    x = F.explode(F.array(F.lit(0), F.lit(1))).alias("x")
    events = m.select("message_id", x).select((F.col("message_id") * 2 + F.col("x")).alias("event_id"), (F.lit(1) + F.col("x")).alias("event_type"), F.col("message_id").alias("ref_id"))
    members = m.select("session_id", F.col("sender").alias("person_id")).distinct()
    importance = F.lit(0.5) + (F.col("message_id") % 50) / F.lit(100.0)
    seen = m.select("session_id", "message_id").join(members, "session_id").select("person_id", "message_id", importance.alias("importance"), x)
    return m, events, seen.select("person_id", (F.col("message_id") * 2 + F.col("x")).alias("event_id"), "importance")


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, events, seen = _chain(spark, sf_dir)
    return seen, memory.observed_messages(seen, events, m)


@PLANS.query(f"WITH {_MESSAGES} SELECT 1 AS event_type, message_id AS ref_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)) AS created_at FROM messages")
def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return memory.message_events(messages(spark, sf_dir).withColumn("created_at", created))


@PLANS.query(f"WITH {_CHAIN} SELECT person_id, event_id, 0.5::DOUBLE AS importance, TIMESTAMP '2024-02-01 00:00:00' AS last_scored_at FROM seen WHERE event_id % 3 > 0")
def memory_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice, and every third one was observed before."""
    _, _, seen = _chain(spark, sf_dir)
    new = memory.new_observations(seen.unionByName(seen), seen.where("event_id % 3 = 0"), at("2024-02-01 00:00:00"))
    return new.select("person_id", "event_id", "importance", "last_scored_at")


@PLANS.query(f"WITH {_CHAIN} SELECT person_id, event_id, message_id, session_id, sender, md5(content) AS content_md5 FROM observed")
def observation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)[1].select("person_id", "event_id", "message_id", "session_id", "sender", F.md5("content").alias("content_md5"))


@PLANS.query(f"WITH {_CHAIN} SELECT p.person_id, m.message_id * 2 AS event_id FROM messages m JOIN members p ON p.conv_id = m.conv_id WHERE m.message_id % 5 = 0")
def memory_route_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three persons recall every fifth message each; those of conversations in which they aren't hit nothing."""
    m, events, seen = _chain(spark, sf_dir)
    recalled = m.where("message_id % 5 = 0").select("message_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("person_id"), at("2024-02-01 00:00:00").alias("at"))
    return memory.routed_hits(recalled, events, seen).select("person_id", "event_id")


@PLANS.query(
    f"""WITH {_BOTH}, counted AS (SELECT person_id, entity_type, entity_id, count(DISTINCT event_id) AS n FROM both_ways GROUP BY ALL HAVING count(DISTINCT event_id) >= 4)
    SELECT * FROM counted WHERE person_id IN (SELECT person_id FROM seen GROUP BY person_id HAVING count(*) >= 4) AND NOT (entity_type = 2 AND entity_id % 2 = 0)"""
)
def density_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of even sessions were updated an hour ago, those of odd ones ten hours ago."""
    seen, observed = _observed(spark, sf_dir)
    hours = F.when(F.col("entity_id") % 2 == 0, 1).otherwise(10)
    keys = observed.select("person_id", F.lit(2).alias("entity_type"), F.col("session_id").alias("entity_id")).distinct()
    profiles = keys.withColumn("last_updated_at", at("2024-02-01 00:00:00") - F.make_dt_interval(hours=hours))
    return memory.due_directions(memory.directions(seen, observed, 4), profiles, at("2024-02-01 00:00:00"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third person has no name."""
    names = spark.createDataFrame([(1, "system"), (2, "user")], "person_id int, name string")
    return memory.evidence_texts(memory.labelled(memory.evidence(_observed(spark, sf_dir)[1], 3), names))


@PLANS.query(f"WITH {_INPUTS} SELECT person_id, entity_type, entity_id, evidence_count, md5(input) AS input_md5 FROM inputs")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select("person_id", "entity_type", "entity_id", "evidence_count", F.md5("input").alias("input_md5"))


@PLANS.query(
    f"""WITH {_INPUTS} SELECT person_id, entity_type, entity_id, CASE entity_id % 3 WHEN 0 THEN 'kept' ELSE 'about ' || left(input, 20) END AS narrative,
      evidence_count, md5(input) AS input_md5, CASE entity_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_updated_at FROM inputs"""
)
def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles: of unchanged inputs for every third entity, of outdated ones for the next, none for the last."""
    inputs = _inputs(spark, sf_dir)
    old = inputs.where("entity_id % 3 < 2").select(
        "person_id", "entity_type", "entity_id", F.lit("kept").alias("narrative"), "evidence_count", F.when(F.col("entity_id") % 3 == 0, F.md5("input")).otherwise(F.lit("old")).alias("input_md5"), at("2024-01-01 00:00:00").alias("last_updated_at")
    )
    return memory.profile_upsert(old, inputs, lambda x: F.concat(F.lit("about "), F.substring(x, 1, 20)), at("2024-02-01 00:00:00"))


@PLANS.query(f"WITH {_CHAIN} SELECT person_id, 2 AS entity_type, conv_id AS entity_id, CASE WHEN conv_id % 2 = 0 THEN 'session ' || conv_id ELSE '' END AS narrative FROM members")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second session has a profile."""
    m = _chain(spark, sf_dir)[0]
    asked = m.select(F.col("sender").alias("person_id"), F.lit(2).alias("entity_type"), F.col("session_id").alias("entity_id")).distinct()
    profiles = asked.where("entity_id % 2 = 0").withColumn("narrative", F.concat(F.lit("session "), F.col("entity_id").cast("string")))
    return memory.profile_of(asked, profiles)


@PLANS.query("SELECT doc_id, md5(text) AS input_md5 FROM documents WHERE doc_id % 3 <> 0")
def profile_md5_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes: right ones for every third document, outdated ones for the next, none for the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    previous = docs.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5("text")).otherwise(F.lit("old")).alias("input_md5"))
    return memory.changed_inputs(docs, previous, "doc_id", "text").select("doc_id", "input_md5")


@PLANS.query("SELECT user_id, max(ts) AS last_updated_at FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 360 MINUTE")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_updated_at"))
    return memory.due(profiles, at("2024-01-30 00:00:00"))


@PLANS.query(
    """WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings)
    SELECT vec_id, round(0.7 * sim + 0.2 * ((vec_id % 10) / 10.0::DOUBLE) + 0.1 / (1 + vec_id % 7), 6) AS score FROM s WHERE vec_id % 10 > 0"""
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and age of a vector are made from its id."""
    v = table(spark, sf_dir, "embeddings")
    from heron.functions.vectors import cosine_similarity
    from heron.plans.knowledge import vector_of

    sim = cosine_similarity("embedding", vector_of(v, 0))
    score = S.composite_score(sim, (F.col("vec_id") % 10) / F.lit(10.0), F.col("vec_id") % 7)
    return v.select("vec_id", F.round(score, 6).alias("score")).where("score is not null")
