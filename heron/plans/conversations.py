"""Conversation queries. A message's id is conv_id * 1000 + turn; roles stand for persons: system 1, user 2, assistant 3."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.operators import conversation, relational, runtime
from heron.plans.base import Plans, at, shared_root, table
from heron.sources import files

PLANS = Plans()

_MESSAGES = "messages AS (SELECT *, conv_id * 1000 + turn AS message_id, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 END AS person_id FROM conversations)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3)
    return table(spark, sf_dir, "conversations").withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("person_id", person)


@PLANS.query(
    f"""WITH {_MESSAGES}, s AS (SELECT message_id, CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) + CAST(contains(lower(text), '%') AS INTEGER) AS score
    FROM messages WHERE message_id < (SELECT max(message_id) FROM messages)) SELECT message_id, score FROM s WHERE score > 0 ORDER BY score DESC, message_id DESC LIMIT 25"""
)
def history_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages before the last one."""
    m = messages(spark, sf_dir)
    last = m.agg(F.max("message_id")).first()[0]  # one row
    return conversation.keyword_search(m, ["tion", "und", "%"], before=last, limit=25).select("message_id", "score")


@PLANS.query(f"WITH {_MESSAGES} SELECT message_id, conv_id, CASE person_id WHEN 1 THEN 'system' ELSE 'person_' || person_id END AS name FROM messages WHERE conv_id IN (SELECT conv_id FROM messages WHERE person_id = 1) AND contains(lower(text), 'en') ORDER BY message_id DESC LIMIT 20")
def history_search_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    names = m.where("person_id = 1").select("person_id", F.col("role").alias("name")).distinct()
    return conversation.history_search(m, m.where("person_id = 1"), "EN", names=names).select("message_id", "conv_id", "name")


@PLANS.query(
    f"""WITH {_MESSAGES}, d AS (SELECT *, turn % 3 = 0 AS pending FROM messages)
    SELECT 'message' AS of, message_id AS id, md5(text) AS text FROM d WHERE pending UNION ALL SELECT 'draft', message_id, CASE WHEN pending THEN '1' ELSE '-1' END FROM d
    UNION ALL SELECT 'cursor', conv_id * 10 + person_id, CAST(greatest(conv_id * 1000 + 2, coalesce(max(message_id) FILTER (WHERE pending), 0)) AS VARCHAR) FROM d GROUP BY conv_id, person_id
    UNION ALL SELECT 'title', conv_id, CASE WHEN conv_id % 2 = 0 THEN 'kept' ELSE coalesce((SELECT CASE WHEN length(text) > 15 THEN left(text, 15) || '...' ELSE text END FROM d x WHERE x.conv_id = c.conv_id AND pending ORDER BY message_id LIMIT 1), '') END FROM (SELECT DISTINCT conv_id FROM d) c"""
)
def drafts_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message of a conversation is a pending draft, the others were discarded; even sessions have titles.
    The four tables are published together and read back."""
    m = messages(spark, sf_dir)
    drafts = m.select(F.col("message_id").alias("draft_id"), F.col("conv_id").alias("session_id"), "person_id", "message_id", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, 0).otherwise(-1).alias("status"))
    participants = cursors(m).withColumnRenamed("conv_id", "session_id")
    sessions = m.select(F.col("conv_id").alias("session_id")).distinct().withColumn("title", F.when(F.col("session_id") % 2 == 0, "kept").otherwise(""))
    root = f"{shared_root(spark)}/drafts-{uuid.uuid4().hex}"
    files.publish(spark, conversation.commit_drafts(drafts, participants, sessions), root)
    got = files.published(spark, root)
    row = lambda t, name, i, text: got[t].select(F.lit(name).alias("of"), i.cast("long").alias("id"), text.cast("string").alias("text"))
    out = row("messages", "message", F.col("message_id"), F.md5("content")).unionByName(row("drafts", "draft", F.col("draft_id"), F.col("status")))
    return out.unionByName(row("participants", "cursor", F.col("session_id") * 10 + F.col("person_id"), F.col("last_read"))).unionByName(row("sessions", "title", F.col("session_id"), F.col("title")))


@PLANS.query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@PLANS.query("SELECT conv_id, turn, CAST(n AS INTEGER) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n BETWEEN 2 AND 4")
def message_seq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sequence_range(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 2, 4)


_CURSORS = f"{_MESSAGES}, cursors AS (SELECT DISTINCT conv_id, person_id, conv_id * 1000 + 2 AS last_read FROM messages)"


def cursors(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "person_id").distinct().withColumn("last_read", F.col("conv_id") * 1000 + 2)


@PLANS.query(f"WITH {_CURSORS} SELECT c.conv_id, c.person_id, m.message_id FROM cursors c JOIN messages m ON m.conv_id = c.conv_id AND m.message_id > c.last_read")
def unread_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return conversation.unread(m.select("conv_id", "message_id"), cursors(m)).select("conv_id", "person_id", "message_id")


@PLANS.query(f"WITH {_CURSORS} SELECT c.conv_id, c.person_id, greatest(c.last_read, x.most) AS last_read FROM cursors c JOIN (SELECT conv_id, max(message_id) AS most FROM messages GROUP BY conv_id) x ON x.conv_id = c.conv_id")
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    delta = m.select("conv_id", F.col("message_id").alias("last_read"))
    return relational.advance(cursors(m), delta, "conv_id", "last_read").select("conv_id", "person_id", "last_read")


@PLANS.query(f"WITH {_CURSORS} SELECT DISTINCT m.conv_id, m.person_id, m.message_id FROM messages m JOIN cursors c ON c.conv_id = m.conv_id AND c.person_id = m.person_id WHERE c.last_read < m.message_id")
def delivery_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    twice = m.select("conv_id", "person_id", "message_id")
    return conversation.not_delivered(twice.unionByName(twice), cursors(m), ["conv_id", "person_id"]).select("conv_id", "person_id", "message_id")


@PLANS.query("SELECT conv_id, turn AS version, md5(text) AS content_md5 FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn").select("conv_id", F.col("turn").alias("version"), F.md5("text").alias("content_md5"))


_WINDOWS = """m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, length(text) // 4 AS t FROM conversations),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS used, false AS closed FROM m
  UNION ALL
  SELECT m.conv_id, m.seq, CASE WHEN f.closed THEN 1 ELSE f.n + 1 END, CASE WHEN f.closed THEN m.t ELSE f.used + m.t END,
    (CASE WHEN f.closed THEN 1 ELSE f.n + 1 END) >= 4 OR (CASE WHEN f.closed THEN m.t ELSE f.used + m.t END) > 200
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.seq = f.seq + 1),
w AS (SELECT conv_id, seq AS version, seq - n + 1 AS first_seq, n AS n_messages, used AS tokens FROM f WHERE closed)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.summary_windows(table(spark, sf_dir, "conversations"), window=4, most_tokens=200)


@PLANS.query(f"WITH RECURSIVE {_WINDOWS} SELECT * FROM w")
def summary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@PLANS.query(f"WITH RECURSIVE {_WINDOWS} SELECT *, first_seq - 1 AS base FROM w WHERE conv_id % 2 = 1")
def summary_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries exist for the even conversations."""
    w = _windows(spark, sf_dir)
    return conversation.pending_windows(w, w.where("conv_id % 2 = 0").select("conv_id", "version"))


@PLANS.query(
    f"""WITH RECURSIVE {_WINDOWS}, n AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2 GROUP BY conv_id),
    b AS (SELECT n.conv_id, n_messages, md5(recent) AS recent_md5, coalesce((SELECT max(version) FROM w WHERE w.conv_id = n.conv_id), -1) AS version, n_messages < 4 AS simple FROM n JOIN r USING (conv_id))
    SELECT *, CASE WHEN version > 0 AND conv_id % 2 = 0 THEN 'told ' || version END AS narrative, n_messages >= 4 OR conv_id % 3 = 0 AS prepared FROM b"""
)
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations have narratives; every third one has a knowledge base."""
    w = _windows(spark, sf_dir)
    told = w.where("conv_id % 2 = 0").withColumn("narrative", F.concat(F.lit("told "), F.col("version").cast("string")))
    out = conversation.context_bundle(messages(spark, sf_dir), w, 2, simple_below=4, narratives=told)
    prepared = conversation.preprocessing_due(F.col("n_messages"), F.col("conv_id") % 3 == 0, 4)
    return out.select("conv_id", "n_messages", F.md5("recent").alias("recent_md5"), "version", "simple", "narrative", prepared.alias("prepared"))


@PLANS.query(f"WITH RECURSIVE {_WINDOWS} SELECT conv_id, version, conv_id % 2 = 0 AS told FROM w")
def narrative_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries exist for the even conversations; for the others one is asked for first."""
    w = _windows(spark, sf_dir).select("conv_id", "version")
    ready, missing = conversation.with_narrative(w, w.where("conv_id % 2 = 0").withColumn("summary", F.lit("s")))
    return ready.select("conv_id", "version", F.lit(True).alias("told")).unionByName(missing.withColumn("told", F.lit(False)))


@PLANS.query(f"WITH {_MESSAGES} SELECT DISTINCT conv_id FROM messages WHERE conv_id NOT IN (SELECT conv_id FROM messages WHERE person_id = 1)")
def foreign_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first person asks for all sessions."""
    m = messages(spark, sf_dir)
    return conversation.foreign_sessions(m, m.where("person_id = 1"))


@PLANS.query(
    f"""WITH {_MESSAGES} SELECT conv_id, md5(string_agg('person_' || person_id || ' [' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%d %H:%M:%S') || ']: ' || text, chr(10) ORDER BY turn)) AS history_md5
    FROM messages GROUP BY conv_id"""
)
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("person_"), F.col("person_id").cast("string"))
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return conversation.history_lines(messages(spark, sf_dir), name, when, F.col("text")).select("conv_id", F.md5("history").alias("history_md5"))


@PLANS.query(
    f"""WITH {_MESSAGES}, members AS (SELECT DISTINCT conv_id, person_id FROM messages), people AS (SELECT n_nationkey AS person_id, n_name AS name FROM nation WHERE n_nationkey % 3 <> 1)
    SELECT conv_id, string_agg(person_id || ':' || name, ',' ORDER BY person_id) AS members FROM members JOIN people USING (person_id) GROUP BY conv_id"""
)
def session_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations give the persons their names; of every third kind of person there is none (another type)."""
    people = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name"))
    nested = relational.members(messages(spark, sf_dir).select("conv_id", "person_id").distinct(), people, "conv_id", "person_id", "name")
    text = F.array_join(F.transform("members", lambda x: F.concat(x["person_id"].cast("string"), F.lit(":"), x["name"])), ",")
    return nested.select("conv_id", text.alias("members"))


@PLANS.query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id")
def roles_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = relational.first_seen(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"], "roles")
    return seen.withColumn("roles", F.array_join("roles", ","))


_LINE = "CASE WHEN x.person_id = p.person_id THEN 'you' WHEN x.person_id = 3 THEN 'person_3' ELSE 'name ' || x.person_id END || ' [' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(x.turn AS INTEGER)), '%Y-%m-%d %H:%M') || ']: ' || CASE WHEN length(x.text) > 200 THEN left(x.text, 200) || '...' ELSE x.text END"


@PLANS.query(
    f"""WITH {_MESSAGES}, members AS (SELECT DISTINCT conv_id, person_id FROM messages),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY message_id DESC) AS k FROM messages) WHERE k <= 5)
    SELECT p.person_id, p.conv_id AS session_id,
      coalesce((SELECT string_agg(CASE o.person_id WHEN 3 THEN 'person_3' ELSE 'name ' || o.person_id END, ', ' ORDER BY o.person_id) FROM members o WHERE o.conv_id = p.conv_id AND o.person_id <> p.person_id), '') AS others,
      CASE WHEN p.conv_id % 2 = 0 THEN 'told ' || p.conv_id ELSE '' END AS narrative, md5(string_agg({_LINE}, chr(10) ORDER BY x.message_id)) AS recent_md5
    FROM members p JOIN last x ON x.conv_id = p.conv_id GROUP BY ALL"""
)
def sessions_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third person has no name; every second session has a narrative."""
    created = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    m = messages(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "message_id", F.col("person_id").alias("sender"), F.col("text").alias("content"), created.alias("created_at"))
    members = m.select("session_id", F.col("sender").alias("person_id")).distinct()
    names = members.where("person_id < 3").select("person_id").distinct().withColumn("name", F.concat(F.lit("name "), F.col("person_id").cast("string")))
    profiles = members.where("session_id % 2 = 0").withColumn("narrative", F.concat(F.lit("told "), F.col("session_id").cast("string")))
    out = runtime.sessions_overview(members, names, profiles, m)
    return out.select("person_id", "session_id", "others", "narrative", F.md5("recent").alias("recent_md5"))


@PLANS.query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS participating FROM customer")
def participation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.participation(table(spark, sf_dir, "customer").select("c_custkey"), mine, "c_custkey")


@PLANS.query("SELECT o_orderkey, o_custkey, coalesce(c_name, 'person_' || o_custkey) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer has no name here."""
    people = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return relational.with_names(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey", "name")


@PLANS.query(f"WITH {_MESSAGES}, members AS (SELECT DISTINCT conv_id, person_id FROM messages) SELECT m.message_id, p.person_id FROM messages m JOIN members p ON p.conv_id = m.conv_id AND p.person_id <> m.person_id")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    members = m.select("conv_id", "person_id").distinct()
    return conversation.fan_out(m.select("conv_id", "message_id", F.col("person_id").alias("sender")), members).select("message_id", "person_id")


@PLANS.query(
    f"""WITH {_MESSAGES}, page AS (SELECT DISTINCT conv_id FROM messages ORDER BY conv_id LIMIT 30 OFFSET 10)
    SELECT p.conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS members, bool_or(role = 'system') AS participating FROM page p JOIN messages m ON m.conv_id = p.conv_id GROUP BY p.conv_id"""
)
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of sessions with their members, and whether the system is one of them."""
    m = messages(spark, sf_dir)
    paged = relational.page(m.select("conv_id").distinct(), ["conv_id"], 10, 30)
    members = m.join(paged, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("members"))
    return relational.participation(members, m.where("role = 'system'"), "conv_id")


@PLANS.query(
    """WITH j AS (SELECT n_regionkey, c_custkey, n_name, c_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS i, max(c_custkey) OVER (PARTITION BY n_regionkey) AS most
      FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey)
    SELECT n_regionkey, c_custkey, n_name, c_name, coalesce(most, 0) AS most FROM j WHERE i = 1"""
)
def first_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way join with one whole row a group: that of the least id, where the original takes any."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey")
    joined = nations.join(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey").select("n_regionkey", "c_custkey", "n_name", "c_name")
    most = joined.groupBy("n_regionkey").agg(F.coalesce(F.max("c_custkey"), F.lit(0)).alias("most"))
    return relational.any_of(joined, ["n_regionkey"], "c_custkey").join(most, "n_regionkey")


@PLANS.query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))")
def nested_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = relational.in_list(table(spark, sf_dir, "region"), "r_name", ["ASIA"])
    steps = (table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey"), (regions, "n_regionkey", "r_regionkey")
    return relational.nested_semi(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), *steps)
