"""Retrieval over conversations: keywords, histories, unread ranges, summary windows and context bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import text as T
from heron.operators.folds import ordered_fold
from heron.operators.relational import id_range, last_n, with_names

LIMIT, HISTORY_LIMIT, HISTORY_MOST = 5, 20, 100
WINDOW, WINDOW_TOKENS = 50, 16_000


def keyword_search(messages: DataFrame, keywords: Sequence[str], before: int | None = None, limit: int = LIMIT, content: str = "text", id_column: str = "message_id") -> DataFrame:
    """Messages by how many keywords they have, newest first among ties; those without any are left out. An empty list
    of keywords gives no rows."""
    rows = messages if before is None else messages.where(F.col(id_column) < before)
    scored = rows.withColumn("score", T.keyword_score(F.col(content), keywords)).where(F.col("score") > 0)
    return scored.orderBy(F.desc("score"), F.desc(id_column)).limit(limit)


def history_search(messages: DataFrame, mine: DataFrame, needle: str, session: str = "conv_id", limit: int = HISTORY_LIMIT, content: str = "text", id_column: str = "message_id", names: DataFrame | None = None, person: str = "person_id") -> DataFrame:
    """Newest messages with the needle in the sessions of `mine`; at most HISTORY_MOST. With `names` (person, name) also
    the sender's name, or person_ and the id."""
    own = messages.join(mine.select(session).distinct(), session, "left_semi")
    found = own.where(T.contains_any_case(F.col(content), needle)).orderBy(F.desc(id_column)).limit(min(limit, HISTORY_MOST))
    return found if names is None else with_names(found, names, person, "name")


def commit_drafts(drafts: DataFrame, participants: DataFrame, sessions: DataFrame, pending: int = 0, committed: int = 1, most_title: int = 15) -> dict[str, DataFrame]:
    """What one commit of the pending drafts makes, to be published together: messages (draft_id tells which draft),
    the drafts, each participant's cursor moved to the largest message of its own drafts, and a title for sessions that
    have none: the head of their first message. drafts: draft_id, session_id, person_id, message_id, content, status;
    participants: session_id, person_id, last_read; sessions: session_id, title."""
    own = drafts.where(F.col("status") == pending)
    messages = own.select("message_id", "session_id", "person_id", "content", "draft_id")
    done = drafts.withColumn("status", F.when(F.col("status") == pending, committed).otherwise(F.col("status")))
    read = own.groupBy("session_id", "person_id").agg(F.max("message_id").alias("_read"))
    cursors = participants.join(read, ["session_id", "person_id"], "left").withColumn("last_read", F.greatest("last_read", "_read")).drop("_read")
    first = own.groupBy("session_id").agg(F.min_by("content", "message_id").alias("_first"))
    title = F.when(F.coalesce("title", F.lit("")) == "", T.shortened(F.col("_first"), most_title))
    titled = sessions.join(first, "session_id", "left").withColumn("title", F.coalesce(title, "title")).drop("_first")
    return {"messages": messages, "drafts": done, "participants": cursors, "sessions": titled}


def unread(messages: DataFrame, cursors: DataFrame, session: str = "conv_id", id_column: str = "message_id", cursor: str = "last_read") -> DataFrame:
    """For each cursor (session, person, last_read) the messages behind it, up to the largest that the session has."""
    return cursors.join(messages, session).where(F.col(id_column) > F.coalesce(F.col(cursor), F.lit(0)))


def not_delivered(deliveries: DataFrame, cursors: DataFrame, keys: list[str], id_column: str = "message_id", cursor: str = "last_read") -> DataFrame:
    """Deliveries that the cursor has not passed yet, each once."""
    rows = deliveries.dropDuplicates([*keys, id_column]).join(cursors.select(*keys, cursor), keys, "left")
    return rows.where(F.col(cursor).isNull() | (F.col(cursor) < F.col(id_column))).drop(cursor)


def _window_start() -> tuple:
    return 0, 0, 0


def _window_step(state: tuple, order: int, tokens: int, window: int, most: int) -> tuple:
    seen, n, used = state
    seen, n, used = seen + 1, n + 1, used + tokens
    if n >= window or used > most:
        return (seen, 0, 0), [(seen, seen - n + 1, n, used)]
    return (seen, n, used), ()


def summary_windows(messages: DataFrame, session: str = "conv_id", order: str = "turn", content: str = "text", window: int = WINDOW, most_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Windows that close at `window` messages or beyond `most_tokens` estimated tokens: session, version (the place of
    the last message), first_seq, n_messages, tokens. An open window at the end gives nothing. What closes a window
    depends on where the last one closed, so this is a fold."""
    rows = messages.select(F.col(session).cast("long").alias(session), F.col(order).cast("long").alias(order), F.coalesce(T.estimated_tokens(F.col(content)), F.lit(0)).cast("long").alias("_tokens"))
    return ordered_fold(rows, [session], [order], [order, "_tokens"], _window_start, partial(_window_step, window=window, most=most_tokens), f"{session} long, version long, first_seq long, n_messages long, tokens long")


def pending_windows(windows: DataFrame, existing: DataFrame, session: str = "conv_id") -> DataFrame:
    """Windows without a summary of their version yet; `base` is the version that the next summary builds on."""
    return windows.join(existing.select(session, "version").distinct(), [session, "version"], "left_anti").withColumn("base", F.col("first_seq") - 1)


def with_narrative(targets: DataFrame, summaries: DataFrame, session: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """targets (session, version): those with a summary of their version, from which a narrative can be told, and those
    whose summary has to be asked for first."""
    keys = [session, "version"]
    return targets.join(summaries, keys), targets.join(summaries.select(*keys), keys, "left_anti")


def preprocessing_due(count: Column, has_knowledge: Column, window: int = WINDOW) -> Column:
    """Whether a context is prepared before an answer: for long conversations, and wherever there is a knowledge base."""
    return (count >= window) | has_knowledge


def foreign_sessions(asked: DataFrame, mine: DataFrame, session: str = "conv_id") -> DataFrame:
    """The sessions of a search that are not one's own; a search within them is refused."""
    return asked.select(session).distinct().join(mine.select(session), session, "left_anti")


def context_bundle(messages: DataFrame, summaries: DataFrame, n: int, session: str = "conv_id", order: str = "message_id", content: str = "text", simple_below: int = WINDOW, narratives: DataFrame | None = None) -> DataFrame:
    """Per session: its last n messages in order as one text, the latest summary version (-1: none), and whether the
    plain context (few messages) serves. With `narratives` (session, version, narrative) also the one of that version."""
    counts = messages.groupBy(session).agg(F.count("*").alias("n_messages"))
    recent = last_n(messages, session, order, n).groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n").alias("recent"))
    latest = summaries.groupBy(session).agg(F.max("version").alias("version"))
    out = counts.join(recent, session).join(latest, session, "left")
    out = out.select(session, "n_messages", "recent", F.coalesce("version", F.lit(-1)).alias("version"), (F.col("n_messages") < simple_below).alias("simple"))
    return out if narratives is None else out.join(narratives.select(session, "version", "narrative"), [session, "version"], "left")


def history_lines(messages: DataFrame, name: Column, at: Column, content: Column, session: str = "conv_id", order: str = "message_id") -> DataFrame:
    """Each session as lines `name [time]: content`, in order."""
    line = F.format_string("%s [%s]: %s", name, F.date_format(at, "yyyy-MM-dd HH:mm:ss"), content)
    rows = messages.select(session, F.col(order).alias("_o"), line.alias("_l"))
    return rows.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), "\n").alias("history"))


def sequence_range(messages: DataFrame, first: int, last: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages from place `first` to `last` (from 1) of every session."""
    placed = messages.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    return id_range(placed, "seq", first - 1, last)


def fan_out(messages: DataFrame, members: DataFrame, session: str = "conv_id", sender: str = "sender", member: str = "person_id") -> DataFrame:
    """A row for every other member of the message's session."""
    return messages.join(members.select(session, member), session).where(F.col(member) != F.col(sender))
