"""Hand cases: what the tables don't have."""

import datetime as dt
import math

import plain_chunks
import pytest
from pyspark.sql import functions as F

from heron.functions import scalars as S
from heron.functions import text as T
from heron.functions import vectors as V
from heron.operators import cascade, chunking, conversation, library, memory, relational, runtime
from heron.operators import vectors as search
from heron.sources import files



def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Chunks.


def test_blank_text_has_no_chunk():
    assert plain_chunks.pack(plain_chunks.paragraphs("\n \n\n")) == []


def test_paragraphs_end_at_blank_lines():
    assert plain_chunks.paragraphs("a\nb\n \t\nc") == ["a\nb", "c"]


def test_large_paragraph_is_cut_by_words():
    got = plain_chunks.pack([" ".join(f"w{i}" for i in range(15))], size=7, overlap=0, least=1)
    assert [n for _, n, _, _ in got] == [7, 7, 1]


def test_small_tail_joins_the_one_before():
    got = plain_chunks.pack(["a b c", "d e f", "g"], size=3, overlap=0, least=2)
    assert [c for c, *_ in got] == ["a b c", "d e f\n\ng"]


def test_overlap_moves_the_start_only():
    got = plain_chunks.pack(["a b", "c d", "e f"], size=4, overlap=2, least=1)
    assert [c for c, *_ in got] == ["a b\n\nc d", "e f"]
    assert got[1][2] == got[0][3] - len("c d") - 2
    assert [s for *_, s, _ in got] == sorted(s for *_, s, _ in got)


def test_the_next_chunk_starts_behind_the_pieces_of_a_large_paragraph():
    got = plain_chunks.pack(["a b c d e f", "g h"], size=4, overlap=3, least=1)
    assert [(c, s, e) for c, _, s, e in got] == [("a b c d", 0, 7), ("e f", 7, 10), ("g h", 10, 13)]


def test_a_part_within_the_overlap_moves_the_start_back():
    got = plain_chunks.pack(["a b", "c d e f"], size=4, overlap=2, least=1)
    assert [s for _, _, s, _ in got] == [0, -2]


def _texts(seed, n=60):
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "ccc", "é", "dddd-eeee", "漢字"])
    line = lambda: rng.choice(["", " ", "\t", "\u2003"]) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 25])))
    texts = ["\n".join(line() for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return [*texts, None, "", "\n\n", "one\r\n\r\ntwo", "a " * 500, " \n lead", "trail \n\n", "x\n\ny"]


def test_native_chunks_equal_the_plain_ones(spark):
    """Parts that are too large, overlaps that reach over several, small tails; by words and by a tokenizer of one's own."""
    texts = _texts(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of = lambda t: (len(t) + 2) // 3
    for by_line in (False, True):
        for size, overlap, least in ((7, 0, 1), (10, 4, 3), (6, 100, 5), (500, 50, 100), (1, 0, 0)):
            for own, batched in ((plain_chunks.count_words, None), (of, lambda ts: [(len(t) + 2) // 3 for t in ts])):
                want = []
                for i, t in enumerate(texts):
                    parts = [x for x in (t or "").split("\n") if x.strip()] if by_line else plain_chunks.paragraphs(t or "")
                    want += [(i, k, *c) for k, c in enumerate(plain_chunks.pack(parts, size, overlap, least, own, "\n" if by_line else "\n\n"))]
                got = chunking.chunk_documents(df, size, overlap, least, batched, by_line)
                assert rows(got) == sorted(want), (by_line, size, overlap, least, batched)


def test_chunking_is_native_and_splits_a_text_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = chunking.chunk_documents(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    words = chunking.chunk_words(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert not any("transform(" in x or "split(" in x for x in words.splitlines() if "Filter" in x)


def test_many_small_chunks_of_a_long_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20_000))), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.chunk_words(df, 10).collect()
    assert [r.chunk_index for r in got] == list(range(2000)) and got[-1].content.endswith("w19999")


def test_chunking_handles_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a\n\nb", "z")], "doc_id long, text string, content string")
    assert [r.doc_id for r in chunking.chunk_documents(df).collect()] == [3]
    assert rows(chunking.ingest(df)[1]) == [(1, 3, 0), (2, 3, 0), (3, 2, 1)]


def test_a_document_with_a_chunk_without_a_vector_fails_whole(spark):
    df = spark.createDataFrame([(1, "a b\n\nc d"), (2, "e f\n\nx y"), (3, None)], "doc_id long, text string")
    embed = lambda c: c.withColumn("embedding", F.when(~F.contains("content", F.lit("x")), F.array(F.lit(1.0))))
    kept, status = chunking.ingest(df, embed, size=2, overlap=0, least=0)
    assert [r.doc_id for r in kept.collect()] == [1, 1] and rows(status) == [(1, 2, 2), (2, 3, 0), (3, 3, 0)]


# Vectors.


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, None), (7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.search(df, [1.0, 0.0], 3).collect()] == [1, 7, 3]
    assert [r.vec_id for r in search.search(df, [1.0, 0.0], 9, min_score=0.9).collect()] == [1, 7]
    assert [r.vec_id for r in search.search(df, [0.0, 0.0], 2, metric="euclidean").collect()] == [4, 1]
    s = search.statistics(df).first()
    assert (s.zero_vectors, s.invalid_vectors, s.n) == (1, 2, 7)
    pairs = search.similar_to_set(df, df.where("vec_id <= 3"), 0.7, block=2)
    assert rows(pairs.select("hit_id", "vec_id")) == [(1, 3), (1, 7), (2, 3), (3, 1), (3, 2), (3, 7)]
    assert search.similar_to_set(df, df.limit(0)).collect() == []


def test_vectors_of_other_dimensions_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0], 1), (3, [2.0, 0.1], 1), (4, [2.0], 2), (5, [3.0], 1)], "vec_id long, embedding array<float>, s long")
    assert [r.vec_id for r in search.search(df, [1.0, 0.0], 9).collect()] == [1, 3]
    assert [r.vec_id for r in search.search_each(df, [1.0], "s", 9).orderBy("vec_id").collect()] == [2, 4, 5]
    assert rows(search.similar_to_set(df, df, 0.9).select("hit_id", "vec_id")) == [(1, 3), (2, 4), (2, 5), (3, 1), (4, 2), (4, 5), (5, 2), (5, 4)]
    assert rows(search.similar_to_set(df, df, 0.9, scope="s").select("hit_id", "vec_id")) == [(1, 3), (2, 5), (3, 1), (5, 2)]


def test_blocks_change_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = df.where("vec_id % 20 = 0")
    one = rows(search.similar_to_set(df, q, 0.2).select("hit_id", "vec_id"))
    assert one and rows(search.similar_to_set(df, q, 0.2, block=50).select("hit_id", "vec_id")) == one


def test_nearest_to_each(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "b"), (3, [1.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, [float("nan"), 1.0], "a"), (6, None, "b"), (7, [3.0, 0.0], None), (8, [1.0], "a"), (None, [1.0, 0.0], "a")], "vec_id long, embedding array<float>, g string")
    for block in (1, 2, 100):
        got = search.nearest_to_each(df, df.where("vec_id in (1, 3, 4, 8)"), 2, block=block)
        assert rows(got.select("hit_id", "rank", "vec_id")) == [(1, 1, 2), (1, 2, 7), (3, 1, 1), (3, 2, 2)]
        assert rows(search.nearest_to_each(df, df.where("vec_id = 1"), 2, itself=True, block=block).select("vec_id")) == [(1,), (2,)]
    each = search.nearest_to_each(df.where("g is not null"), df.where("vec_id = 1"), 1, group="g").select("g", "vec_id", "rank")
    assert rows(each) == [("a", 3, 1), ("b", 2, 1)]
    assert search.nearest_to_each(df.limit(0), df, 3).collect() == [] == search.nearest_to_each(df, df.limit(0), 3).collect()


def test_nearest_of_many_equal_vectors(spark):
    """A third of the rows have one vector; ties go by id, in whatever block they lie."""
    import numpy as np

    rng = np.random.default_rng(1)
    same = rng.normal(size=16)
    v = [(i, (same if i % 3 == 0 else rng.normal(size=16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(7)
    x = np.array([e for _, e in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 12)
    want = [(i, j) for i in range(0, 300, 20) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], j))[:4]]
    for block in (13, 1000):
        assert rows(search.nearest_to_each(df, df.where("vec_id % 20 = 0"), 4, block=block).select("hit_id", "vec_id")) == sorted(want)


def test_a_prefilter_holds_before_the_cut(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.search(df, [1.0, 0.0], 2, prefilter=F.col("vec_id") > 1).collect()] == [2, 3]


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine_distance("a", "b")).collect()] == [1.0, 0.0]


def test_embeddings_are_asked_for_in_batches_and_checked(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(25)], "id long, content string").coalesce(1)

    def embed(texts):
        assert len(texts) <= 10
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.id: r.embedding for r in search.with_embeddings(df, embed, 2).collect()}
    assert got[3] is None and got[24] == [24.0, 1.0] and len(got) == 25
    for bad in (lambda t: [[1.0]] * len(t), lambda t: [[float("nan"), 1.0]] * len(t), lambda t: []):
        with pytest.raises(Exception, match="vector"):
            search.with_embeddings(df, bad, 2).collect()


def test_distance_registry():
    with pytest.raises(ValueError, match="no distance"):
        V.distance("taxi")
    V.register_distance("taxi", lambda a, b: F.lit(0.0))
    assert V.distance("taxi")
    del V.DISTANCES["taxi"]


def test_blobs(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\0\x80?")), (2, bytearray(b"abc")), (3, None)], "chunk_id long, blob binary")
    assert rows(search.decode_blobs(df)) == [(1, [1.0]), (2, None), (3, None)]
    v = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "chunk_id long, embedding array<float>")
    assert rows(search.decode_blobs(search.encode_blobs(v))) == [(1, [1.0, -2.5]), (2, []), (3, None)]


# Memory.


def test_cooldown_is_anchored_on_what_counted(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, i, t(m)) for i, m in enumerate([0, 6, 12, 18])], "user_id long, event_id long, ts timestamp_ntz")
    again = memory.hits(df, importance=F.lit(0.9), scored_at=F.lit("2024-01-01 00:05:00")).first()
    assert (again.n_counted, again.last_scored_at, again.last_accessed_at) == (1, t(18), t(18)) and math.isclose(again.importance, 0.91)
    got = memory.hits(df).first()
    assert (got.n_hits, got.n_counted, got.last_scored_at) == (4, 2, t(12))
    assert math.isclose(got.importance, 1 - 0.5 * 0.9**2)


def test_decay_stops_at_the_floor(spark):
    df = spark.createDataFrame([(0.5,), (1e-7,), (0.9,)], "i double")
    got = [r[0] for r in df.select(S.decayed(F.col("i"), F.lit(100_000))).collect()]
    assert got[1] == 1e-7 and all(1e-6 * 0.97 < x <= 1e-6 for x in (got[0], got[2]))


def test_first_rule_wins(spark):
    df = spark.createDataFrame([(1, 2, 4), (1, 2, 1), (1, 1, 1), (3, 2, 2)], "hit_id long, event_id long, rule int")
    assert rows(memory.first_rule(df)) == [(1, 2, 1), (3, 2, 2)]


def test_gains_in_order_of_time(spark):
    t = dt.datetime(2024, 1, 1, 12)
    obs = spark.createDataFrame([(1, 0.5, None), (2, 0.99, t - dt.timedelta(hours=1)), (3, 0.5, t - dt.timedelta(minutes=5)), (4, 0.1, None)], "event_id long, importance double, last_scored_at timestamp_ntz")
    gains = spark.createDataFrame([(7, 1, 0.2), (6, 1, 0.1), (7, 2, 0.2), (7, 3, 0.2)], "hit_id long, event_id long, gain double")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    folded = {r.event_id: (round(r.importance, 9), r.last_scored_at) for r in memory.apply_gains(obs, gains.withColumn("at", now)).collect()}
    assert folded == {1: (0.6, t), 2: (1.0, t), 3: (0.5, t - dt.timedelta(minutes=5))}


def plain_cascade(observations, hits, cooldown, similar):
    """One hit after another over dicts: observations (id, created, importance, scored, vector), hits (at, id) of a session."""
    now, accessed = {i: [imp, scored] for i, _, imp, scored, _ in observations}, {}
    vector = {i: v for i, _, _, _, v in observations}
    created = {i: c for i, c, *_ in observations}
    is_open = lambda i, at: now[i][1] is None or at - now[i][1] >= cooldown

    def cosine(a, b):
        return -1 if a is None or b is None or not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for at in sorted({a for a, _ in hits}):
        there = sorted(i for i in created if created[i] <= at)
        batch = sorted({i for a, i in hits if a == at and i in there})
        deltas = {}
        for i in batch:
            accessed[i] = at
            if is_open(i, at):
                deltas[i] = 0.1 * (1 - now[i][0])
                now[i] = [now[i][0] + deltas[i], at]
        for i, delta in deltas.items():
            for j in there:
                if j == i or not is_open(j, at):
                    continue
                away = abs(there.index(i) - there.index(j))
                share = 0.5 if away == 1 else 0.2 if away == 2 or cosine(vector[i], vector[j]) > similar else 0.15
                now[j] = [min(1.0, now[j][0] + share * delta), at]
    return {i: (round(now[i][0], 9), now[i][1], accessed.get(i)) for i in now}


def _a_session(seed, n, hits):
    """Ids in order of time, some observations scored before they came, some without a vector or with a zero one."""
    import random

    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    times = sorted(rng.randrange(0, 300, 5) for _ in range(n))
    vectors = [None, [0.0, 0.0], [1.0, 0.0], [1.0, 0.2], [0.0, 1.0], [-1.0, 0.1]]
    obs = [(10 + 3 * k, at(m), rng.random(), rng.choice([None, at(m), at(m - 7), at(m - 300)]), rng.choice(vectors)) for k, m in enumerate(times)]
    return obs, [(at(rng.randrange(0, 300, 5)), rng.choice([o[0] for o in obs] + [999])) for _ in range(hits)]


def test_the_cascade_equals_the_plain_version(spark):
    """Several persons and sessions, whose observations have the same ids; hits of one time, of what isn't there yet, and of
    nothing."""
    sessions = {(p, s): _a_session(10 * p + s, n, h) for p, s, n, h in [(1, 1, 1, 3), (1, 2, 9, 30), (2, 1, 25, 60), (2, 2, 5, 0), (3, 1, 40, 200)]}
    obs = [(p, s, *o, "x") for (p, s), (os, _) in sessions.items() for o in os]
    hit = [(p, s, *h) for (p, s), (_, hs) in sessions.items() for h in hs]
    o = spark.createDataFrame([(*r[:6], r[6], 1) for r in obs], "person_id long, session_id long, event_id long, created_at timestamp_ntz, importance double, last_scored_at timestamp_ntz, embedding array<double>, kind int")
    h = spark.createDataFrame(hit, "person_id long, session_id long, at timestamp_ntz, event_id long").repartition(3)
    got = {(r.person_id, r.session_id, r.event_id): (round(r.importance, 9), r.last_scored_at, r.last_accessed_at) for r in cascade.replay(o, h.unionByName(h), ["person_id", "session_id"], 10, 0.8).collect()}
    want = {(p, s, i): v for (p, s), (os, hs) in sessions.items() for i, v in plain_cascade(os, hs, dt.timedelta(minutes=10), 0.8).items()}
    assert got == want
    assert cascade.replay(o.limit(0), h, ["person_id", "session_id"]).collect() == []
    assert cascade.replay(o, h.limit(0), ["session_id"]).count() == len({(r[1], r[2]) for r in obs})


def test_hits_at_one_time_equal_the_plain_version(spark):
    """A hit is no target, one within its cooldown spreads nothing, and persons don't reach each other's observations."""
    t = dt.datetime(2024, 1, 1, 12)
    rows_, want = [], {}
    for person in (1, 2, 3, 4):
        obs, _ = _a_session(person, 12, 0)
        obs = [(i, c, imp, scored and min(scored, t), v) for i, c, imp, scored, v in obs]
        if person == 4:
            obs = [(i, c, imp, t, v) for i, c, imp, _, v in obs]  # all in cooldown
        hits = [(t, i) for i, *_ in obs if i % 4 == 0 and person != 3]
        want |= {(person, i): v[:2] for i, v in plain_cascade([(i, t - dt.timedelta(days=1), *o) for i, _, *o in obs], hits, dt.timedelta(minutes=10), 0.8).items()}
        rows_ += [(person, 7, i, imp, scored, v) for i, _, imp, scored, v in obs]
    df = spark.createDataFrame(rows_, "person_id long, session_id long, event_id long, importance double, last_scored_at timestamp_ntz, embedding array<double>")
    done = memory.scored_at_once(df, (F.col("event_id") % 4 == 0) & (F.col("person_id") != 3), F.lit(t).cast("timestamp_ntz"), ["person_id", "session_id"])
    got = {(r.person_id, r.event_id): (round(r.importance, 9), r.last_scored_at) for r in done.collect()}
    assert got == want
    assert {r.rule for r in done.where("person_id = 4").collect()} == {None} and 0 in {r.rule for r in done.where("person_id = 1").collect()}


def test_neighbours_stay_within_all_keys(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (1, 5, 3), (2, 5, 4)], "person_id long, session_id long, event_id long").withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    keys = ["person_id", "session_id"]
    assert rows(memory.temporal_neighbours(df, F.col("event_id") == 1, keys)) == [(1, 3, 1)]
    assert rows(memory.similar_neighbours(df, F.col("event_id") == 2, session=keys)) == [(2, 4, 3)]
    assert rows(memory.session_share(df, F.col("event_id") == 2, spark.createDataFrame([], "hit_id long, event_id long"), keys)) == [(2, 1)]


# Conversations and relations.


def test_keywords_are_literal_and_count_twice(spark):
    df = spark.createDataFrame([(1, "100% Ja"), (2, "nein"), (3, None)], "message_id long, text string")
    assert rows(conversation.keyword_search(df, ["%", "JA", "ja"]).select("message_id", "score")) == [(1, 3)]
    assert conversation.keyword_search(df, []).collect() == []


def test_windows_close_by_count_or_tokens(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([4, 4, 4, 400, 4])], "conv_id long, turn long, text string")
    assert rows(conversation.summary_windows(df, window=3, most_tokens=50)) == [(1, 3, 1, 3, 3), (1, 4, 4, 1, 100)]
    assert conversation.summary_windows(df.limit(0)).collect() == []


def test_the_last_row_of_a_key_counts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, None, 3), (2, "y", 2), (4, "z", 1)], "id long, v string, n long")
    assert rows(relational.upsert(base, delta, ["id"], ["n"])) == [(1, "a"), (2, None), (4, "z")]
    assert rows(relational.upsert(base, delta.drop("n"), ["id"]))[1] == (2, "y")


def test_relations(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (1, "b", 2), (2, "c", 9)], "k long, v string, n long")
    assert rows(relational.first_seen(df, ["k"], "v", ["n"])) == [(1, ["a", "b"]), (2, ["c"])]
    assert rows(relational.any_of(df, ["k"], "n")) == [(1, "a", 1), (2, "c", 9)]
    assert rows(relational.lookup(df, spark.createDataFrame([(2,), (2,), (5,)], "k long"), "k")) == [(2, "c", 9)]
    assert rows(relational.mark(df, spark.createDataFrame([(2,)], "k long"), "k", "n", 0))[-1] == (2, "c", 0)
    assert [r.n for r in relational.page(df, [F.desc("n")], 1, 2).collect()] == [3, 2]
    assert [relational.id_range(df, "n", 1, u).count() for u in (None, 0, 2)] == [3, 3, 1]


def test_upsert_and_lists(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert rows(relational.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert relational.in_list(base, "id", []).collect() == []
    lists = spark.createDataFrame([("[1, 2, 1]",), (None,)], "ids string")
    assert [r[0] for r in relational.remove_from_lists(lists, "ids", 1).collect()] == ["[2]", None]


def test_advance_never_goes_back(spark):
    base, delta = (spark.createDataFrame(x, "k long, c long") for x in ([(1, 5), (2, 5)], [(1, 3), (2, 9)]))
    assert rows(relational.advance(base, delta, "k", "c").select("k", "c")) == [(1, 5), (2, 9)]


# Runtime.


def test_block_is_sticky_and_runs_reset(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("aaaab" + "a")], "k long, i long, s string")
    got = [(r.cycle_count, r.warned, r.blocked) for r in runtime.signature_runs(df, "k", ["i"], F.col("s"), warn=1, block=3).orderBy("i").collect()]
    assert got == [(0, False, False), (1, True, False), (2, True, False), (3, False, True), (0, False, True), (0, False, True)]


def test_budget_buffers_and_replays_in_order():
    d = dt.date(2024, 1, 1)
    state, seen = (100, None, 0), []
    for day, beat in [(d, False), (d, False), (d, True), (d + dt.timedelta(1), False)]:
        state, did = runtime.spend(state, day, beat, 60, 90)
        seen.append(did)
    assert seen == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (1, 0, 0, 1)]
    assert state[0] == 140 - 120


@pytest.mark.parametrize("n", [5, 100, 101, 150, 400])
def test_bulk_shrink_shows_the_last_entries_of_a_long_list(spark, n):
    got = runtime.bulk_shrink(spark.range(n).withColumn("k", F.lit(1)), "k", ["id"])
    assert [r.id for r in got.orderBy("id").collect()] == list(range(n))[-10 if n > 100 else -n :]


def test_one_note_stays(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 50), (2, 1, 3), (2, 2, 4)], "k long, i long, n long")
    assert rows(runtime.trim_notes(df, "k", ["i"], F.col("n"), 7).select("k", "i")) == [(1, 2), (2, 1), (2, 2)]


def test_actions_are_judged_one_by_one(spark):
    fields = "id long, type string, source string, event_type int, guidance string, reason string, work_type int, delivery_target string, session_id long, recipient_id long, trigger_at string, message string, alarm_action string, alarm_content string, in_session long, target_work_id long"
    blank = (None,) * 11
    df = spark.createDataFrame(
        [
            (1, "route", "event", 0, "g", "r", *(None,) * 8, 5, 10),
            (2, "route", "heartbeat", 0, "g", "r", *(None,) * 8, 5, 10),
            (3, "route", "event", 0, "g", "r", *(None,) * 8, 6, 10),
            (4, "create", "event", 0, "g", None, 1, None, None, None, *(None,) * 4, 5, None),
            (5, "create", "heartbeat", 0, "g", None, 1, "send_to_session", 7, None, *(None,) * 4, 5, None),
            (6, None, None, None, None, *blank),
            (7, "create", "heartbeat", 0, "g", None, None, "x", *(None,) * 8),
            (8, "create", "event", 0, "g", None, None, "x", *(None,) * 8),
        ],
        fields,
    )
    works = spark.createDataFrame([(10, 5, 2)], "work_id long, session_id long, work_type int")
    assert {r.id: r.error for r in runtime.valid_actions(df, works).collect()} == {1: None, 2: "not on a heartbeat", 3: "no such work", 4: None, 5: None, 6: "unknown type", 7: "chat only on a heartbeat", 8: "unknown target"}


def test_activity_of_odd_payloads(spark):
    df = spark.createDataFrame([(1, 1, 2, "{", 0), (2, 1, 2, '{"content": "\\n x\\u2003\\n", "tool_calls": null}', 0), (3, 1, 3, None, 0), (4, 1, 1, "{}", 0), (5, 9, 3, "{}", 0)], "interaction_id long, work_id long, kind int, data string, created_at int")
    works = spark.createDataFrame([(1, 7, 2), (9, 7, 1)], "work_id long, session_id long, work_type int")
    assert rows(runtime.activity_rows(df, works, {}).select("interaction_id", "kind", "label")) == [(2, "thinking", "x"), (3, "guidance", "")]


def test_idle_count_starts_again(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("hhxhh")], "k long, i long, e string")
    assert [r.idle for r in runtime.idle_ticks(df, "k", ["i"], F.col("e") == "x").orderBy("i").collect()] == [1, 2, 0, 1, 2]


def test_streams_publish_batch_by_batch(spark, tmp_path):
    from heron.streaming import events

    for k in range(2):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k))], "event_id long, ts timestamp_ntz").write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = events.publish(events.read_events(spark, str(tmp_path / "in"), per_trigger=1), lambda df, i: seen.append((i, df.count())), str(tmp_path / "check"))
    query.awaitTermination()
    assert sum(n for _, n in seen) == 2 and len({i for i, _ in seen}) == len(seen)
    again = events.publish(events.read_events(spark, str(tmp_path / "in"), per_trigger=1), lambda df, i: seen.append((i, df.count())), str(tmp_path / "check"))
    again.awaitTermination()
    assert sum(n for _, n in seen) == 2


# Text, library, files.


def test_text_edges(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("",), (None,)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(T.head(t, 3)).collect()] == ["a", "", None]
    assert [r[0] for r in df.select(T.tail(t, 4)).collect()] == ["b\nc", "", None]
    assert [r[0] for r in df.select(T.line_range(t, 2, 9, "-")).collect()] == ["-", "-", "-"]
    wide = spark.createDataFrame([("aé",), ("é\n" + "b" * 5,)], "t string")
    assert [bytes(r[0]) for r in wide.select(T.head_bytes(t, 2)).collect()] == [b"a\xc3", b"\xc3\xa9"]
    assert [r[0] for r in wide.select(T.head(t, 2)).collect()] == ["a\ufffd", "é"]
    assert [bytes(r[0]) for r in wide.select(T.tail_bytes(t, 7)).collect()] == ["aé".encode(), b"bbbbb"]
    assert [r[0] for r in df.select(T.replace_exact(t, "b", "B")[0]).collect()] == ["a\nB\nc", None, None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, "no front matter"),
        ("x", "no front matter"),
        ("---\nname: a\n", "no front matter"),
        ("# x\n---\nname: a\n---\n", "no front matter"),
        ("---\nname: a\nx: [\n---\n", "no YAML: a bracket is not closed"),
        ("---\nname: 'a\n---\n", "no YAML: a quote is not closed"),
        ("---\nname a\n---\n", "no YAML: not a key and a value"),
        ("---\ndescription: key: value\n---\n", "no YAML: a mapping within a value"),
        ("---\nname: a\n  b: c\n---\n", "no YAML: a mapping within a value"),
        ("---\nname: [a, b]\n---\n", "no YAML: name is no text"),
        ("---\ndescription:\n- a\n---\n", "no YAML: description is no text"),
        ("---\nname:\n  k: v\n---\n", "no YAML: name is no text"),
        ("---\nname: a\nname: b\n---\n", "no YAML: a key comes twice"),
        ("---\nname: - a\n---\n", "no YAML: not a plain value"),
    ],
)
def test_no_front_matter(raw, want):
    assert library.parse_front_matter(raw) == (None, None, None, want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("---\r\nname: 'a: b'\r\ndescription: d\r\n---\r\n\r\nbody", ("a: b", "d", "body")),
        ("---\nname: a # note\n---\n", ("a", "", "")),
        ("---\nname: null\ndescription: ~\n---\n", ("", "", "")),
        ("---\nmy:key: x\nna#me: y\n'name': a#b\ndescription: http://x:80\n---\n", ("a#b", "http://x:80", "")),
        ("---\nname: # none\ntags: [a, {b: c}]\nother:\n- name: z\n---\n", ("", "", "")),
        ("---\ntext: |\n  name: no\nname: 'it''s'\n---\n", ("it's", "", "")),
        ("---\ndescription: |\n  one\n   two\n---\nb", ("", "one\n two\n", "b")),
        ("---\nname: x\ndescription: >-\n  one\n  two\n\n  three\ntags:\n- a\n---\n", ("x", "one two\nthree", "")),
        ('---\nname: "a \\"b\\""\ndescription: it goes\n  on\nmeta:\n  k: v\n---\n', ('a "b"', "it goes on", "")),
    ],
)
def test_front_matter(raw, want):
    assert library.parse_front_matter(raw) == (*want, None)


def test_notes_are_cut_by_bytes(spark):
    note = lambda k: f"## [{k}] x\n\n" + "é" * 10 + "\n"
    df = spark.createDataFrame([(note(1) + "\n" + note(2),), (note(1),), ("é" * 50,), (None,)], "t string")
    got = [r[0] for r in df.select(T.trimmed_notes(F.col("t"), 41, "-")).collect()]
    assert len(note(1).encode()) == 31 and got == ["-" + note(2), note(1), "-\ufffd" + "é" * 20, None]


def test_rewritten_notes(spark, tmp_path):
    from heron.sources.notes import Notes

    book, schema = Notes(spark, str(tmp_path)), "i long, t string"
    assert book.read(schema)[0].collect() == []
    book.append(spark.createDataFrame([(1, "a"), (2, "b")], schema))
    book.rewrite(book.read(schema)[0].where("i = 2"))
    assert rows(book.read(schema)[0]) == [(2, "b")] and book.version() == 1
    book.append(spark.createDataFrame([(3, "c")], schema))
    late = Notes(spark, str(tmp_path))
    late.version = lambda: 0  # one that began before the rewrite
    with pytest.raises(RuntimeError, match="somebody else"):
        late.rewrite(spark.createDataFrame([(9, "z")], schema))
    assert rows(book.read(schema)[0]) == [(2, "b"), (3, "c")] and len(list((tmp_path / "notes").iterdir())) == 2


def test_commits_count_once_wherever_a_writer_breaks_off(spark, tmp_path, monkeypatch):
    from heron.sources.commits import Commits, Storage

    c = Commits(spark, str(tmp_path))
    tables = lambda n: {"a": spark.createDataFrame([(n,)], "x long"), "b": spark.createDataFrame([(n, "y")], "x long, y string")}
    schema = tables(0)["a"].schema
    assert c.read("a", schema).collect() == [] and c.batches("s") == []
    assert c.commit("s", 0, tables(0)) and not c.commit("s", 0, tables(7))

    class Broken(RuntimeError):
        pass

    def breaks(*_):
        raise Broken

    for step in ("write", "rename"):  # data is written, or the manifest too, and nothing is published
        with monkeypatch.context() as m:
            m.setattr(Storage, step, breaks)
            with pytest.raises(Broken):
                c.commit("s", 1, tables(1))
        assert rows(c.read("a")) == [(0,)] and not c.has("s", 1) and c.orphans()
    assert c.commit("s", 1, tables(1))
    with monkeypatch.context() as m:  # a writer that found nothing there yet, and comes second
        m.setattr(Commits, "has", lambda *_: False)
        assert not c.commit("s", 1, tables(8))
    assert c.commit("other", 1, tables(2)) and c.batches("s") == [0, 1]
    assert rows(c.read("a")) == [(0,), (1,), (2,)] and rows(c.read("b")) == [(0, "y"), (1, "y"), (2, "y")] and len(c.orphans()) == 2


def test_a_replayed_stream_publishes_nothing_twice(spark, tmp_path):
    from heron.sources.commits import Commits, publish_stream

    for k in range(3):
        spark.createDataFrame([(k,)], "x long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c, seen = Commits(spark, str(tmp_path / "out")), []

    def tables(df):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return {"t": df}

    def run(checkpoint):
        stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        publish_stream(stream, c, "s", tables, str(tmp_path / checkpoint)).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run("one")
    assert c.batches("s") == [0]
    run("one")
    run("two")  # the checkpoint is lost: all batches come again
    assert c.batches("s") == [0, 1, 2] and rows(c.read("t")) == [(0,), (1,), (2,)]


def test_buckets_that_are_not_touched_stay(spark, tmp_path):
    from heron.sources.buckets import BucketTable, Conflict

    v = spark.range(200).select(F.col("id").alias("chunk_id"), (F.col("id") % 5).cast("int").alias("kb_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    t = BucketTable(spark, str(tmp_path), v.schema, buckets=3)
    assert t.read().collect() == [] and t.upsert(v) == 1
    files = lambda: {f: (tmp_path / f).stat().st_mtime_ns for f in map(str, (p.relative_to(tmp_path) for p in tmp_path.rglob("data/**/*.parquet")))}
    first, cells = files(), {(r.kb_id, r.bucket): r.version for r in t.cells().collect()}
    delta = v.where("chunk_id = 7").withColumn("embedding", F.array(F.lit(-1.0)))
    assert t.upsert(delta.withColumn("n", F.lit(1)).unionByName(delta.withColumn("embedding", F.array(F.lit(-2.0))).withColumn("n", F.lit(2))), ["n"]) == 2
    after = {(r.kb_id, r.bucket): r.version for r in t.cells().collect()}
    assert sum(cells[c] != after[c] for c in cells) == 1 and {f: files()[f] for f in first} == first
    assert len(files()) - len(first) == 1
    assert [r.embedding for r in t.read().where("chunk_id = 7").collect()] == [[-2.0]] and t.read().count() == 200
    assert t.read(1).where("chunk_id = 7").first().embedding == [7.0]
    plan = t.read().where("kb_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kb_id" in plan
    kbs = spark.createDataFrame([(2, "x"), (3, "y")], "kb_id int, name string")
    kbs.write.parquet(str(tmp_path / "kbs"))
    named = spark.read.parquet(str(tmp_path / "kbs")).where("name = 'x'")
    joined = t.read().join(F.broadcast(named), "kb_id")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 40
    assert t.delete(v.where("kb_id = 4")) == 3 and t.read().count() == 160 and not t.read().where("kb_id = 4").count()
    late = BucketTable(spark, str(tmp_path), v.schema, buckets=3)
    late.version = lambda: 2
    with pytest.raises(Conflict):
        late.upsert(v.limit(1))
    assert t.version() == 3 and t.read().count() == 160
    odd = spark.createDataFrame([(None, 1, [1.0]), (900, None, [1.0]), (901, 1, None)], "chunk_id long, kb_id int, embedding array<double>")
    assert t.upsert(odd) == 4 and t.read().count() == 161


def test_clusters_find_what_a_full_search_finds(spark, tmp_path):
    """Vectors in clumps, with copies; a delta replaces, adds and deletes."""
    import numpy as np

    from heron.operators.clusters import ClusteredVectors, bounds

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    v = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist() if i % 7 else centres[0].tolist()) for i in range(600)]
    odd = [(1000, [0.0] * 8), (1001, None), (1002, [1.0, 2.0]), (1003, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>").repartition(4)
    c = ClusteredVectors.write(df, str(tmp_path / "c"), 12, rounds=4)
    c.add(spark.createDataFrame([(5, v[300][1]), (2000, v[301][1]), (6, None)], "vec_id long, embedding array<double>"), 1)
    c.add(spark.createDataFrame([(5, v[200][1]), (9, None)], "vec_id long, embedding array<double>"), 2)
    now = {i: x for i, x in v} | {5: v[200][1], 2000: v[301][1]}
    now = {i: x for i, x in now.items() if i not in (6, 9)}
    full = spark.createDataFrame(list(now.items()), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    want = rows(search.nearest_to_each(full, asked, 5).select("hit_id", "rank", "vec_id"))
    assert rows(c.nearest_to_each(asked, 5, probes=1, exact=True).select("hit_id", "rank", "vec_id")) == want
    near = rows(c.nearest_to_each(asked, 5, probes=2).select("hit_id", "rank", "vec_id"))
    assert len(set(near) & set(want)) >= 0.9 * len(want)
    for q in (v[3][1], v[0][1], centres[4].tolist()):
        one = [(r.vec_id, round(r.score, 9)) for r in search.search(full, q, 7).collect()]
        assert [(r.vec_id, round(r.score, 9)) for r in c.search(q, 7, probes=1, exact=True).collect()] == one
        assert len({i for i, _ in one} & {r.vec_id for r in c.search(q, 7, probes=3).collect()}) >= 6
    assert "PartitionFilters: [cluster" in c.base([1, 2])._jdf.queryExecution().executedPlan().toString()
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, members, q = x[0], x[1:100], x[100:]
    assert (bounds((q @ centre)[:, None], np.array([(members @ centre).min()]))[:, 0] >= (q @ members.T).max(1)).all()
    empty = ClusteredVectors.write(df.limit(0), str(tmp_path / "e"), 4)
    assert empty.nearest_to_each(asked, 3, exact=True).collect() == [] and empty.search([1.0] * 8, 3, exact=True).collect() == []


def test_ingested_bodies_and_titles(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, raw string")
    assert sorted((r.doc_id or 0, r.body) for r in library.ingested(same).collect()) == [(0, "c"), (1, "a"), (1, "a"), (1, "b")]
    df = spark.createDataFrame([(1, "---\nname: n\n---\n\nbody\n---\nmore"), (2, "only text"), (3, "---\n---\nb"), (4, None)], "doc_id long, raw string")
    got = {r.doc_id: (r.title, r.body) for r in library.ingested(df).collect()}
    assert got == {1: ("n", "body\n---\nmore"), 2: ("only text", "only text"), 3: ("b", "b"), 4: (None, None)}


def test_updates_embed_only_what_changed(spark):
    items = spark.createDataFrame([(1, 1, "t", "a"), (2, 1, "t", None), (3, 2, "t", "c")], "item_id long, owner long, title string, description string")
    new = spark.createDataFrame([(1, 1, "u", "a"), (2, 1, "u", "b"), (3, 1, "u", "x")], "item_id long, owner long, title string, description string")
    out, stale = library.updated(items, new, ["title", "description"])
    assert rows(out) == [(1, 1, "u", "a"), (2, 1, "u", "b"), (3, 2, "t", "c")] and rows(stale) == [(2, "b")]
    twice = new.withColumn("n", F.lit(2)).unionByName(new.withColumn("title", F.lit("z")).withColumn("description", F.lit("z")).withColumn("n", F.lit(1)))
    out, stale = library.updated(items, twice, ["title", "description"], order=["n"])
    assert rows(out) == [(1, 1, "u", "a"), (2, 1, "u", "b"), (3, 2, "t", "c")] and rows(stale) == [(2, "b")]


def test_deliveries_are_whole_or_none(spark):
    asked = spark.createDataFrame([(1, 1, 2, 3, ["a", "b"]), (2, 1, 2, 3, ["a", "z"]), (3, 1, 2, 3, []), (4, 1, 2, 3, None)], "delivery_id long, sender long, receiver long, session_id long, paths array<string>")
    got = {r.delivery_id: (r.paths, r.error) for r in library.deliveries(asked, spark.createDataFrame([("a",), ("b",)], "path string"), F.current_timestamp()).collect()}
    assert got == {1: ('["a","b"]', None), 2: (None, "1 missing"), 3: (None, "no paths"), 4: (None, "no paths")}


def test_signature_ignores_the_order_of_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"x": [{"p": 1, "q": 2}], "y": 2}}',), ('{"b": {"y": 2, "x": [{"q": 2, "p": 1}]}, "a": 1}',)], "j string")
    assert len({r[0] for r in df.select(S.signature(F.lit("f"), F.col("j"))).collect()}) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hallo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF\0")
    (tmp_path / "c.md").write_text(" ")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("hallo", None), "b.pdf": (None, "unsupported: pdf"), "c.md": (" ", "no text")}
    failed = files.read_texts(spark, str(tmp_path), {"pdf": lambda c: F.lit(None).cast("string")})
    assert {r.path.rpartition("/")[2]: r.error for r in failed.collect()}["b.pdf"] == "not extracted"
    (tmp_path / "d.png").write_bytes(b"plain")
    (tmp_path / "e.x").write_bytes(b"a\0")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path.rpartition("/")[2] for r in raw.where(files.is_binary()).collect()} == {"b.pdf", "d.png", "e.x"}


def test_notes(spark, tmp_path):
    path = tmp_path / "n.jsonl"
    path.write_text('{"id": 1, "t": "a"}\n\nbroken{\n{"id": 2, "t": "b"}\n')
    good, bad = files.read_notes(spark, str(path), "id long, t string")
    assert rows(good) == [(1, "a"), (2, "b")] and [r[0] for r in bad.collect()] == ["broken{"]
    files.append_notes(good, str(tmp_path / "out"))
    files.append_notes(good.where("id = 1"), str(tmp_path / "out"))
    assert rows(files.read_notes(spark, str(tmp_path / "out"), "id long, t string")[0]) == [(1, "a"), (1, "a"), (2, "b")]


def test_notes_are_cut_at_a_heading(spark):
    df = spark.createDataFrame([("## [1] a\n\nx\n## [2] b\n\ny",), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(T.trimmed_notes(F.col("t"), 18, "cut ")).collect()] == ["cut ## [2] b\n\ny", "short", None]


def test_a_story_needs_a_summary(spark):
    e = F.lit("")
    told = lambda version: spark.range(1).select(T.prompt(F.lit("c"), e, F.lit("s"), F.lit(version), e, e, e, e, e)).first()[0]
    assert told(3) == "# Character\nc\n\n# Story so far\ns" and told(-1) == "# Character\nc"


def test_large_texts_have_no_page(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "t string")
    assert tuple(df.select(*T.lines_page(F.col("t"), 1, 2)).first()) == (["a", "b"], 1, None)
    assert tuple(df.select(*T.lines_page(F.col("t"), most_bytes=2)).first()) == (None, None, "too large")


def test_several_tables_are_published_together(spark, tmp_path):
    one = spark.range(2)
    files.publish(spark, {"a": one, "b": one}, str(tmp_path))
    files.publish(spark, {"a": one.limit(1), "b": one.limit(0)}, str(tmp_path))
    got = files.published(spark, str(tmp_path))
    assert (got["a"].count(), got["b"].count()) == (1, 0)


def test_vectors_are_written_all_or_none(spark, tmp_path):
    base = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    delta = spark.createDataFrame([(1, [2.0]), (2, [float("nan")])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 vectors"):
        files.write_checked_vectors(base, delta, str(tmp_path / "x"), V.valid_embedding("embedding"))
    out = files.write_checked_vectors(base, delta.where("vec_id = 1"), str(tmp_path / "y"), V.valid_embedding("embedding"))
    assert rows(out) == [(1, [2.0])]
