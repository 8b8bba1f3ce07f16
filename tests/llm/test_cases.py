"""Odd rows: repeated and null ids, ties, clashing columns and dense groups, each with its defined result."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from heron.llm import codec, jpeg, lm, media, packing, quality, sharding, simhash, substring, token_counts, token_files
from heron.llm.bpe import encoding_digests
from heron.llm.common import shared_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = "these are thirteen words or some more that two documents have in common today"
#: Ids that repeat, with equal and with other texts, and rows without one.
ROWS = [(7, "one text"), (7, "one text"), (7, f"another text and {PASSAGE}"), (None, "no id"), (None, None), (3, f"{PASSAGE} and an end"), (None, f"{PASSAGE} without an id"), (9, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names of inner ones."""
    names = "doc_id long, text string, fp long, label long, hash long, shard int, node long, ids string, n_words long"
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1, "x", 5) for i, t in ROWS], names).repartition(3)


def told(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def tokens(path, text):
    return codec.codec(path).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_every_row_is_encoded(docs):
    want = Counter((i, len(tokens(WORD, t)), sha(" ".join(map(str, tokens(WORD, t))))) for i, t in ROWS)
    assert told(encoding_digests(docs, WORD), "doc_id", "n_tokens", "ids_sha256") == want


def test_every_row_is_counted_and_nothing_counts_in_an_empty_table(spark, docs):
    full = docs.withColumn("source", F.lit("s")).withColumn("lang", F.lit(None).cast("string"))
    gone = spark.createDataFrame([(7,), (7,), (None,)], "doc_id long")
    got = token_counts.maintained_totals(full, gone, BYTE, "v").collect()
    left = [t for i, t in ROWS if i != 7]
    assert [(r.source, r.lang, r.n_docs, r.n_tokens) for r in got] == [("s", None, len(left), sum(len(tokens(BYTE, t)) for t in left))]
    assert token_counts.maintained_totals(full.limit(0), gone, BYTE, "v").collect() == []


def test_rollups_survive_what_breaks_off(spark):
    roll = token_counts.Rollup(spark, shared_dir(spark, "rollup"))
    change = lambda n: spark.createDataFrame([("a", "en", "v", 1, n)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    for k in range(3):
        assert roll.commit(f"b{k}", change(10**k))
    change(500).write.parquet(f"{roll.path}/batch/broken")
    files, mark = roll._hadoop(f"{roll.path}/batch/broken/_SUCCESS")
    files.delete(mark, False)
    assert [r.n_tokens for r in roll.totals().collect()] == [111]
    roll.compact()
    change(1).write.parquet(f"{roll.path}/batch/b0")  # as if compact() had broken off before it deleted this one
    assert [r.n_tokens for r in roll.totals().collect()] == [111] and roll.has("b0") and roll.has("b2") and not roll.has("b3")
    roll.commit("b3", change(1000))
    roll.compact()
    assert [r.n_tokens for r in roll.totals().collect()] == [1111] and not roll.commit("b1", change(7)) and roll.commit("broken", change(20000))
    assert [r.n_tokens for r in roll.totals().collect()] == [21111]


def brute_shards(rows, shards):
    """The order and the cuts of the docstring, one after another."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    size = [len((t or "").encode()) + 1 for _, t in ordered]
    out, before, slots = [], 0, Counter()
    for (i, t), s in zip(ordered, size, strict=True):
        k = min((2 * before + s) * shards // (2 * sum(size)), shards - 1)
        out.append((i, s, k, slots[k], before))
        slots[k] += 1
        before += s
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_like_brute_force(spark, docs, shards):
    assert told(sharding.shard_documents(docs, shards), "doc_id", "size", "shard", "slot", "first_byte") == brute_shards(ROWS, shards)
    rng = np.random.default_rng(shards)
    many = [(int(i), "x" * int(n)) for i, n in zip(rng.integers(0, 40, 300), rng.integers(0, 90, 300), strict=True)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(7)
    assert told(sharding.shard_documents(df, shards), "doc_id", "size", "shard", "slot", "first_byte") == brute_shards(many, shards)


def test_written_shards_hold_every_row_once(spark, docs):
    path = shared_dir(spark, "shards")
    sharding.write_shards(docs, path, 3)
    got = spark.read.parquet(path)
    assert Counter((r.doc.doc_id, r.doc.text) for r in got.collect()) == Counter(ROWS)
    assert told(got.withColumn("doc_id", F.col("doc.doc_id")), "doc_id", "shard", "slot") == told(sharding.shard_documents(docs, 3), "doc_id", "shard", "slot")


def test_fingerprints_of_repeated_and_null_ids(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.component_id for r in got if r.doc_id == 7) == [7, 7, 7]
    of_empty = [r.component_id for r in got if int(r.fingerprint, 16) == 0]
    assert of_empty == [9, 9]  # the empty text without an id links to the one with an id
    assert [r.component_id for r in got if r.doc_id == 3] == [3]


def test_files_hold_every_row_once(spark, docs):
    files = token_files.write_token_files(docs, BYTE, shared_dir(spark, "ids"))
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, (*tokens(BYTE, t), 0)) for i, t in ROWS)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == [None, None, None, 3, 7, 7, 7, 9]
    assert [r.doc_id for r in token_files.read_token_files(files, [7, 0]).collect()] == [7, 7, 7]


def test_one_id_with_most_rows_is_dealt_to_several_files(spark):
    df = spark.range(400).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where partitions are large
    try:
        files = token_files.write_token_files(df, BYTE, shared_dir(spark, "ids"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and token_files.read_token_files(files, whole=False).count() == 400


def test_rules_judge_every_row(docs):
    assert told(quality.judge(docs, []), "doc_id", "n_words", "kept") == Counter((i, len((t or "").split()), len((t or "").split()) >= 10) for i, t in ROWS)


def test_verdicts_like_a_plain_version_of_the_list(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    assert rules
    for r in quality.judge(docs, rules).collect():
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        first = None
        for k, rule in enumerate(rules, 1):
            shares = [(c, r[quality.RATIOS[c.ratio][0]] / max(r[quality.RATIOS[c.ratio][1]], 1)) for c in rule]
            if first is None and all(x > c.value if c.above else x <= c.value for c, x in shares):
                first = k
        assert (r.base_failed, r.rule, r.kept) == (failed, first, not failed and first is None)


def test_equal_values_and_labels_of_both_kinds_teach_nothing():
    same = {c: np.ones(60) for c in quality.COUNTS}
    assert quality.learn_rules(same, np.arange(60) % 2 == 0) == []


def test_scores_of_repeated_and_null_ids(docs):
    got = lm.score_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    assert all(not r.held_out for r in got if r.doc_id is None)
    pair = [(r.score, r.base_score) for r in got if r.doc_id == 7 and r.n_tokens == 3]
    assert len(pair) == 2 and pair[0] == pair[1]


def plain_scores(texts, model):
    """The model's definition, a token at a time."""
    count = dict(zip(model.hashes.tolist(), model.logs.tolist(), strict=True))
    out = []
    for text in texts:
        t = lm.tokens_of([text])
        total = 0.0
        for j in range(len(t.choice)):
            z = np.sum([w[r[j]].astype(float) for w, r in zip(model.weights, t.rows, strict=True)], axis=0)
            total += (z[t.choice[j]] - np.log(np.exp(z).sum())) / np.log(10)
        total += sum(count.get(h, np.log10(lm.ADD)) - model.share[k] for h, k in zip(t.hash.tolist(), t.label.tolist(), strict=True))
        out.append(total)
    return out


def test_scores_like_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts, model, n, v = lm.train(df, unit=100_000)
    got = {r.doc_id: r.score for r in lm.score(df, counts, model, n, v).collect()}
    some = [r for r in df.collect() if len(r.text or "") < 400][:25]
    want = plain_scores([(r.text or "").encode() for r in some], model)
    assert np.allclose([got[r.doc_id] for r in some], want, rtol=1e-4)
    # One unknown word a bucket and all known words have the probability of one together.
    t = lm.tokens_of([b"w"])
    z = [lm.softmax(model.weights, [r[k : k + 1] for r in t.rows]).sum() for k in range(len(t.choice))]
    assert np.allclose(z, 1, atol=1e-5)
    bucket = counts.count() and model.share[(lm.tokens_of([b""]).label)[0]]
    known = next(x for h, x in zip(model.hashes.tolist(), model.logs.tolist(), strict=True) if h == int(lm.END))
    assert np.isclose(10 ** (known - bucket) + 10 ** (np.log10(lm.ADD) - bucket), 1)


def test_scores_hang_little_on_the_splits(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = []
    for k in (1, 4, 64):
        r = lm.score_documents(df.repartition(k)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        sums.append(r[0])
        assert r[0] > 0.97 * r[1]
    assert max(sums) - min(sums) < 0.005 * abs(sums[0])


def test_media_of_every_row(docs):
    got = told(media.media_digests(docs), "doc_id", "n_bytes", "payload_sha256")
    assert got == Counter((i, len((t or "").encode()), sha((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192))) for i, t in ROWS)


def test_removal_of_every_row(docs):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.repeat_digests(docs).collect()}
    n = len(PASSAGE.split())
    assert got == {(7, 2): 0, (7, 3 + n): n, (None, 2): 0, (None, 0): 0, (3, n + 3): 0, (None, n + 3): 0, (9, 0): 0}
    kept = Counter((r.doc_id, r.text) for r in substring.remove_repeats(docs).collect())
    assert kept == Counter((i, "another text and" if i == 7 and PASSAGE in t else t) for i, t in ROWS)


@pytest.mark.parametrize("whole", [True, False])
def test_packing_of_every_row(docs, whole):
    got = packing.pack_documents(docs, WORD, whole=whole).collect()
    assert sum(r.length for r in got) == sum(len(tokens(WORD, t)) + 1 for _, t in ROWS)
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for i, _ in ROWS)


def test_packing_of_many_equal_lengths(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words " * 40).alias("text")).coalesce(1)
    got = packing.pack_documents(df, WORD, whole=False).collect()
    n = len(tokens(WORD, "same words " * 40)) + 1
    assert sum(r.length for r in got) == 500 * n and {r.doc_tokens for r in got} == {n}


def test_the_pipeline_takes_odd_rows(spark, docs):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    full = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    longer = full.withColumn("text", F.concat(F.col("text"), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("word"), i.cast("string"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"))), " ")))
    stage = longer
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, d)
        assert after.columns == full.columns, name
        stage = after
    kept = Counter(r.doc_id for r in stage.collect())
    # The null texts fail the base rule; two equal rows of id 7 and a third, which is much like them, leave one.
    assert kept[3] == 1 and 1 <= kept[7] <= 2 and kept[None] == 2 and kept[9] == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, d).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == kept


@pytest.mark.parametrize("name", ["op3_sharding", "op9_substring"])
def test_queries_like_their_sql(spark, name):
    import duckdb

    from heron.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    df = queries.queries()[name](spark, d)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert told(df, *columns) == Counter(tuple(r[k] for k in at) for r in found.fetchall())


# Merges as matrices against the library.


def test_pieces_like_the_library():
    rng = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçABCXYZÄÉ0123456789.,;:!?'\"-_()$%&@#ﬁ中🙂İǆ"
    words = ["".join(rng.choice(list(letters), rng.integers(1, 60))) for _ in range(4000)] + ["a" * n for n in range(1, 60)] + ["don't", "it's", "'s", "x'll'"]
    text = " ".join(words)
    for path in (WORD, BYTE):
        own = codec.Codec(path)
        assert own.encode([text])[0] == np.array(tokens(path, text), "<u4").tobytes()
        assert own.encode([text, ""])[0] == np.array(tokens(path, text), "<u4").tobytes()


def test_pair_ranks():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    ranks = codec.PairRanks(pairs[:, 0], pairs[:, 1])
    assert ranks.of(pairs[:, 0], pairs[:, 1]).tolist() == list(range(len(pairs)))
    assert (ranks.of(pairs[:, 0] + 1000, pairs[:, 1]) == codec.PairRanks.NONE).all()


# Dense groups.


def chain(rng, n, length=60):
    """Near copies that drift: each differs from the one before by one word."""
    w = [f"w{x}" for x in rng.integers(0, 50_000, length)]
    out = []
    for k in range(n):
        w = list(w)
        w[(7 * k) % length] = f"v{k}"
        out.append(" ".join(w))
    return out


def brute_keep(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and ((not a and not b) or len(a & b) >= similarity * len(a | b)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(least.values()) + [None] * sum(i is None for i, _ in rows)


@pytest.mark.parametrize(("hot", "block", "parts"), [(4096, 512, 1), (8, 16, 4), (8, 512, 1)])
def test_drifting_copies_keep_one_like_brute_force(spark, hot, block, parts):
    rng = np.random.default_rng(11)
    rows = [(i, t) for i, t in enumerate(chain(rng, 120))] + [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 50_000, 40))) for i in range(40)] + [(None, "a b"), (5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id for r in simhash.keep_one(df, hot=hot, block=block).collect()), key=lambda x: (x is None, x or 0))
    assert got == brute_keep(rows)


def test_a_dense_group_among_others_keeps_one(spark):
    """A group whose members differ by a word each, in one key, larger than a key may be, with unrelated rows beside it."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
    rows = []
    for k in range(300):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"v{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"u{x}" for x in rng.integers(0, 50_000, 50))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [0, *range(1000, 1300)]
    for hot, block in ((16, 32), (4096, 512)):
        assert sorted(r.doc_id for r in simhash.keep_one(df, hot=hot, block=block).collect()) == want


def test_recall_of_lone_pairs_at_the_similarity(spark):
    """Pairs of 0.80 to 0.83 by exact similarity, each alone: at least nine of ten are found."""
    rng, rows, pairs = np.random.default_rng(13), [], 0
    for k in range(300):
        n = int(rng.integers(120, 400))
        a = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        b = list(a)
        total, changed = n - 4, 0
        while (total - 5 * (changed + 1)) / (total + 5 * (changed + 1)) >= 0.8 and 3 + 8 * changed < n - 8:
            b[3 + 8 * changed] = f"c{changed}"
            changed += 1
        pairs += 1
        rows += [(k, " ".join(a)), (1000 + k, " ".join(b))]
    left = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(range(300)) <= set(left)
    assert len(left) - 300 <= 0.1 * pairs


@pytest.mark.parametrize("line", [False, True])
def test_unlike_texts_are_hardly_compared(spark, monkeypatch, line):
    """Pairs of one key follow the number of texts, also if all have a line in common."""
    rng = np.random.default_rng(15)
    common = "\n" + " ".join(f"line{x}" for x in range(13)) if line else ""
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 120)) + common) for k in range(3000)]
    pairs, compared = [], simhash._compared

    def counted(rows, keys, *how):
        pairs.append(rows.groupBy(*keys).count().selectExpr("sum(count * (count - 1) / 2)").first()[0] or 0)
        return compared(rows, keys, *how)

    monkeypatch.setattr(simhash, "_compared", counted)
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3000
    assert pairs and sum(pairs) < 5 * 3000


@pytest.mark.parametrize("shared", [0, 9, 60])
def test_similar_sets_share_a_key(shared):
    """Sets of all sizes at a similarity of 0.8, with common hashes in both or in one of them."""
    from types import SimpleNamespace

    rng = np.random.default_rng(shared)
    common = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    sets = []
    for k in range(3000):
        both = 4 * (1 + k % 60) * (1 + 9 * (k % 7 == 0))
        alone = rng.integers(0, 1 << 63, both // 4).astype(np.uint64)
        own = rng.integers(0, 1 << 63, both).astype(np.uint64)
        often = rng.choice(common, min(shared, len(own)), replace=False)
        if k % 2:
            own[: len(often)] = often
        else:
            alone[: len(often)] = often[: len(alone)]
        cut = int(rng.integers(0, len(alone) + 1))
        sets += [np.unique(np.append(own, alone[:cut])), np.unique(np.append(own, alone[cut:]))]
    told = [simhash._sketch(x) for x in sets]
    b = pa.record_batch([pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.binary()), pa.array(range(len(sets)), pa.int64())], names=["shingles", "sketch", "node"])
    keys = [set() for _ in sets]
    for out in simhash._keyed([b], 0.8, SimpleNamespace(value=common)):
        for key, often, node in zip(*(out.column(c).to_pylist() for c in ("key", "often", "node")), strict=True):
            assert often == (key in common.view(np.int64))
            keys[node].add(key)
    assert max(map(len, keys)) <= 2 * simhash.KEYS
    for i in range(0, len(sets), 2):
        x, y = sets[i], sets[i + 1]
        assert len(np.intersect1d(x, y)) < 0.8 * len(np.union1d(x, y)) - 1e-9 or keys[i] & keys[i + 1], (i, len(x), len(y))


def test_a_sketch_has_the_least_hashes():
    rng = np.random.default_rng(16)
    for n, values in ((0, 9), (1, 9), (31, 1 << 62), (128, 1 << 62), (129, 20), (500, 40), (500, 1 << 62), (3000, 33)):
        x = rng.integers(0, values, n).astype(np.uint64)
        own = np.unique(x)
        told, least = simhash._sketch(x)
        assert np.frombuffer(least, np.uint64).tolist() == own[: simhash.SKETCH].tolist()
        assert told == len(own) or told >= len(own) > simhash.SKETCH


def test_pivots_change_nothing(spark):
    rng = np.random.default_rng(14)
    base = int(rng.integers(0, 1 << 63))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    own = sorted(prints)
    label = {x: x for x in own}
    for i, x in enumerate(own):
        for y in own[:i]:
            if (x ^ y).bit_count() <= 4 and label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
    from heron.llm.components import components

    for hot in (8, 64):
        got = {r.node: r.label for r in components(simhash.links(df, 4, hot)).collect()}
        groups = lambda of: {frozenset(k for k in own if of(k) == g) for g in map(of, own)}
        assert groups(lambda x: got.get(x, x)) == groups(label.__getitem__)


# Thumbnails.


@pytest.mark.parametrize("size", [192, 1000, 40_000, 300_000])
def test_thumbnails_like_brute_force(size):
    payload = bytes(np.random.default_rng(size).integers(0, 256, -(-size // 192) * 192, dtype=np.uint8))
    image = jpeg.decode(jpeg.encode([payload]))[0]
    wide, high = -(-image.width // 8), -(-image.height // 8)
    q = int(image.quantisers[image.components[0].quantiser][0])
    thumb = [[min(max((payload[192 * (i * wide + j)] - 128 if 192 * (i * wide + j) < len(payload) else 0) * q / 8 + 128, 0), 255) for j in range(wide)] for i in range(high)]
    got = jpeg.thumbnail(image)
    full = len(payload) // 192
    assert got.shape == (high, wide) and got.ravel()[:full].tolist() == [x for row in thumb for x in row][:full]
    assert jpeg.payload(image) == payload
    bits = 0
    for i in range(8):
        cell = []
        for j in range(9):
            r, c = i * high // 8, j * wide // 9
            part = got[r : max(r + 1, (i + 1) * high // 8 if i < 7 else high), c : max(c + 1, (j + 1) * wide // 9 if j < 8 else wide)]
            cell.append(part.mean())
        for j in range(8):
            bits = bits << 1 | int(cell[j] > cell[j + 1])
    assert jpeg.difference_hash(got) == bits
