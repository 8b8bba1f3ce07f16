"""The operators of the subpackage against brute force, the libraries and exact round trips, with the odd cases."""

import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from heron.llm import fm_index, jpeg, lm, media, packing, quality, sharding, simhash, substring, token_counts, token_files
from heron.llm.bpe import encode_documents, encoding_digests
from heron.llm.common import shared_dir
from heron.llm.components import components
from heron.llm.xxh import xxh64

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LINE = "the same old line of thirteen words and more that many documents have in them here"
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Größe & Maß: 3,5 — naïve 中文 🙂 don't",
    f"{LINE}\nand then something else",
    f"before {LINE} after",
    LINE,
    LINE,
    "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o q",
    "<|endoftext|> written out\r\n\r\ntwice  <|endoftext|>",
    " ".join(f"word{i % 700}" for i in range(30_000)),
    "x" * 5000,
    f"{LINE} {LINE}",
]
ROWS = [(i, t, "s" if i % 2 else None, "en", f"clash{i}") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, source string, lang string, {} string"


@pytest.fixture(scope="module")
def docs(spark):
    """An extra column has the name of an inner one."""
    return spark.createDataFrame(ROWS, SCHEMA.format("content")).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def words_of(text):
    return (text or "").encode().split()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_is_the_library(docs, empty):
    got, t = by_id(encoding_digests(docs, WORD)), tokenizer(WORD)
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text
    assert encoding_digests(empty, WORD).collect() == [] and encode_documents(empty, WORD).collect() == []


def test_token_counts_are_idempotent_and_compact(spark, docs):
    toxic = spark.createDataFrame([(3,), (4,), (99,)], "doc_id long")
    want = Counter()
    for i, t, s, lang, _ in ROWS:
        if i not in (3, 4):
            want[s, lang, "v"] += len(ids_of(BYTE, t))
    got = token_counts.maintained_totals(docs, toxic, BYTE, "v").collect()
    assert {(r.source, r.lang, r.tokenizer): r.n_tokens for r in got} == dict(want)
    assert sum(r.n_docs for r in got) == len(ROWS) - 2
    roll = token_counts.Rollup(spark, shared_dir(spark, "rollup"))
    change = spark.createDataFrame([("a", "en", "v", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    assert roll.totals().collect() == []
    assert roll.commit("b1", change) and not roll.commit("b1", change)
    roll.compact()
    assert not roll.commit("b1", change) and roll.commit("b2", change)
    assert [r.n_tokens for r in roll.totals().collect()] == [10]
    with pytest.raises(ValueError, match="batch id"):
        roll.commit("../x", change)


def test_shards_are_contiguous_and_even(docs, empty):
    got = sorted(sharding.shard_documents(docs).collect(), key=lambda r: r.doc_id)
    size = [len((t or "").encode()) + 1 for t in TEXTS]
    assert [r.size for r in got] == size and [r.text_crc32 for r in got] == [zlib.crc32((t or "").encode()) for t in TEXTS]
    assert [r.first_byte for r in got] == np.cumsum([0, *size[:-1]]).tolist()
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    for k in {r.shard for r in got}:
        own = [r for r in got if r.shard == k]
        assert [r.slot for r in own] == list(range(len(own)))
    assert sharding.shard_documents(empty).collect() == []


def test_shards_of_one_size_are_equal(spark):
    df = spark.range(80).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    assert {r["count"] for r in sharding.shard_documents(df).groupBy("shard").count().collect()} == {10}


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_simhash_links_like_all_pairs(spark, docs, hot):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(12)]
    texts = list(TEXTS)
    for b in base:
        for k in range(9):
            w = list(b)
            w[5 * k % 60] = f"v{k // 2}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(simhash.near_duplicates(df, hot=hot))
    fp = [fingerprint(t) for t in texts]
    label = list(range(len(fp)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fp)):
            for j in range(i):
                if bin(fp[i] ^ fp[j]).count("1") <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert [got[i].fingerprint for i in range(len(fp))] == [f"{x:016x}" for x in fp]
    assert [got[i].component_id for i in range(len(fp))] == label


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    a = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    b = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    near = [*a[:150], "changed", *a[151:]]
    df = spark.createDataFrame([(1, " ".join(a), "x"), (2, " ".join(a), "y"), (3, " ".join(near), "z"), (4, " ".join(b), "u"), (None, "free", "v")], "doc_id long, text string, fp string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, None}


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 50_000, n)]


def test_near_copies_among_many_texts_of_close_fingerprints(spark):
    """A refrain makes the fingerprints of unlike texts close, so keys are dense; shingles count once in a similarity."""
    rng, rows = np.random.default_rng(2), []
    for k in range(300):
        tail = prose(rng, 60)
        rows += [(k, " ".join(["five words of a refrain"] * 20 + tail)), (1000 + k, " ".join(["five words of a refrain"] * 20 + [*tail[:30], "changed", *tail[31:]]))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))


def test_near_copies_are_told_at_the_similarity(spark):
    """Of 300 words, 6 changed ones leave a similarity of 0.816, and 7 one of 0.788."""
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        a = prose(rng, 300)
        b = list(a)
        for j in range(6 + k % 2):
            b[20 + 40 * j] = "changed"
        rows += [(k, " ".join(a)), (1000 + k, " ".join(b))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(400)) | {1000 + k for k in range(1, 400, 2)}
    assert len(kept & {1000 + k for k in range(0, 400, 2)}) <= 10


@pytest.mark.parametrize("block", [1024, 3])
def test_families_are_compared_like_brute_force(spark, block):
    rng, rows = np.random.default_rng(4), [(0, 9, None), (1, 9, ""), (2, 9, "one"), (3, 9, "ONE")]
    for f in range(5):
        base = prose(rng, 100)
        for _ in range(12):
            w = list(base)
            for j in rng.integers(0, 20, rng.integers(0, 4)):
                w[5 * j] = "changed"
            rows.append((len(rows), f, " ".join(w)))
    nodes = spark.createDataFrame(rows, "node long, label long, text string")
    families = nodes.select("node", "label", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    found = components(simhash.confirmed(families, nodes.select("node", "text"), ["node"], 5, 0.8, block=block))
    got = {r.node: r.label for r in found.collect()}
    words = [(t or "").lower().split() for _, _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][1] == rows[j][1] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    for i in range(len(rows)):
        for j in range(i):
            assert (got.get(i, i) == got.get(j, j)) == (label[i] == label[j])


def test_rows_of_a_repeated_id_are_decided_each(spark):
    rng = np.random.default_rng(6)
    a, b, c = (prose(rng, 300) for _ in range(3))
    near = " ".join([*a[:150], "changed", *a[151:]])
    a, b, c = map(" ".join, (a, b, c))
    for rows in ([(1, a), (2, near), (2, b), (2, b), (3, c)], [(3, c), (2, b), (2, near), (1, a), (2, b)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [(1, a), (2, b), (3, c)]


def test_allocation_is_optimal():
    from itertools import product

    costs = [{-1: 0, 0: 3, 1: 9}, {-1: 0, 0: 2, 1: 20}, {-1: 0, 0: 4, 1: 5}]
    best = min(sum(c[t] for c, t in zip(costs, ts, strict=True)) for ts in product((-1, 0, 1), repeat=3) if sum(ts) == 0)
    assert simhash.allocate(costs, 0)[0] == best


def test_hubs_are_carried_apart(spark, monkeypatch):
    """Stars, one within another, and a path; with hubs and without the same components."""
    from heron.llm import components as module

    edges = [(0, k) for k in range(1, 40)] + [(40 + k, 39) for k in range(30)] + [(1000 + k, 1001 + k) for k in range(20)] + [(2000, 2001)]
    want = {n: 0 if n < 1000 else 1000 if n < 2000 else 2000 for e in edges for n in e}
    for hub in (5, 10**6):
        monkeypatch.setattr(module, "HUB", hub)
        got = {r.node: r.label for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        least = {}
        for n, label in got.items():
            least[label] = min(n, least.get(label, n))
        assert {n: least[label] for n, label in got.items()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), *[(100, 100 + i) for i in range(1, 50)], *[(i, i + 1) for i in range(1000, 1100)]]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 3 + 2 + 50 + 101 and len(set(got.values())) == 4
    assert got[1] == got[3] and got[4] == got[5] and got[1000] == got[1100]


def test_xxh64():
    data = bytes(range(256)) * 20
    start = np.arange(0, 700)
    length = start.copy()
    got = xxh64(data, start, length, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def test_token_files_round_trip(spark, docs, empty):
    folder = shared_dir(spark, "ids")
    files = token_files.write_token_files(docs, BYTE, folder)
    got, place = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.doc_id), 0
    for r, t in zip(got, TEXTS, strict=True):
        want = [*ids_of(BYTE, t), 0]
        assert (r.start, r.n_tokens, r.ids) == (place, len(want), want)
        place += len(want)
    assert [r.doc_id for r in token_files.read_token_files(files, [4, 12]).collect()] == [4, 12]
    assert token_files.token_file_digests(empty, BYTE).collect() == []


def test_token_files_read_only_what_is_asked_and_find_damage():
    out = io.BytesIO()
    w = token_files.TokenFileWriter(out)
    docs = {i: np.full(200_000, i, "<u4").tobytes() for i in range(5)}
    for i, b in docs.items():
        w.add(i, b)
    w.close()
    r = token_files.TokenFileReader(io.BytesIO(out.getvalue()))
    assert list(r.read(r.find([3]))) == [(3, 600_000, docs[3])] and len(r.table) == 6
    data = bytearray(out.getvalue())
    data[int(r.start[3]) + 20] ^= 1
    bad = token_files.TokenFileReader(io.BytesIO(bytes(data)))
    assert list(bad.read(bad.find([0]))) == [(0, 0, docs[0])]
    with pytest.raises(Exception, match="."):
        list(bad.read(bad.find([3])))


def test_quality_counts(docs, empty):
    got = by_id(quality.document_features(docs))
    for i, text in enumerate(TEXTS):
        words = [w.decode() for w in words_of(text)]
        lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        found, inside = Counter(windows), set()
        for j, x in enumerate(windows):
            if found[x] > 1:
                inside.update(range(j, j + 5))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")), text
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside)), text
    assert quality.filter_documents(empty, []).collect() == []


def test_rules_learn_and_keep_clean_documents(spark):
    good = [(i, " ".join(f"clean{(i * 31 + j * 7) % 997} text{j}" for j in range(40)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{(i * 17 + j) % 8999} | x{j}" for j in range(40)), 0) for i in range(150)]
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in good + bad], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good[:200] + bad[:100]] + [(None, 1), (5000, 0)], "doc_id long, quality int")
    rules = quality.fit(df, labels)
    kept = quality.filter_documents(df, rules)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in good}
    assert quality.fit(df, labels.where("quality = 1")) == []


def test_lm_scores(spark, docs, empty):
    got = by_id(lm.score_documents(docs))
    tokens = {i: [*words_of((t or "").lower() if (t or "").isascii() else t), b"\0end"] for i, t in enumerate(TEXTS)}
    tokens[4] = [*TEXTS[4].encode().lower().split(), b"\0end"]
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(w for i, ws in tokens.items() if i not in out for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score_documents(empty).collect() == []
    few = by_id(lm.score_documents(docs, top=3))  # most counts by the join
    assert all(few[i].n_known == got[i].n_known and math.isclose(few[i].base_score, got[i].base_score, rel_tol=1e-9) for i in got)


def test_lm_beats_the_unigrams_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_documents(df).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_media(docs, empty):
    got = by_id(media.media_digests(docs))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature
    assert media.media_digests(empty).collect() == []


def test_damaged_images_give_a_reason(spark):
    good = jpeg.encode([b"a" * 192])[0]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:60])), (3, None), (4, bytearray(b"no"))], "doc_id long, media binary")
    got = by_id(media.media_features(df))
    assert got[1].width and got[1].error is None and got[2].error and got[4].error and got[3].media_bytes is None


def brute_repeats(rows, window=13):
    least = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_repeats_like_brute_force(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeat_digests(docs).collect()}
    assert got == brute_repeats(list(enumerate(TEXTS)))
    assert got[14][1] == 32 and got[5][1] == 0
    assert substring.repeat_digests(empty).collect() == [] and substring.remove_repeats(empty).collect() == []


@pytest.mark.parametrize(("hot", "limit"), [(1, 100), (3, 1 << 20), (20_000, 50)])
def test_hot_anchors_and_small_indexes_change_nothing(docs, hot, limit):
    want = {d: n for d, (_, n, _) in brute_repeats(list(enumerate(TEXTS))).items()}
    spans = {r.doc_id: r.spans for r in substring.repeats(docs, hot=hot, limit=limit).collect()}
    got = {i: int(substring._removed((t or "").encode(), len(words_of(t)), spans.get(i), 13).sum()) for i, t in enumerate(TEXTS)}
    assert got == want


def test_removed_texts_keep_their_columns(docs):
    out = substring.remove_repeats(docs)
    got = by_id(out)
    assert out.columns == docs.columns and got[0].text is None and got[7].text == "" and got[5].text == TEXTS[5] and got[7].content == "clash7"


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fm_index.FmIndex(text, 5, 6)
    starts = np.arange(394)
    number, lo, hi = index.repeated(text, starts, 6)
    for s in starts.tolist():
        places = {i for i in range(395) if (text[i : i + 6] == text[s : s + 6]).all()}
        k = np.flatnonzero(number == s)
        assert ({*index.order[lo[k[0]] : hi[k[0]]].tolist()} == places) if len(places) > 1 else not len(k)


def test_packing_covers_every_id_once(docs, empty):
    rows = packing.pack_documents(docs, WORD).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [*ids_of(WORD, t), 2]
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in own)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        n = sum(r.length for r in w)
        assert [r.offset for r in w] == np.cumsum([0, *(r.length for r in w[:-1])]).tolist()
        assert n <= 4096 and n & (n - 1) == 0 and {r.tier for r in w} == {n}
    assert packing.pack_documents(empty, WORD).collect() == []


def test_queries_and_pipeline_run(spark):
    import __spark_entry__
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()["pipeline"](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, d)
        assert after.columns == docs.columns, name
        assert after.count() <= stage.count()
        stage = after
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in stage.select("doc_id").collect()}
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, d).collect() == [], name
