"""Cases of the third round's findings, each against the query's SQL or a plain loop."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from heron.plans import registry


def against_sql(spark, tmp_path, name, **tables):
    """A query over made tables, and its SQL over the same."""
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for table, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
    return want


def test_a_heading_at_the_very_start_of_what_is_kept(spark, tmp_path):
    """Of the last 400 bytes the heading is the first, the second, or none; its line end lies outside in the first case."""
    head = len("## [2] user\n\n") + len("\n\nReferences:\n- user\n")
    talks = [(3 * k + 1, turn, "user", "x" * (200 if turn == 1 else 400 - head + off)) for k, off in enumerate((-1, 0, 1)) for turn in (1, 2)]
    want = against_sql(spark, tmp_path, "notes_rendered", conversations=(talks, "conv_id long, turn long, role string, text string"))
    assert [w.endswith("None)") for w in sorted(want, key=lambda w: int(w.split(", ")[1]))] == [False, True, True]


T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.mark.parametrize("buckets", [1, 4])
def test_keys_of_a_stream_share_state(spark, tmp_path, buckets):
    """Many persons of an alarm or two: the store is asked by bucket, not by person, in one part and in two."""
    from heron.streaming import ordered
    from heron.streaming.events import run_to_table

    rng = random.Random(3)
    changes, want = [], []
    for person in range(400):
        for k in range(rng.randrange(1, 3)):
            set_at, trigger = rng.randrange(100), rng.randrange(300)
            changes.append((person, 0, minutes(set_at), 10 * person + k, minutes(trigger), 0))
            gone = trigger > 150 and rng.random() < 0.3
            if gone:
                changes.append((person, 0, minutes(150), 10 * person + k, minutes(trigger), 2))
            else:
                want.append((person, 10 * person + k, minutes(trigger), minutes(max(trigger, set_at))))
    changes.append((-1, 0, minutes(400), None, None, None))
    schema = "person_id long, shard int, changed_at timestamp, alarm_id long, trigger_at timestamp, status int"
    folder = f"file://{tmp_path}"
    for i, part in enumerate(([c for c in changes if c[2] < minutes(120)], [c for c in changes if c[2] >= minutes(120)])):
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        out = run_to_table(ordered.alarm_stream(stream, buckets=buckets), folder, timers=True)
    assert sorted(tuple(r) for r in out.drop("shard").collect()) == sorted(want)
    states = spark.read.format("statestore").option("stateVarName", "next").load(f"{folder}/checkpoint")
    assert 0 < states.count() <= buckets


def test_a_long_spill_is_a_heap():
    """Ids that come backwards go in front of all that wait."""
    from heron.streaming.ordered import Budget

    gate = Budget(60, 90)
    state = gate.start()
    state[0], state[1] = 0, 0
    n = 50_000
    for i in range(n):
        assert gate.take(state, i, [n - i, False, "{}" if i % 2 else "{", 0])[-1][1] == "buffered"
    state[0] = 120
    got = gate.take(state, n, [n + 1, True, "{}", 0])
    assert [(x[0], x[1]) for x in got] == [(1, "replayed"), (3, "replayed"), (n + 1, "dropped")]


def test_short_sessions_are_told_together():
    """A batch of many sessions comes back as few batches, not as one for each."""
    import pyarrow as pa

    from heron.operators import cascade

    n, us = 300, pa.timestamp("us")
    keys = [k for k in range(n) for _ in range(3)]
    times = pa.array([T0, T0, minutes(60)] * n, us)
    rows = pa.record_batch([pa.array(keys), times, pa.array([0, 0, 1] * n, pa.int32()), pa.array([1, 2, 1] * n), pa.array([0.5, 0.5, None] * n), pa.nulls(3 * n, us), pa.array([[1.0, 0.0], [1.0, 0.1], None] * n)], names=list("kaxeisv"))
    told = pa.schema([("k", pa.int64()), ("event_id", pa.int64()), ("importance", pa.float64()), ("last_scored_at", us), ("last_accessed_at", us)])
    got = list(cascade._replay([rows], 1, 600_000_000, 0.8, told))
    assert len(got) == 1
    assert [tuple(r.values()) for r in got[0].to_pylist()] == [x for k in range(n) for x in ((k, 1, 0.55, minutes(60), minutes(60)), (k, 2, 0.525, minutes(60), None))]


def test_tasks_of_similar_vectors_grow_in_number(spark, monkeypatch):
    """More vectors make more partitions, not larger ones; vectors keep their width."""
    from heron.operators import vectors

    rng = random.Random(5)
    made = [(i, i // 7, [rng.random() - 0.5 for _ in range(4)]) for i in range(700)]
    df = spark.createDataFrame(made, "event_id long, s long, embedding array<float>")
    found = lambda: vectors.similar_to_set(df, df.where("event_id % 5 = 0"), 0.3, "event_id", "embedding", "s")
    plain = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(vectors, "TASK_ROWS", 35)
    assert found().rdd.getNumPartitions() == 20
    assert sorted(map(tuple, found().collect())) == plain and len(plain) > 100


def test_words_are_merged_by_numbers():
    """The library's ids for odd words, by pairs that are numbers and symbols laid out at once; a word's texts are kept once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from heron.llm.bpe import PairIndexBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = PairIndexBpe(path), Tokenizer.from_file(path)
    library.no_truncation()
    rng = random.Random(11)
    texts = ["", "a", "aaaaaaaaaaaaaaaa", "ababababab bababa", "ÿ \x00\x01 é漢字 ½", "x" * 3000] + ["".join(rng.choice("abcde tion'é1#") for _ in range(rng.randrange(200))) for _ in range(200)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [(x, y) for x, y in bpe.encode_decode(texts)] == [(" ".join(map(str, i)), library.decode(i, skip_special_tokens=False)) for i in want]
    assert bpe.merge([]) == [] and all(isinstance(x, str) for pair in bpe.words.values() for x in pair)


def test_a_codec_forgets_its_pieces():
    import public_tokenizers

    from heron.llm.codec import Codec

    codec = Codec(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two", "three  two <unk>", ""]
    before = codec.encode(texts)
    many = len(codec.kept)
    codec.forget()
    assert len(codec.kept) < many and not codec.older and codec.encode(texts) == before


def test_a_step_of_term_counts_is_small():
    """What numpy and Python hold at once while 20 MB are counted; a worker holds it beside the JVM."""
    import tracemalloc

    import pyarrow as pa

    from heron.llm import divergence

    rng = random.Random(5)
    words = [f"{rng.choice(('the', 'Term', 'größe'))}{rng.choice('abcdefgh')}{'xyz' * rng.randrange(4)} " for _ in range(200)]
    texts = ["".join(rng.choices(words, k=1500)) for _ in range(1400)]
    batch = pa.record_batch({"text": texts, "lang": ["l"] * len(texts), "source": [f"s{k % 3}" for k in range(len(texts))]})
    want = Counter(w for t in texts for w in t.lower().split())
    tracemalloc.start()
    got: Counter = Counter()
    for b in divergence._counts([batch]):
        for term, count in zip(b["term"].to_pylist(), b["count"].to_pylist(), strict=True):
            got[term] += count
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.pop(None) == 0 and got == want
    assert sum(map(len, texts)) > 16 << 20 and peak < 160 << 20, peak


def test_merges_take_no_call_for_each_place():
    """All places of a pair are merged together: Python makes far fewer calls than there are merges."""
    import sys

    import public_tokenizers

    from heron.llm.bpe import PairIndexBpe

    bpe, rng = PairIndexBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(12)
    words = ["".join(rng.choice(("th", "er", "in", "an", "st", "e", "o")) for _ in range(8)) for _ in range(20_000)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids = bpe.merge(words)
    finally:
        sys.setprofile(None)
    merges = sum(len(w) - len(x) for w, x in zip(words, ids, strict=True))
    assert merges > 100_000 and calls < merges // 2, (merges, calls)


def test_merges_in_any_order_are_the_library(tmp_path):
    """Where a merge makes a pair of lower rank, that goes before the word's next places; runs of one letter overlap."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from heron.llm.bpe import PairIndexBpe

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = json.load(f)
    rng = random.Random(13)
    short = [m for m in made["model"]["merges"] if len("".join(m)) < 9]
    rng.shuffle(short)
    made["model"]["merges"] = short
    path = str(tmp_path / "shuffled.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    bpe, library = PairIndexBpe(path), Tokenizer.from_file(path)
    assert any(bpe.early)
    texts = ["", "a" * 40, "e" * 41 + " " + "abab" * 9, "1 two <unk> é漢字 ½ÿ"] + ["".join(rng.choices(("a", "b", "e", "th", "in", "er", "on", " ", "st", "ss", "o"), k=300)) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.encode_decode(texts) == [(" ".join(map(str, i)), library.decode(i, skip_special_tokens=False)) for i in want]
