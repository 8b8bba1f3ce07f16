"""Source divergences, alignment of two tokenizers and licence scans against plain versions."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from heron.llm import alignment, divergence, licenses, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM, WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    "", None, " ", "  two  spaces ", "tab\tand\r\ncr\r\n\r\nlf;\r\nx;\r y", "special <|endoftext|> and <s> </s> <0x41>", "▁under ▁", "emoji 😀👩‍👩‍👧 漢字 　 wide\xa0nb", "a\0b\x1c c", "it's 'tis don't",
    "\n\nlead", "x" * 700, "ﬁ x² é", "trail\n\n \n", "\r", ";\r", "{\r\n}\r\n a  {\r", "same text", "same text",
]


def plain_divergences(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    in_docs, counts, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOW))
        counts[lang, source].update(terms)
        whole[lang].update(terms)
        in_docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, source in counts:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(whole[lang])
        pairs = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                o = shares(counts[lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other))
        terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t])
        for part, got in (("pair", sorted(pairs)), ("term", terms[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(got, 1)}
    return out


def test_divergences_of_odd_rows(spark):
    rows = [("The cat", "en", "a"), ("the CAT sat", "en", "b"), ("the cat, the dog", "en", None), (None, "en", "empty"), ("", None, None), ("él él", "es", "a"), ("él", "es", "a"), ("él nada", "es", "b"), ("nur eins", "de", "a"), ("the cat", "en", "a"), ("x" * 3000 + " y" * 5000, "en", "long")]
    rows += [("x" * 3000, "en", f"s{k}") for k in range(6)]
    docs = spark.createDataFrame([(7, 1, 2, 3, *r) for r in rows], "doc_id long, term long, pos int, count long, text string, lang string, source string").repartition(3)
    want = plain_divergences(rows, 3, 200)
    for tile, part in ((256, 1 << 18), (2, 2)):  # one task a language; many, in tiles of two sources
        assert {tuple(r) for r in divergence.source_divergences(docs, tile=tile, part=part).collect()} == want
    assert {tuple(r) for r in divergence.source_divergences(docs, least=1, top=1).collect()} == plain_divergences(rows, 1, 1)
    assert divergence.source_divergences(docs.limit(0)).collect() == []


def test_divergences_by_tile_add_up():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (5, 40)) * (rng.random((5, 40)) < 0.3)
    counts[2] = 0
    n, v = counts.sum(1), counts.shape[1]
    shares = 1 + 10**9 * (counts + 1) // (n + v)[:, None]
    rest = 1 + 10**9 // (n + v)
    want = [[int(((shares[s] - shares[r]) ** 2 // shares[r]).sum()) for r in range(5)] for s in range(5)]
    got = v * ((rest[:, None] - rest) ** 2 // rest)
    for half in (slice(0, 17), slice(17, 40)):
        row, col = np.nonzero(counts[:, half])
        indptr = np.append(0, np.cumsum(np.bincount(row, minlength=5)))
        got += divergence.csr_divergences(indptr, col, shares[:, half][row, col], rest, shares[:, half].shape[1])
    assert got.tolist() == want


def test_many_tiles_give_the_same_pairs(spark):
    """Sources of more tiles than one."""
    rows = [(f"word{k % 7} word{k % 3} word", "en", f"s{k % 300}") for k in range(900)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {tuple(r) for r in divergence.source_divergences(docs).where("source in ('s0', 's299', 's17')").collect()}
    assert got == {r for r in plain_divergences(rows, 3, 200) if r[1] in ("s0", "s299", "s17")}


def test_colliding_hashes_are_told_apart():
    data = b"ab abc ab xyz abc " + b"q" * 600 + b" " + b"q" * 599 + b"r"
    offsets = np.array([0, 9, 9, len(data)])
    start, length = divergence.boundaries(np.frombuffer(data, np.uint8), offsets)
    words = [data[s : s + n] for s, n in zip(start, length, strict=True)]
    assert words == data.split()
    for hashed in (divergence.xxh64, lambda d, s, n, seed: np.zeros(len(s), np.uint64), lambda d, s, n, seed: n.astype(np.uint64)):
        first, number = divergence.grouped(data, start, length, hashed)
        assert len(first) == len(set(words)) and [words[first[k]] for k in number] == words


def test_divergences_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = Counter(con.execute(queries.oracle_sql()["op11_divergence"]).fetchall())
    assert Counter(tuple(r) for r in queries.op11_divergence(spark, DATA).collect()) == want


def plain_alignments(texts):
    """By the byte offsets at which tokens end."""
    al = alignment.Aligner(A, B)
    a_bytes, b_bytes = al.transducer.tokens
    parts, count = [], Counter()
    for x in texts:
        raw = (" " + (x or "")).encode()
        a, b = al.a.encode(" " + (x or ""), add_special_tokens=False).ids, al.b.encode(x or "")
        if not x or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            parts.append(None)
            continue
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((a_bytes, a), (b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        parts.append((len(a), len(b), groups))
        count.update({(i, j) for g in groups for i in g[0] for j in g[1]})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for p in parts:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for g in p[2] for i in g[0] for j in g[1]]
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in p[2])
        out.append((p[0], p[1], len(p[2]), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest()))
    return out, parts


def test_alignments_equal_the_plain_version(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]
    rows = [(i, t, 1, 2, 3) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, idx int, count long").repartition(5)
    want, parts = plain_alignments(texts)
    assert sum(p is None for p in parts) >= 3
    got = Counter(tuple(r) for r in alignment.alignment_digests(docs, A, B).collect())
    assert got == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert alignment.alignment_digests(docs.limit(0), A, B).collect() == []


def test_groups_of_ids(spark):
    texts = [*ODD, "antidisestablishmentarianism 😀 naïveté"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, parts = plain_alignments(texts)
    for r in alignment.aligned_groups(docs, A, B).collect():
        assert [(list(g.a), list(g.b)) for g in r.groups] == ([] if parts[r.doc_id] is None else parts[r.doc_id][2])


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"x", b"abx"])

    def groups(*units):
        size = tuple(np.array([len(u[k]) for u in units]) for k in (0, 1))
        ids = np.array([i for k in (0, 1) for u in units for i in u[k]], np.int64)
        group, n, same = t.groups(ids, size)
        return group.tolist(), n[same].tolist(), same.tolist()

    assert groups(([0, 1], [0, 1]), ([2, 3], [0, 1, 2])) == ([0, 0, 0, 1, 0, 0, 0, 0, 1], [1, 2], [True, True])
    assert groups(([], []), ([0], [0]), ([0], []), ([], [0]), ([0, 1], [3]))[2] == [True, False, False, False, False]
    assert t.move(0, b"bc", 0) is None and t.move(0, b"bc", 1) == (1, b"") and t.move(1, b"a", 0) == (0, b"b")
    t.forget()
    assert groups(([2], [0, 1])) == ([0, 0, 0], [1], [True])


def test_what_a_worker_forgets_changes_nothing(monkeypatch):
    texts = [r for r in ODD if r] + ["a b c d", "e f a b", "a b", "g\nh  i"]
    al = alignment.Aligner(A, B)
    want = list(alignment.Block(al, texts).told())
    for name, value in (("KEEP", 2), ("MOVES", 3), ("LEARN", 2)):
        monkeypatch.setattr(alignment, name, value)
    small = alignment.Aligner(A, B)
    assert [next(alignment.Block(small, [t]).told()) for t in texts] == want and list(alignment.Block(small, texts).told()) == want


def occurs(notice, k, text):
    """Whether some stretch of the text is the notice but for k edits, by dynamic programming."""
    row = list(range(len(notice) + 1))
    for c in text:
        new = [0]
        for i, d in enumerate(notice, 1):
            new.append(min(row[i - 1] + (d != c), row[i] + 1, new[-1] + 1))
        if new[-1] <= k:
            return True
        row = new
    return False


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_no_notice_is_missed_and_none_is_made_up():
    rng, s = random.Random(5), licenses.Scanner(share=10)
    seen = 0
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 3)):
            j = rng.randrange(len(s.notices))
            x = list(s.notices[j][0])
            for _ in range(rng.randint(0, s.edits[j] + 2)):
                p, kind = rng.randrange(len(x)), rng.randrange(3)
                x[p : p + (kind != 1)] = [rng.choice("abcdeg t")] if kind < 2 else []
            text.append("".join(x) + " of the license" * rng.randint(0, 2))
        words = licenses.normal_form(" ".join(text).encode())
        spans = s.spans(words)
        assert {p.notice for p in spans} == {j for j, (n, _) in enumerate(s.notices) if occurs(n, s.edits[j], words)}
        for p in spans:
            assert distance(words[p.start : p.end], s.notices[p.notice][0]) <= p.edits <= s.edits[p.notice]
        seen += len(spans)
    assert seen > 100


def test_every_place_of_a_notice_counts():
    """A worse occurrence before a better one, and many in a row."""
    s = licenses.Scanner()
    words = licenses.normal_form(b"Released under teh MIT license. released UNDER the mit-license; " * 40)
    assert len([p for p in s.spans(words) if s.notices[p.notice][0] == "released under the mit license"]) >= 40
    one = licenses.normal_form(b"redistribution and use in sorce and binary form, with or without modification, are permitted (redistribution and use in source and binary forms with or without modification are permitted)")
    assert [p.edits for p in s.spans(one)] == [2, 0]


def test_license_rows(spark):
    texts = ["Released under the MIT License.", "mit\nLICENSE? Apache--license", None, "", "permission is hereby granted, free of charge, to any persom obtaining a copy of this software", "general public licenses", "the GNU General Public License general public license", "emit license", "x " * 30000 + "Apache License", "Licensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame([(None if k == 3 else 7, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, label int")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for k, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOW))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want.append((None if k == 3 else 7, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    told = {(r.n_words, r.labels, round(r.score, 4)) for r in got}
    assert (16, "mit", round(1 - 1 / len(licenses.NOTICES[0][0]), 4)) in told and (7, "cc-by-nc", 1.0) in told and (0, "", 0.0) in told and (3, "", 0.0) in told
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    spans = {(r.label, r.first_word, r.last_word, r.edits, r.found) for r in licenses.notice_spans(docs).collect()}
    assert ("mit", 0, 15, 1, licenses.normal_form(texts[4].encode())) in spans and ("cc-by-nc", 0, 6, 0, "licensed under cc by nc 4 0") in spans
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_a_close_notice_wins_over_another_licence():
    s = licenses.Scanner(share=12)  # two edits turn one Creative Commons licence into another
    assert {s.notices[p.notice][1] for p in s.spans("licensed under cc by nc 4 0")} == {"cc-by-nc", "cc-by-sa"}
    assert s.scan("licensed under cc by nc 4 0")[5] == "cc-by-nc"
    with pytest.raises(ValueError, match="no words"):
        licenses.Scanner((("--", "x"),))


def test_licenses_of_the_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert rows.where(F.lower("text").contains("mit license")).count() == sum(r.base_labels == "mit" for r in got.values())
