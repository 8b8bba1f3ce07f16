"""Quality rules: learned decision lists over interpretable text features.

Features of every whole text come from numpy over batches of documents. Labelled documents (at most SAMPLE, in the order
of a hash of their id: the bound of what the driver sees) give the statistics from which sequential covering learns:
rules are grown condition by condition on two thirds of the labels by information gain, pruned on the other third, and
kept while they are precise there. The list comes out as one Spark conditional expression, in the order learned.

Cases: a null or empty text has no words, so it fails the base rule; words are runs of other characters than ASCII white
space; a label without a value, or for an unknown document, is not used; with no labels, or labels of one class, no
rule is learned and only the base rule rejects; equal values are never parted; a text of any length is taken whole, as a
step of its own; repeated rows and ids give a row each; an empty table gives an empty result; other columns of the input
are kept by filter_documents and never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, utf8

#: Labelled documents that the driver learns from at most.
SAMPLE = 8000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_bars", "n_other_marks", "n_distinct_words")
#: The characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    found = Counter(windows)
    covered, last = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + WINDOW - max(i, last)
            last = i + WINDOW
    return covered


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    chars = np.frombuffer(b"".join(texts), np.uint8)
    table = np.bincount(owner * 256 + chars, minlength=n * 256).reshape(n, 256)
    some = lambda members: table[:, list(members)].sum(1)
    words = [t.split() for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter((h for w in words for h in map(hash, w)), np.int64, int(length.sum())).view(np.uint64)
    doc = np.repeat(np.arange(n), length)
    repeats = np.zeros(n, np.int64)
    if len(hashes) >= WINDOW:
        # Equal windows have equal hashes; a text with equal hashes is counted anew by its words.
        m = len(hashes) - WINDOW + 1
        mixed = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(WINDOW):
            mixed = (mixed ^ hashes[j : j + m]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        inside = doc[:m] == doc[WINDOW - 1 :]
        mixed, of = mixed[inside], doc[:m][inside]
        ordered = np.sort(mixed)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
            for d in np.unique(of[twice[at] == mixed]).tolist():
                repeats[d] = _repeated(words[d])
    duplicates, lines_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines_of[i] = len(lines)
        duplicates[i] = len(lines) - len(set(lines))
    total = table.sum(1)
    return {
        "n_words": length,
        "word_chars": total - some(range(0x80, 0xC0)) - some(b" \t\n\v\f\r"),
        "n_symbols": some(SYMBOLS),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "n_lines": lines_of,
        "n_upper": some(range(65, 91)),
        "n_lower": some(range(97, 123)),
        "n_digits": some(range(48, 58)),
        "n_stops": some(b".,;:"),
        "n_bars": some(b"|"),
        "n_other_marks": some(b"!?\"'()[]{}=+/\\^_`~@-"),
        "n_distinct_words": np.array([len(set(w)) for w in words], np.int64),
    }


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, limit=1 << 20):
        got = counts(utf8(b.column("text")))
        yield pa.record_batch([b.column("doc_id"), *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=["doc_id", *COUNTS])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What conditions test: a count against another, as a share.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "lower": ("n_lower", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "stops": ("n_stops", "word_chars"),
    "bars": ("n_bars", "n_words"),
    "other_marks": ("n_other_marks", "word_chars"),
    "distinct": ("n_distinct_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}
FAILS = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] > self.value if self.above else x[self.ratio] <= self.value

    def column(self) -> Column:
        a, b = RATIOS[self.ratio]
        share = F.col(a) / F.greatest(F.col(b), F.lit(1))
        return share > F.lit(self.value) if self.above else share <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, bins: int) -> Rule:
    """Adds the condition with the best information gain until no good text is covered or nothing is gained."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < 4:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, bins + 1)[:-1])):
                high = v > t
                for above in (True, False):
                    covered = inside & (high if above else ~high)
                    p, n = (covered & bad).sum(), (covered & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn_rules(labelled: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, most: int = 12, bins: int = 48, least: int = 3) -> list[Rule]:
    """An ordered list of conjunctions that reject. labelled: the COUNTS by name; bad: whether the label says so."""
    x = {r: labelled[a] / np.maximum(labelled[b], 1) for r, (a, b) in RATIOS.items()}
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.arange(len(bad)) % 3 == 2  # the rows come in the order of a hash
    while len(rules) < most and (left & bad).sum() >= least:
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], bins)
        if not rule:
            break
        own, truth = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(r: Rule, own=own, truth=truth) -> float:
            held = _holds(r, own, len(truth))
            p, n = (held & truth).sum(), (held & ~truth).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        held = _holds(rule, x, len(bad)) & left
        right = (held & bad).sum()
        checked = held & part
        if right < least or right < precision * held.sum() or (checked & bad).sum() < precision * checked.sum():
            break
        rules.append(_with_margin(rule, x, held))
        left &= ~held
    return rules


def _with_margin(rule: Rule, x: dict[str, np.ndarray], held: np.ndarray) -> Rule:
    """Each threshold in the middle between the texts that the rule rejects and the nearest on the other side."""
    out = []
    for c in rule:
        v, inside = x[c.ratio], x[c.ratio][held]
        other = v[v <= c.value] if c.above else v[v > c.value]
        if len(inside) and len(other):
            c = Condition(c.ratio, c.above, float((inside.min() + other.max()) / 2 if c.above else (inside.max() + other.min()) / 2))
        out.append(c)
    return tuple(out)


def rules_column(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, else null, as one conditional expression."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> list[Rule]:
    """Learns from labels (doc_id, quality: 1 good, 0 bad) of texts that pass the base rule."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows are broadcast, and as many come to the driver.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = document_features(texts.dropDuplicates(["doc_id"])).join(F.broadcast(chosen), "doc_id").where(f"not ({FAILS})")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if got.empty:
        return []
    return learn_rules({c: got[c].to_numpy(dtype=float) for c in COUNTS}, got["quality"].to_numpy() == 0, **how)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the COUNTS, base_failed, rule (the first that rejects), kept."""
    judged = document_features(docs).withColumn("base_failed", F.expr(FAILS)).withColumn("rule", rules_column(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def _with_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, limit=1 << 20):
        got = counts(utf8(b.column("text")))
        yield pa.record_batch([*b.columns, *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=[*b.schema.names, *(f"_q_{c}" for c in COUNTS)])


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns. No join: the counts travel beside the columns."""
    inner = docs.toDF(*[f"_c{i}" if f.name != "text" else "text" for i, f in enumerate(docs.schema.fields)])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields] + [f"`_q_{c}` long" for c in COUNTS])
    counted = inner.mapInArrow(_with_counts, schema)
    named = counted.select(*inner.columns, *(F.col(f"_q_{c}").alias(c) for c in COUNTS))
    passed = named.where(f"not ({FAILS})").where(rules_column(rules).isNull())
    return passed.select(*[F.col(c).alias(f.name) for c, f in zip(inner.columns, docs.schema.fields, strict=True)])
