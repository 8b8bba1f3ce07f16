"""What the quality rules and the language model learn, against plain loops on small tables."""

import math

import numpy as np

from heron.llm import lm, quality


def plain_grow(rows, bins):
    """rows (ratios, bad): conditions one by one, each the best by information gain among all thresholds and both sides."""
    rule, inside = [], list(rows)
    while len(rule) < 4:
        p0 = sum(bad for _, bad in inside)
        n0 = len(inside) - p0
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name in inside[0][0]:
            values = [x[name] for x, _ in inside]
            for t in sorted({float(np.quantile(values, k / bins)) for k in range(bins)}):
                for above in (True, False):
                    kept = [bad for x, bad in inside if (x[name] > t) == above]
                    p = sum(kept)
                    if p:
                        g = p * (math.log2(p / len(kept)) - math.log2(p0 / (p0 + n0)))
                        if g > gain + 1e-12:
                            best, gain = (name, above, t), g
        if best is None:
            break
        rule.append(best)
        inside = [(x, bad) for x, bad in inside if (x[best[0]] > best[2]) == best[1]]
    return rule


def holds(rule, x):
    return all((x[name] > t) == above for name, above, t in rule)


def plain_rules(counts, bad, precision, most, bins, least):
    rows = [({r: counts[a][i] / max(counts[b][i], 1) for r, (a, b) in quality.RATIOS.items()}, bool(bad[i])) for i in range(len(bad))]
    left, rules = set(range(len(rows))), []
    while len(rules) < most and sum(rows[i][1] for i in left) >= least:
        rule = plain_grow([rows[i] for i in sorted(left) if i % 3 != 2], bins)
        if not rule:
            break
        pruned, best = None, None
        for k in range(1, len(rule) + 1):
            got = [rows[i][1] for i in left if i % 3 == 2 and holds(rule[:k], rows[i][0])]
            worth = (2 * sum(got) - len(got)) / len(got) if got else -1.0
            if best is None or worth > best:
                pruned, best = rule[:k], worth
        held = {i for i in left if holds(pruned, rows[i][0])}
        right, checked = sum(rows[i][1] for i in held), [rows[i][1] for i in held if i % 3 == 2]
        if right < least or right < precision * len(held) or sum(checked) < precision * len(checked):
            break
        told = []
        for name, above, t in pruned:
            inside, other = [rows[i][0][name] for i in held], [x[name] for x, _ in rows if (x[name] > t) != above]
            if other:
                t = (min(inside) + max(other)) / 2 if above else (max(inside) + min(other)) / 2
            told.append((name, above, t))
        rules.append(told)
        left -= held
    return rules


def test_rules_are_those_of_the_plain_learner():
    found = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = 150
        counts = {c: rng.integers(0, 60, n).astype(float) for c in quality.COUNTS}
        counts["n_words"] += 10
        counts["word_chars"] += 40
        bad = (counts["n_symbols"] / np.maximum(counts["word_chars"], 1) > 0.8) | ((counts["n_stops"] < 9) & (counts["n_upper"] > 30))
        bad ^= rng.random(n) < (0.0 if seed % 2 else 0.02)
        got = quality.learn_rules(counts, bad, precision=0.8, bins=12)
        want = plain_rules(counts, bad, 0.8, 12, 12, 3)
        assert [[(c.ratio, c.above) for c in r] for r in got] == [[c[:2] for c in r] for r in want]
        assert np.allclose([c.value for r in got for c in r], [c[2] for r in want for c in r])
        found += len(got)
    assert found > 5


def plain_step(weights, had, decisions):
    """One gradient step over some decisions (rows in the tables, choice), weights as lists."""
    grads = {}
    for rows, choice in decisions:
        z = [sum(weights[j][r][k] for j, r in enumerate(rows)) for k in range(lm.CLASSES)]
        top = max(z)
        total = sum(math.exp(x - top) for x in z)
        g = [math.exp(x - top) / total - (k == choice) for k, x in enumerate(z)]
        for j, r in enumerate(rows):
            own = grads.setdefault((j, r), [0.0] * lm.CLASSES)
            for k in range(lm.CLASSES):
                own[k] += g[k]
    for (j, r), g in grads.items():
        had[j][r] = had[j].get(r, 0.0) + sum(x * x for x in g)
        for k in range(lm.CLASSES):
            weights[j][r][k] -= lm.RATE * g[k] / math.sqrt(had[j][r] + 1)


class Zeros(dict):
    def __missing__(self, key):
        self[key] = [0.0] * lm.CLASSES
        return self[key]


def test_a_training_step_is_that_of_the_plain_loop(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 5)
    t = lm.tokens_of([b"the cat sat on the mat", b"", b"the the the dog", b"The CAT sat"])
    trainer = lm.Trainer()
    weights, had = [Zeros() for _ in lm.TABLES], [{} for _ in lm.TABLES]
    for _ in range(2):  # the second time over weights that are not zero
        trainer.learn(t)
        for a in range(0, len(t.hash), 5):
            plain_step(weights, had, [([int(r[d]) for r in t.rows], int(t.choice[d])) for d in range(len(t.choice)) if a <= t.of[d] < a + 5])
    for j in range(len(lm.TABLES)):
        for r, w in weights[j].items():
            assert np.allclose(trainer.weights[j][r], w, atol=2e-4)
        assert np.allclose([trainer.had[j][r] for r in had[j]], list(had[j].values()), rtol=1e-3)
        rest = np.delete(np.arange(lm.TABLES[j]), list(weights[j]))
        assert not trainer.weights[j][rest].any() and not trainer.had[j][rest].any()


def test_units_are_mixed_by_what_they_learnt():
    """Each row's mean over the units, weighed by the gradients that it had in them; rows that had none stay."""
    units = []
    for text in (b"a b c a b", b"a b d d", b"x"):
        u = lm.Trainer()
        u.learn(lm.tokens_of([text]))
        units.append(u)
    before = [np.full((r, lm.CLASSES), 0.25, np.float32) for r in lm.TABLES]
    weights, had = lm.mixed(sum(u.sums() for u in units), before)
    for j in range(len(lm.TABLES)):
        for r in range(0, lm.TABLES[j], 1 if j == 3 else 37):
            n = [float(u.had[j][r]) for u in units]
            want = sum(m * u.weights[j][r] for m, u in zip(n, units, strict=True)) / sum(n) if sum(n) else before[j][r]
            assert np.allclose(weights[j][r], want, atol=1e-5) and np.isclose(had[j][r], sum(n) / 3, atol=1e-6)
