"""The toxicity model against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from brackwater.llm import toxicity

COLUMNS = "word string, toxic long, plain long, toxic_late long, plain_late long"


def test_tables_keep_every_expression_apart(spark):
    """More expressions than 2**17."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(9)) for _ in range(40_000)})
    made = spark.createDataFrame([(w, i % 3, i % 5 + 1, 0, 0) for i, w in enumerate(words)], COLUMNS)
    model = toxicity.KneserNey(toxicity.expression_counts(made).cache())
    padded = lambda w: "\2" * 5 + w + "\3"
    sixes = {padded(w)[i : i + 6] for w in words for i in range(len(w) + 1)}
    fours = {x[2:] for x in sixes}
    assert len(fours) > 1 << 17
    assert len(model.top.keys) == len(sixes)
    seen, over, order = model.shared[-1]
    assert order == 4 and len(seen.keys) == len(fours) and len(over.keys) == len({x[:3] for x in fours})
    kinds = Counter(x[2:] for x in sixes)  # continuation counts: kinds of what stands before
    _, h = toxicity.expressions(words[:50])
    want = [kinds[padded(w)[i + 2 : i + 6]] for w in words[:50] for i in range(len(w) + 1)]
    got = seen.sums[0][seen.at(h[4])]
    assert np.array_equal(got, want)


def test_ratios_are_those_of_the_formula(spark):
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    counts = {w: (rng.randint(0, 3), rng.randint(0, 3)) for w in {some() for _ in range(300)}}
    rows = [(w, t, p, 7, 9) for w, (t, p) in counts.items()]
    model = toxicity.KneserNey(toxicity.expression_counts(spark.createDataFrame(rows, COLUMNS)).cache())
    cut = lambda w: [("\2" * 5 + w + "\3")[i : i + 6] for i in range(len(w) + 1)]
    top = [Counter(), Counter()]
    for w, pair in counts.items():
        for g in cut(w):
            for c in (0, 1):
                top[c][g] += pair[c]
    grams = [g for g in top[0] | top[1] if top[0][g] + top[1][g]]
    four, two = Counter(g[2:] for g in grams), Counter(x[2:] for x in {g[2:] for g in grams})
    d, b = 0.75, toxicity.BACKOFF

    def lower(gram, seen, below):
        over = [n for g, n in seen.items() if g[:-1] == gram[:-1]]
        return min((max(seen[gram] - d, 0) + d * len(over) * below) / sum(over), 1) if over else below

    contexts = [defaultdict(list), defaultdict(list)]
    for c in (0, 1):
        for g, n in top[c].items():
            if n:
                contexts[c][g[:-1]].append(n)

    def log(g, c):
        q = lower(g[2:], four, lower(g[4:], two, 1 / 256))
        own = contexts[c][g[:-1]]
        return math.log((max(top[c][g] - d, 0) + (d * len(own) + b) * q) / (sum(own) + b))

    words = [*list(counts)[:40], *(some() for _ in range(40)), "abcdé", "zzz"]
    want = [sum(log(g, 0) - log(g, 1) for g in cut(w)) for w in words]
    assert np.allclose(model.ratios(words), want, atol=1e-5)


def test_curve_never_falls():
    assert toxicity._curve([(-1.0, 5, 6), (1.0, 1, 6)], 0.3)[0] >= toxicity.LEAST_SLOPE
    slope, offset = toxicity._curve([(0.0, 5, 100), (1.0, 60, 100), (2.0, 95, 100)], 0.3)
    assert slope > 1 and abs(1 / (1 + math.exp(-offset)) - 0.05) < 0.03
    assert toxicity._curve([], 0.2)[0] > 0
