"""Near copies at similarity 0.8, against all pairs; also as the pipeline's stage."""

import random

import numpy as np
from conftest import SMALL

import corpus_pipeline as p
from brackwater.llm import near


def brute_near(rows):
    """Places of the rows that stay, of (doc_id, text) in the order of their row keys."""
    sets = []
    for _, text in rows:
        parts = (text or "").encode().lower().split()
        sets.append({b" ".join(parts[i : i + 5]) for i in range(max(len(parts) - 5, 0) + 1)} if parts else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        first.setdefault(group[i], i)
    return set(first.values())


def made_rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(9999)}"
    bases = [[word() for _ in range(200)] for _ in range(12)]
    texts = [" ".join(b) for b in bases]
    for changes in (1, 2, 3, 4, 5, 6, 8):  # similarities on both sides of 0.8
        for b in bases:
            new = list(b)
            for at in rng.sample(range(200), changes):
                new[at] = word()
            texts.append(" ".join(new))
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    return [*rows, (None, texts[0]), (None, texts[13]), (5000, "four words of text"), (5000, "other text"), (5001, "Four  words of TEXT"), (None, None), (7000, " ")]


def stayed(spark, rows):
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars int")
    return sorted(((r[0], r[1]) for r in p.near_dedup_stage(spark, docs.coalesce(1), SMALL).select("doc_id", "text").collect()), key=str)


def test_near_stage_against_all_pairs(spark):
    rows = made_rows()
    assert stayed(spark, rows) == sorted((rows[i] for i in brute_near(rows)), key=str)
    assert stayed(spark, []) == []


def test_pairs_across_blocks(spark):
    """Each pair in one of the lists that it shares, from whatever blocks."""
    h = near.shingles(b"one two three four five six seven")
    low = near.minima(h)
    sketch = bytearray(near.range_minima(h).tobytes())
    bands = bytearray(near.band_keys(low).astype("<i4").tobytes())
    index = spark.createDataFrame([(k, k - 1, n, n % 3) for n in range(40) for k in (1, 3)], "key long, band int, node long, component long")
    sketches = spark.createDataFrame([(n, len(h), bands, sketch) for n in range(40)], "node long, size long, bands binary, sketch binary")
    got = [tuple(r) for r in near.pairs_across(index.filter("key = 1"), sketches, 0.8, block=7).collect()]
    assert sorted(got) == [(u, v) for u in range(40) for v in range(u + 1, 40) if u % 3 != v % 3]
    assert near.pairs_across(index.filter("key = 3"), sketches, 0.8).count() == 0


def test_sketches_pass_what_reaches_the_similarity():
    rng = np.random.default_rng(11)
    for n in (10, 100, 1000, 5000):
        for _ in range(60):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            other = base.copy()
            other[: n // 9] = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)  # similarity of 0.8 or just above
            a, b = (near.range_minima(np.sort(x << np.uint64(1))) for x in (base, other))
            assert len(near.alike(a, b[None, :], n, np.array([n]), 0.8)) == 1


def test_leaks_go_whatever_their_doc_id(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(None, f"before {item} after"), (None, "a clean text"), (3, f"again {item}"), (3, "another clean text")]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars int")
    left = p.decontamination_stage(spark, docs, SMALL).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([rows[1], rows[3]], key=str)
