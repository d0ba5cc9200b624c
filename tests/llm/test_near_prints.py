"""The positional byte index over fingerprints of the near-duplicate stage."""

import random

import numpy as np
from test_near import brute_near, made_rows, stayed

from brackwater.llm import near


def nodes_of(spark, texts):
    prints = [near.fingerprint(near.shingles(t.encode())).view(np.int64).tolist() for t in texts]
    return spark.createDataFrame([(n, *p) for n, p in enumerate(prints)], "node long, " + ", ".join(f"{c} long" for c in near.PRINT_COLUMNS))


def near_pairs(count, words=200, changes=4):
    """Texts 2i and 2i + 1 are alike at some 0.82, others at nothing."""
    rng = random.Random(9)
    texts = []
    for _ in range(count):
        base = [f"w{rng.randrange(99999)}" for _ in range(words)]
        other = list(base)
        for at in rng.sample(range(words), changes):
            other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    return texts


def groups(pairs, n):
    label = list(range(n))
    for u, v in pairs:
        a, b = label[u], label[v]
        label = [a if x == b else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == g) for g in set(label)}


def test_fingerprint_is_the_majority_of_each_bit():
    assert near.fingerprint(near.shingles(b"")).tolist() == [0] * near.PRINT_WORDS
    one, two = (near.shingles(t) for t in (b"a b c d e", b"f g h i j"))
    both = near.fingerprint(np.sort(np.concatenate([one, two])))
    assert (both == near.fingerprint(one) & near.fingerprint(two)).all()
    long = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 70_000, dtype=np.uint64))  # several chunks
    share = np.bitwise_count(near.fingerprint(long) ^ near.fingerprint(long[7000:])).sum() / (64 * near.PRINT_WORDS)
    assert 0 < share < 0.25


def test_index_finds_nine_of_ten_pairs_at_the_similarity(spark):
    texts = near_pairs(300)
    nodes = nodes_of(spark, texts)
    wanted = {(i, i + 1) for i in range(0, len(texts), 2)}
    got = [tuple(r) for r in near.close_prints(nodes, 0.8).collect()]
    assert len(got) == len(set(got)) and len(wanted & set(got)) >= 0.9 * len(wanted)
    assert len(set(got) - wanted) < 10
    assert near.close_prints(nodes.limit(0), 0.8).count() == 0


def test_long_lists_in_blocks_join_the_same_rows(spark):
    """A group of near copies shares hot lists: few links, whatever the blocks."""
    base = near_pairs(1)[0].split()
    rng = random.Random(4)
    texts = near_pairs(20)
    for _ in range(120):
        new = list(base)
        new[rng.randrange(200)] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(new))
    nodes = nodes_of(spark, texts)
    whole, cut = ([tuple(r) for r in near.close_prints(nodes, 0.8, block).collect()] for block in (near.BLOCK, 7))
    assert groups(whole, len(texts)) == groups(cut, len(texts)) and max(map(len, groups(cut, len(texts)))) == 122  # base and its pair too


def test_joining_leaves_out_pairs_that_are_joined_already():
    prints = np.zeros((5000, near.PRINT_WORDS), dtype=np.uint64)
    flat = np.zeros(5000, dtype=np.int64)
    i, j = near.joining(prints, flat, flat, flat > 0, 10)
    assert len(i) < 5 * len(prints) and (i < j).all()
    i, j = near.joining(prints[: near.FEW - 1], *(x[: near.FEW - 1] for x in (flat, flat, flat > 0)), 10)
    assert len(i) >= near.FEW - 2


def test_stage_takes_its_links_from_the_index(spark, monkeypatch):
    """The minima see what fingerprints have joined as one component, and find the rest."""
    seen = []
    across = near.pairs_across

    def counted(index, *rest):
        seen.append((index.select("node").distinct().count(), index.select("component").distinct().count()))
        return across(index, *rest)

    found = []
    close = near.close_prints
    monkeypatch.setattr(near, "pairs_across", counted)
    monkeypatch.setattr(near, "close_prints", lambda *a: found.append(1) or close(*a))
    rows = made_rows()
    assert stayed(spark, rows) == sorted((rows[i] for i in brute_near(rows)), key=str)
    assert found and seen[0][0] - seen[0][1] >= 40  # of 48 or so: four variants of each of twelve texts reach 0.8
    # with no links from the index the result is the same
    monkeypatch.setattr(near, "close_prints", lambda nodes, similarity: close(nodes.limit(0), similarity))
    assert stayed(spark, rows) == sorted((rows[i] for i in brute_near(rows)), key=str)
    assert seen[1][1] == seen[1][0]
