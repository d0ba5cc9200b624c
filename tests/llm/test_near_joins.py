"""Rows of the near-duplicate stage's joins on a large group of near copies."""

import random

from test_near import brute_near, stayed
from test_near_prints import groups, nodes_of

from brackwater.llm import near


def one_group(count, words=150):
    """Near copies of one text: each with one to four words of its own."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(99999)}" for _ in range(words)]
    texts = []
    for _ in range(count):
        new = list(base)
        for at in rng.sample(range(words), rng.randint(1, 4)):
            new[at] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(new))
    return texts


def test_blocks_of_a_list_add_few_links(spark):
    """What a block has joined in itself isn't joined again with each other block."""
    texts = one_group(400)
    nodes = nodes_of(spark, texts).cache()
    whole, cut = ([tuple(r) for r in near.close_prints(nodes, 0.8, block).collect()] for block in (near.BLOCK, 16))
    assert len(cut) < 1.5 * len(whole)
    assert groups(cut, len(texts)) == groups(whole, len(texts))


def test_components_of_random_links(spark):
    rng = random.Random(8)
    for n, m in ((60, 25), (60, 50), (40, 300)):
        links = [(u, v) for u, v in (sorted(rng.sample(range(n), 2)) for _ in range(m))]
        got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
        assert got == {x: min(g) for g in groups(links, n) for x in g if len(g) > 1}
    chain = [(i, i + 1) for i in range(50)]
    got = near.components(spark.createDataFrame(chain, "u long, v long"), "t").collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(51)]
    assert near.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_rounds_carry_few_links_of_a_large_group(spark, monkeypatch):
    carried, search = [], near.connected_components
    distinct = lambda edges: edges.selectExpr("least(u, v)", "greatest(u, v)").distinct().count()
    monkeypatch.setattr(near, "connected_components", lambda edges, name: carried.append(distinct(edges)) or search(edges, name))
    rows = list(enumerate(one_group(150)))
    assert stayed(spark, rows) == sorted((rows[i] for i in brute_near(rows)), key=str)
    assert carried and max(carried) < 2 * len(rows)
