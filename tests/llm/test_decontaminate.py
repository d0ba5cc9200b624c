"""Containment search against brute force and its SQL twin: items of one to four words in long documents."""

import random
import re

import duckdb
import pandas as pd
from conftest import plain, same

from brackwater.llm import decontaminate


def brute(docs, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for doc, text in docs:
        w = cut(text)
        for item, said in items:
            own = cut(said)
            k = min(5, len(own))
            if not k:
                continue
            want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            shared = len(want & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
            if 1000 * (len(want) - shared) <= 200 * len(want):
                out.add((doc, text, item, said, shared, len(want), shared / len(want)))
    return [(d, i, s, n, c) for d, _, i, _, s, n, c in out]


COLUMNS = ["doc_id", "item_id", "n_shared", "n_item", "containment"]


def test_items_of_every_length(spark):
    rng, vocabulary = random.Random(6), [f"w{i}" for i in range(9)] + ["Übung", "x9"]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, words(n)) for i, n in enumerate([1, 2, 3, 3, 4, 4, 4, 5, 5, 6, 7, 9, 12, 20])] + [(90, "alpha beta gamma delta"), (91, "never said"), (92, None), (93, " .,"), (94, "lone")]
    docs = [(i, words(rng.choice([0, 1, 2, 4, 5, 30, 200]))) for i in range(120)]
    docs += [(200 + i, f"{words(20)}. {said.upper() if said else ''}, {words(300)}") for i, said in items]
    docs += [(300, "far " * 900 + "Alpha, beta; GAMMA-delta! " + "far " * 900), (301, "alpha beta gamma"), (302, None), (303, ""), (None, "alpha beta gamma delta"), (304, "alonelone lone2")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, body int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, size int")
    got = decontaminate.contained_items(d, b).select(*COLUMNS)
    want = brute(docs, items)
    assert plain(got.collect()) == plain(want)
    assert {(300, 90), (None, 90)} <= {w[:2] for w in want} and not any(w[0] in (301, 304) and w[1] >= 90 for w in want)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    same(got, con, decontaminate.OP6_SQL)


def test_verified_on_text(spark):
    """Shingles of different lengths with the same words, and equal rows."""
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "c b a"), (2, "ab c"), (3, "far " * 100_000 + "A B." + " far" * 100_000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "ab")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(d, b).collect()) == [(1, 1), (1, 2), (2, 3), (3, 1)]
