"""Pieces of frequent anchors are dealt by their strings, with the results of brute force."""

import random

import numpy as np
import pyarrow as pa
from test_llm_operators import EDGES, brute_suffixes, docs, whole_table

from brackwater.llm import suffixes


def shared(n, size):
    """Texts of their own around one passage of ``size`` bytes."""
    rng = random.Random(size)
    own = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = own(size)
    return [(i, own(150) + passage + own(150)) for i in range(n)]


def test_results_do_not_depend_on_frequency(spark):
    rows = [*EDGES, *whole_table(spark)[:60], *((900 + d, t) for size in (50, 60, 93, 300) for d, t in shared(40, size))]
    for hot in (0, 30):
        got = suffixes.deduplicate(docs(spark, rows).select("doc_id", "text"), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == brute_suffixes(rows)


def largest_bucket(size, hot, buckets=16):
    """(share of the pieces that the fullest bucket gets, pieces)"""
    plan = suffixes.Plan(buckets, hot=hot)
    texts = [(f"{d:03d}", d, t.encode()) for d, t in shared(300, size)]
    chunk = pa.table({"chunk": pa.array([0] * 300, pa.int32()), "h": [x[0] for x in texts], "doc": [x[1] for x in texts], "text": pa.array([x[2] for x in texts], pa.binary())})
    keys = plan.send_keys(chunk)
    bits = pa.concat_tables([plan.answer_keys(keys.slice(i, 1)) for i in range(keys.num_rows)])
    sent = plan.send_pieces(chunk, bits)
    n = np.array([len(x) // plan.width for x in sent["data"].to_pylist()])
    return n.max() / n.sum(), n.sum()


def test_edges_of_a_passage_are_spread():
    for size in (60, 93, 150):
        assert largest_bucket(size, hot=100)[0] < 0.2


def test_anchors_are_dealt_evenly():
    rng = np.random.default_rng(3)
    texts = pa.table({"chunk": pa.array([0], pa.int32()), "h": ["x"], "doc": [1], "text": pa.array([rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()], pa.binary())})
    n = [len(x) for x in suffixes.Plan(16).send_keys(texts)["data"].to_pylist()]
    assert max(n) < 1.5 * sum(n) / 16
