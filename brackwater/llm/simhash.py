"""SimHash near-duplicates: positional byte index, count filter, exact verification.

A fingerprint of 64 bits has 8 positional bytes. Two fingerprints at Hamming distance 4 or less
spoil at most 4 of them, so they share at least 4 positional bytes: the guaranteed minimum. The
index is keyed by triples of positional bytes; the triples are a covering design in which every
set of 4 positions holds one, so every linkable pair meets in a posting list. There the shared
positional bytes of a pair are tallied, pairs with fewer than the minimum fall out, and the rest
are verified by counting differing bits. Posting lists are compared in blocks of bounded size and
only a spanning forest of the verified links leaves a task, never the pairs of a group.

Defined results: null and blank texts have fingerprint zero and link like any other; rows with
a null doc_id get a fingerprint and a component, and count for no component's smallest id; equal
texts share a fingerprint, so copies are one node; repeated rows come back repeated; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import by_slices, connected_components, stored, table

BYTES = 8
MAX_BITS = 4
BLOCK = 512


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions contain one (20 triples).

    The positions are dealt into three rings; a triple lies in one ring, or has two positions in
    a ring and one in the next.
    """
    ring = [p % 3 for p in range(BYTES)]

    def chosen(t: tuple[int, int, int]) -> bool:
        counts = [sum(ring[p] == r for p in t) for r in range(3)]
        return 3 in counts or any(counts[r] == 2 and counts[(r + 1) % 3] == 1 for r in range(3))

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned number."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        cut = [joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), dtype=np.uint64, count=len(cut))
    tally = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        tally += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * tally > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; the long has the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_slices()(b)):
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, group: np.ndarray, block: np.ndarray, cross: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that span the components of rows which share a group and verify."""
    n = len(fp)
    label = np.arange(n)
    raw = fp.view(np.uint8).reshape(-1, BYTES)
    need = max(BYTES - max_bits, 0)
    live = np.arange(max(n - 1, 0))
    shift = 1
    while len(live):
        live = live[live + shift < n]
        live = live[group[live] == group[live + shift]]
        i = live[~cross[live] | (block[live] != block[live + shift])]
        j = i + shift
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        shared = (raw[i] == raw[j]).sum(axis=1)
        i, j = i[shared >= need], j[shared >= need]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        i, j = i[close], j[close]
        while len(i):
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tolist() != label.tolist() if n < 64 else not np.array_equal(up := label[label], label):
                label = up
            left = label[i] != label[j]
            i, j = i[left], j[left]
        shift += 1
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints ``nodes`` (fp)."""
    keys = []
    for k, (a, b, c) in enumerate(covering_triples()):
        of = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        keys.append(F.lit(k << 24).cast("long") + F.shiftleft(of(a), 16) + F.shiftleft(of(b), 8) + of(c))
    index = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    dealt = index.join(lists, "key").select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    dealt = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in range(5)])
            kept.append(rows)
            if sum(r.shape[1] for r in kept) < 20_000:
                continue
            rows = np.concatenate(kept, axis=1)
            last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))  # rows of the last group wait for more
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [rows[:, cut:]]
            if cut:
                yield spanning(rows[:, :cut])
        if kept:
            yield spanning(np.concatenate(kept, axis=1))

    def spanning(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        fp = np.ascontiguousarray(rows[4]).view(np.uint64)
        child, top = _forest(fp, np.cumsum(new), rows[3], rows[1] != rows[2], max_bits)
        return pa.RecordBatch.from_arrays([pa.array(rows[4][child]), pa.array(rows[4][top])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find links of {MAX_BITS} bits at most")
    prints = stored(fingerprints(docs, words, seed), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = connected_components(links(nodes.select("fp"), max_bits), "simhash")
    labelled = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    labelled = stored(labelled, "simhash-labelled")
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(labelled.join(firsts, "component").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
