"""Near copies at a Jaccard similarity of word shingles: SimHash fingerprints in a positional byte index, count
filter, exact verification; banded minima for what fingerprints leave apart.

A text is its set of distinct five-word shingles (a shorter text is one shingle), lower-cased and
cut as for the fingerprints of ``simhash``. Equal sets are one node.

1. A node's fingerprint is the majority of its shingles' hashes in each of 64 * PRINT_WORDS bits. At a Jaccard
   similarity s the sets' cosine is 2s / (1 + s), and that angle over pi is the share of bits that differ: 0.15 at 0.8,
   39 of 256. No number of positional bytes is sure to be spared by so many, so the index is keyed by KEYS pairs of
   positions, dealt so that each position is in four: a pair at 0.8 shares a byte with probability 0.27 and a
   key with 0.95. In a posting list the shared positional bytes of a pair are tallied, pairs with fewer than
   LEAST_BYTES fall out, and so do those that differ in more bits than PRINT_DEVIATIONS standard deviations above the
   mean at the similarity. Of what is left, rows that others have joined to FEW or more rows of the list give no more
   links between themselves, so a large group of near copies becomes one component for a linear number of links.
2. A node has BANDS keys of ROWS minima each. A pair at similarity s shares none with probability
   (1 - s**ROWS)**BANDS: 3e-6 at 0.8, less above. In lists that still hold several components, all pairs of different
   components are looked at, in blocks of bounded size, each pair in the first list that it shares: that is the
   exact way for links that fingerprints miss. A sketch tells which can't reach the similarity: a byte of the least hash
   in each of BINS ranges. The least hashes of two texts' ranges are a sample of their union without replacement, so the
   shared ones of a pair at the similarity are fewer than DEVIATIONS standard deviations below their mean with
   probability 3e-7.
3. Pairs of both steps are verified by the exact intersection of their shingles.

Defined results: null and blank texts are copies of each other; rows with a null doc_id are
compared like any other, and come after all others where a component's first row is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import by_slices, connected_components, forget, stored, tidy

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 32
BLOCK = 2048
BINS = 1024
DEVIATIONS = 5.0
PRINT_WORDS = 4
PRINT_BYTES = 8 * PRINT_WORDS
PRINT_COLUMNS = [f"print{w}" for w in range(PRINT_WORDS)]
#: Pairs of byte positions: each position with the next and with the fifth from it, round in a ring.
KEYS = [(p, (p + step) % PRINT_BYTES) for step in (1, 5) for p in range(PRINT_BYTES)]
LEAST_BYTES = 3
FEW = 2
PRINT_DEVIATIONS = 2.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD, _XOR = np.random.default_rng(7).integers(0, 1 << 64, (2, ROWS * BANDS), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)
_PRINT_XOR = np.random.default_rng(8).integers(0, 1 << 64, PRINT_WORDS, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of one text in UTF-8, sorted."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    cut = [b" ".join(parts[i : i + words]) for i in range(max(len(parts) - words, 0) + 1)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), dtype=np.uint64, count=len(cut)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set of shingles: a bit is 1 if it is set in over half of the hashes."""
    tally = np.zeros(64 * PRINT_WORDS, dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            mixed = (hashes[at : at + 4096, None] ^ _PRINT_XOR) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            mixed ^= mixed >> np.uint64(29)
            tally += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * tally > len(hashes)).view(np.uint64)


def most_bits(similarity: float) -> int:
    """Bits in which fingerprints may differ at ``similarity``: PRINT_DEVIATIONS standard deviations above the mean."""
    share = math.acos(min(2 * similarity / (1 + similarity), 1.0)) / math.pi
    return math.ceil(64 * PRINT_WORDS * share + PRINT_DEVIATIONS * math.sqrt(64 * PRINT_WORDS * share * (1 - share)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of ROWS * BANDS orders."""
    low = np.full(ROWS * BANDS, (1 << 64) - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            np.minimum(low, ((hashes[at : at + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in low.reshape(BANDS, ROWS).T:
            key = (key ^ part) * _MIX
            key ^= key >> np.uint64(29)
    return key


def range_minima(hashes: np.ndarray) -> np.ndarray:
    """A byte of the least of the sorted hashes in each of BINS ranges; 0 where a range has none."""
    out = np.zeros(BINS, dtype=np.uint8)
    of = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    out[of[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out


def prints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, keys, size, bands, sketch) and the fingerprint's words of ``docs`` (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (s for b in batches for s in by_slices()(b)):
            node, keys, size, bands, sketch, words = [], [], [], [], [], []
            for text in batch.column(2).cast(pa.large_binary()):
                h = shingles(text.as_py() or b"")
                low = minima(h)
                node.append(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64))
                keys.append(band_keys(low).view(np.int64) if len(h) else np.zeros(0, np.int64))
                bands.append(keys[-1].astype("<i4").tobytes())
                size.append(len(h))
                sketch.append(range_minima(h).tobytes())
                words.append(fingerprint(h).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())]
            columns += [pa.array(w) for w in np.array(words, dtype=np.int64).reshape(-1, PRINT_WORDS).T.copy()]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "keys", "size", "bands", "sketch", *PRINT_COLUMNS])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, node long, keys array<long>, size long, bands binary, sketch binary, " + ", ".join(f"{c} long" for c in PRINT_COLUMNS))


def joining(prints: np.ndarray, group: np.ndarray, own: np.ndarray, cross: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with close fingerprints in each group: all of up to FEW rows, of more as many as join them.

    ``cross`` rows lie in order of their two blocks and give pairs of one with the other only: what joins a block in
    itself is given by that block's own group, so here it is sought first and left out, and two large groups of near
    copies are joined by a few pairs, not by one a row.
    """
    n = len(prints)
    label, members = np.arange(n), np.ones(n, dtype=np.int64)
    left, right = [label[:0]], [label[:0]]
    part = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (cross[1:] & (own[1:] != own[:-1]))])
    for of, across in ((part, False), (group, True)):
        live = np.flatnonzero(cross[:-1]) if across else np.arange(max(n - 1, 0))
        size = np.bincount(of)[of]
        shift = 1
        while len(live):
            live = live[live + shift < n]
            live = live[of[live] == of[live + shift]]
            i = live[own[live] != own[live + shift]] if across else live
            i = i[(label[i] != label[i + shift]) | (members[label[i]] < FEW)]
            differ = prints[i] ^ prints[i + shift]
            enough = (differ.view(np.uint8) == 0).sum(axis=1) >= LEAST_BYTES
            i = i[enough][np.bitwise_count(differ[enough]).sum(axis=1) <= bits]
            given = i[cross[i] == across]
            left.append(given)
            right.append(given + shift)
            apart = label[i] != label[i + shift]
            i, j = i[apart], i[apart] + shift
            changed = len(i) > 0
            while len(i):
                a, b = label[i], label[j]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := label[label], label):
                    label = up
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
            if changed:
                members = np.bincount(label, minlength=n)
                live = live[members[label[live]] < np.maximum(size[live], FEW)]  # a group that is joined as a whole is done
            shift += 1
    return np.concatenate(left), np.concatenate(right)


def close_prints(nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node and its fingerprint's words) that may reach ``similarity``, by the positional
    byte index of the fingerprints. See ``joining`` for those of a long list."""

    def byte(p: int):
        return F.shiftrightunsigned(PRINT_COLUMNS[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255)).cast("int")

    keys = F.array(*(F.lit(k << 16) + F.shiftleft(byte(a), 8) + byte(b) for k, (a, b) in enumerate(KEYS)))
    index = nodes.select("node", *PRINT_COLUMNS, F.explode(keys).alias("key"))
    # only lists of several blocks are looked up, so this side of the join is small
    long = stored(index.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > block).select("key", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("parts")), "near-long")
    dealt = index.join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", *PRINT_COLUMNS)
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own")
    bits = most_bits(similarity)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        i, j = joining(np.ascontiguousarray(rows[5:].T).view(np.uint64), np.cumsum(new), rows[3], rows[1] != rows[2], bits)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rows[4][i], rows[4][j])), pa.array(np.maximum(rows[4][i], rows[4][j]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            kept.append(np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]))
            if sum(r.shape[1] for r in kept) < 20_000:
                continue
            rows = np.concatenate(kept, axis=1)
            last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))  # rows of the last group wait for more
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [rows[:, cut:]]
            if cut:
                yield found(rows[:, :cut])
        if kept:
            yield found(np.concatenate(kept, axis=1))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) at ``similarity`` or more, by the exact intersection of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_slices(64)(b)):
            sets = [shingles(t.as_py() or b"").view(np.int64) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "row"), "node")
    sets = stored(docs.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(run, "node long, hashes array<long>"), "near-sets")
    # a node with many pairs is dealt over as many parts as it needs
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    left = sets.join(parts, sets.node == parts.u).select("u", F.col("hashes").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v").join(left, ["u", "part"])
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("shared"), (F.size("a") + F.size("b")).alias("sizes"))
    return both.filter(F.col("shared") * 1000 >= (F.col("sizes") - F.col("shared")) * F.lit(round(similarity * 1000))).select("u", "v")


def components(links: DataFrame, name: str) -> DataFrame:
    """``connected_components`` of ``links`` (u, v), after each node is merged with its least neighbour: of a large group
    of near copies few links are left between merged nodes, so its rounds don't carry the group's links each time."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    heads = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("head")), f"{name}-heads")
    ends = links.join(heads.select(F.col("node").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("node").alias("v"), F.col("head").alias("b")), "v")
    merged = connected_components(ends.filter("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")), name)
    return heads.join(merged.withColumnRenamed("node", "head"), "head", "left").select("node", F.coalesce("component", "head").alias("component"))


def alike(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` may reach ``similarity`` with ``one``, by their sketches and numbers of shingles."""
    used = ((one > 0) | (others > 0)).sum(axis=1)
    shared = ((one == others) & (one > 0)).sum(axis=1)
    union = (size + sizes) / (1 + similarity)  # at the similarity; more of it may be shared above
    spread = np.sqrt(used * similarity * (1 - similarity) * np.clip((union - used) / np.maximum(union - 1, 1), 0, 1))
    return np.flatnonzero(shared >= similarity * used - DEVIATIONS * spread - 1)


def pairs_across(index: DataFrame, sketches: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of different components that share a key; ``index`` has key, band (the key's place among
    its node's keys), node and component, ``sketches`` has node, size, bands (four bytes of each key) and sketch.

    Only rows of lists with several components get their node's sketch.
    """
    lists = index.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    dealt = index.join(lists, "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "band")
    dealt = dealt.join(sketches.select("node", "size", "bands", "sketch"), "node").select("key", "lo", "hi", "own", "node", "component", "band", "size", "bands", "sketch")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, lo, hi, own, node, component, band, size, bands, sketch = rows
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            cross = lo[a] != hi[a]
            for i in range(a, z - 1):
                j = np.arange(i + 1, z)
                j = j[(component[j] != component[i]) & ((own[j] != own[i]) | (not cross))]
                j = j[alike(sketch[i], sketch[j], size[i], size[j], similarity)]
                # in an earlier list already
                j = j[~(bands[j, : band[i]] == bands[i, : band[i]]).any(axis=1)]
                if len(j):
                    u, v = np.minimum(node[j], node[i]), np.maximum(node[j], node[i])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in range(8)]
            new.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), dtype="<i4").reshape(batch.num_rows, -1))
            new.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1))
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]) | (kept[2] != kept[2][-1])) if len(kept[0]) else []
            if len(last):  # rows of the last group wait for more
                yield from found([x[: last[-1] + 1] for x in kept])
                kept = [x[last[-1] + 1 :] for x in kept]
        if kept and len(kept[0]):
            yield from found(kept)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def first_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row): of each component of near copies in ``docs`` (row, doc_id, text) the row with the
    smallest doc_id, and of those with that doc_id one that its text decides."""
    return tidy(lambda: _first_rows(docs, similarity), docs.sparkSession, "near-first-rows")


def _first_rows(docs: DataFrame, similarity: float) -> DataFrame:
    made = stored(prints(docs), "near-prints")
    nodes = stored(made.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("keys", "size", "bands", "sketch", *PRINT_COLUMNS))), "near-nodes")
    near = stored(close_prints(nodes.filter("size > 0"), similarity), "near-close")
    links = stored(verified(near, nodes, docs, similarity), "near-links")
    joined = components(links, "near")
    named = nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.posexplode("keys").alias("band", "key"))
    rest = stored(pairs_across(named, nodes, similarity).join(near, ["u", "v"], "left_anti"), "near-rest")
    more = stored(verified(rest, nodes, docs, similarity), "near-more")
    known = joined.filter("node != component").select(F.col("component").alias("u"), F.col("node").alias("v"))  # one link a node
    joined = components(known.union(more), "near-all")
    of = made.select("row", "doc_id", "node").join(joined, "node", "left").select(F.coalesce("component", "node").alias("component"), F.col("doc_id").isNull().alias("last"), "doc_id", "node", "row")
    return of.groupBy("component").agg(F.min(F.struct("last", "doc_id", "node", "row")).alias("first")).select("first.row")
