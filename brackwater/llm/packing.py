"""Sequence packing by non-negative least squares over shallow length combinations.

Documents are tokenised, ended by one id and cut into pieces of at most a window; whole windows
are sequences already. The lengths of the remainders are rounded up to a grid, and combinations
of at most three different grid lengths and six pieces that fill a window exactly are enumerated.
Repeat counts x with A x = histogram, x >= 0, are solved by non-negative least squares with an
active set, so that no more combinations are in use than there are grid lengths, then rounded up
as long as there are pieces. Pieces that no combination takes are packed greedily: laid end to
end, and cut where a sequence is full.

Only the histogram (one count per grid length) reaches the driver. Pieces find their combination
by their rank among pieces of their length; ranks are counted in hashed parts and carried on top
of the parts' counts, so a length that a third of all documents share is no hot group.

Defined results: a null or empty text has the end id alone; equal rows are packed separately; rows with a
null doc_id are packed like others; a text of any length is cut into as many windows as it fills;
further columns are ignored; an empty table gives an empty result. ids_crc32 is over
little-endian unsigned 32-bit ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.llm.common import by_bytes, kept, partitions, stored, table

WINDOW = 4096
GRID = 8
PIECES = 6
END_ID = 2
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the rest
#: as characters from 256 on, in order.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Bytes of lower-case letters up to U+00FF; 0xC3 leads those beyond ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[0x80:0xC0] = _LETTER[0xC3] = True
_LETTER[[0x97, 0xB7]] = False
NO_RANK = np.int64(1 << 40)


class Merges:
    """The vocabulary's merges, applied to many words of letters at a time: in each round every
    word merges its first pair of the least rank."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order]
        of = [chr(BYTES.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([ids.get(c + x, -1) for c in of], dtype=np.int64) for x in ("", end))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], NO_RANK), self.made[at]

    def apply(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words whose bytes ``data`` holds one after the other, and how many each has."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol = self.inner[data]
        symbol[ends] = self.last[data[ends]]
        rank, made = np.full(len(data), NO_RANK), np.zeros(len(data), dtype=np.int64)
        if len(data) > 1:
            rank[:-1], made[:-1] = self._ranks(symbol[:-1], symbol[1:])
            rank[ends] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            new = np.r_[True, word[1:] != word[:-1]]
            starts = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, starts)
            open_ = (best < NO_RANK)[number]
            done.append((word[~open_], symbol[~open_]))
            at = np.flatnonzero(open_ & (rank == best[number]))
            at = at[np.r_[True, number[at][1:] != number[at][:-1]]] if len(at) else at
            symbol[at] = made[at]
            stay = open_
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            # a merged pair's end is the end of what it met
            at = place[at]
            symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
            touched = np.zeros(len(word) + 1, dtype=bool)
            touched[at] = touched[at - 1] = True  # at -1 for the first: the spare last place
            redo = np.flatnonzero(touched[:-1][:-1] & (word[1:] == word[:-1])) if len(word) else at
            rank[at] = NO_RANK
            rank[redo], made[redo] = self._ranks(symbol[redo], symbol[redo + 1])
        word, symbol = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        by = np.argsort(word, kind="stable")
        return symbol[by].astype("<u4"), np.bincount(word, minlength=len(sizes))


class WordCoder:
    """The ids of words, encoded once each. The vocabulary drops white space and lower-cases
    character by character, so a text's ids are those of its words in turn, and a full stop or a
    comma after a letter is a word of its own. Words of letters go straight to the merges; all
    others, and texts with special tokens, through the tokenizer."""

    LIMIT = 250_000

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = Merges(self.tokenizer)
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.n = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.int64), 0
        self._put([""], np.array([self.end_id], dtype="<u4"), np.ones(1, dtype=np.int64))  # the end of a text

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.starts[self.n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(words)] = at + np.cumsum(sizes)
        self.known.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def _learn(self, words: list[str], arrow: pa.Array) -> None:
        _, offsets, data = arrow.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[arrow.offset : arrow.offset + len(arrow) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        plain = np.logical_and.reduceat(_LETTER[data], offsets[:-1] - offsets[0])
        ids, counts = self.merges.apply(data[np.repeat(plain, sizes)], sizes[plain])
        self._put([words[i] for i in np.flatnonzero(plain)], ids, counts)
        other = [words[i] for i in np.flatnonzero(~plain)]
        for at in range(0, len(other), 500):
            part = other[at : at + 500]
            found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._put(part, np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64))

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, one after the other, and how many each text has."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(memoryview(x) for x in texts.cast(pa.binary()).to_pylist()), dtype=np.uint8).copy()
        ends = np.cumsum(sizes)
        whole = np.repeat(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), sizes)  # may hold special tokens
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[ends] = edge[0] = True
        before, after = np.r_[np.uint8(32), data[:-1]] if len(data) else data, np.r_[data[1:], np.uint8(32)] if len(data) else data
        upper = (data >= 65) & (data <= 90) | (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        space = ((data == 32) | (data == 10)) & ~whole
        data[upper & ~whole] += 32
        wide = _LETTER & (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
        before = np.r_[np.uint8(32), data[:-1]] if len(data) else data
        letter = (before >= 97) & (before <= 122) | wide[before] & (np.r_[np.zeros(2, np.uint8), data[:-2]][: len(data)] == 0xC3)
        gap = np.r_[True, space[:-1]] | edge[:-1] if len(data) else space
        # a stop or comma after a letter and before a space
        stop = ((data == 46) | (data == 44)) & letter & ~edge[:-1] & ((after == 32) | (after == 10) | edge[1:]) & ~whole
        first = np.flatnonzero((gap | stop) & ~space)
        left = np.cumsum(~space)
        offsets = np.r_[left[first] - 1, left[-1] if len(left) else 0].astype(np.int32)
        flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[~space]))
        return flat.dictionary_encode(), np.diff(np.r_[0, np.searchsorted(first, ends)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), each with its end id, and where each text ends."""
        if self.n > self.LIMIT:
            self.forget()
        coded, counts = self.words(texts)
        kinds, at = coded.dictionary, np.zeros(0, dtype=np.int64)
        if len(kinds):
            words = kinds.to_numpy(zero_copy_only=False).tolist()
            row = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            new = np.flatnonzero(row < 0)
            if len(new):
                names = [words[i] for i in new]
                self._learn(names, kinds.take(pa.array(new)))
                row[new] = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
            at = row[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.insert(at, np.cumsum(counts), 0)
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        out = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - size), size)]
        return out, ends[np.cumsum(counts + 1) - 1]


def coder(vocabulary: str, end_id: int) -> WordCoder:
    """One coder for all tasks of a Python worker."""
    return kept(f"coder:{vocabulary}:{end_id}", lambda: WordCoder(vocabulary, end_id))


def token_rows(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per document: row, doc_id, doc_tokens, ids (the remainder's, 32 bit, little-endian),
    and full_crc, the checksums of its whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, end_id)
        for batch in (s for b in batches for s in by_bytes(b, 1)):
            ids, ends = own.ids(pc.fill_null(batch.column(1), ""))
            begin = np.r_[0, ends[:-1]]
            rest = begin + (ends - begin) // window * window
            blobs = [ids[a:z].tobytes() for a, z in zip(rest, ends, strict=True)]
            crcs = [[zlib.crc32(ids[k : k + window]) for k in range(a, z, window)] for a, z in zip(begin, rest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - begin), pa.array(blobs, pa.binary()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "ids", "full_crc"])

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, ids binary, full_crc array<long>")
    return coded.withColumn("row", F.monotonically_increasing_id())


def combinations(bins: int, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Ways to write ``bins`` with three parts or fewer: the parts, and how often each is taken.

    Two parts a and b times each (a + b <= pieces), or two once and a third up to pieces - 2 times.
    """
    p = np.arange(1, bins + 1)
    found = [np.stack([p[bins % p == 0], 0 * p[bins % p == 0], 0 * p[bins % p == 0], bins // p[bins % p == 0]], axis=1)]
    found = [np.c_[f[:, :3], f[:, 3], 0 * f[:, 3], 0 * f[:, 3]] for f in found]
    found[0] = found[0][found[0][:, 3] <= pieces]
    for a in range(1, pieces):
        for b in range(1, pieces + 1 - a):
            rest = bins - a * p
            q = rest // b
            ok = (rest > 0) & (rest % b == 0) & (q < p)
            found.append(np.stack([p[ok], q[ok], 0 * p[ok], 0 * p[ok] + a, 0 * p[ok] + b, 0 * p[ok]], axis=1))
    big, small = (x.ravel() for x in np.meshgrid(p, p, indexing="ij"))
    big, small = big[big > small], small[big > small]
    for c in range(1, pieces - 1):
        rest = bins - big - small
        r = rest // c
        ok = (rest > 0) & (rest % c == 0) & ((r < small) if c == 1 else (r != small) & (r != big))
        one = 0 * r[ok] + 1
        found.append(np.stack([big[ok], small[ok], r[ok], one, one, c * one], axis=1))
    every = np.concatenate(found)
    return every[:, :3], every[:, 3:]


def nnls(parts: np.ndarray, times: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """x >= 0 for which the counts of parts come close to ``target``, each miss at its weight, in the
    least-squares sense. Active set (Lawson and Hanson); a column of A is times at parts."""
    x = np.zeros(len(parts))
    value = times * np.where(parts > 0, weight[parts], 0.0)  # the weighted entries of A
    scaled = value / np.sqrt((value**2).sum(axis=1))[:, None]
    goal = weight * target
    least = 1e-6 * max(1.0, np.abs(goal).max())
    active = np.zeros(0, dtype=np.int64)
    columns, gram, aim = np.zeros((len(target), 0)), np.zeros((0, 0)), np.zeros(0)
    for _ in range(3 * len(target)):
        left = goal - columns @ x[active]
        slope = np.einsum("ij,ij->i", scaled, left[parts])
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= least:
            break
        one = np.zeros(len(target))
        np.add.at(one, parts[best], value[best])
        beside = columns.T @ one
        gram = np.block([[gram, beside[:, None]], [beside[None, :], (one @ one) * (1 + 1e-9)]])
        active, columns, aim = np.r_[active, best], np.c_[columns, one], np.r_[aim, one @ goal]
        while len(active):
            own = np.linalg.solve(gram, aim)
            if own.min() > 0:
                x[active] = own
                break
            was, low = x[active], own <= 0
            step = (was[low] / np.maximum(was[low] - own[low], 1e-300)).min()
            now = was + step * (own - was)
            stay = ~(low & (now <= 1e-9 * max(1.0, now.max())))
            if stay.all():
                stay[np.flatnonzero(low)[own[low].argmin()]] = False
            x[active] = np.where(stay, now, 0)
            active, columns, gram, aim = active[stay], columns[:, stay], gram[np.ix_(stay, stay)], aim[stay]
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of (length, first rank, last rank, first sequence, place, sequences) that the ranks of
    the pieces of a grid length fall into."""
    h = np.array([histogram.get(k, 0) for k in range(bins + 1)], dtype=float)
    h[0] = 0
    parts, times = combinations(bins)
    there = ((h[parts] > 0) | (parts == 0)).all(axis=1)
    parts, times = parts[there], times[there]
    if not len(parts):
        return []
    x = nnls(parts, times, h, 1 / np.sqrt(np.maximum(h, 1)))  # a miss counts against the length's own number
    left = h.astype(np.int64)
    runs, sequence = [], 0
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        own = [(int(p), int(m)) for p, m in zip(parts[k], times[k], strict=True) if p]
        n = int(min(np.ceil(x[k] - 1e-9), *(left[p] // m for p, m in own), left[own[0][0]]))
        if n <= 0:
            continue
        place = 0
        for part, m in own:
            first = int(h[part] - left[part])
            runs.append((part, first, first + m * n - 1, sequence, place, n))
            left[part] -= m * n
            place += m
        sequence += n
    return runs


def ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with rank: 0, 1, ... within each group, in hashed parts of the key."""
    parts = max(64, partitions(rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    counts = counts.select(group, "part", (F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(group, "part").orderBy(key)))
    return numbered.join(counts, [group, "part"]).withColumn("rank", F.col("before") + F.col("place_") - 1).drop("part", "place_", "before")


def running(rows: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with before: the sum of the sizes of all rows before it, in hashed parts of the key."""
    parts = max(64, 4 * partitions(rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("part").agg(F.sum(size).alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    inner = dealt.withColumn("inner", F.sum(size).over(Window.partitionBy("part").orderBy(key)) - F.col(size))
    return inner.join(sums, "part").withColumn("before", F.col("base") + F.col("inner")).drop("part", "base", "inner")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, grid: int = GRID, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their places: ``PIECE`` columns."""
    rows = stored(token_rows(docs, vocabulary, window, end_id), "packing-tokens")
    bins = window // grid
    rest = rows.filter(F.length("ids") > 0).select("row", (F.length("ids") / 4).cast("long").alias("length"))
    rest = rest.withColumn("bin", F.ceil(F.col("length") / F.lit(grid)).cast("int"))
    histogram = {r["bin"]: r["count"] for r in rest.groupBy("bin").count().collect()}  # at most window / grid rows
    runs = plan(histogram, bins)
    spark = docs.sparkSession
    # one row for each length and combination in use: bounded by the grid, not by the documents
    ways = spark.createDataFrame(runs, "bin int, first long, last long, sequence long, place int, n long")
    rank = ranked(rest, "bin", "row")
    match = (rank["bin"] == ways["bin"]) & F.col("rank").between(F.col("first"), F.col("last"))
    behind = F.col("rank") - F.col("first")
    placed = rank.join(F.broadcast(ways), match, "left").select("row", "length", (F.col("sequence") + behind % F.col("n")).alias("s"), (F.col("place") + F.floor(behind / F.col("n"))).alias("place"))
    placed = stored(placed, "packing-placed")
    filled = placed.filter("s is not null")
    by_sequence = Window.partitionBy("s").orderBy("place")
    filled = filled.select("row", "length", "s", (F.sum("length").over(by_sequence) - F.col("length")).alias("o"))
    base = max((r[3] + r[5] for r in runs), default=0)
    loose = running(placed.filter("s is null").select("row", "length"), "row", "length")
    loose = loose.select("row", "length", (F.lit(base) + F.floor(F.col("before") / window)).cast("long").alias("s"), (F.col("before") % window).alias("o"))
    spots = stored(filled.select("row", "s", "o").union(loose.select("row", "s", "o")), "packing-spots")
    tokens = placed.filter("s is null").agg(F.sum("length")).first()[0] or 0
    whole_base = base + -(-tokens // window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, ids, s, o in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                size = len(ids) // 4
                first = min(size, window - o)
                for at, length in ((0, first), (first, size - first)):
                    if length:
                        out.append((doc_id, n - size + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, s + (at > 0), o if at == 0 else 0))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in PIECE.split(", ")])

    pieces = rows.select("row", "doc_id", "doc_tokens", "ids").join(spots, "row").select("doc_id", "doc_tokens", "ids", "s", "o").mapInArrow(cut, PIECE)
    whole = rows.filter(F.size("full_crc") > 0).select("row", "doc_id", "doc_tokens", "full_crc", F.size("full_crc").cast("long").alias("n"))
    whole = running(whole, "row", "n").select("doc_id", "doc_tokens", "before", F.posexplode("full_crc").alias("k", "crc"))
    whole = whole.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.lit(whole_base) + F.col("before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.unionByName(whole)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
