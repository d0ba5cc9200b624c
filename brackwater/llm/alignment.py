r"""Cross-tokenizer alignment: how the tokens of two vocabularies cover the same bytes.

Each text is encoded by A (over a space and the text) and by B (which puts the space itself). The
byte offsets where tokens of either end cut it into intervals; an interval lies in one token of A
and one of B, and each overlapping pair of tokens has one interval: the links. Offsets where both
end close a group.

An array from A's ids to the B id of the same bytes is computed beforehand. Groups of one token
each whose ids agree with it are counted in vectors of A's vocabulary length; only the links of
other groups become (A id, B id) pairs and are counted by a shuffle, pre-aggregated by task. Of the
pairs, those with more than a 2^17th of all pair links, at most 2^17, are looked up in an array too;
only links of rarer pairs are joined to their counts, so no join key holds more than that share.

Texts are encoded in segments, cut at single spaces between printable characters. No token of A or
B lies across such a cut (A's pattern starts anew at a space, and no piece of B has a space mark
after another character), so a segment's tokens don't depend on what is around it, and each worker
encodes a segment once for as long as it is remembered.

Defined results: null and empty texts, and texts whose joined token bytes of A or of B differ from
the space and the text, have zeros and an empty digest and give no links. Rows are told apart by a
stored number, so repeated rows and null doc_ids have a row each; further columns are ignored; an
empty table gives an empty result. A text of any length is encoded whole; one without a space
between words is one segment.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import by_bytes, kept, stored, table, tidy

#: A pair's key is its A id times this and its B id; both vocabularies are smaller than 2^16.
SHIFT = 1 << 16
HEAVY = 1 << 17
REMEMBERED = 24 << 20  # characters of segments and of their groups that a worker remembers
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
PLAIN = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.DOTALL)
ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and B's id of the same bytes for each of A's."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        back, n_a, n_b = byte_level(), self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) > SHIFT:
            raise ValueError("a vocabulary has more than 2^16 ids")
        self.bytes_a = [bytes(back.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(n_a)]
        piece = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        first: dict[bytes, int] = {}
        for i in sorted(range(n_b), key=lambda i: (self.b.is_byte(i), i)):  # a piece before a byte of the same bytes
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                first.setdefault(self.bytes_b[i], i)
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        coded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in coded], self.b.encode(texts, num_threads=1)

    def whole(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        """Whether either's joined bytes are the space and the text."""
        want = (" " + text).encode()
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == want == b"".join(map(self.bytes_b.__getitem__, ids_b))


def intervals(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, A id, B id, closes) of each interval; ``closes`` where tokens of both end."""
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, ids_a[at_a], ids_b[at_b], (ends_a[at_a] == ends) & (ends_b[at_b] == ends)


class Aligner:
    """What each segment gives: its counts, its groups as text and its links, remembered by segment."""

    CHUNK = 4096  # characters that are encoded at once

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.fresh: list[np.ndarray] = []  # (A tokens, B tokens, groups, links, whole) of each segment
        self.fresh_links: list[np.ndarray] = []
        self.counts, self.links, self.starts = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, segments: list[str]) -> None:
        """Encodes new segments: plain ones together, as no token lies across their cuts; others alone."""
        plain, chunk, room = [], [], 0
        chunks: list[list[str]] = []
        for s in segments:
            if PLAIN.match(s):
                chunk.append(s)
                room += len(s) + 1
                if room >= self.CHUNK:
                    plain.append(chunk)
                    chunk, room = [], 0
            else:
                chunks.append([s])
        chunks += [*plain, chunk] if chunk else plain
        for i in range(0, len(chunks), 64):
            part = chunks[i : i + 64]
            texts = [" ".join(c) for c in part]
            for c, text, ids_a, ids_b in zip(part, texts, *self.v.ids(texts), strict=True):
                self._add(c, text, ids_a, ids_b)
        if self.fresh:
            self.counts = np.concatenate([self.counts, *self.fresh])
            self.links = np.concatenate([self.links, *self.fresh_links])
            self.starts = np.r_[0, np.cumsum(self.counts[:, 3])]
            self.fresh, self.fresh_links = [], []

    def _add(self, segments: list[str], text: str, ids_a: list[int], ids_b: list[int]) -> None:
        whole = self.v.whole(text, ids_a, ids_b)
        if not whole:
            if len(segments) > 1:
                for s in segments:
                    self._add([s], s, *(x[0] for x in self.v.ids([s])))
                return
            counts, links, groups = np.zeros((1, 5), np.int64), np.zeros(0, np.int64), [""]
        else:
            counts, links, groups = self._cut(segments, np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64))
        self.known.update(zip(segments, range(len(self.groups), len(self.groups) + len(segments)), strict=True))
        self.groups += groups
        self.held += len(text) + sum(map(len, groups))
        self.fresh.append(counts)
        self.fresh_links.append(links)

    def _cut(self, segments: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Counts, links and groups of segments that were encoded together."""
        n = len(segments)
        last = np.cumsum([len(s.encode()) + 1 for s in segments])
        ends_a, ends_b = np.cumsum(self.v.size_a[ids_a]), np.cumsum(self.v.size_b[ids_b])
        ends, a, b, closes = intervals(ids_a, ids_b, ends_a, ends_b)
        of = np.searchsorted(last, ends)
        tokens = [np.bincount(np.searchsorted(last, x), minlength=n) for x in (ends_a, ends_b)]
        counts = np.stack([*tokens, np.bincount(of[closes], minlength=n), np.bincount(of, minlength=n), np.ones(n, np.int64)], axis=1)
        single = closes & np.r_[True, closes[:-1]]
        same = single & (self.v.same[a] == b)
        # a negative link is one of the identity map: less one, its A id
        links = np.where(same, -1 - a, a * SHIFT + b)
        closed = ends[closes]
        stop_a, stop_b = np.searchsorted(ends_a, closed) + 1, np.searchsorted(ends_b, closed) + 1
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, from_a, from_b, stop = [], 0, 0, 0
        to_a, to_b = stop_a.tolist(), stop_b.tolist()
        for until in np.cumsum(counts[:, 2]).tolist():
            parts = []
            for i in range(stop, until):
                x, y = to_a[i], to_b[i]
                parts.append(f"{text_a[from_a]}|{text_b[from_b]}" if x - from_a == y - from_b == 1 else f"{','.join(text_a[from_a:x])}|{','.join(text_b[from_b:y])}")
                from_a, from_b = x, y
            groups.append(";".join(parts))
            stop = until
        return counts, links, groups

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts of each text, digests, text, link, times) of all distinct links of each text."""
        if self.held > REMEMBERED:
            self.forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut], dtype=np.int64)
        flat = [s for c in cut for s in c]
        new = {s: None for s in flat if s not in self.known}
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        text = np.repeat(np.arange(len(texts)), sizes)
        found = self.counts[at]
        sums = np.stack([np.bincount(text, weights=found[:, i], minlength=len(texts)).astype(np.int64) for i in range(5)], axis=1) if len(flat) else np.zeros((len(texts), 5), np.int64)
        good = (sums[:, 4] == sizes) & (sizes > 0)
        sums[~good] = 0
        stops = np.cumsum(sizes)
        listed = at.tolist()
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, listed[z - n : z])).encode()).hexdigest() if ok else "" for ok, z, n in zip(good, stops.tolist(), sizes.tolist(), strict=True)]
        keep = good[text]
        at, text = at[keep], text[keep]
        n = self.counts[at, 3]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[at], n)
        # each distinct link of a text once: text and link in one number
        low = -SHIFT
        key = np.repeat(text, n) * (SHIFT * SHIFT + SHIFT) + (self.links[place] - low)
        key, times = np.unique(key, return_counts=True)
        return sums, digests, key // (SHIFT * SHIFT + SHIFT), key % (SHIFT * SHIFT + SHIFT) + low, times


def aligner(a: str, b: str) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return kept(f"aligner:{a}:{b}", lambda: Aligner(Vocabularies(a, b)))


def _lists(n: int, of: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    """Values in lists by the row that they are of, which is in order."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def encode_texts(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for whole in batches:
            for batch in by_bytes(whole, 2):
                n = batch.num_rows
                sums, digests, of, link, times = own.align([x or "" for x in batch.column(2).to_pylist()])
                same = link < 0
                columns = [batch.column(0), batch.column(1), *(pa.array(sums[:, i]) for i in range(4)), pa.array(digests, type=pa.string())]
                columns += [_lists(n, of[same], -1 - link[same], pa.int32()), _lists(n, of[same], times[same], pa.int32()), _lists(n, of[~same], link[~same], pa.int64()), _lists(n, of[~same], times[~same], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"])

    return run


def encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each text with its counts, its digest and its distinct links, stored: texts are encoded once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(encode_texts(a, b), ENCODED), "alignment-encoded")


def count_links(size: int):
    """Links by task: those of the identity map in a vector of ``size``, the others as sums of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size, np.int64)
        row = lambda same, key, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(key), same)), pa.array(key), pa.array(n)], names=["same", "link", "n"])
        for batch in batches:
            same, same_n, pairs, pairs_n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(4))
            np.add.at(vector, same, same_n)
            key, at = np.unique(pairs, return_inverse=True)
            yield row(False, key, np.bincount(at, weights=pairs_n, minlength=len(key)).astype(np.int64))
        used = np.flatnonzero(vector)
        yield row(True, used, vector[used])

    return run


def link_counts(texts: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(pair, a, b, n, best): how many links hold each pair of ids, and whether no other pair of the B id has more."""
    same = vocabularies.same
    sums = texts.select("same", "same_n", "pairs", "pairs_n").mapInArrow(count_links(len(same)), "same boolean, link long, n long").groupBy("same", "link").agg(F.sum("n").alias("n"))
    spark = texts.sparkSession
    # one row for each id of A: the vocabulary bounds it
    to_b = spark.createDataFrame([(i, int(x)) for i, x in enumerate(same.tolist()) if x >= 0], "link long, to_b long")
    mapped = sums.filter("same").join(F.broadcast(to_b), "link").select((F.col("link") * SHIFT + F.col("to_b")).alias("pair"), "n")
    pairs = stored(mapped.union(sums.filter("not same").select("link", "n")).groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    pairs = pairs.select("pair", F.expr(f"pair div {SHIFT}").alias("a"), F.expr(f"pair % {SHIFT}").alias("b"), "n")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of B
    return stored(pairs.join(F.broadcast(most), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-counts")


def looked_up(size: int, held):
    """(row, n_best, count_sum) over the links that the arrays hold; the others are left to the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_count, same_best, keys, counts, best = held.value
        for batch in batches:
            n = batch.num_rows
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, known in ((1, None), (3, keys)):
                lists, times = batch.column(i), batch.column(i + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                link = lists.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                if known is None:
                    many, top = same_count[link], same_best[link]
                else:
                    at = np.minimum(np.searchsorted(keys, link), max(len(keys) - 1, 0))
                    hit = keys[at] == link if len(keys) else np.zeros(len(link), bool)
                    of, times, at = of[hit], times[hit], at[hit]
                    many, top = counts[at], best[at]
                np.add.at(total, of, times * many)
                np.add.at(n_best, of, times * top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total)], names=["row", "n_best", "count_sum"])

    return run


def rare_links(held):
    """(row, pair, times) of the links that the arrays don't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value[2]
        for batch in batches:
            lists, link = batch.column(1), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(keys, link), max(len(keys) - 1, 0))
            rare = keys[at] != link if len(keys) else np.ones(len(link), bool)
            yield pa.RecordBatch.from_arrays([pa.array(row[rare]), pa.array(link[rare]), pa.array(batch.column(2).flatten().to_numpy(zero_copy_only=False)[rare])], names=["row", "pair", "times"])

    return run


def align(docs: DataFrame, a: str, b: str, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    ``heavy`` bounds how many pairs are looked up in an array; it makes no difference to the result.
    """
    spark, vocabularies = docs.sparkSession, Vocabularies(a, b)
    texts = encoded(docs, a, b)
    counts = link_counts(texts, vocabularies)
    size = len(vocabularies.same)
    same_count, same_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    total = counts.agg(F.sum("n")).first()[0] or 0
    to_b = spark.createDataFrame([(i * SHIFT + int(x),) for i, x in enumerate(vocabularies.same.tolist()) if x >= 0], "pair long")
    # at most the vocabulary's length of the one, and ``heavy`` of the other, as each has over a heavy-th of all links
    for pair, n, best in counts.join(F.broadcast(to_b), "pair").select("pair", "n", "best").toLocalIterator():
        same_count[pair // SHIFT], same_best[pair // SHIFT] = n, best
    top = sorted(counts.filter(F.col("n") * F.lit(heavy) > F.lit(total)).select("pair", "n", "best").collect())
    keys, many, best = (np.array([x[i] for x in top], dtype=np.int64) for i in range(3))
    held = spark.sparkContext.broadcast((same_count, same_best, keys, many, best))
    own = texts.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(looked_up(size, held), "row long, n_best long, count_sum long")
    rare = texts.select("row", "pairs", "pairs_n").mapInArrow(rare_links(held), "row long, pair long, times int")
    joined = rare.join(counts.select("pair", "n", "best"), "pair").select("row", F.when(F.col("best"), F.col("times").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = own.unionByName(joined).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").drop("row")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return tidy(lambda: align(docs, *paths), spark, "alignment")
