"""Repeated substrings across documents, by column-wise multi-string BWT construction.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document
with a smaller doc_id. Strings that are equal have the same smallest k-gram hash (their anchor)
at the same place, so they need only be sorted among the strings with that anchor:

1. documents are dealt into chunks by hash of the text; a task sends a text once, and of further
   copies only a smaller doc_id, so equal texts are one text (their copies are removed whole);
2. a chunk sends the anchors that it has, each once,
   to buckets of the anchor's hash, which send back one bit for each: is it elsewhere too?
3. for the anchors that are, the chunk sends the pieces of text around them, each once, with the
   smallest and the largest doc_id that has it;
4. a bucket builds the order of all its pieces' suffixes column by column: each round puts one
   more symbol in front of every piece's suffix. The symbols, read in the order of the last
   round, are a column of the Burrows-Wheeler transform; a stable distribution of that column is
   the next order, and common prefixes follow from range minima between equal symbols. All
   passes go through the arrays from start to end. Runs with a common prefix of ``length`` are
   equal strings, and get the smallest doc_id of the run;
5. the chunk covers its texts with the strings that start in a smaller doc_id.

The rounds' files are arrays of a bucket, which is bounded by the number of buckets, since
executors have no folders of their own. Anchors and pieces are gathered by chunk before they
are sent, so what lies well inside a passage that many documents share is sent once by each
chunk. Pieces at its edges (18 bytes from its start, 50 from its end) hold the documents' own
text and differ; they would all go to the bucket of their anchor. So chunks tell how often they
have an anchor, and around one that is too frequent in all (``HOT``) they send every string of
``length`` bytes by itself, padded to a piece, to the bucket of the string's own hash.

Defined results: a null text is an empty one; a text of any length is one text of its chunk; texts shorter than ``length`` lose nothing; rows
with equal doc_ids never take from each other; rows with a null doc_id come after all others;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import forget, fresh, partitions, table

LENGTH = 50
GRAM = 32
CHUNK_BYTES = 2 << 20
HOT = 2000  # occurrences of an anchor whose pieces are dealt by string
PAD = 0xFF  # in no UTF-8 text
LAST = (1 << 63) - 1
_P = 0x9E3779B97F4A7C15


# --- anchors of texts


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k bytes from each position on."""
    have, size = {1: buf.astype(np.uint64) + np.uint64(1)}, 1
    while size * 2 <= k:
        wide = have[size] * np.uint64(pow(_P, size, 1 << 64))
        wide[:-size] += have[size][size:]
        size *= 2
        have[size] = wide
    out, got = have[size], size
    for s in sorted(have, reverse=True):
        while k - got >= s:
            out = out * np.uint64(pow(_P, s, 1 << 64))
            out[:-got] += have[s][got:]
            got += s
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over the w values from each position on (fewer at the end)."""
    out, s = a, 1
    while s < w:
        step = min(s, w - s)
        new = out.copy()
        f(out[:-step], out[step:], out=new[:-step])
        out, s = new, s + step
    return out


def anchors(texts: list[bytes], length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, position) of the k-grams with the least hash of some string of ``length``."""
    w = length - k + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    with np.errstate(over="ignore"):
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                size += len(texts[to])
                to += 1
            if size >= length:
                sizes = np.fromiter(map(len, texts[at:to]), dtype=np.int64, count=to - at)
                buf = np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8)
                number = np.repeat(np.arange(at, to), sizes)
                end = np.repeat(np.cumsum(sizes), sizes)
                place = np.arange(size)
                h = gram_hashes(buf, k)
                h[place + k > end] = np.uint64((1 << 64) - 1)
                least = sliding(h, w, np.minimum)
                least[place + length > end] = 0
                told = sliding(least[::-1], w, np.maximum)[::-1] == h
                p = np.flatnonzero(told & (place + k <= end))
                start = np.cumsum(sizes) - sizes
                found.append((h[p], number[p], p - start[number[p] - at]))
            at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _short(key: np.ndarray) -> bytes:
    """The lower four bytes of each key; the bucket tells more of it, the more buckets there are."""
    return np.ascontiguousarray((key & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes()


def piece_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    wide[:, :width] = rows
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in wide.view("<u8").T:
            h = (h ^ column) * np.uint64(_P)
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# --- the column-wise construction


def least_owners(pieces: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each piece (rows of bytes of one width) and each place where a string of ``length`` can
    start: the smallest owner among all pieces that have the same string at that place."""
    n, width = pieces.shape
    starts = width - length + 1
    out = np.full((n, starts), LAST, dtype=np.int64)
    columns = np.ascontiguousarray(pieces.T)
    order = np.arange(n)
    common = np.zeros(n, dtype=np.uint8)  # of a suffix and the one before it, up to length
    for place in range(width - 1, -1, -1):
        column = columns[place][order]  # the transform's column: what stands before each suffix
        by = np.argsort(column, kind="stable")
        fresh, ended = np.zeros(n, dtype=np.uint8), np.append(common, np.uint8(0))  # so that the last range has an end
        first = 0
        for symbol, count in zip(*np.unique(column, return_counts=True), strict=True):
            if count > 1:
                seen = by[first : first + count]
                fresh[first + 1 : first + count] = np.minimum.reduceat(ended, seen + 1)[:-1]
                fresh[first + 1 : first + count] = np.minimum(fresh[first + 1 : first + count] + 1, length) if symbol != PAD else 0
            first += count
        order, common = order[by], fresh
        if place < starts:
            runs = np.flatnonzero(common < length)
            low = np.minimum.reduceat(owner[order], runs)
            out[order, place] = np.repeat(low, np.diff(np.r_[runs, n]))
    pads = np.cumsum(np.pad(pieces == PAD, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    out[(pads[:, length:] - pads[:, :-length])[:, :starts] > 0] = LAST
    return out


# --- what chunks and buckets do


class Plan:
    """The number of buckets, and the lengths; what every task has to know."""

    def __init__(self, buckets: int, length: int = LENGTH, k: int = GRAM, hot: int = HOT):
        self.buckets, self.length, self.k, self.hot = buckets, length, k, hot
        self.left = length - k  # of the anchor, in a piece
        self.width = self.left + length

    def texts(self, docs: pa.Table) -> tuple[list[str], np.ndarray, list[bytes]]:
        """A chunk's distinct texts in the order of their hash, each with its smallest doc_id."""
        low: dict[str, int] = {}
        body: dict[str, bytes] = {}
        for name, doc, text in zip(*(docs[c].to_pylist() for c in ("h", "doc", "text")), strict=True):
            low[name] = min(doc, low.get(name, LAST))
            if text is not None:
                body[name] = text
        h = sorted(body)
        return h, np.array([low[x] for x in h], dtype=np.int64), [body[x] for x in h]

    def keys(self, docs: pa.Table):
        h, doc, texts = self.texts(docs)
        key, number, place = anchors(texts, self.length, self.k)
        # anchors are least hashes, and the buckets are ranges: mixed again they are even
        key = key * np.uint64(_P)
        key ^= key >> np.uint64(29)
        unique, inverse = np.unique(key, return_inverse=True)
        return h, doc, texts, key, number, place, unique, inverse

    def bounds(self, where: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The buckets that occur in ``where`` (sorted), and where each begins; the end at last."""
        new = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
        return where[new].tolist(), np.r_[new, len(where)]

    def pieces(self, docs: pa.Table, bits: pa.Table):
        """The pieces around anchors that are elsewhere too: (h, doc, texts, occurrence's text,
        place and piece, pieces, their bucket), pieces by bucket and hash."""
        h, doc, texts, key, number, place, unique, inverse = self.keys(docs)
        alive, hot = np.zeros(len(unique), dtype=bool), np.zeros(len(unique), dtype=bool)
        some, cut = self.bounds(bucket_of(unique, self.buckets))
        span = {b: slice(cut[i], cut[i + 1]) for i, b in enumerate(some)}
        for b, data in zip(bits["bucket"].to_pylist(), bits["data"].to_pylist(), strict=True):
            own = span[b]
            alive[own], hot[own] = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(2, -1), axis=1, count=own.stop - own.start)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        start = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        kept, split = (alive & ~hot)[inverse], (alive & hot)[inverse]
        # where strings of hot anchors start, each once
        begin = (start[number[split]] + place[split] - self.left)[:, None] + np.arange(self.left + 1)
        real = (begin >= start[number[split], None]) & (begin + self.length <= (start + sizes)[number[split], None])
        begin = np.unique(begin[real])
        of = np.searchsorted(start, begin, side="right") - 1 if len(begin) else begin
        whole = int(kept.sum())
        key, number, place = key[kept], np.r_[number[kept], of], np.r_[place[kept], begin - start[of] + self.left]
        # texts with pads between them: a piece that reaches over an end has pads there
        apart = np.full(int(sizes.sum()) + self.width * (len(texts) + 1), PAD, dtype=np.uint8)
        apart[np.arange(len(buf)) + np.repeat(self.width * np.arange(1, len(texts) + 1), sizes)] = buf
        first = start[number] + self.width * (number + 1) + place - self.left
        rows = np.lib.stride_tricks.sliding_window_view(apart, self.width)[first]
        rows[whole:, self.length :] = PAD
        name = piece_hashes(rows)
        where = bucket_of(np.r_[key, name[whole:]], self.buckets)
        order = np.lexsort((name, where))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (name[order][1:] != name[order][:-1]) | (where[order][1:] != where[order][:-1])
        piece = np.empty(len(order), dtype=np.int64)
        piece[order] = np.cumsum(new) - 1
        one = order[new]
        return h, doc, texts, number, place, piece, rows[one], where[one]

    # each of these takes and gives Arrow tables

    def send_keys(self, docs: pa.Table) -> pa.Table:
        _, doc, _, _, number, _, unique, inverse = self.keys(docs)
        # the binary digits of the occurrences, and 128 where they are in several texts
        many = np.zeros(len(unique), dtype=np.uint8)
        if len(unique):
            low, high = np.full(len(unique), LAST), np.zeros(len(unique), dtype=np.int64)
            np.minimum.at(low, inverse, number)
            np.maximum.at(high, inverse, number)
            digits = np.ceil(np.log2(np.bincount(inverse, minlength=len(unique)) + 1)).astype(np.uint8)
            many = digits | np.where(low < high, 128, 0).astype(np.uint8)
        some, cut = self.bounds(bucket_of(unique, self.buckets))
        spans = [slice(a, z) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        chunk = docs["chunk"][0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()), "data": pa.array([_short(unique[x]) for x in spans], pa.binary()), "many": pa.array([many[x].tobytes() for x in spans], pa.binary())})

    def answer_keys(self, sent: pa.Table) -> pa.Table:
        keys = [np.frombuffer(d, dtype="<u4") for d in sent["data"].to_pylist()]
        many = np.concatenate([np.frombuffer(m, dtype=np.uint8) for m in sent["many"].to_pylist()])
        inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)[1:]
        alive = (count[inverse] > 1) | (many >= 128)
        hot = np.bincount(inverse, weights=np.exp2(many & 127))[inverse] > self.hot  # at most twice the occurrences
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"chunk": sent["chunk"], "bucket": sent["bucket"], "kind": pa.array([0] * len(keys), pa.int32()), "data": pa.array([np.packbits(a).tobytes() + np.packbits(h).tobytes() for a, h in zip(np.split(alive, ends), np.split(hot, ends), strict=True)], pa.binary())})

    def send_pieces(self, docs: pa.Table, bits: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"bucket": [], "data": [], "low": [], "high": []}
        if docs.num_rows:
            _, doc, _, number, _, piece, rows, where = self.pieces(docs, bits)
            low, high = np.full(len(rows), LAST, dtype=np.int64), np.full(len(rows), -LAST, dtype=np.int64)
            np.minimum.at(low, piece, doc[number])
            np.maximum.at(high, piece, doc[number])
            some, cut = self.bounds(where)
            for b, a, z in zip(some, cut[:-1], cut[1:], strict=True):
                for c, x in zip(cols, (b, rows[a:z].tobytes(), low[a:z].tobytes(), high[a:z].tobytes()), strict=True):
                    cols[c].append(x)
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return pa.table({"bucket": pa.array(cols["bucket"], pa.int32()), "chunk": pa.array([chunk] * len(cols["bucket"]), pa.int32()), **{c: pa.array(cols[c], pa.binary()) for c in ("data", "low", "high")}})

    def answer_pieces(self, sent: pa.Table) -> pa.Table:
        """Runs (piece of the chunk, first and last start, smallest doc) that some document loses by."""
        blocks = [np.frombuffer(d, dtype=np.uint8).reshape(-1, self.width) for d in sent["data"].to_pylist()]
        rows = np.concatenate(blocks)
        low, high = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in sent[c].to_pylist()]) for c in ("low", "high"))
        name = piece_hashes(rows)
        first, inverse = np.unique(name, return_index=True, return_inverse=True)[1:]
        owner = np.full(len(first), LAST, dtype=np.int64)
        np.minimum.at(owner, inverse, low)
        least = least_owners(rows[first], owner, self.length)
        ends = np.cumsum([0, *(len(b) for b in blocks)])
        out = []
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            mine = least[inverse[a:z]]
            hit = mine < high[a:z, None]
            new = hit.copy()
            new[:, 1:] &= ~hit[:, :-1] | (mine[:, 1:] != mine[:, :-1])
            last = hit.copy()
            last[:, :-1] &= ~hit[:, 1:] | (mine[:, 1:] != mine[:, :-1])
            idx, begin = np.nonzero(new)
            out.append(np.concatenate([idx.astype("<i4").view(np.uint8), begin.astype(np.uint8), np.nonzero(last)[1].astype(np.uint8), mine[new].astype("<i8").view(np.uint8)]).tobytes())
        return pa.table({"chunk": sent["chunk"], "bucket": sent["bucket"], "kind": pa.array([1] * len(blocks), pa.int32()), "data": pa.array(out, pa.binary())})

    def cover(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["h", "n_removed", "kept_sha256", "spans"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        if not docs.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        kind = answers["kind"].to_numpy()
        bits, runs = answers.filter(pa.array(kind == 0)), answers.filter(pa.array(kind == 1))
        h, doc, texts, number, place, piece, rows, where = self.pieces(docs, bits)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        start = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
        by = np.argsort(piece, kind="stable")
        first = np.searchsorted(piece[by], np.arange(len(rows) + 1))
        cut = dict(zip(*(x if isinstance(x, list) else x.tolist() for x in self.bounds(where)), strict=False))
        for b, data in zip(runs["bucket"].to_pylist(), runs["data"].to_pylist(), strict=True):
            n = len(data) // 14
            raw = np.frombuffer(data, dtype=np.uint8)
            idx = raw[: 4 * n].view("<i4").astype(np.int64) + cut[b]
            begin, end, low = raw[4 * n : 5 * n].astype(np.int64), raw[5 * n : 6 * n].astype(np.int64), raw[6 * n :].copy().view("<i8")
            times = first[idx + 1] - first[idx]
            run = np.repeat(np.arange(n), times)
            at = by[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[idx], times)]
            lost = doc[number[at]] > low[run]
            at, run = at[lost], run[lost]
            base = start[number[at]] + place[at] - self.left
            np.add.at(change, base + begin[run], 1)
            np.add.at(change, base + end[run] + self.length, -1)
        gone = np.cumsum(change[:-1]) > 0
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        out: list[list] = [[], [], [], []]
        for i, name in enumerate(h):
            own = gone[start[i] : start[i] + sizes[i]]
            n = int(own.sum())
            spans = np.flatnonzero(np.diff(np.r_[False, own, False])) if n else np.zeros(0, np.int64)  # first, end, first, end ...
            sha = hashlib.sha256(buf[start[i] : start[i] + sizes[i]][~own].tobytes()).hexdigest() if n else name
            for c, x in zip(out, (name, n, sha, spans.astype(np.int32)), strict=True):
                c.append(x)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds, strict=True)})


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, h, doc, text) without the texts that the task has sent already; a copy is sent,
    without its text, where its doc is smaller than those before."""
    forget()
    seen: dict[bytes, int] = {}
    for batch in batches:
        new, lower = [], []
        for h, doc in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            name = bytes.fromhex(h)
            before = seen.get(name)
            new.append(before is None)
            lower.append(before is not None and doc < before)
            if before is None or doc < before:
                seen[name] = doc
        yield batch.filter(pa.array(new))
        if any(lower):
            less = batch.filter(pa.array(lower))
            yield pa.RecordBatch.from_arrays([*less.columns[:3], pa.nulls(less.num_rows, less.schema.field(3).type)], schema=less.schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte and
    end of each removed run, in turn); columns of these names are replaced."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    h, doc, body, first = (fresh(docs, x) for x in ("h", "doc", "body", "first"))
    base = docs.withColumn(body, F.coalesce("text", F.lit("")).cast("binary"))
    base = base.withColumns({h: F.sha2(body, 256), doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "n_bytes": F.length(body).cast("long")})
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(partitions(docs), -(-int(total) // CHUNK_BYTES))
    plan = Plan(chunks, length, k, hot)
    chunk = F.pmod(F.xxhash64(h), F.lit(chunks)).cast("int").alias("chunk")
    texts = base.select(chunk, F.col(h).alias("h"), F.col(doc).alias("doc"), F.col(body).alias("text")).mapInArrow(once, "chunk int, h string, doc long, text binary")
    by_chunk = texts.groupBy("chunk")
    keys = by_chunk.applyInArrow(lambda t: plan.send_keys(t), "bucket int, chunk int, data binary, many binary")
    bits = keys.groupBy("bucket").applyInArrow(lambda t: plan.answer_keys(t), "chunk int, bucket int, kind int, data binary")
    pieces = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(lambda a, b: plan.send_pieces(a, b), "bucket int, chunk int, data binary, low binary, high binary")
    runs = pieces.groupBy("bucket").applyInArrow(lambda t: plan.answer_pieces(t), "chunk int, bucket int, kind int, data binary")
    answers = bits.unionByName(runs)
    covered = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: plan.cover(a, b), "h string, n_removed long, kept_sha256 string, spans array<int>")
    firsts = base.groupBy(F.col(h).alias("h")).agg(F.min(doc).alias(first))
    found = covered.join(firsts, "h").withColumnRenamed("h", fresh(docs, "h", "found"))
    out = base.drop(body).join(found, F.col(h) == F.col(found.columns[0]))
    copy = (F.col(doc) > F.col(first)) & (F.col("n_bytes") >= length)
    none = hashlib.sha256(b"").hexdigest()
    out = out.withColumns({"n_removed": F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")), "kept_sha256": F.when(copy, F.lit(none)).otherwise(F.col("kept_sha256")), "spans": F.when(copy, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.col("spans"))})
    return out.withColumn("n_spans", F.expr("cast(size(spans) div 2 as long)")).select(*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def without_spans(text, spans):
    """What is left of ``text`` (a string column) without the bytes of ``spans``; a character that a cut splits
    becomes a replacement character."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    ends = F.concat(F.array(F.lit(0)), spans, F.array(F.length(body)))
    part = lambda i: F.substring(body, F.get(ends, 2 * i) + 1, F.get(ends, 2 * i + 1) - F.get(ends, 2 * i)).cast("string")
    return F.make_valid_utf8(F.array_join(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int")), part), ""))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by SQL over every 50-byte string, in hexadecimal digits; texts are cut into stretches first.
OP3_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, length(x) // 2 AS n FROM d),
stretch AS (SELECT r, doc_id, k, substr(x, 2 * k + 1, 1098) AS y FROM (SELECT r, doc_id, x, unnest(range(0, n - 49, 500)) AS k FROM n)),
w AS (SELECT r, doc_id, k + j AS i, substr(y, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, length(y) // 2 - 49)) AS j FROM stretch)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN f USING (s) WHERE first < doc_id),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, g),
cuts AS (SELECT r, a, b FROM runs UNION ALL SELECT r, n, n FROM n),
kept AS (SELECT r, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a, b) AS x FROM (SELECT r, x, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS p FROM cuts JOIN d USING (r)) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, n.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM n JOIN kept USING (r) LEFT JOIN sums USING (r)"""
