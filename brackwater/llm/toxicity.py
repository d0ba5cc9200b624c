"""Toxicity from two class-conditional Kneser-Ney models over the characters of words.

An expression is a character of a word with the five before it (word starts and ends are
characters too). For each class c the top order is

    P_c(x | h) = (max(C_c(h, x) - D, 0) + (D * N_c(h, .) + B) * Q(x | h')) / (C_c(h) + B)

and both classes back off to one shared Q, which is itself Kneser-Ney over continuation counts
(order 4, then order 2, then a uniform floor) of the two classes together. The B shared backoff
counts keep expressions that a class has seen once or twice near Q, so their likelihoods are nearly equal.

A toxic text is mostly ordinary words, so its model takes a word from the toxic class with
probability ``share`` and from the ordinary class else. The statistic is the length-normalised
difference of the two log-likelihoods, mean over words of log(1 - share + share * P_toxic(w) /
P_ordinary(w)), held back by some words of weight zero for very short texts: the many
words that are equally likely in both add nothing, however long the text.

A logistic curve of positive slope makes it a probability of label 1. It is fitted on fold 3 with
counts of folds 0 and 1; then the counts of fold 3 are added, so all labels that may be learnt
from are in the model. The tables hold every distinct expression and context of the labelled
words under its 64-bit hash, so the model grows with them and two of them share no count
(``bits`` under 64 would let them).

Defined results: null or blank texts score as a text with a statistic of zero; rows with a null
doc_id are scored and never learnt from; repeated labels of a doc_id count as toxic if one is;
null labels are left out; with no labels of a class the models are equal and every text gets the
base rate; a text of any length is scored whole; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import by_slices, stored, table

ORDER = 6
LENGTHS, CONTEXTS = (6, 4, 2), (5, 3, 1)
# cross-fitting in folds 0, 1 and 3 tells little between these and smaller ones; figures are in the README
BACKOFF = 5.0
SHARE = 0.003
BITS = 64  # of a hash by which expressions are told apart: all
LEAN = 20.0
LEAST_SLOPE = 0.05
WORD = re.compile(r"\w+")
START, END = 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def expressions(words: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For every character of every word (and its end): the word's number, and the hashes of the k
    characters that end there, for k in LENGTHS, and that end before it, at -k for k in CONTEXTS."""
    padded = "".join(f"{chr(START) * (ORDER - 1)}{w}{chr(END)}" for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    number = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDER - 1)
    of: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for k, skip in (*((k, 0) for k in LENGTHS), *((k, 1) for k in CONTEXTS)):  # the contexts end one before
            h = np.full(len(at), k, dtype=np.uint64)
            for back in range(k - 1 + skip, skip - 1, -1):
                h = (h ^ codes[at - back]) * _MIX
                h ^= h >> np.uint64(29)
            of[-k if skip else k] = h
    return number[at], of


COUNTS = ("toxic", "plain", "toxic_late", "plain_late")


def word_counts(train: DataFrame) -> DataFrame:
    """(word, COUNTS): occurrences in the texts of either class; ``train`` has text, toxic and late, which
    is 1 for the fold that is counted apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: list[Counter] = [Counter() for _ in COUNTS]

        def out() -> pa.RecordBatch:
            words = list(set().union(*tallies))
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([t[w] for w in words], pa.int64()) for t in tallies)], ["word", *COUNTS])
            for t in tallies:
                t.clear()
            return made

        for batch in (s for b in batches for s in by_slices()(b)):
            for text, toxic, late in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tallies[1 - toxic + 2 * late].update(words_of(text.as_py()))
            if sum(map(len, tallies)) > 200_000:
                yield out()
        yield out()

    parts = train.select("text", F.col("toxic").cast("int"), F.col("late").cast("int")).mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def expression_counts(words: DataFrame) -> DataFrame:
    """One row per distinct expression: its hash, those of its parts, and its counts."""
    names = ["top", "ctx", "h4", "c3", "h2", "c1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_slices(20_000)(b)):
            number, h = expressions(batch.column(0).to_pylist())
            first, inverse = np.unique(h[ORDER], return_index=True, return_inverse=True)[1:]
            sums = [np.bincount(inverse, weights=batch.column(c).to_numpy(zero_copy_only=False)[number], minlength=len(first)).astype(np.int64) for c in range(1, 5)]
            cols = [h[k][first].view(np.int64) for k in (ORDER, 1 - ORDER, 4, -3, 2, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, *sums)], [*names, *COUNTS])

    parts = words.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, *COUNTS]))
    return parts.groupBy("top").agg(*(F.min(n).alias(n) for n in names[1:]), *(F.sum(c).alias(c) for c in COUNTS))


class Table:
    """Sums by hash: the sorted hashes of one column, and a column of sums for each expression of ``sums``."""

    def __init__(self, df: DataFrame, key: str, bits: int, *sums):
        self.drop = np.uint64(64 - bits)
        got = df.groupBy(F.shiftrightunsigned(F.col(key), 64 - bits).alias("key")).agg(*(s.cast("float").alias(f"s{i}") for i, s in enumerate(sums))).toArrow()
        got = got.take(pc.sort_indices(got, [("key", "ascending")]))
        self.keys = got.column("key").to_numpy()
        # the last row stands for all that were never seen
        self.sums = [np.append(got.column(f"s{i}").to_numpy(), np.float32(0)) for i in range(len(sums))]

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of ``hashes``."""
        wanted, inverse = np.unique((hashes >> self.drop).view(np.int64), return_inverse=True)
        row = np.searchsorted(self.keys, wanted)
        if len(self.keys):
            row[self.keys[np.minimum(row, len(self.keys) - 1)] != wanted] = len(self.keys)
        return row[inverse]


class KneserNey:
    """Both models, as tables by hash, from expressions with counts toxic and plain; ``ratios`` scores words."""

    def __init__(self, grams: DataFrame, bits: int = BITS, discount: float = 0.75, backoff: float = BACKOFF):
        self.d, self.b = discount, backoff
        t, p = F.col("toxic"), F.col("plain")
        grams = grams.filter((t > 0) | (p > 0))
        self.top = Table(grams, "top", bits, F.sum(t), F.sum(p))
        self.ctx = Table(grams, "ctx", bits, F.sum(t), F.sum(p), F.count_if(t > 0), F.count_if(p > 0))
        fours = grams.groupBy("h4").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("c3", "h2", "c1")))
        twos = fours.groupBy("h2").agg(F.count("*").alias("n"), F.min("c1").alias("c1"))
        self.shared = [(Table(f, h, bits, F.sum("n")), Table(f, c, bits, F.sum("n"), F.count("*")), int(h[1])) for f, h, c in ((twos, "h2", "c1"), (fours, "h4", "c3"))]

    def __getstate__(self) -> bytes:
        """Tasks get the tables compressed."""
        return zlib.compress(pickle.dumps(self.__dict__), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P_toxic(w) - log P_ordinary(w) of each word."""
        number, h = expressions(words)
        q = np.full(len(number), 1 / 256, dtype=np.float64)
        for seen, over, k in self.shared:
            at = over.at(h[-(k - 1)])
            count, total, kinds = seen.sums[0][seen.at(h[k])], over.sums[0][at], over.sums[1][at]
            n = np.maximum(total, 1e-9)
            q = np.where(total > 0, np.minimum(np.maximum(count - self.d, 0) / n + self.d * kinds / n * q, 1.0), q)
        at, over = self.top.at(h[ORDER]), self.ctx.at(h[1 - ORDER])
        logs = [np.log((np.maximum(self.top.sums[c][at] - self.d, 0) + (self.d * self.ctx.sums[2 + c][over] + self.b) * q) / (self.ctx.sums[c][over] + self.b)) for c in (0, 1)]
        return np.bincount(number, weights=logs[0] - logs[1], minlength=len(words))


def statistics(docs: DataFrame, model: KneserNey, lean: float = LEAN, share: float = SHARE) -> DataFrame:
    """(doc_id, ratio): the length-normalised log-likelihood ratio of every whole text, by 100 words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in (s for b in batches for s in by_slices()(b)):
            texts = [words_of(t.as_py()) for t in batch.column(1)]
            new = list({w for ws in texts for w in ws if w not in known})
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                known.update(zip(part, np.log1p(share * np.expm1(np.minimum(held.value.ratios(part), 50.0))).tolist(), strict=True))
            ratios = [100 * sum(map(known.__getitem__, ws)) / (len(ws) + lean) for ws in texts]
            if len(known) > 400_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratios, pa.float64())], ["doc_id", "ratio"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ratio double")


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4


def _curve(found: list, base: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (bin, toxic, n) by Newton's method; the slope is
    LEAST_SLOPE at least, so that a higher ratio is never a lower score."""
    x, y, n = (np.array([r[i] for r in found], dtype=float) for i in range(3)) if found else np.zeros((3, 0))
    base = min(max(base, 1e-3), 1 - 1e-3)
    b = np.array([np.log(base / (1 - base)), 1.0])
    if 0 < y.sum() < n.sum():
        for free in (np.ones(2), np.array([1.0, 0.0])):  # the offset alone where the slope is held
            design = np.stack([np.ones_like(x), x], axis=1)
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
                grad = (design.T @ (y - n * p) - np.array([0.0, 1e-3]) * b) * free
                hess = (design * (n * p * (1 - p))[:, None]).T @ design * np.outer(free, free) + np.diag([1e-6, 1e-3 + 1 - free[1]])
                step = np.linalg.solve(hess, grad)
                b = b + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
            if b[1] >= LEAST_SLOPE:
                break
            b[1] = LEAST_SLOPE
    return float(b[1]), float(b[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, ratio) for every row of ``docs``.

    Of the folds of crc32(doc_id) mod 4, 2 is held out; see above for the others.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fit = known.filter(fold() != 2).withColumn("late", (fold() == 3).cast("int"))
    # the same plan at every size: both sides are shuffled, once; what is learnt from is stored
    train = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(fit.hint("merge"), "doc_id"), "toxicity-train")
    grams = stored(expression_counts(word_counts(train)), "toxicity-grams")
    late = statistics(train.filter("late = 1"), KneserNey(grams, bits)).join(fit, "doc_id")
    # at most 12,001 bins reach the driver
    bins = late.groupBy(F.round(F.least(F.greatest(F.col("ratio"), F.lit(-6.0)), F.lit(6.0)), 3).alias("x")).agg(F.sum("toxic"), F.count("*")).collect()
    rate = fit.agg(F.avg("toxic")).first()[0]
    slope, offset = _curve(bins, rate if rate is not None else 0.0)
    both = grams.withColumns({c: F.col(c) + F.col(f"{c}_late") for c in COUNTS[:2]})
    raw = statistics(docs, KneserNey(both, bits))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + F.lit(offset))))
    return raw.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "ratio")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
