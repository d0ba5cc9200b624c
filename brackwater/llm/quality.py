"""Quality classifier from weak labels: heuristic labellers, EM, and a hashed linear scorer.

Labellers look at a text's measurements and vote good, bad or nothing. The votes of a row are one
pattern; the patterns are counted over all rows, and expectation-maximisation on those counts
estimates how often each labeller, when it votes, is right about good and about bad texts. The posterior of a row's
pattern is its training label: no given label is used. A linear scorer over hashed features
(words, endings, shapes, and how much a text repeats itself) learns the posteriors, so that it
also judges texts on which the labellers are silent or at odds.

The scorer is fitted on a bounded sample: at most ``sample`` rows on each side of a posterior of
one half, those with the smallest hash. Everything else covers all rows and whole texts.

Defined results: null and blank texts have no features and get the score of the offset alone;
repeated rows get equal scores; null doc_ids are kept; a text of any length is judged whole; with all votes alike the model is constant
and keeps what the prior keeps; further columns are ignored (``with_quality`` passes them on); an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm.common import by_bytes, kept, stored, table

BITS = 18
SAMPLE = 3000
KEEP = 0.3
GOOD, BAD, NONE = 2, 1, 0
WINDOW = 5
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Labeller -> (votes bad when, votes good when), on the measurements of texts.
LABELLERS: dict[str, tuple[Callable, Callable]] = {
    "symbols": (lambda m: 4 * m.n_symbols > m.n_words, lambda m: (m.n_symbols == 0) & (m.n_words >= 20)),
    "capitals": (lambda m: (2 * m.n_upper > m.word_chars) & (m.n_words >= 10), lambda m: (10 * m.n_upper < m.word_chars) & (m.n_words >= 20)),
    "exclamations": (lambda m: 4 * m.n_marks > m.n_words, lambda m: (m.n_marks == 0) & (m.n_words >= 20)),
    "repetition": (lambda m: (100 * m.n_repeat_words > 60 * m.n_words) & (m.n_words >= 30), lambda m: (100 * m.n_repeat_words < 10 * m.n_words) & (m.n_words >= 20)),
    "variety": (lambda m: (10 * m.n_distinct_words < 3 * m.n_words) & (m.n_words >= 30), lambda m: (10 * m.n_distinct_words > 5 * m.n_words) & (m.n_words >= 20)),
    "lines": (lambda m: (10 * m.n_dup_lines > 4 * m.n_lines) & (m.n_lines >= 4), lambda m: (m.n_dup_lines == 0) & (m.n_lines >= 3)),
    "word_length": (lambda m: (m.word_chars > 7 * m.n_words) & (m.n_words >= 10), lambda m: (m.word_chars >= 4 * m.n_words) & (m.word_chars <= 6 * m.n_words) & (m.n_words >= 20)),
}


class Measured:
    """Measurements of a batch of whole texts, all texts at a time; each is worked out when asked for.

    Words are runs of bytes other than white space; ``code`` numbers the distinct ones of the
    batch, whose strings are ``kinds``; ``text`` is the text of each word.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.space = SPACES[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.begins] = True
        self.first = np.flatnonzero(~self.space & (np.r_[True, self.space[:-1]] | edge[:-1])) if len(self.data) else np.zeros(0, np.int64)
        self.last_word = np.searchsorted(self.first, self.ends)
        self.n_words = np.diff(np.r_[0, self.last_word])
        self.text = np.repeat(np.arange(len(sizes)), self.n_words)
        left = np.cumsum(~self.space)
        offsets = np.r_[left[self.first] - 1, left[-1] if len(left) else 0].astype(np.int32)
        words = pa.StringArray.from_buffers(len(self.first), pa.py_buffer(offsets), pa.py_buffer(self.data[~self.space])).dictionary_encode()
        self.kinds, self.code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def _bytes(self, mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[self.ends] - total[self.begins]

    def _distinct(self, key: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many different keys each text has; a key names its text too."""
        by = np.argsort(key)
        new = np.r_[True, key[by][1:] != key[by][:-1]] if len(by) else np.zeros(0, bool)
        return np.bincount(text[by][new], minlength=len(self.ends))

    def _grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each place of a text on, with the text; and those places."""
        at = np.flatnonzero(self.text[: max(len(self.text) - n + 1, 0)] == self.text[n - 1 :]) if len(self.text) >= n else np.zeros(0, np.int64)
        h = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for x in (self.text[at], *(self.code[at + k] for k in range(n))):
                h = (h ^ (x + 1).astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
        return h, at

    word_chars = property(lambda self: self._bytes(~self.space & ((self.data & 0xC0) != 0x80)))
    n_symbols = property(lambda self: self._bytes(SYMBOLS[self.data]))
    n_marks = property(lambda self: self._bytes(self.data == 33))
    n_distinct_words = property(lambda self: self._distinct(self.text << 32 | self.code, self.text))
    n_pairs = property(lambda self: self._distinct((g := self._grams(2))[0], self.text[g[1]]))
    n_followed = property(lambda self: np.bincount(self.text[1:][(self.code[1:] == self.code[:-1]) & (self.text[1:] == self.text[:-1])], minlength=len(self.ends)))

    @property
    def n_upper(self) -> np.ndarray:
        """ASCII and Latin-1 capitals."""
        wide = (self.data >= 0x80) & (self.data <= 0x9E) & (self.data != 0x97) & (np.r_[np.uint8(0), self.data[:-1]][: len(self.data)] == 0xC3)
        return self._bytes((self.data >= 65) & (self.data <= 90) | wide)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words in a window of WINDOW words that the text has twice or more."""
        h, at = self._grams(WINDOW)
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[by[1:][same]] = twice[by[:-1][same]] = True
        change = np.zeros(len(self.text) + 1, dtype=np.int32)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + WINDOW, -1)
        return np.bincount(self.text[np.cumsum(change[:-1]) > 0], minlength=len(self.ends))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word: how many each text has, and how many of them are equal to an earlier one."""
        breaks = np.flatnonzero(self.data == 10)
        cuts = np.union1d(np.r_[breaks, breaks + 1], np.r_[self.begins, self.ends])
        if len(cuts) < 2:
            return np.zeros(len(self.ends), np.int64), np.zeros(len(self.ends), np.int64)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(self.data))
        code = parts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.diff(np.searchsorted(self.first, cuts)) > 0
        text = np.searchsorted(self.ends, cuts[:-1], side="right")
        n = np.bincount(text[word], minlength=len(self.ends))
        return n, n - self._distinct((text << 32 | code)[word], text[word])

    def votes(self) -> np.ndarray:
        """Each text's votes as a number with a digit to base 3 for each labeller."""
        self.n_lines, self.n_dup_lines = self.lines
        m = Frozen(self)
        pattern = np.zeros(len(self.ends), dtype=np.int32)
        for place, (bad, good) in enumerate(LABELLERS.values()):
            pattern += np.where(bad(m), BAD, np.where(good(m), GOOD, NONE)).astype(np.int32) * 3**place
        return pattern


class Frozen:
    """The measurements that the labellers use, worked out once."""

    NAMES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_repeat_words", "n_distinct_words", "n_dup_lines", "n_lines")

    def __init__(self, of: Measured):
        for name in self.NAMES:
            setattr(self, name, getattr(of, name))


def votes(rows: DataFrame) -> DataFrame:
    """(doc_id, key, pattern) of every row of ``rows`` (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_bytes(b, 2)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(Measured(batch.column(2)).votes())], ["doc_id", "key", "pattern"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, pattern int")


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The probability of good for each pattern, by EM on the patterns' counts.

    Bad texts are of several kinds and most labellers find nothing wrong with most of them, so
    there is a latent class for good texts and one for the kind of bad text that each labeller
    looks for. A class has an accuracy for each labeller, among the votes that it casts.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns], dtype=float)
    digits = np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], axis=1)
    against = (digits == BAD).astype(float)
    share = np.concatenate([np.where(against.any(axis=1), 0.05, 0.95)[:, None], against + 0.005], axis=1)
    share /= share.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        logs = []
        for p in share.T:
            log = np.full(len(n), np.log(((n * p).sum() + 1) / (n.sum() + share.shape[1])))
            for k in range(len(LABELLERS)):  # silence tells nothing
                seen = np.bincount(digits[:, k], weights=n * p, minlength=3)[1:] + 0.5
                log += np.r_[0.0, np.log(seen / seen.sum())][digits[:, k]]
            logs.append(log)
        new = np.exp(np.stack(logs, axis=1) - np.max(logs, axis=0)[:, None])
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    return dict(zip(patterns.tolist(), share[:, 0].tolist(), strict=True))


_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - BITS)


def word_features(word: str) -> list[int]:
    """Slots of a word: itself, its ending, its shape and its length."""
    if word.isalpha() and word.islower():
        shape = "a"
    else:
        letters = _RUNS[0].sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
        shape = _RUNS[1].sub("9", letters)[:12]
    return [slot("w" + word.lower()), slot("e" + word[-3:]), slot("s" + shape), slot(f"l{min(len(word), 20)}")]


@lru_cache(maxsize=1)
def text_slots() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of how varied a text's words (by its size) and word pairs are, and how often a word
    follows itself, in tenths."""
    return np.array([[slot(f"v{size}:{k}") for k in range(11)] for size in range(6)]), np.array([slot(f"p{k}") for k in range(11)]), np.array([slot(f"r{k}") for k in range(11)])


def text_features(m: Measured) -> np.ndarray:
    """Three slots of each text as a whole."""
    n = np.maximum(m.n_words, 1)
    size = np.minimum(np.ceil(np.log2(n + 1)).astype(int), 5)
    v, p, r = text_slots()
    pairs = np.where(m.n_words > 1, m.n_pairs, n)
    return np.stack([v[size, 10 * m.n_distinct_words // n], p[10 * pairs // n], r[10 * m.n_followed // n]], axis=1)


WEIGHT = 10.0  # of the mean over a text's words; a feature of the whole text counts one


def sample_features(sample: DataFrame) -> pa.Table:
    """(pattern, slots, values) of the sampled rows, counted by whole texts on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_bytes(b, 1)):
            m = Measured(batch.column(1))
            of_word = list(map(word_features, m.kinds.to_pylist()))
            whole = text_features(m).tolist()
            slots, values = [], []
            for i, (z, n) in enumerate(zip(m.last_word.tolist(), m.n_words.tolist(), strict=True)):
                x: Counter = Counter()
                for k in m.code[z - n : z].tolist():
                    for f in of_word[k]:
                        x[f] += WEIGHT / n
                if n:
                    x.update(whole[i])
                slots.append(list(x.keys()))
                values.append(list(x.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["pattern", "slots", "values"])

    return sample.select("pattern", "text").mapInArrow(run, "pattern int, slots array<int>, values array<float>").toArrow()


def fit(found: pa.Table, good: dict[int, float], rounds: int = 60, rate: float = 0.5, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and offset of the scorer, by adaptive gradient steps on the posteriors."""
    weights, offset = np.zeros(1 << BITS), 0.0
    y = np.array([good[p] for p in found.column("pattern").to_pylist()])
    if not len(y):
        return weights, 1.0
    sizes = found.column("slots").combine_chunks().value_lengths().to_numpy()
    at = found.column("slots").combine_chunks().flatten().to_numpy()
    x = found.column("values").combine_chunks().flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), sizes)
    side = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    used, at = np.unique(at, return_inverse=True)
    w, past, bias_past = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * w[at], minlength=len(y)) + offset, -30, 30)))
        error = side * (p - y)
        step = np.bincount(at, weights=x * error[row], minlength=len(used)) + shrink * w
        past += step**2
        bias_past += error.sum() ** 2
        w -= rate * step / np.sqrt(past)
        offset -= rate * error.sum() / np.sqrt(bias_past)
    weights[used] = w
    return weights, float(offset)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): rows with one key are equal in both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float], tuple[np.ndarray, float]]:
    """The rows' votes, the patterns' posteriors and the scorer."""
    rows = keyed(docs)
    voted = stored(votes(rows), "quality-votes")
    # at most 3 to the number of labellers patterns reach the driver
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    good = posteriors(counts)
    sides = [[p for p, g in good.items() if (g >= 0.5) == side] for side in (True, False)]
    least = [voted.filter(F.col("pattern").isin(of)).groupBy("key").agg(F.min("pattern").alias("pattern")).orderBy("key").limit(sample) for of in sides]
    # at most ``sample`` rows a side are broadcast
    chosen = rows.join(F.broadcast(least[0].union(least[1])), "key").dropDuplicates(["key"])
    return voted, good, fit(sample_features(chosen), good)


def known_words(model: str) -> dict[str, float]:
    """The sums of words' weights that a Python worker has met, for one model."""
    return kept(f"words:{model}", dict)


def with_quality(docs: DataFrame, scorer: tuple[np.ndarray, float], column: str = "quality_score") -> DataFrame:
    """``docs`` with the scorer's probability of good, from the whole text of each row."""
    held = docs.sparkSession.sparkContext.broadcast((scorer[0].astype(np.float32), scorer[1]))
    name = f"{zlib.crc32(scorer[0].tobytes())}:{scorer[1]}"
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = held.value
        listed, known = weights.tolist(), known_words(name)
        for batch in (s for b in batches for s in by_bytes(b, place)):
            if len(known) > 200_000:
                known.clear()
            m = Measured(batch.column(place))
            words = m.kinds.to_numpy(zero_copy_only=False).tolist()
            for w in words:
                if w not in known:
                    a, b, c, d = word_features(w)
                    known[w] = listed[a] + listed[b] + listed[c] + listed[d]
            value = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
            sums = np.bincount(m.text, weights=value[m.code], minlength=len(m.ends))
            whole = np.where(m.n_words > 0, weights[text_features(m)].sum(axis=1), 0.0)
            score = 1 / (1 + np.exp(-np.clip(offset + WEIGHT * sums / np.maximum(m.n_words, 1) + whole, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema=pa.schema([*batch.schema, pa.field(column, pa.float64())]))

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, kept) for every row of ``docs``."""
    voted, good, scorer = train(docs, sample)
    scored = with_quality(keyed(docs), scorer, "score").select("doc_id", "key", "score")
    pairs = [F.lit(x) for p, g in good.items() for x in (p, g)]
    posterior = F.create_map(*pairs)[F.col("pattern")] if pairs else F.lit(None).cast("double")
    by_key = voted.groupBy("key").agg(F.min("pattern").alias("pattern"))
    return scored.join(by_key, "key").select("doc_id", posterior.alias("posterior"), "score", (F.col("score") >= KEEP).alias("kept"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
