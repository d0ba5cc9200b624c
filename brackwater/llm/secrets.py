r"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

Patterns (spans ``assign``, ``access`` and ``hex``) are matched from the left without overlap; matches
that are too short are dropped, and what they covered stays covered.

Every other run of 20 or more letters, digits and ``+ / _ -`` is a candidate, with up to two ``=`` after it. Its encoding is the
smallest alphabet that holds it (decimal, hexadecimal, letters, base 32, 36, 62, 64). The battery: a
chi-squared test that all symbols of the alphabet are equally frequent, a runs test of symbols in its
lower and upper half, and the correlation of each symbol with the next. A candidate passes when none
of the three rejects randomness; at 20 symbols most ordinary words pass too, so that isn't enough.

How far a candidate is from ordinary text is measured by the same chi-squared sum under the other
hypothesis: symbols drawn with the frequencies that the whole corpus has within that alphabet, of which
mean and variance follow from length, so a longer string gives stronger evidence. False discoveries
are controlled by the step-up procedure at 1 % in each class of length (a doubling) and encoding
separately: the many short candidates don't set the bar of long ones, nor the other way round. What is
discovered and passes the battery, and overlaps no span of a pattern, is a span ``random``.

Texts are read twice, for the corpus's frequencies and for the spans; the corpus gives one count for each byte value and one for each class and
twentieth of a decimal of p, so what the driver sees doesn't grow with the corpus.

Defined results: null and empty texts have no spans and the digest of the empty string; offsets count
code points, ends are exclusive; rows are told apart by themselves, so repeated rows and null doc_ids
have a row each; further columns are ignored; an empty table gives an empty result; texts of any
length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import by_bytes, stored, table, tidy

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by the size of their alphabets; the first that holds a string is its encoding.
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
#: Two-sided level of the whole battery; each test has a third of it.
BATTERY = 0.003
DISCOVERY = 0.01
BINS = 20  # of a decimal of p
MOST = 60 * BINS
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, starts array<int>, ends array<int>, encodings array<int>, sizes array<int>, chi array<double>, passed array<boolean>"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which alphabets hold each byte (as bits), and its place in each."""
    bits, place = np.zeros(256, np.int64), np.zeros((len(ALPHABETS), 256), np.int64)
    for k, letters in enumerate(ALPHABETS):
        for i, c in enumerate(letters):
            bits[ord(c)] |= 1 << k
            place[k, ord(c)] = i
    return bits, place


HOLDS, PLACE = _tables()


def tail(z: float) -> float:
    """The normal distribution's upper tail."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_moments(n: float, p: np.ndarray) -> tuple[float, float]:
    """Mean and variance of the chi-squared sum against equal frequencies, of n symbols drawn with frequencies p."""
    k, s2, s3 = len(p), float((p**2).sum()), float((p**3).sum())
    f2, f3 = n * (n - 1), n * (n - 1) * (n - 2)
    pairs = f3 * (n - 3) * s2**2 + 4 * f3 * s3 + 2 * f2 * s2 - (f2 * s2) ** 2
    return k * f2 * s2 / n + k - n, (k / n) ** 2 * max(pairs, 0.0)


def runs_z(high: np.ndarray) -> float:
    """Wald and Wolfowitz: runs of True and False against their expectation."""
    n, a = len(high), int(high.sum())
    b = n - a
    if not a or not b:
        return math.inf
    mean = 2 * a * b / n + 1
    spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return (1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread) if spread > 0 else math.inf


def serial_z(x: np.ndarray) -> float:
    """The correlation of each symbol with the next, in standard deviations."""
    n, centred = len(x), x - x.mean()
    total = float((centred**2).sum())
    return (float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n) if total > 0 else math.inf


def encoding(codes: np.ndarray) -> int:
    """The smallest alphabet that holds all symbols, -1 where none does."""
    held = int(np.bitwise_and.reduce(HOLDS[codes])) if len(codes) else 0
    return min((k for k in range(len(ALPHABETS)) if held >> k & 1), key=lambda k: (len(ALPHABETS[k]), k), default=-1)


def battery(word: str) -> tuple[int, int, float, bool] | None:
    """(encoding, symbols, chi-squared sum, whether no test rejects randomness); None where no alphabet holds it."""
    codes = np.frombuffer(word.rstrip("=").encode("ascii"), dtype=np.uint8)
    k = encoding(codes)
    if k < 0 or len(codes) < LEAST:
        return None
    x, n, size = PLACE[k][codes], len(codes), len(ALPHABETS[k])
    counts = np.bincount(x, minlength=size)
    chi = float((counts**2).sum()) * size / n - n
    mean, spread = chi_moments(n, np.full(size, 1 / size))
    each = BATTERY / 3
    z = [(chi - mean) / math.sqrt(spread), abs(runs_z(x >= size / 2)), abs(serial_z(x))]
    return k, n, chi, tail(z[0]) >= each and 2 * tail(z[1]) >= each and 2 * tail(z[2]) >= each


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def merged(spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What spans in the order of their starts cover, as disjoint (start, end) in order."""
    open_: tuple[int, int] | None = None
    for start, _, end in spans:
        if open_ and start <= open_[1]:
            open_ = open_[0], max(open_[1], end)
        else:
            if open_:
                yield open_
            open_ = start, end
    if open_:
        yield open_


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, battery) of the strings that overlap no base span."""
    at = 0
    covered = list(merged(base))
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if (at == len(covered) or covered[at][0] >= end) and (seen := battery(m.group())):
            yield start, end, seen


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("base", pa.string()), *((n, pa.list_(pa.int32())) for n in ("starts", "ends", "encodings", "sizes")), ("chi", pa.list_(pa.float64())), ("passed", pa.list_(pa.bool_()))])
    for whole in batches:
        for batch in by_bytes(whole, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                n = [sum(s[1] == k for s in base) for k in range(3)]
                said = joined(base)
                found = list(candidates(text or "", base))
                rows.append((doc, *n, hashlib.sha256(said.encode()).hexdigest(), said, [c[0] for c in found], [c[1] for c in found], *([c[2][i] for c in found] for i in range(4))))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, n) of a task's texts; every symbol of the alphabets is one byte of UTF-8."""
    total = np.zeros(256, np.int64)
    for whole in batches:
        for batch in by_bytes(whole, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


def ordinary(docs: DataFrame) -> list[np.ndarray]:
    """The frequencies that all texts together have within each alphabet, each symbol counted once more."""
    counts = np.ones(256)
    for byte, n in docs.select("text").mapInArrow(count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect():  # 256 rows
        counts[byte] += n
    found = [counts[[ord(c) for c in letters]] for letters in ALPHABETS]
    return [x / x.sum() for x in found]


def decimals(chi: float, n: int, p: np.ndarray) -> int:
    """How unlikely so small a sum is in ordinary text: -log10 of p in twentieths, rounded down."""
    mean, spread = chi_moments(n, p)
    below = tail((mean - chi) / math.sqrt(spread)) if spread > 0 else 1.0
    return min(MOST, int(-math.log10(below) * BINS)) if below > 0 else MOST


def classes(sizes: int, k: int) -> int:
    return k * 64 + int(math.log2(sizes))


def judge(frequencies: list[np.ndarray]):
    """(doc_id, ..., class and decimals of each candidate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            lists = [batch.column(at[n]).to_pylist() for n in ("encodings", "sizes", "chi")]
            strata = [[classes(n, k) for k, n in zip(ks, ns, strict=True)] for ks, ns in zip(*lists[:2], strict=True)]
            levels = [[decimals(c, n, frequencies[k]) for k, n, c in zip(*row, strict=True)] for row in zip(*lists, strict=True)]
            kept = [batch.column(at[n]) for n in JUDGED[:9]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(strata, type=pa.list_(pa.int32())), pa.array(levels, type=pa.list_(pa.int32()))], names=JUDGED)

    return run


JUDGED = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "starts", "ends", "passed", "strata", "levels"]


def step_up(levels: dict[int, int], q: float = DISCOVERY) -> int | None:
    """The least level that is discovered, of {level: candidates}; None where none is.

    Benjamini and Hochberg's rule, with each p rounded up to its level.
    """
    m, above, least = sum(levels.values()), 0, None
    for level in sorted(levels, reverse=True):
        above += levels[level]
        if 10 ** (-level / BINS) * m <= q * above:
            least = level
    return least


def add_random(bars: dict[int, int]):
    """The result's rows: base spans and those candidates that reach their class's bar and pass the battery."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, number = [], []
            for base, *row in zip(*(batch.column(i).to_pylist() for i in range(5, 11)), strict=True):
                more = [(start, 3, end) for start, end, ok, stratum, level in zip(*row, strict=True) if ok and level >= bars.get(stratum, MOST + 1)]
                split = (s.split(":") for s in base.split(",") if s)
                spans.append(joined(sorted([(int(a), KINDS.index(kind), int(z)) for kind, a, z in split] + more)))
                number.append(len(more))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(spans, type=pa.string()), pa.array(number, type=pa.int64())], names=[*JUDGED[:5], "spans", "n_random"])

    return run


def find_secrets(docs: DataFrame, discovery: float = DISCOVERY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequencies = ordinary(rows)
    scanned = rows.mapInArrow(scan, SCANNED)
    kept = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, starts array<int>, ends array<int>, passed array<boolean>, strata array<int>, levels array<int>"
    judged = stored(scanned.mapInArrow(judge(frequencies), kept), "secrets-judged")
    each = judged.select(F.explode(F.arrays_zip("strata", "levels")).alias("c")).groupBy("c.strata", "c.levels").agg(F.count("*").alias("n"))
    found: dict[int, dict[int, int]] = {}
    for stratum, level, n in each.collect():  # classes times levels at most
        found.setdefault(stratum, {})[level] = n
    bars = {s: bar for s, levels in found.items() if (bar := step_up(levels, discovery)) is not None}
    return judged.mapInArrow(add_random(bars), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    return tidy(lambda: find_secrets(table(spark, sf_dir, "documents")), spark, "secrets")
