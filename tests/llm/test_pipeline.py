"""The pipeline's stages, each against brute force on the stage's own input, and on odd rows."""

import re

import numpy as np
import pytest
from conftest import SMALL
from test_llm_operators import brute_suffixes
from test_near import brute_near

import corpus_pipeline as p
from brackwater.llm import quality
from brackwater.llm.common import stored


def brute_score(text, weights, offset):
    v, q, r = quality.text_slots()
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, x = len(words), offset
    if n:
        pairs = list(zip(words, words[1:], strict=False))
        x += 10 * sum(weights[f] for w in words for f in quality.word_features(w)) / n
        x += weights[v[min(n.bit_length(), 5)][10 * len(set(words)) // n]] + weights[q[10 * (len(set(pairs)) if n > 1 else n) // n]] + weights[r[10 * sum(a == b for a, b in pairs) // n]]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_clean(rows, items):
    items = [s for s in map(shingles, items) if s]
    return [r for r in rows if not any(1000 * len(s - own) <= 200 * len(s) for own in [shingles(r[1])] for s in items)]


def brute_cut(rows, length=50):
    """What is left of each text that keeps a byte."""
    first, out = {}, []
    rank = lambda d: (1 << 63) - 1 if d is None else d
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first.get(t[i : i + length], rank(d)), rank(d))
    for (d, t), (_, text) in zip(data, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < rank(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        if not any(gone):
            out.append((d, text))
        elif kept:
            out.append((d, kept.decode("utf-8", "replace")))
    return out


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, frames = docs.columns, []
    _, _, (weights, offset) = quality.train(docs)
    for name, stage in p.STAGES:
        frames.append(docs)
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    raw, judged, unique, cut, clean = map(pairs, frames)
    assert ordered(judged) == ordered(r for r in raw if brute_score(r[1], weights, offset) >= quality.KEEP) and len(judged) < len(raw)
    assert ordered(unique) == ordered(judged[i] for i in brute_near(judged))
    assert {d for d, _ in cut} == {d for d, n, gone, _, _ in brute_suffixes(unique) if n - gone or not n}
    strip = lambda rows: ordered((d, t and re.sub("�+", "�", t)) for d, t in rows)  # noqa: E731  how many stand for a split character is the decoder's choice
    assert strip(cut) == strip(brute_cut(unique))
    items = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    assert ordered(clean) == ordered(brute_clean(cut, items)) and len(clean) < len(cut)
    packed = docs.toPandas()
    assert set(packed.doc_id) == {d for d, _ in clean}
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and np.issubdtype(packed.offset.dtype, np.integer)


LONG = "passage of words that is repeated in several documents and is longer than fifty bytes in all "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, h string, quality_score string, n_removed string, spans string, Row_ string, body string, hashes string, body_ string"


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    """Nulls, blanks, a text of megabytes, ties, repeats and columns with the names that stages use."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, LONG), (6, "head " + LONG + "t\xe9"), (7, LONG), (7, LONG), (7, "another text for the same id"), (None, LONG + "null"), (None, f"start {item} end"), (8, f"so {item}"), (9, " ".join(f"w{i % 7919}" for i in range(600_000))), (10, "\xe9\xe8 " * 40)]
    rows = [(d, t, None, "s", None if t is None else len(t), *"abcdefghij") for d, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, SMALL)
    if name == "packing":
        assert {r[0] for r in out.select("doc_id").distinct().collect()} == {d for d, _ in texts}
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert all(tuple(r)[5:] == tuple("abcdefghij") for r in got)
    left = ordered((r["doc_id"], r["text"]) for r in got)
    if name == "quality_classifier":
        assert all(r in texts for r in left)
    elif name == "simhash_near_dedup":
        assert left == ordered(texts[i] for i in brute_near(texts))
    elif name == "suffix_array_dedup":
        assert left == ordered(brute_cut(texts))
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    else:
        assert left == ordered(brute_clean(texts, [item]))
    none = stage(spark, docs.limit(0), SMALL)
    assert none.columns == docs.columns and none.count() == 0
