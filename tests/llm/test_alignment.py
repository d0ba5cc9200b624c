"""Cross-tokenizer alignment against whole-text encoding and counting of all overlapping pairs."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from conftest import plain

from brackwater.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "a", "  two  spaces ", "line\nbreak\n  indented\ttab", "▁x a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ① ​ x y", "日本語 テキスト", "\U0001f600 smile", "it's they're", "a\x00b", "naïve café é", "x" * 300, "the the the", "the the the", "  z\x85 w \x1c q", "12345 67,890.12", "_a_ -b- _", "| èiereux |çpatre"]


def brute(rows):
    v = alignment.Vocabularies(A, B)
    per, pairs = [], Counter()
    for doc, text in rows:
        ids_a = v.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = v.b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(v.bytes_a[i] for i in ids_a) != want or b"".join(v.bytes_b[i] for i in ids_b) != want:
            ids_a, ids_b = [], []
        spans = []
        for ids, sizes in ((ids_a, v.size_a), (ids_b, v.size_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + int(sizes[i]), i))
                at += int(sizes[i])
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = ["|".join(",".join(str(t[2]) for t in s if lo < t[1] <= hi) for s in spans) for lo, hi in zip([0, *both], both)]
        pairs.update(links)
        per.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return [(doc, n_a, n_b, g, len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), sha) for doc, n_a, n_b, g, links, sha in per]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("heavy", [1, 40, 1 << 17])
def test_odd_texts(spark, heavy):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a")]
    docs = spark.createDataFrame([(d, t, "kept", d) for d, t in rows], "doc_id long, text string, ROW string, pairs long")
    got = alignment.align(docs, A, B, heavy).select(*COLUMNS)
    assert plain(got.collect()) == plain(brute(rows))


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text[:3000] if r.text else r.text) for r in docs.select("doc_id", "text").collect()]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B).select(*COLUMNS)
    assert plain(got.collect()) == plain(brute(rows))


def test_forgetting_makes_no_difference(monkeypatch):
    texts = [f"{t} word{i} and {t}" for i in range(3) for t in TEXTS if t]
    one, two = alignment.Aligner(alignment.Vocabularies(A, B)), alignment.Aligner(alignment.Vocabularies(A, B))
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    for t in texts:
        sums, digests, *links = one.align([t])
        again = two.align([t, t])
        assert digests * 2 == again[1] and (sums == again[0][1:]).all() and links[1].tolist() * 2 == again[3].tolist()


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 97} wörd" for i in range(120_000))
    rows = [(0, long), (1, "y" * 200_000), (2, "w1 wörd")]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert got[0].n_links > 240_000 and got[1].n_a > 0 and got[2].n_groups > 0
    assert got[0].n_a == sum(len(x) for x in alignment.Vocabularies(A, B).ids([long])[0])
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
