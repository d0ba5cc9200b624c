"""Operators against brute force, and their edge cases."""

import hashlib
import io
import re
import zlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL, same

from brackwater.llm import chat, common, decontaminate, packing, quality, queries, rules, sharding, simhash, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part string, row string, h string, chunk string"
LONG = "passage of words that is repeated in several documents and is longer than fifty bytes in all "
EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (6, "head " + LONG + "tail"), (7, LONG), (7, LONG), (None, LONG + "null"), (8, "word " * 30_000),
    (9, "éè " * 40), (10, "A b C d. E f!"), (11, LONG.upper()),
]


def docs(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, None, None, None, None, "x", "y", "z", "c") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def whole_table(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# --- simhash


def brute_simhash(rows):
    def print_of(text):
        words = (text or "").encode().lower().split()
        cut = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in cut]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            top[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash(spark):
    assert all(any(set(t) <= set(q) for t in simhash.covering_triples()) for q in combinations(range(8), 4))
    for rows in (EDGES, whole_table(spark)):
        assert sorted(map(tuple, simhash.simhash_components(docs(spark, rows)).collect()), key=str) == brute_simhash(rows)
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_simhash_links_in_blocks(spark):
    """A hot posting list is cut into many blocks and loses no link."""
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)} | {base ^ 0b11111 << 40})
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), block=7)
    from brackwater.llm.common import connected_components

    labels = dict(map(tuple, connected_components(got).collect()))
    near = {p: {q for q in prints if (p ^ q).bit_count() <= 4 and p != q} for p in prints}
    for p, q in product(prints, prints):
        if q in near[p]:
            assert labels[p] == labels[q]


# --- suffixes


def brute_suffixes(rows, length=50):
    rank = lambda d: (1 << 63) - 1 if d is None else d
    first, out = {}, []
    data = [(rank(d), (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first.get(t[i : i + length], d), d)
    for (d, t), (own, _) in zip(data, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((own, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(spark):
    for rows in (EDGES, whole_table(spark)):
        got = suffixes.deduplicate(docs(spark, rows).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == brute_suffixes(rows)
    assert suffixes.deduplicate(docs(spark, []).select("doc_id", "text")).count() == 0


def test_least_owners_is_exact():
    rng = np.random.default_rng(1)
    pieces = rng.integers(97, 99, (200, 14)).astype(np.uint8)
    pieces[::7, :3] = suffixes.PAD
    owner = np.arange(200)[::-1].copy()
    got = suffixes.least_owners(pieces, owner, 9)
    for i, o in product(range(200), range(6)):
        own = pieces[i, o : o + 9]
        want = suffixes.LAST if (own == suffixes.PAD).any() else min(owner[j] for j in range(200) if (pieces[j, o : o + 9] == own).all())
        assert got[i, o] == want


# --- sharding


def test_sharding(spark):
    for rows in (EDGES, whole_table(spark)):
        got = sharding.shard_documents(docs(spark, rows)).collect()
        assert len(got) == len(rows)
        sums, groups = {}, {}
        for r in got:
            sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        for _, t in rows:
            h = hashlib.md5((t or "").encode()).hexdigest()
            groups[h] = groups.get(h, 0) + len((t or "").encode()) + 8
        sizes = [groups[h] for h in sorted(groups)]

        def fits(c, sizes=sizes):
            n, at = 1, 0
            for s in sizes:
                n, at = (n, at + s) if at + s <= c else (n + 1, s)
            return n <= 24

        assert max(sums.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        for s in sums:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert sharding.shard_documents(docs(spark, [])).count() == 0


# --- packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*EDGES, (12, "café, naïve. İstanbul é ΣΣ it's 12,5 <|endoftext|> x"), (13, "a.b, c. ,. ...")]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    want = {}
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault((d, len(ids)), []).append(ids)
    places, seen = {}, 0
    for r in got:
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in want[r["doc_id"], r["doc_tokens"]])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen += r["length"]
    assert seen == sum(len(i) for ids in want.values() for i in ids)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_packing_ids_are_the_tokenizers(spark):
    """Whole tables and odd texts, in batches that share words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), packing.WordCoder(path, 2)
    odd = [None, "", " ", "\n", "a", "A.", "\xc9, \xc8\xc0\xde. \xd7\xf7 x\xd7. \xdf\xff", "<|ENDOFTEXT|> Hi. <|endoftext|>", "x . y ,z", "foo\tbar baz.\x85qux, w.", "e\u0301. E\u0301, I\u0307 ", "don't. we'll, 's. s", "\x1c a\x1f.", "\xaa\xba. \xb5, x\xb2,", "end,\n.", ".", "a.\r\nb", "\U0001f600. x\U0001f600,", "ab\xadcd. \u0152 \u0178, \u0133.", "\u03a3\u03a3. \u65e5\u672c. x" * 50]
    texts = odd + [t for _, t in whole_table(spark)] + odd
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        ids, ends = own.ids(pa.array([t or "" for t in part]))
        for t, a, z in zip(part, [0, *ends[:-1]], ends, strict=True):
            assert ids[a:z].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_packing_plan_takes_no_piece_twice():
    histogram = {100: 37, 156: 37, 60: 10, 76: 3, 255: 4, 1: 4, 64: 400}
    runs = packing.plan(histogram, 256)
    for part, n in histogram.items():
        ranks = sorted(k for p, a, b, *_ in runs if p == part for k in range(a, b + 1))
        assert ranks == list(range(len(ranks))) and len(ranks) <= n
    full, places = {}, {}
    for p, a, b, s, place, n in runs:
        for k in range(b - a + 1):
            full[s + k % n] = full.get(s + k % n, 0) + p
            places.setdefault(s + k % n, []).append(place + k // n)
    assert set(full.values()) == {256} and sorted(full) == list(range(len(full)))
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert sum(b - a + 1 for _, a, b, *_ in runs) >= 0.95 * sum(histogram.values())


def test_packing_combinations_against_brute_force():
    parts, times = packing.combinations(24)
    got = sorted(tuple(sorted((p, m) for p, m in zip(ps, ms, strict=True) if p)) for ps, ms in zip(parts.tolist(), times.tolist(), strict=True))
    assert len(got) == len(set(got)) and all(sum(p * m for p, m in way) == 24 and sum(m for _, m in way) <= packing.PIECES for way in got)
    two = {tuple(sorted(((p, a), (q, b)))) for p in range(1, 25) for q in range(1, p) for a in range(1, 6) for b in range(1, 7 - a) if a * p + b * q == 24}
    ones = {((p, 1), (q, 1), (24 - p - q, 1)) for p in range(1, 25) for q in range(p + 1, 25) if 24 - p - q > q}
    assert two <= set(got) and ones <= set(got) and {((24, 1),), ((4, 6),)} <= set(got)


def test_packing_nnls_is_the_least_squares_solution():
    """The conditions that only the optimum meets: no slope where x > 0, none upwards where x = 0."""
    rng = np.random.default_rng(3)
    for bins in (12, 40, 64):
        parts, times = packing.combinations(bins)
        h = np.r_[0, rng.integers(0, 90, bins)].astype(float)
        weight = 1 / np.sqrt(np.maximum(h, 1))
        a = np.zeros((bins + 1, len(parts)))
        for place in range(3):
            np.add.at(a, (parts[:, place], np.arange(len(parts))), times[:, place])
        a[0] = 0
        x = packing.nnls(parts, times, h, weight)
        slope = (a * weight[:, None]).T @ (weight * (h - a @ x))
        assert x.min() >= 0 and (x > 0).sum() <= bins + 1
        assert slope.max() < 1e-4 * h.max() and np.abs(slope[x > 0]).max() < 1e-4 * h.max()


def test_rules_share_one_ledger(spark):
    """Policies and ablations read the ledger that op7 wrote; one that has gone is written again."""
    sf = "/root/testdata/sf0.001"
    first = rules.op7_quality_rules(spark, sf).inputFiles()
    other = rules.stored_ledger(spark, sf)
    assert sorted(rules.rules_policies(spark, sf).inputFiles()) == sorted(other.inputFiles()) == sorted(first)
    common.discard(spark, first[0].rsplit("/", 1)[0])
    assert rules.rules_ablations(spark, sf).count() == 9
    assert rules.op7_quality_rules(spark, sf).inputFiles() != rules.stored_ledger(spark, sf, anew=True).inputFiles()


# --- warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")


def test_warc_edges(spark):
    big, small = "x" * 1500, "y" * 20
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", big), (3, "http://c", big), (4, "u", None), (5, "u", small), (6, "u", small), (None, "u", big)]
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1500, "revisit", 3), (2, 1500, "revisit", 3), (3, 1500, "response", None), (3, 1500, "response", None), (4, 0, "response", None), (5, 20, "response", None), (6, 20, "response", None), (None, 1500, "revisit", 3)], key=str)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_warc_reader_finds_damage():
    data = warc.record(1, "u", b"hello" * 500, None, False) + warc.record(2, "u", b"", 1, True)
    assert [r[0] for r in warc.read_archive(io.BytesIO(data))] == [1, 2]
    with pytest.raises(EOFError):
        list(warc.read_archive(io.BytesIO(data[:-9])))
    broken = zlib.decompress(warc.record(1, "u", b"hello" * 500, None, False), 31).replace(b"hello", b"hallo", 1)
    c = zlib.compressobj(wbits=31)
    with pytest.raises(warc.DigestError):
        list(warc.read_archive(io.BytesIO(c.compress(broken) + c.flush())))


def test_warc_reader_holds_no_payload():
    """A 96 MB payload goes by in pieces; reads of any size, down to one byte, frame the same records."""
    import tracemalloc

    sizes = [0, 3, 96 << 20, 1 << 16, 70_001, 5]
    data = b"".join(warc.record(i, "u" * (200_000 if i == 3 else 1), b"ab\r\n\r\n"[: n] * (n // 6) + b"z" * (n % 6), None, False) for i, n in enumerate(sizes))
    tracemalloc.start()
    got = [r[:2] for r in warc.read_archive(io.BytesIO(data), keep=False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, n // 6 * len(b"ab\r\n\r\n"[:n]) + n % 6) for i, n in enumerate(sizes)]
    assert peak < len(data) + (4 << 20)

    class Slow(io.BytesIO):
        def read(self, size=-1):
            return super().read(1)

    small = b"".join(warc.record(i, "u", b"\r\n\r\n" * i, None, False) for i in range(20))
    assert [(r[0], r[5]) for r in warc.read_archive(Slow(small))] == [(i, b"\r\n\r\n" * i) for i in range(20)]


def test_warc_reader_frames_by_length():
    whole = zlib.decompress(warc.record(1, "u", b"hello", None, False), 31)
    for wrong in (whole[:-4], whole + b"\r\n", whole.replace(b"WARC/1.1", b"WORC/1.1"), whole.replace(b"\r\n\r\n", b"\r\n")):
        c = zlib.compressobj(wbits=31)
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(c.compress(wrong) + c.flush())))


# --- chat


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "bot", "> How are  YOU?\nFine."), (1, 2, "user", "other"), (1, 3, "user", "> > how are you?\n> Fine.\nGreat"), (1, 4, "a", "> unknown\nx"), (1, 5, "b", "> other\nyes"), (None, None, None, None), (2, 0, "user", "")]
    m = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, row string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_conversations(m).collect()}
    assert [got[1, t]["reply_to"] for t in range(6)] == [None, 0, None, 1, None, 2]
    assert [got[1, t]["position"] for t in range(6)] == [0, 1, 3, 2, 5, 4]
    assert [got[1, t]["content"] for t in (1, 3, 5)] == ["Fine.", "Great", "yes"]
    assert got[1, 3]["quote_depth"] == 2 and got[1, 4]["n_linked"] == 0 and len(got) == len(rows)
    assert chat.link_conversations(m.limit(0)).count() == 0


def test_chat_places_have_no_gaps(spark, sf_dir):
    got = chat.op4_chat(spark, sf_dir).collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in by.values())


# --- decontamination


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    edited = item.replace("upsilon", "changed")
    half = " ".join(item.split()[:12])
    d = docs(spark, [(1, "x " * 5000 + item.upper() + ", y " * 5000), (2, edited), (3, half), (4, None), (None, item), (5, item), (5, item), (6, "tiny item")])
    b = spark.createDataFrame([(1, item, "z"), (2, "tiny item", "z"), (3, None, "z"), (4, item, "z")], "item_id long, text string, hashes string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contained_items(d, b).collect()), key=str)
    n = len(item.split()) - 4
    assert got == sorted([(i, k, n if i != 2 else n - 1) for i in (1, 2, None, 5) for k in (1, 4)] + [(6, 2, 1)], key=str)
    assert decontaminate.contained_items(d.limit(0), b).count() == 0 and decontaminate.contained_items(d, b.limit(0)).count() == 0


# --- rules


def test_rules_ablation(spark):
    entries = rules.ledger(docs(spark))
    kept = rules.apply_policy(entries, 2).filter("kept").count()
    for r in rules.ablations(entries, 2).collect():
        others = [x for x in rules.POLICIES[2] if x != r["rule"]]
        assert r["n_kept"] == kept
        assert r["n_kept_without"] == entries.filter(f"failure_bits & {sum(map(rules.bit, others))} = 0").count()
    assert rules.apply_policy(entries, 2).filter("doc_id in (1, 2, 3) and kept").count() == 0
    assert rules.ledger(docs(spark, [])).count() == 0


# --- models


def test_toxicity_edges_and_accuracy(spark):
    rows = [(i, ("you vile cretin " if i % 3 == 0 else "a kind and gentle ") + "person of the town " * (i % 5 + 1)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows + [(None, None), (1000, "")]), labels, bits=14).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(docs(spark, []), labels, bits=14).count() == 0
    assert toxicity.score_toxicity(docs(spark), labels.limit(0), bits=14).count() == len(EDGES)


def test_toxicity_on_held_out_rows(spark):
    big = SMALL.replace("sf0.001", "sf0.1")
    got = toxicity.op1_toxicity(spark, big).filter("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    hit, told, there = (sum(f(r) for r in got) for f in (lambda r: r["predicted"] == r["toxic"] == 1, lambda r: r["predicted"], lambda r: r["toxic"]))
    assert hit >= 0.85 * there and hit >= 0.9 * told
    by = sorted(got, key=lambda r: r["score"])
    ranks = [i for i, r in enumerate(by) if r["toxic"]]
    assert (sum(ranks) - there * (there - 1) / 2) / (there * (len(by) - there)) >= 0.95


def test_quality_against_labels(spark):
    big = SMALL.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{big}/documents.parquet")
    got = quality.classify(table).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in got)
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert right >= 0.93 * len(got) and sum(clean) >= 0.98 * len(clean)


def test_quality_measurements_against_native_ones(spark):
    rows = [*EDGES, *whole_table(spark), (20, "a\n\na\n b \na\n"), (21, "x y " * 9), (22, "\n"), (23, "\u65e5\u672c \u65e5\u672c! |")]
    m = quality.Measured(pa.array([t for _, t in rows]))
    m.n_lines, m.n_dup_lines = m.lines
    want = rules.measurements(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).toPandas().sort_values("doc_id")
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_marks"):
        assert getattr(m, name).tolist() == want[name].tolist(), name
    for i, (_, t) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        pairs = list(zip(words, words[1:], strict=False))
        assert (m.n_pairs[i], m.n_followed[i]) == (len(set(pairs)), sum(a == b for a, b in pairs))


def test_quality_em_against_brute_force():
    """The same EM, vote by vote and row by row."""
    rng = np.random.default_rng(5)
    k = len(quality.LABELLERS)
    counts = {int(p): int(n) for p, n in zip(rng.choice(3**k, 60, replace=False), rng.integers(1, 50, 60), strict=True)}
    rows = [[p // 3**j % 3 for j in range(k)] for p in sorted(counts) for _ in range(counts[p])]
    share = []
    for r in rows:
        own = [0.05 if quality.BAD in r else 0.95, *((d == quality.BAD) + 0.005 for d in r)]
        share.append([x / sum(own) for x in own])
    for _ in range(200):
        size = [sum(s[c] for s in share) for c in range(k + 1)]
        prior = [(x + 1) / (len(rows) + k + 1) for x in size]
        rate = [[[0.5 + sum(s[c] for s, r in zip(share, rows, strict=True) if r[j] == v) for v in (1, 2)] for j in range(k)] for c in range(k + 1)]
        new = []
        for r in rows:
            own = [prior[c] * np.prod([rate[c][j][d - 1] / sum(rate[c][j]) for j, d in enumerate(r) if d]) for c in range(k + 1)]
            new.append([x / sum(own) for x in own])
        moved = max(abs(a - b) for x, y in zip(new, share, strict=True) for a, b in zip(x, y, strict=True))
        if moved < 1e-6:
            break
        share = new
    got, at = quality.posteriors(counts), 0
    for p in sorted(counts):
        assert abs(got[p] - share[at][0]) < 1e-6
        at += counts[p]


def test_quality_scorer_is_its_formula(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << quality.BITS)
    rows = [(i, t) for i, (_, t) in enumerate([*EDGES, *whole_table(spark)[:40]])]
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(docs(spark, rows), (weights, 0.5), "s_").withColumnRenamed("s_", "score").collect()}
    v, p, r = quality.text_slots()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, x = len(words), 0.5
        if n:
            pairs = list(zip(words, words[1:], strict=False))
            x += 10 * sum(weights[f] for w in words for f in quality.word_features(w)) / n
            x += weights[v[min(n.bit_length(), 5)][10 * len(set(words)) // n]] + weights[p[10 * (len(set(pairs)) if n > 1 else n) // n]] + weights[r[10 * sum(a == b for a, b in pairs) // n]]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) < 1e-4


def test_quality_edges(spark):
    assert quality.classify(docs(spark)).count() == len(EDGES)
    assert quality.classify(docs(spark, [])).count() == 0
