r"""Benchmark decontamination: size-partitioned MinHash containment search, in built-in functions.

Texts are lower-cased and cut at whatever is no letter or digit. An item's shingles are its runs of five
words; an item of one to four words is one shingle of its own length. Documents are cut into runs of
five words and of each shorter length that an item has, so a short item is found inside a long document
like any other. An item with n distinct shingles is contained in a document that has at least
``threshold`` of them. Such a document lacks at most floor((1 - threshold) * n), so it holds at least one
of any floor((1 - threshold) * n) + 1 of them. The items are partitioned by size (powers of two); the
signature of an item has that many minima of its shingles' hashes for the largest n of its partition. A
signature hash that occurs in a document makes a candidate, and no contained item can escape it, however
long the document is. Candidates are verified by exact intersection of the shingles themselves, as text;
only documents with a candidate are cut again for that.

Defined results: null or blank texts have no shingles and match nothing; equal items are found
each; rows with the same doc_id are told apart by their text and give a row each (equal rows give
one); rows with a null doc_id or item_id are compared and keep the null; further columns are
ignored; an empty table on either side gives an empty result; texts of any length are cut whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import stored, table

WORDS = 5
THRESHOLD = 0.8


def words(column):
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def runs(parts, sizes, make):
    """``make(w, i, k)`` for the k words from each place i (from 0) of an array of words, for each k of ``sizes``."""
    each = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: make(w, i, k)))
    none = F.array().cast("array<string>")
    whole = lambda w: F.concat(*(F.coalesce(each(w, k), F.array().cast("array<long>") if make is hashed else none) for k in sizes))
    # the words are bound to a name, so they are cut once
    return F.element_at(F.transform(F.array(parts), whole), 1)


def hashed(w, i, k: int):
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)))


def spelt(w, i, k: int):
    return F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))  # slice() would copy the whole array each time


def allowance(n, threshold: float):
    """How many of n shingles a document may lack; in whole thousandths, to be exact."""
    return F.floor(n * F.lit(1000 - round(threshold * 1000)) / 1000).cast("int")


def item_table(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, item_id, size, hashes, shingles, n, signature): one row per item, ``size`` its shingles' length."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("size", F.least(F.size("w"), F.lit(WORDS))).filter("size > 0")
    cut = lambda make: F.coalesce(*(F.when(F.col("size") == k, runs(F.col("w"), [k], make)) for k in range(1, WORDS + 1)))
    items = items.select("item_id", "size", F.sort_array(F.array_distinct(cut(hashed))).alias("hashes"), F.array_distinct(cut(spelt)).alias("shingles"))
    items = items.withColumn("n", F.size("shingles"))
    # the largest size of the partition; an item's own n where it is smaller
    top = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    items = items.withColumn("signature", F.slice("hashes", F.lit(1), F.least(F.col("n"), allowance(top, threshold) + 1)))
    return items.withColumn("item", F.xxhash64("item_id", "shingles"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every item that a document contains."""
    items = stored(item_table(benchmark, threshold), "decontaminate-items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # five at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared int, n_item int, containment double")
    # the text's hash comes first: beside an explode it would be taken again for each shingle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    seen = rows.select("doc_id", "body", F.explode(runs(words(F.col("text")), sizes, hashed)).alias("hash"))
    signatures = items.select("item", F.explode("signature").alias("hash"))
    candidates = stored(seen.join(signatures, "hash").select("doc_id", "body", "item").distinct(), "decontaminate-candidates")
    wanted = candidates.select(F.col("doc_id").alias("d"), F.col("body").alias("b")).distinct()
    again = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left_semi")
    own = again.select("doc_id", "body", F.explode(runs(words(F.col("text")), sizes, spelt)).alias("shingle")).distinct()
    sought = items.select("item", F.explode("shingles").alias("shingle"))
    hits = own.join(sought, "shingle").groupBy("doc_id", "body", "item").agg(F.count("*").cast("int").alias("n_shared"))
    verified = hits.join(items.select("item", "item_id", F.col("n").alias("n_item")), "item").filter(F.col("n_shared") + allowance(F.col("n_item"), threshold) >= F.col("n_item"))
    return verified.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by SQL, without hashes; items of fewer than five words are sought in the text between spaces.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT rid, doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
bs AS (SELECT DISTINCT bid, item_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT bid, item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) > 4)),
few AS (SELECT bid, item_id, ' ' || list_aggregate(w, 'string_agg', ' ') || ' ' AS s FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT bid, count(*)::INTEGER AS n_item FROM bs GROUP BY bid),
m AS (SELECT rid, doc_id, bid, item_id, count(*)::INTEGER AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (bid)
WHERE 1000 * (n_item - n_shared) <= n_item * 200
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN few ON contains(' ' || list_aggregate(w, 'string_agg', ' ') || ' ', s)
"""
