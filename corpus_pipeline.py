"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written and read again
as the docs of the next; all but the last keep the columns of documents.
"""

from pyspark.sql import functions as F

from brackwater.llm import decontaminate, near, packing, quality, suffixes
from brackwater.llm.common import fresh, stored, table, tidy, with_row_key


def aside(docs):
    """``docs`` with every column but doc_id and text under a name that no operator has, and the way back."""
    names = {c: f"aside_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), lambda df: df.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go.

    Equal texts are judged alike; null, empty and blank texts have the score of the offset alone; null and
    repeated doc_ids make no difference; an empty table stays empty.
    """
    _, _, scorer = quality.train(docs)
    score = fresh(docs, "quality_score")
    return quality.with_quality(docs, scorer, score).filter(F.col(score) >= quality.KEEP).select(*docs.columns)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group of near copies (Jaccard similarity 0.8 or more of five-word shingles) the row
    with the smallest doc_id stays.

    Rows are told apart by a key of their own, not by their doc_id: of near copies with one doc_id their texts
    decide which stays, and if they aren't near copies all stay; null doc_ids come last. Texts without a
    word are copies of each other. An empty table stays empty.
    """
    row = fresh(docs, "row")
    keyed = with_row_key(docs, row)
    first = near.first_rows(keyed.select(F.col(row).alias("row"), "doc_id", "text"))
    return keyed.join(first.select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


def repeats_stage(spark, docs, sf_dir):
    """Bytes of strings that start in an earlier document are cut; texts of which nothing is left go.

    A cut may split a character; what is left of it becomes a replacement character. n_chars is counted
    again where text was cut. Null and empty texts stay as they are; rows with equal doc_ids take nothing
    from each other; null doc_ids come last; an empty table stays empty.
    """
    renamed, back = aside(docs)
    cut = suffixes.deduplicate(renamed).filter("n_removed = 0 or n_removed < n_bytes")
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, suffixes.without_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = f"aside_{docs.columns.index('n_chars')}"
        cut = cut.withColumn(n_chars, F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return back(cut)


def decontamination_stage(spark, docs, sf_dir):
    """Rows that contain a benchmark item go; all others stay.

    Rows are told apart by a key of their own, so null and repeated doc_ids make no difference; null and
    empty texts contain nothing; an empty table, or an empty benchmark, changes nothing.
    """
    row = fresh(docs, "row")
    keyed = with_row_key(docs, row)
    rows = keyed.select(F.col(row).alias("doc_id"), "text")
    leaks = tidy(lambda: decontaminate.contained_items(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct(), spark, "pipeline-leaks")
    return keyed.join(leaks, row, "left_anti").select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    """The pieces of all documents that are left, in sequences of at most 4096 tokens.

    Every row is packed by itself, whatever its doc_id; a null or empty text has the end id alone; an
    empty table has no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained scorer nor the tokenizer: tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
