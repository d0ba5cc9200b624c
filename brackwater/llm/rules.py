"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once per whole text. The ledger stores the measurements and one integer
of failure bits; a policy is a versioned mask of the bits that reject. Applying a policy, or
asking what a policy would keep without one of its rules, is bitwise work on the stored integer
and never touches a text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Defined results: a null text has no words, so it fails
the base rules; an empty or blank text likewise; repeated rows are judged alone and come back
repeated; null doc_ids are kept as they are; further columns are ignored; an empty table gives
an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import exists, scratch_path, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule name -> when a row of measurements fails it; the place in this dict is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "5 * n_symbols > 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "shouting": "10 * n_upper > 5 * word_chars",
    "exclamations": "2 * n_marks > n_words",
    "word_length": "2 * word_chars < 5 * n_words or word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Policies by version. The second rejects on every rule.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: int) -> int:
    return sum(bit(r) for r in POLICIES[version])


def _let(value, body):
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words):
    """How many words lie in a 5-word window that the text has twice or more."""

    def covered(grams):
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s):
            same = lambda k, j: F.get(s, k)["g"] == F.get(s, j)["g"]
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def length(p):
            spans = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(pairs, lambda s: _let(places(s), length)))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(words, lambda w: _let(grams(w), covered)))


def measurements(docs: DataFrame) -> DataFrame:
    """The measurements of every row, one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda c, chars: F.translate(c, chars, "")
    base = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"),
        text.alias("text"),
        F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0).alias("lines"),
    )
    kept = F.col("text")
    return base.select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(kept, SPACES)).cast("long").alias("word_chars"),
        (F.length(kept) - F.length(without(kept, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length(kept) - F.length(without(kept, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ"))).cast("long").alias("n_upper"),
        (F.length(kept) - F.length(without(kept, "!"))).cast("long").alias("n_marks"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of every row."""
    bits = None
    for name, fails in RULES.items():
        one = F.when(F.expr(fails), F.lit(bit(name))).otherwise(F.lit(0))
        bits = one if bits is None else bits.bitwiseOR(one)
    return measurements(docs).withColumn("failure_bits", bits)


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """The ledger with the policy's version and verdict."""
    return entries.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """(rule, n_failed, n_kept, n_kept_without): the policy with and without each of its rules.

    The rows are counted by failure bits first, so only as many rows as there are patterns of
    bits (2 to the number of rules, at most) meet the rules.
    """
    patterns = entries.groupBy("failure_bits").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("b")) for r in POLICIES[version]))
    each = patterns.select("failure_bits", "n", F.inline(rules))
    has = F.col("failure_bits").bitwiseAND(F.lit(mask(version)))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(has.bitwiseAND(F.col("b")) != 0).alias("n_failed"),
        count(has == 0).alias("n_kept"),
        count(has.bitwiseAND(F.bitwise_not(F.col("b"))) == 0).alias("n_kept_without"),
    )


#: Where the last ledger of an input has been written, by application, input and its files.
_LEDGERS: dict[tuple, str] = {}


def stored_ledger(spark, sf_dir: str, anew: bool = False) -> DataFrame:
    """The documents' ledger as a table in the shared folder: verdicts, policies and ablations read it, and never
    a text.

    With ``anew`` the rules are evaluated and the ledger written; without, the last one that this application
    wrote of the same files is read, if it is still there.
    """
    docs = table(spark, sf_dir, "documents")
    entries = ledger(docs)
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(docs.inputFiles()))
    if anew or key not in _LEDGERS or not exists(spark, _LEDGERS[key]):
        path = scratch_path(spark, "rules-ledger")
        entries.write.parquet(path)
        _LEDGERS[key] = path
    return spark.read.schema(entries.schema).parquet(_LEDGERS[key])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = apply_policy(stored_ledger(spark, sf_dir, anew=True), version=2)
    failed = F.col("failure_bits").bitwiseAND(F.lit(mask(1))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failure_bits", "policy")


def rules_policies(spark, sf_dir: str) -> DataFrame:
    """Every document's verdict by each version of the policy, from one ledger."""
    entries = stored_ledger(spark, sf_dir)
    return reduce(DataFrame.unionByName, [apply_policy(entries, v) for v in POLICIES]).select("doc_id", "policy", "kept")


def rules_ablations(spark, sf_dir: str) -> DataFrame:
    """What each version of the policy keeps, with and without each of its rules, from one ledger."""
    entries = stored_ledger(spark, sf_dir)
    return reduce(DataFrame.unionByName, [ablations(entries, v).withColumn("policy", F.lit(v)) for v in POLICIES])


_LEDGER_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
gg AS (SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS gram FROM g),
d AS (SELECT rid, i FROM gg QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM d) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(text, '[^A-ZÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ]+', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 5 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 10 * n_upper > 5 * word_chars THEN 16 ELSE 0 END + CASE WHEN 2 * n_marks > n_words THEN 32 ELSE 0 END
      + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END)::INTEGER AS failure_bits FROM m)
"""
OP7_SQL = f"""{_LEDGER_SQL}SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
       failure_bits = 0 AS kept, failure_bits, 2::INTEGER AS policy FROM b
"""
POLICIES_SQL = f"""{_LEDGER_SQL}SELECT doc_id, 1::INTEGER AS policy, failure_bits & 3 = 0 AS kept FROM b UNION ALL SELECT doc_id, 2::INTEGER, failure_bits = 0 FROM b"""
ABLATIONS_SQL = f"""{_LEDGER_SQL}
SELECT rule, policy::INTEGER AS policy, count(*) FILTER (failure_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failure_bits & all_bits = 0)::BIGINT AS n_kept,
       count(*) FILTER (failure_bits & (all_bits - bit) = 0)::BIGINT AS n_kept_without
FROM b CROSS JOIN (VALUES ('few_words', 1, 1, 3), ('repeated_words', 2, 1, 3), ('few_words', 1, 2, 127), ('repeated_words', 2, 2, 127), ('symbols', 4, 2, 127), ('duplicate_lines', 8, 2, 127),
  ('shouting', 16, 2, 127), ('exclamations', 32, 2, 127), ('word_length', 64, 2, 127)) r(rule, bit, policy, all_bits) GROUP BY 1, 2"""
