"""Lexicon polarity of texts, in built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words by polarity, the default where no lexicon is given. Quarters add up exactly.
POLARITY = {
    1.0: "amazing astounding awesome best brilliant delightful excellent exceptional fabulous fantastic flawless incredible magnificent marvelous outstanding perfect perfectly phenomenal superb wonderful",
    0.75: "beautiful delighted elegant enjoyed great happy impressed impressive love loved loves recommend recommended reliable remarkable satisfied splendid terrific thrilled",
    0.5: "accurate attractive clean comfortable convenient durable easy effective efficient enjoy fast fine friendly good handy helpful like liked nice pleasant pleased quick quiet smooth solid sturdy useful valuable well worth",
    0.25: "acceptable adequate better decent fair improved okay sufficient",
    -0.25: "average heavy late mediocre ordinary pricey slow small stiff tight",
    -0.5: "annoying complicated confusing dirty disappointing dull expensive flimsy hard inaccurate inferior lacking loud noisy poor poorly problem problems rough sloppy stuck ugly uncomfortable unreliable weak wrong",
    -0.75: "angry bad badly broke broken cheap defective disappointed failed failure faulty fragile frustrated frustrating hate hated leaked misleading refund regret rude stupid trash unhappy unusable useless waste wasted",
    -1.0: "abysmal appalling atrocious awful disgusting dreadful fraud garbage hideous horrible horrendous idiot junk nightmare pathetic rubbish scam terrible worst worthless",
}


def lexicon() -> list[tuple[str, float]]:
    return [(word, p) for p, words in POLARITY.items() for word in words.split()]


def lexicon_table(spark: SparkSession) -> DataFrame:
    """(word, polarity): the default lexicon."""
    return F.broadcast(spark.createDataFrame(lexicon(), "word string, polarity double"))  # the words above, no more


def score(df: DataFrame, column: str = "body", key: str = "review_id", words: DataFrame | None = None) -> DataFrame:
    """``df`` with sentiment_score: the mean polarity in [-1, 1] of the words of ``words`` (word, polarity) in a
    text, each time that they occur; 0 without any, null for a null text.

    Words are joined to the lexicon and summed by ``key``, which tells the rows apart; sums are taken before
    the shuffle, so it moves one small row a text.
    """
    said = df.select(key, F.explode(F.split(F.lower(column), "[^a-z]+")).alias("word"))
    held = words if words is not None else lexicon_table(df.sparkSession)
    sums = said.join(held, "word").groupBy(key).agg(F.sum("polarity").alias("total_"), F.count("*").alias("n_"))
    scored = F.when(F.col(column).isNotNull(), F.coalesce(F.col("total_") / F.col("n_"), F.lit(0.0)))
    return df.join(sums, key, "left").withColumn("sentiment_score", scored).select(*df.columns, "sentiment_score")
