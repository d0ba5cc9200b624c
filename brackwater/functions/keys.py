"""Surrogate keys, as hashes of natural keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(source: str, key: Column) -> Column:
    """SHA-256 of source and key joined by ``|``; null for a null key."""
    return F.when(key.isNotNull(), F.sha2(F.concat_ws("|", F.lit(source), key.cast("string")), 256))


def composite_key(source: str, *keys: Column) -> Column:
    """MD5 of source and keys joined by ``||``."""
    return F.md5(F.concat_ws("||", F.lit(source), *(k.cast("string") for k in keys)))


def seconds_text(ts: Column) -> Column:
    """A timestamp as text of fixed form, for hashing."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
