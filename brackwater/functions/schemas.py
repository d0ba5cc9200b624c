"""Schemas from text, without a session."""

from pyspark.sql import types as T

TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "money": T.DecimalType(10, 2)}


def fields(text: str) -> T.StructType:
    """``name type, name type``, of the plain types above; ``name!`` for a column that is never null."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name.rstrip("!"), TYPES[kind], not name.endswith("!")) for name, kind in pairs])
