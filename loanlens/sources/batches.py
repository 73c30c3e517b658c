"""Request envelopes: batches of typed records as ``array<struct>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.rules import ALL_FIELDS

BATCH_CAP = 100  # records per request envelope


def to_envelopes(df: DataFrame, key: str = "app_id", size: int = BATCH_CAP, by: str = "key") -> DataFrame:
    """Pack records into envelopes of at most ``size`` records.

    ``by='key'``: envelope = floor(key / size), for a unique integer key (the
    registered query uses the order key); ``by='position'``: envelope =
    floor(monotonically_increasing_id / size), i.e. consecutive rows of one
    input partition, so a group never exceeds ``size`` whatever the key
    distribution (deterministic for a deterministic input order).
    Either way ``collect_list`` works on a bounded group.
    """
    rec = F.struct(F.col(key), *[F.col(c) for c in ALL_FIELDS])
    if by == "key":
        env = F.floor(F.col(key) / size)
    elif by == "position":
        env = F.floor(F.monotonically_increasing_id() / size)
    else:
        raise ValueError(by)
    return df.groupBy(env.alias("batch_id")).agg(F.array_sort(F.collect_list(rec)).alias("applications"))


def explode_envelopes(env: DataFrame) -> DataFrame:
    """A3: one row per record with its batch and position."""
    return env.select("batch_id", F.posexplode("applications").alias("position", "r")).select(
        "batch_id", "position", "r.*")


def read_envelopes_json(spark, path: str) -> DataFrame:
    """JSON files whose lines are ``{"applications": [ {...}, ... ]}``."""
    from loanlens.sources.tables import APPLICATION_SCHEMA
    from pyspark.sql import types as T
    rec = T.StructType([f for f in APPLICATION_SCHEMA.fields if f.name in ALL_FIELDS or f.name == "app_id"])
    schema = T.StructType([T.StructField("applications", T.ArrayType(rec))])
    return spark.read.schema(schema).json(path).select(
        F.monotonically_increasing_id().alias("batch_id"), "applications")
