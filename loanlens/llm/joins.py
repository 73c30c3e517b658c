"""Joins whose frequent keys are dealt out over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import free_name, quoted

#: A key with more than this share of the rows is split; there are fewer than ``PARTS`` such keys.
PARTS = 4096


def counted_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", parts: int = PARTS) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and the key's row count ``n`` in ``rows``.

    A key with more than 1 / parts of the counted rows gets a salt for each
    such share: its table row is repeated once a salt and its rows are dealt
    over the salts by the hash of all their columns. Fewer than ``parts``
    keys can pass that line whatever the data, so the list of them is
    broadcast. ``n`` is dropped from the result. Keys must not be null.
    ``table`` is read three times: pass a written one.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // parts)
    salts = F.ceil(F.col(n) / F.lit(share)).cast("int")
    salt, of = free_name(rows, "_salt"), free_name(rows, "_salts")
    frequent = table.filter(F.col(n) > share).select(*keys, salts.alias(of))
    dealt = (rows.join(F.broadcast(frequent), keys, "left")
             .withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), F.col(of)).cast("int"), F.lit(0)))
             .drop(of))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(n) > share, salts - 1).otherwise(F.lit(0))))
    return dealt.join(table.withColumn(salt, copies).drop(n), [*keys, salt]).drop(salt)
