"""Category dictionaries and sparse one-hot vectors for columns of any number of categories.

A dictionary is a written table (feature, value, index, n), not driver state:
the distinct values of all text columns from one grouped aggregation, put in
order of (column, value) by a range shuffle and numbered by range offsets.
The order is that of :meth:`FittedEncoder.output_names` without its numeric
part. The driver holds one number a column.

Encoding looks every cell up in the dictionary and gives each record one
sparse vector. Values with more than 1 / ``PARTS`` of the cells are looked up
in a broadcast list (there are fewer than ``PARTS`` of them whatever the
data), so no frequent value is shuffled; all others are joined by shuffle.

Defined results: a null takes its column's most frequent value, ties to the
smallest (``impute=False``: no position); a value that the dictionary lacks
sets no position; a column without any value has no positions; keys must be
unique and not null; an empty table gives an empty dictionary and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import functions as MF
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.sources.stages import written

PARTS = 4096
_ROW_BITS = 33      # monotonically_increasing_id: partition number above, row number below


def cells(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """(key, position of the column, value) of every cell of ``columns``, nulls included."""
    names = [str(i) for i in range(len(columns))]
    keys = [F.col(key).alias("key")] if key else []
    text = df.select(*keys, *[F.col(c).cast("string").alias(n) for c, n in zip(columns, names, strict=True)])
    return text.unpivot(["key"] if key else [], names, "col", "value").withColumn("col", F.col("col").cast("int"))


@dataclass
class CategoryDictionary:
    columns: list[str]
    table: DataFrame        # col, value, index, n; written
    sizes: list[int]        # number of categories of each column

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], partitions: int | None = None) -> "CategoryDictionary":
        """Number the distinct values of ``columns``, over ``partitions`` ranges (the session's number of them)."""
        counts = cells(df, columns).where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
        order = ["col", "value"]
        ranges = counts.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
        # written once: whichever task is repeated, a value keeps its place
        placed = written(ranges.withColumn("_id", F.monotonically_increasing_id()), "categories")
        placed = placed.select(*order, "n", F.shiftright("_id", _ROW_BITS).alias("_part"),
                               F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row a range
        offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
            "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        table = placed.join(F.broadcast(offsets), "_part").select(*order, (F.col("_before") + F.col("_row")).alias("index"), "n")
        table = written(table, "dictionary")
        found = {r["col"]: r["n"] for r in table.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a column
        return cls(list(columns), table, [found.get(i, 0) for i in range(len(columns))])

    @property
    def dimension(self) -> int:
        return sum(self.sizes)

    @property
    def offsets(self) -> list[int]:
        """First index of each column."""
        return [sum(self.sizes[:i]) for i in range(len(self.sizes))]

    def named(self) -> DataFrame:
        """(feature, value, index, n)."""
        names = F.array(*[F.lit(c) for c in self.columns])
        return self.table.select(names[F.col("col")].alias("feature"), "value", "index", "n")

    def modes(self) -> DataFrame:
        """(col, mode): index of each column's most frequent value, ties to the smallest."""
        best = F.max(F.struct("n", (-F.col("index")).alias("back")))
        return self.table.groupBy("col").agg(best.alias("b")).select("col", (-F.col("b.back")).alias("mode"))

    def indices(self, df: DataFrame, key: str, impute: bool = True) -> DataFrame:
        """(key, i0, i1, ...): the index of every cell's value, null where there is none."""
        total = self.table.agg(F.sum("n")).first()[0] or 0
        frequent = self.table.where(F.col("n") > max(1, total // PARTS)).select("col", "value", "index")
        rare = self.table.where(F.col("n") <= max(1, total // PARTS)).select("col", "value", "index")
        looked = cells(df, self.columns, key).join(F.broadcast(frequent), ["col", "value"], "left")
        done = F.col("index").isNotNull() | F.col("value").isNull()
        rest = looked.where(~done).drop("index").join(rare.hint("merge"), ["col", "value"], "left")
        both = looked.where(done).select("key", "col", "value", "index").unionByName(rest.select("key", "col", "value", "index"))
        if impute:
            both = both.join(F.broadcast(self.modes()), "col", "left").withColumn(
                "index", F.when(F.col("value").isNull(), F.col("mode")).otherwise(F.col("index")))
        return both.groupBy("key").agg(*[F.max(F.when(F.col("col") == i, F.col("index"))).alias(f"i{i}")
                                         for i in range(len(self.columns))]).withColumnRenamed("key", key)

    def encode(self, df: DataFrame, key: str, impute: bool = True, out: str = "features") -> DataFrame:
        """(key, out): one vector of ``dimension`` positions a record, with a one at each of its values."""
        at = self.indices(df, key, impute)
        used = [i for i, n in enumerate(self.sizes) if n]
        if not used:
            return at.select(key, MF.array_to_vector(F.array().cast("array<double>")).alias(out))
        # an index behind the last one is "invalid", kept as a last position and dropped: no position at all
        own = at.select(key, *[F.coalesce(F.col(f"i{i}") - self.offsets[i], F.lit(self.sizes[i])).cast("double").alias(f"i{i}")
                               for i in used])
        last = df.sparkSession.createDataFrame([tuple(float(self.sizes[i] - 1) for i in used)], [f"i{i}" for i in used])
        hot = OneHotEncoder(inputCols=[f"i{i}" for i in used], outputCols=[f"v{i}" for i in used],
                            handleInvalid="keep", dropLast=True).fit(last)
        vectors = VectorAssembler(inputCols=[f"v{i}" for i in used], outputCol=out).transform(hot.transform(own))
        return vectors.select(key, out)


def positions(vector: str) -> "F.Column":
    """Positions of a vector column that are not zero, without making it dense."""
    v = F.unwrap_udt(F.col(vector))
    dense = F.filter(F.transform(v["values"], lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return F.when(v["type"] == 0, v["indices"]).otherwise(dense)
