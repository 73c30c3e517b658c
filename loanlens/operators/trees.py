"""Binned record blocks and tree models, shared by boosting and forests."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.session import ensure_checkpoint_dir, scratch_path

MAX_BINS = 32
BLOCK = 1 << 14         # records of a block at most
PART = 1 << 16          # records of a task, where there are more tasks than cores


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def salted(mixed_key: np.ndarray, salt: int) -> np.ndarray:
    return mixed(mixed_key ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for every key and salt."""
    return (salted(mixed(key), salt) >> np.uint64(11)) * 2.0 ** -53


# ------------------------------------------------------------------ binned blocks

def bin_edges(df: DataFrame, dim: int, max_bins: int = MAX_BINS, features: str = "features") -> list[list[float]]:
    """Upper edges of the bins of every feature: its minimum and exact quantiles, without its maximum."""
    if not dim:
        return []
    values = vector_quantiles(df, dim, [i / (max_bins - 1) for i in range(max_bins)], features)
    return [sorted(set(v))[:-1] for v in values]


DIGIT = 16              # bits of a value's place that one pass settles
CHUNK = 1 << 18         # values counted together


def places(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; one zero, NaN is the largest."""
    bits = (np.where(np.isnan(v), np.nan, v) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def value_at(place: int) -> float:
    bits = np.array([place], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(np.float64)[0])


def _counted(open_: "list[np.ndarray] | None", dim: int, shift: int):
    """(feature, cell, n, least, most) of the values of a chunk in the ``open_`` cells of the pass before (None: all)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim))
                n += b.num_rows
            if n * dim >= CHUNK:
                yield count(held)
                held, n = [], 0
        if held:
            yield count(held)

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        x, out = np.concatenate(held), []
        for j in range(dim):
            if open_ is not None and not len(open_[j]):
                continue
            v = places(np.ascontiguousarray(x[:, j]))
            if open_ is not None:
                above = v >> (shift + DIGIT)
                v = v[open_[j].take(np.searchsorted(open_[j], above), mode="clip") == above]
            v.sort()
            cell = v >> shift
            first = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
            end = np.append(first[1:], len(v))[:len(first)]
            out.append((np.full(len(first), j), cell[first], end - first, v[first], v[end - 1]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)],
                                          names=["feature", "cell", "n", "least", "most"])
    return counted


def vector_quantiles(df: DataFrame, dim: int, probs: list[float], features: str = "features") -> list[list[float]]:
    """Exact quantiles of every value of a vector column, as :mod:`loanlens.operators.quantiles` gives them.

    Each pass counts the values by ``DIGIT`` more bits of their place among the doubles, only in the cells that hold a
    wanted rank, with numpy on batches (an unpivoted row a value costs several times as much); a cell of one distinct
    value is settled. Four passes reach any double. The driver sees one row for each wanted rank.
    """
    x = df.select(vector_to_array(features).alias("x")).where(F.col("x").isNotNull())
    n = x.count()
    if not n:
        return [[] for _ in range(dim)]
    ranks = sorted({r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
    todo = {(j, r): (0, r) for j in range(dim) for r in ranks}      # (cell, rank in it)
    value: dict[tuple[int, int], float] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        whole = shift == 64 - DIGIT
        open_ = None if whole else [np.array(sorted({c for (f, _), (c, _) in todo.items() if f == j}), np.int64) for j in range(dim)]
        rows = x.mapInArrow(_counted(open_, dim, shift), "feature long, cell long, n long, least long, most long")
        hist = (rows.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
                .withColumn("above", F.lit(0).cast("long") if whole else F.shiftright("cell", DIGIT)))
        run = Window.partitionBy("feature", "above").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)   # 2 ** DIGIT rows at most
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        wanted = df.sparkSession.createDataFrame([(f, c, r, whole_rank) for (f, whole_rank), (c, r) in todo.items()],
                                                 "feature long, above long, rank long, whole_rank long")
        found = (hist.join(F.broadcast(wanted), ["feature", "above"])
                 .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
                 .select("feature", "whole_rank", "cell", (F.col("rank") - F.col("before")).alias("rank"), "least", "most").collect())
        todo = {}
        for r in found:
            if r["least"] == r["most"]:
                value[r["feature"], r["whole_rank"]] = value_at(r["least"])
            else:
                todo[r["feature"], r["whole_rank"]] = r["cell"], r["rank"]
        if not todo:
            break

    def at(j: int, p: float) -> float:
        pos = (n - 1) * p
        lo, hi = math.floor(pos), math.ceil(pos)
        a, b = value[j, lo], value[j, hi]
        return a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b
    return [[at(j, p) for p in probs] for j in range(dim)]


def binned_values(cells: pa.Array, n: int, cuts: list[np.ndarray]) -> np.ndarray:
    """(features, records) bins of a column of vectors."""
    flat = cells.flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
    x = np.empty((len(cuts), n), np.uint8)
    for j, e in enumerate(cuts):
        x[j] = np.searchsorted(e, flat[:, j], side="left")
    return x


def even_tasks(parts: int, cores: int) -> int:
    """At least ``parts`` tasks: where they are more than the cores, as many on each, so that no pass ends on a few of them."""
    return parts if parts <= cores else -(-parts // cores) * cores


def _pack(edges: list[list[float]]):
    cuts = [np.array(e, np.float64) for e in edges]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = binned_values(b.column(3), b.num_rows, cuts)
            y, fold, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo in range(0, b.num_rows, BLOCK):
                s = slice(lo, lo + BLOCK)
                cells = (y[s].astype(np.uint8), fold[s].astype(np.int32), key[s].view(np.uint64), np.ascontiguousarray(x[:, s]))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["y", "fold", "key", "x"])
    return pack


@dataclass
class Block:
    """Records of one block: label, fold (-1: none), hash, bins (features x records)."""
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, r) -> "Block":
        y = np.frombuffer(r["y"], np.uint8)
        return cls(y, np.frombuffer(r["fold"], np.int32), np.frombuffer(r["key"], np.uint64),
                   np.frombuffer(r["x"], np.uint8).reshape(-1, len(y)))


@dataclass
class Binned:
    """A table written as blocks: its edges and its (fold, label) counts."""
    spark: SparkSession
    path: str
    edges: list[list[float]]
    counts: dict[tuple[int, int], int]
    parts: int

    @classmethod
    def write(cls, df: DataFrame, label: str = "label", features: str = "features", fold: str | None = None,
              key: str | None = None, max_bins: int = MAX_BINS, work: int = 1, part: int = PART) -> "Binned":
        """``key`` names a record for sampling (default: its features and label); ``work`` is the number of fits to come,
        ``part`` the number of records of a task where there are more tasks than cores."""
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        x = vector_to_array(features)
        head = df.select(F.size(x).alias("n")).head()
        edges = bin_edges(df, head["n"] if head else 0, max_bins, features)
        name = F.xxhash64(F.col(key)) if key else F.xxhash64(x, F.col(label).cast("int"))
        rows = df.select(F.coalesce(F.col(label) == 1, F.lit(False)).cast("int").alias("y"),
                         (F.lit(-1) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-1))).alias("fold"),
                         name.alias("key"), x.alias("x"))
        counts = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x 2
        n = sum(counts.values())
        cores = spark.sparkContext.defaultParallelism
        parts = even_tasks(max(1, min(-(-n * work // 250_000), max(cores, -(-n // part)))), cores)
        path = scratch_path(spark, f"binned-{uuid.uuid4().hex[:12]}")
        rows.repartition(parts).mapInArrow(_pack(edges), "y binary, fold binary, key binary, x binary").write.parquet(path)
        return cls(spark, path, edges, counts, parts)

    @property
    def bins(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges], np.int64)

    def class_counts(self, held_out: int | None) -> tuple[int, int]:
        """(negatives, positives) outside a fold."""
        return tuple(sum(n for (f, y), n in self.counts.items() if y == c and (held_out is None or f != held_out)) for c in (0, 1))

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def blocks(self):
        return self.table().coalesce(self.parts).rdd.map(Block.of)

    def delete(self, path: str | None = None) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


# ------------------------------------------------------------------ models

@dataclass
class Tree:
    """Node 0 is the root; a node's children are ``left`` and ``left`` + 1, feature -1 marks a leaf."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.feature), np.int64)
        for k in np.flatnonzero(self.feature >= 0).tolist():     # parents come before their children
            level[self.left[k]:self.left[k] + 2] = level[k] + 1
        return int(level.max(initial=0))

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        """Leaf value of records (rows x features); at or under the threshold goes left, NaN right."""
        node, record = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.value[node]
            right = ~(x[record, np.maximum(f, 0)] <= self.threshold[node])
            node = np.where(f < 0, node, self.left[node] + right)


class TreesModel(Model, MLWritable, MLReadable):
    """Trees over a ``features`` vector; adds ``_raw``, ``_prob`` and ``_pred``.

    ``link`` is "sum" (the sum of leaf values is the log-odds of class 1:
    boosting) or "mean" (their mean is its probability: forest).
    """

    def __init__(self, trees: "list[Tree] | None" = None, num_features: int = 0, link: str = "sum"):
        super().__init__()
        self.trees, self.num_features, self.link = list(trees or []), num_features, link

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaf values of records (rows x features), in single precision for log-odds."""
        out = np.zeros(len(x), np.float32 if self.link == "sum" else np.float64)
        for t in self.trees:
            out += t.leaf_values(x)
        return out.astype(np.float64)

    def _transform(self, df: DataFrame) -> DataFrame:
        total = self.total

        @F.pandas_udf("double")
        def summed(xs):
            import pandas as pd
            if len(xs) == 0:
                return pd.Series([], dtype="float64")
            return pd.Series(total(np.stack(xs.to_numpy())))
        out = df.withColumn("_raw", summed(vector_to_array(F.col("features"))))
        if self.link == "sum":
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_raw")))
        else:
            p = F.col("_raw") / F.lit(float(max(1, len(self.trees))))
        return (out.withColumn("_prob", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("_pred", F.when(p >= 0.5, 1.0).otherwise(0.0))
                .withColumn("_raw", array_to_vector(F.array(-F.col("_raw"), F.col("_raw")))))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as pyspark.ml names it
        """Share of the gain of each feature; every tree of a forest counts alike."""
        total = np.zeros(self.num_features)
        for t in self.trees:
            at = t.feature >= 0
            one = np.bincount(t.feature[at], t.gain[at], self.num_features)
            total += one / one.sum() if self.link == "mean" and one.sum() else one
        return DenseVector(total / total.sum() if total.sum() else total)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_NODES = "tree int, node int, feature int, threshold double, left int, gain double, value double"


class _Writer(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"numFeatures": m.num_features, "link": m.link})
        rows = [(i, k, *v) for i, t in enumerate(m.trees) for k, v in enumerate(zip(
            t.feature.tolist(), t.threshold.tolist(), t.left.tolist(), t.gain.tolist(), t.value.tolist(), strict=True))]
        self.sparkSession.createDataFrame(rows, _NODES).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> TreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(_NODES).parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])  # the model
        value = np.float32 if meta["link"] == "sum" else np.float64
        trees = [Tree(t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(), t["gain"].to_numpy(),
                      t["value"].to_numpy().astype(value)) for _, t in nodes.groupby("tree", sort=True)]
        return TreesModel(trees, int(meta["numFeatures"]), meta["link"])
