"""Forests too large for the driver: their trees stay in the shared folder, cut into pieces.

The driver holds the top of the trees, which it grew by passes, and the number
of the piece under each of its leaves. A piece is what one task grew: a row
with its nodes. To predict, records go down the top in blocks, meet their
piece by its number (a shuffle), and the leaf values of a block meet again in
the trees' order, so a probability is the same to the last bit as that of a
model held whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.grow import Nodes, by_number
from loanlens.operators.trees import BLOCK, binned_values
from loanlens.session import ensure_checkpoint_dir, scratch_path
from loanlens.sources.stages import written

SLICE = 1 << 20         # records that meet a piece at once
PIECES = "piece int, tree int, feature binary, cut binary, left binary, gain binary, value binary"
_TYPES = {"feature": np.int32, "cut": np.int16, "left": np.int32, "gain": np.float32, "value": np.float64}
_ROUTED = "piece int, tree int, block long, at binary, x binary, row binary"
_PARTS = "block long, tree int, at binary, value binary, row binary"


def share(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted share of class 1 among the records of nodes; 0 without records."""
    positive = b * w[1]
    total = a * w[0] + positive
    return np.divide(positive, total, out=np.zeros(len(total)), where=total > 0)


def _rows(numbers: list[int], sub: Nodes, tree: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
    """A row of each piece of a batch; a piece's children stay side by side."""
    order = np.argsort(sub.root, kind="stable")
    start = np.searchsorted(sub.root[order], np.arange(len(numbers) + 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    left = np.where(sub.feature >= 0, place[sub.left] - start[sub.root], 0)
    value = share(sub.a, sub.b, w)
    cells = {"feature": sub.feature, "cut": sub.cut, "left": left, "gain": sub.gain, "value": value}
    for i, number in enumerate(numbers):
        at = order[start[i]:start[i + 1]]
        yield (number, int(tree[number]), *(bytearray(cells[f][at].astype(t).tobytes()) for f, t in _TYPES.items()))


def keep(spark: SparkSession, grow, weights: np.ndarray, trees: int, edges: list[list[float]]) -> "PiecesModel":
    """The forest that ``grow`` grows, its pieces written; ``grow`` takes what is to be done with them."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex[:12]}")

    def kept(grown, tree: np.ndarray, closed: list[tuple[list[int], Nodes]]) -> None:
        rows = grown.flatMap(lambda g: _rows(*g, tree, weights))
        spark.createDataFrame(rows, PIECES, verifySchema=False).write.parquet(path)
        leaves = [r for g in closed for r in _rows(*g, tree, weights)]      # of the top
        if leaves:
            spark.createDataFrame(leaves, PIECES).coalesce(1).write.mode("append").parquet(path)
    top, number = grow(kept)
    return PiecesModel(path, {"feature": top.feature, "cut": top.cut, "left": top.left, "gain": top.gain, "root": top.root, "number": number},
                       trees, edges)


def _route(top: dict, trees: int, edges: list[list[float]]):
    cuts = [np.array(e, np.float64) for e in edges]
    nodes = Nodes(None, None, None, None, top["feature"], top["cut"], top["left"], None)
    number, schema = top["number"], ["piece", "tree", "block", "at", "x", "row"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = binned_values(b.column(1), b.num_rows, cuts)
            row = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, b.num_rows, BLOCK):
                some, ids = np.ascontiguousarray(x[:, lo:lo + BLOCK]), row[lo:lo + BLOCK]
                records = np.ascontiguousarray(some.T)
                for tree in range(trees):
                    piece, at, xs, rows = [], [], [], []
                    for p, mine in by_number(number[nodes.walk(some, np.array([tree]))[0]]):
                        piece.append(p)
                        at.append(mine.astype(np.int32).tobytes())
                        xs.append(records[mine].tobytes())
                        rows.append(ids[mine].tobytes() if tree == 0 else None)
                    n = len(piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(piece, pa.int32()), pa.array([tree] * n, pa.int32()), pa.array([int(ids[0])] * n, pa.int64()),
                         pa.array(at, pa.binary()), pa.array(xs, pa.binary()), pa.array(rows, pa.binary())], names=schema)
    return route


def _walked(dim: int):
    def walked(records: pa.Table, piece: pa.Table) -> pa.Table:
        """Leaf values of the records that met a piece; a piece that grew from no record is not written, its value is 0."""
        read = {f: np.frombuffer(piece.column(f)[0].as_py(), t) for f, t in _TYPES.items() if f != "gain"} if piece.num_rows else None
        nodes = read and Nodes(None, None, None, None, read["feature"], read["cut"], read["left"], None)
        value = []
        for at, cell in zip(records.column("at"), records.column("x"), strict=True):
            x = np.frombuffer(cell.as_py(), np.uint8).reshape(len(at.as_py()) // 4, dim).T
            found = read["value"][nodes.walk(np.ascontiguousarray(x), np.zeros(1, np.int64))[0]] if read else np.zeros(x.shape[1])
            value.append(found.tobytes())
        return pa.table({"block": records.column("block"), "tree": records.column("tree"), "at": records.column("at"),
                         "value": pa.array(value, pa.binary()), "row": records.column("row")})
    return walked


def _summed(parts: pa.Table) -> pa.Table:
    """Sums of a block's leaf values, tree by tree."""
    at = [np.frombuffer(c.as_py(), np.int32) for c in parts.column("at")]
    tree = parts.column("tree").to_numpy()
    n = sum(len(a) for a, t in zip(at, tree, strict=True) if t == 0)
    total, row = np.zeros(n), np.zeros(n, np.int64)
    for i in np.argsort(tree, kind="stable").tolist():
        total[at[i]] += np.frombuffer(parts.column("value")[i].as_py(), np.float64)
        if tree[i] == 0:
            row[at[i]] = np.frombuffer(parts.column("row")[i].as_py(), np.int64)
    return pa.table({"_row": row, "_total": total})


class PiecesModel(Model, MLWritable, MLReadable):
    """A forest in the shared folder; adds the columns of ``TreesModel``.

    ``transform`` writes the rows' sums, so it takes a batch (a stream calls it by ``foreachBatch``).
    """

    def __init__(self, path: str = "", top: "dict[str, np.ndarray] | None" = None, trees: int = 0, edges: "list[list[float]] | None" = None):
        super().__init__()
        self.path, self.top, self.num_trees, self.edges = path, top or {}, trees, edges or []

    @property
    def num_features(self) -> int:
        return len(self.edges)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()      # the numbers stay
        slices = max(1, -(-rows.count() // SLICE))
        routed = (rows.select("_row", vector_to_array("features").alias("x")).mapInArrow(_route(self.top, self.num_trees, self.edges), _ROUTED)
                  .withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")))
        pieces = (spark.read.schema(PIECES).parquet(self.path).drop("gain", "tree")
                  .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
        parts = (routed.groupBy("piece", "slice").cogroup(pieces.groupBy("piece", "slice"))
                 .applyInArrow(_walked(self.num_features), _PARTS))
        sums = written(parts.groupBy("block").applyInArrow(_summed, "_row long, _total double"), "forest-sums")
        p = F.col("_total") / F.lit(float(max(1, self.num_trees)))
        return (rows.join(sums, "_row").drop("_row")
                .withColumn("_raw", array_to_vector(F.array(-F.col("_total"), F.col("_total"))))
                .withColumn("_prob", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("_pred", F.when(p >= 0.5, 1.0).otherwise(0.0)).drop("_total"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as pyspark.ml names it
        """Share of the gain of each feature; every tree counts alike."""
        from loanlens.operators.forest import shares
        n, dim = self.num_trees, self.num_features

        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, feature, gain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    feature, gain = np.frombuffer(feature, np.int32), np.frombuffer(gain, np.float32)
                    at = feature >= 0
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                                                      pa.array(np.bincount(feature[at], gain[at], dim).astype(np.float64))], names=["tree", "feature", "gain"])
        out, inner = np.zeros((n, dim)), self.top["feature"] >= 0
        np.add.at(out, (self.top["root"][inner], self.top["feature"][inner]), self.top["gain"][inner].astype(np.float32))
        pieces = SparkSession.active().read.schema(PIECES).parquet(self.path).select("tree", "feature", "gain")
        for r in pieces.mapInArrow(gains, "tree int, feature int, gain double").groupBy("tree", "feature").agg(F.sum("gain").alias("g")).collect():
            out[r["tree"], r["feature"]] += r["g"]      # a row a tree and feature
        return DenseVector(shares(out))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PiecesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"trees": m.num_trees, "edges": m.edges})
        rows = [(i, *v) for i, v in enumerate(zip(*(m.top[f].tolist() for f in _TOP), strict=True))]     # the top, which the driver holds
        spark.createDataFrame(rows, _TOP_ROWS).coalesce(1).write.parquet(f"{path}/top")
        spark.read.schema(PIECES).parquet(m.path).write.parquet(f"{path}/pieces")


_TOP = ("feature", "cut", "left", "gain", "root", "number")
_TOP_ROWS = "node int, feature long, cut long, left long, gain double, root long, number long"


class _Reader(MLReader):
    def load(self, path: str) -> PiecesModel:
        meta, spark = DefaultParamsReader.loadMetadata(path, self.sparkSession), self.sparkSession
        top = spark.read.schema(_TOP_ROWS).parquet(f"{path}/top").toPandas().sort_values("node")
        return PiecesModel(f"{path}/pieces", {f: top[f].to_numpy() for f in _TOP}, int(meta["trees"]), meta["edges"])
