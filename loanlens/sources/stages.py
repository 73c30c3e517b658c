"""Stage outputs: derived tables written once as Parquet and read back.

The reference persists its cleaned table between notebooks; we do the same
so that a query with several branches (statistics pass, counting pass,
bucket offsets...) reads a narrow, column-pruned Parquet table instead of
re-running the scan + join + fill lineage in every branch. This also cuts
the lineage: a lost executor recomputes from the stage table.

Stage tables live under the shared ``spark.checkpoint.dir`` and are keyed
by the input files' path, size and modification time, so a changed input
gives a new stage. Set ``loanlens.stages.enabled=false`` to plan everything
from the raw scans.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.session import scratch_path


#: Raise it when the stages' code changes, so that older tables in a shared folder are not read.
VERSION = "3"


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem handle (classic sessions); None under Spark Connect."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None, None
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def input_stamp(spark: SparkSession, paths: list[str]) -> str:
    """Path, length and modification time of every file of the inputs, and the version of the stages."""
    parts = [VERSION]
    for path in paths:
        p, fs = _fs(spark, path)
        if fs is not None:
            files = fs.listFiles(p, True)
            while files.hasNext():
                st = files.next()
                parts.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
        else:  # file listing through the binaryFile source; ``content`` is pruned, not read
            rows = (spark.read.format("binaryFile").load(path)
                    .selectExpr("sum(length) AS n", "max(modificationTime) AS t").collect())
            parts.append(f"{path}:{rows[0]['n']}:{rows[0]['t']}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    done, fs = _fs(spark, path + "/_SUCCESS")
    if fs is not None:
        return bool(fs.exists(done))
    try:
        spark.read.parquet(path).schema  # noqa: B018 - listing only
        return True
    except Exception:  # noqa: BLE001 - missing path
        return False


def enabled(spark: SparkSession) -> bool:
    return spark.conf.get("loanlens.stages.enabled", "true").lower() == "true"


_LOCKS: dict[str, threading.RLock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.RLock:
    """One re-entrant lock per stage path: a stage may build from other stages."""
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.RLock())


def stage(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Return the stage table ``name`` for ``inputs``, writing it on first use.

    The table is written to a temporary sibling and renamed into place, so a
    reader never sees a half-written stage and two concurrent builders do not
    corrupt each other (the loser's copy is removed).
    """
    if not enabled(spark):
        return build()
    path = scratch_path(spark, f"stage-{name}-{input_stamp(spark, inputs)}")
    with _lock_for(path):
        if not _exists(spark, path):
            tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
            build().write.mode("overwrite").parquet(tmp)
            src, fs = _fs(spark, tmp)
            if fs is None:  # Spark Connect: no file system handle; read the temp copy
                return spark.read.parquet(tmp)
            dst, _ = _fs(spark, path)
            if not fs.rename(src, dst):  # another builder won: keep theirs
                fs.delete(src, True)
    return spark.read.parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once under the shared folder and read it back.

    For tables that several branches of one plan read (a histogram, its cuts):
    no branch computes it again, and all branches see the same rows whichever
    task is repeated. ``drop_written`` deletes them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _WRITTEN.setdefault(scratch_path(spark, ""), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables ``written`` so far; results that still read them must be finished. Returns their number."""
    paths = _WRITTEN.pop(scratch_path(spark, ""), [])
    for path in paths:
        p, fs = _fs(spark, path)
        if fs is not None:
            fs.delete(p, True)
    return len(paths)
