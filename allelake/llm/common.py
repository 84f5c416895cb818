"""Shared plumbing of the training-data operators: staging in the shared folder, file systems, text chunks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about this many bytes, which bounds a task's memory whatever the batch holds.
CHUNK_BYTES = 1 << 18
#: An Arrow batch carries about so many bytes at most to a worker or back (a longer row makes one of its own).
BATCH_BYTES = 4 << 20
#: What workers keep between tasks, by the operator that keeps it, and how it is given up.
_KEPT: dict[str, Callable[[], None]] = {}
_WORK: list[str] = []


def kept(owner: str, clear: Callable[[], None]) -> None:
    """State that ``owner``'s functions find again in the next task, until a worker runs another operator's function."""
    _KEPT[owner] = clear


def _enter(owner: str | None) -> None:
    for name, clear in _KEPT.items():
        if name != owner:
            clear()


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except OSError:
        return None


def _leave() -> None:
    """Give freed memory back to the system: a worker outlives the stage it was made for."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def mapped(run, schema, owner: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """``mapInArrow`` for ``DataFrame.transform``, in batches bounded by bytes and in workers that keep ``owner``'s state alone.

    Lowers the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to ``BATCH_BYTES`` if it is larger.
    """

    def lean(batches):
        _enter(owner)
        try:
            yield from run(batches)
        finally:
            _leave()

    def apply(df: DataFrame) -> DataFrame:
        bound_batches(df.sparkSession)
        return df.mapInArrow(lean, schema)

    return apply


def bound_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).lower().removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A session in one process that has none gets a temporary one, removed when the process ends; any other is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="allelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own for one run of an operator; ``discard_work`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WORK.append(path)
    return path


def work_dirs() -> list[str]:
    """The folders that runs in this process have made and ``discard_work`` has not removed."""
    return list(_WORK)


def discard_work(spark: SparkSession, keep: list[str] | None = None) -> int:
    """Remove what operators have staged in their work folders, but for ``keep``; gives the number of folders.

    Results of operators read their staged tables: write a result out before its folders go. ``keep`` are folders whose
    results are still needed, as ``work_dirs`` gave them earlier.
    """
    gone = [x for x in _WORK if x not in set(keep or [])]
    for x in gone:
        discard(spark, x)
        _WORK.remove(x)
    return len(gone)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here and no lost executor makes it run again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (``file://``, ``file:/``, ``hdfs://``, ``s3://``) or of an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def remainder_of_crc32(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus`` (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def chunks(text: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of about ``most`` bytes; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64, len(text) + 1, text.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
