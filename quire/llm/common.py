"""Shared helpers of the training-data operators.

Tables between the steps of an operator are written to the shared folder that
the cluster names in ``spark.checkpoint.dir`` and read back, so that a lost
executor costs only its running tasks. ``drop`` removes such a table once
nothing reads it any more.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import shared_path


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package where no path is set for them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table and its path.

    The shuffle files behind it aren't needed any more. Spark deletes them once
    the driver's garbage collection has seen that, which is asked for here, as
    on a large disk share they would otherwise add up over the steps.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that this run wrote to the shared folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: a path as it is, or a public tokenizer's name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` text bytes, to bound a task's arrays."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 byte strings; null is empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name).cast(pa.binary()), b"").to_pylist()


#: What Python keeps of a remembered pair beside its bytes: two object heads and the place in the table.
_PAIR = 170


def _length(value) -> int:
    """Bytes or characters of a string; a number is counted with its object head."""
    return len(value) if hasattr(value, "__len__") else 0


class Remembered(dict):
    """Values of ``make(key)``, strings, byte strings or numbers, for about ``most`` bytes of them. When full, the later half
    goes: frequent keys are met early."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        if self.held >= self.most:
            for late in list(self)[len(self) // 2:]:
                del self[late]
            self.held = sum(_length(k) + _length(v) for k, v in self.items()) + _PAIR * len(self)
        value = self[key] = self.make(key)
        try:
            self.held += len(key) + len(value) + _PAIR
        except TypeError:  # a number
            self.held += _length(key) + _length(value) + _PAIR
        return value


_KEPT: dict = {}


def once(key: tuple, make: Callable):
    """``make()`` once for each Python worker, for as long as the worker does the same work: a worker serves one
    operator after the other, and one operator's tables must not fill the memory of the next."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives up what earlier operators have left in this Python worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
