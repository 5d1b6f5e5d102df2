"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; only where that is unset, one of our own (tests on local[n])."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: executors share no other folder with the driver")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="inkwell-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return f"file://{_OWN['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"inkwell-{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner clears it
            if path.startswith("file://"):
                shutil.rmtree(path[7:], True)

    atexit.register(remove)


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name that starts like ``wanted[0]`` and clashes with no column of ``df`` nor with the rest of ``wanted``."""
    name, taken = wanted[0], {c.lower() for c in (*df.columns, *wanted[1:])}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, work) -> DataFrame:
    """df.mapInArrow(work) with df's own schema, whatever the columns' names: work sees them by position."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(work, plain.schema).toDF(*df.columns)


#: Bytes of text that a worker handles at once; a longer text is a slice of its own.
SLICE = 1 << 21


def text_slices(batch, column: int = 1, size: int | None = None):
    """(slice of the batch, its texts without nulls) of about ``size`` (SLICE) bytes of text each, so that what a worker holds does not follow the batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(column), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + (size or SLICE), side="right")))
        some = texts.slice(a, b - a)
        # offsets of 32 bits would not hold what becomes of a text near their limit
        yield batch.slice(a, b - a), some.cast(pa.large_string()) if int(ends[b - 1]) - base > 1 << 28 else some
        a = b


_OWNER: dict[str, object] = {}


def own_worker(name: str, clear) -> None:
    """Python workers live on from task to task and stage to stage. Memory that the task before has freed is given back to the system, and the caches of
    another operator that ran here before are dropped first."""
    import ctypes
    import gc

    import pyarrow as pa

    if _OWNER.get("name") != name:
        if "clear" in _OWNER:
            _OWNER["clear"]()
        _OWNER.update(name=name, clear=clear)
        gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
        trim(0)


def summed(rows, blocks: int):
    """The sum of arrays of counts, rows (number, places, values) of in_blocks(): {number: (places, sums)}.

    Blocks are added up as they stream by, one array for each block at a time, so memory does not follow the number of rows. What comes to the driver is one
    array for each block, together as large as one of the arrays that are added.
    """
    import numpy as np
    import pyarrow as pa

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, size, places, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(values.as_buffer(), "<u4")
                own = held.setdefault(number, np.zeros(size, np.int64))
                if len(x) == size:
                    own += x
                else:
                    own[np.frombuffer(places.as_buffer(), "<u4")] += x  # places are distinct
        for number, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "places": [at.astype("<u4").tobytes()], "values": [x[at].astype("<i8").tobytes()]})

    found = rows.repartition(blocks, "number").mapInArrow(add, "number int, places binary, values binary").collect()
    return {r.number: (np.frombuffer(r.places, "<u4").astype(np.int64), np.frombuffer(r.values, "<i8")) for r in found}


BLOCK_ROWS = "number int, size int, places binary, values binary"


def in_blocks(x, blocks: int):
    """The rows of summed() for an array of counts under 2 ** 32: whole blocks, or places and values where under a third of a block is not zero."""
    import numpy as np
    import pyarrow as pa

    places, values, sizes = [], [], []
    for part in np.array_split(x.reshape(-1), blocks):
        at = np.flatnonzero(part)
        dense = 3 * len(at) >= len(part)
        sizes.append(len(part))
        places.append(b"" if dense else at.astype("<u4").tobytes())
        values.append((part if dense else part[at]).astype("<u4").tobytes())
    return pa.RecordBatch.from_pydict({"number": pa.array(range(blocks), pa.int32()), "size": pa.array(sizes, pa.int32()), "places": places, "values": values})


def whole(found, size: int, blocks: int):
    """The array that in_blocks() has parted, from summed()."""
    import numpy as np

    parts = np.array_split(np.zeros(size, np.int64), blocks)
    for number, (at, x) in found.items():
        parts[number][at] = x
    return np.concatenate(parts)
