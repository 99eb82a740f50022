"""What the text operators share: reading tables, tables written to the shared folder, batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kindred.plans.scratch import shared_dir

#: Texts handed to one numpy step hold about so many characters at most, or are a single text.
BATCH_CHARS = 4_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_kindred_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="kindred-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/kindred.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/kindred.zip")
    context._kindred_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, rows: int | None = None, per_task: int = 50_000) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and later readers of it survive lost executors. It stays until `discard`.

    rows: how many it has at most, if that is known; its last stage then takes a task for `per_task` of them, so that small tables aren't small files by the hundred.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(8, -(-rows // per_task)))
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made. Nothing that is read later may stand on them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t._kindred_path)
        path.getFileSystem(conf).delete(path, True)


def _release() -> None:
    """Gives freed memory back to the system: Python workers live on, and what they hold would stand in later stages' way."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run) on workers that have this package, which free their memory at a task's end."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: int, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows of a batch, so that a step never holds more than `chars` of text beyond one row's."""
    out: list[str | None] = []
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        n = len(text or "")
        if out and size + n > chars:
            yield start, out
            out, start, size = [], i, 0
        out.append(text)
        size += n
    if out:
        yield start, out


def byte_slices(column: pa.StringArray, size: int) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, rows) of consecutive rows of a column of strings, of about `size` bytes at most or a single row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def chunks(items: list, n: int) -> Iterable[list]:
    return (items[i : i + n] for i in range(0, len(items), n))


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it while a column of the frames has it, in whatever case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, more: str) -> DataFrame:
    """df without columns of the names that a DDL string is about to add: what an operator adds replaces a column of that name."""
    return df.drop(*(f.name for f in StructType.fromDDL(more).fields))


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of df with the columns of a DDL string after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
