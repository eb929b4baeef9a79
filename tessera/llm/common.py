"""What the operators of this package share: inputs, staged tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Options of a write that leave out checksum files in local folders; other file systems don't read them.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's Parquet data, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df in the shared folder and read it back.

    The table survives the loss of executors, and its rows stay as they were
    written even if a part of the plan above it is run twice. Local folders get
    no checksum files: without its native library Hadoop starts a process to set
    the mode of each file and folder, which holds the JVM's memory too until it runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no table still to be read is made from."""
    for t in tables:
        path = getattr(t, "staged_at", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, made without Python workers: Spark would start some apart from those of mapInArrow, and keep them."""
    fields = StructType.fromDDL(schema)
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(to_arrow_schema(fields).types)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, names=fields.names), fields)


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column in taken has it (Spark's names don't tell case)."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def schema_of(df: DataFrame, *more: str) -> str:
    """df's columns as a schema's text, and more columns after them."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


MARKS = 8388593  # bits of the table of ids


def marks(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size with the remainders of ids (id): a sieve ahead of an exact join, which spares other rows the way through it."""
    at = F.pmod(F.col("id"), F.lit(MARKS))
    found = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((MARKS // 32768 + 2, 4096), np.uint8)
    for r in found.collect():  # at most MARKS bits
        bits[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def marked(x: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows of x (doc_id, not null) whose id has a bit."""
    at = np.mod(x.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), MARKS)
    # buckets count from 1, and each holds 32768 bits from its first byte's lowest on
    bucket, bit = np.where(at > 0, (at - 1) // 32768 + 1, 0), np.where(at > 0, (at - 1) % 32768, 0)
    return x.filter(pa.array((bits[bucket, bit >> 3] >> (bit & 7) & 1).astype(bool)))


def some_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is in ids (id), and perhaps others."""
    sent = docs.sparkSession.sparkContext.broadcast(marks(ids))

    def run(batches):
        for x in batches:
            some = marked(x, sent.value)
            if some.num_rows:
                yield some

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(lean(run), schema_of(docs))


def batch(**columns) -> pa.RecordBatch:
    """A batch from named arrays; numpy arrays are taken without a copy."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def chunks(batches, key: str, most: int | None = None, ranged: bool = False) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """A stream sorted by key in parts of at least most rows (None: any), cut between keys unless one key alone has more (None: never within a key).

    Columns, and whether the first key began in an earlier part and the last one
    goes on in a later one; ranged: tasks hold ranges of rows, so the first and
    the last key of all may as well.
    """
    held, rows, before = [], 0, ranged

    def join():
        return {c: np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in held[0].schema.names}

    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        rows += x.num_rows
        if rows < most if most else held[0].column(key)[0] == x.column(key)[-1]:
            continue
        cols = join()
        k = cols[key]
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield {c: v[:cut] for c, v in cols.items()}, before, False
            held, rows, before = [pa.RecordBatch.from_arrays([pa.array(v[cut:]) for v in cols.values()], names=list(cols))], rows - cut, False
        else:  # one key alone
            yield cols, before, True
            held, rows, before = [], 0, True
    if held:
        yield join(), before, ranged


def small_batches(spark: SparkSession) -> None:
    """Send rows with whole texts to Python in batches of at most BATCH_BYTES, so workers hold little at once.

    This is the session's setting; a smaller one is left as it is.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key, None) or "")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Functions with what a Python worker remembers for one operator's tasks (lru_cache); other operators' tasks clear them.
CACHES: list = []


def give_back(keep: tuple = ()) -> None:
    """Return to the system what earlier tasks left in this worker: caches but those in keep, and free memory that Python's and Arrow's allocators hold."""
    held = [f for f in CACHES if f not in keep and f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        gc.collect()  # caches hold methods of their owners
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable, *keep: Callable) -> Callable:
    """run, for mapInArrow, in a worker that holds nothing of earlier tasks, before and after, but the caches in keep (of CACHES).

    Spark uses workers again for all queries of a session, so each would come to
    hold the caches and the largest leftovers of every operator at once, beside an
    executor's whole heap.
    """

    def task(batches):
        own = tuple(f for f in CACHES if f.__name__ in names)  # a worker's copies, not those sent to it
        give_back(own)
        yield from run(batches)
        give_back(own)

    names = {f.__name__ for f in keep}
    return task


class Memo(dict):
    """Remembers f of short keys, at most 2 * keep of them: when full, the older half is let go."""

    def __init__(self, f: Callable, keep: int):
        super().__init__()
        self.f, self.keep, self.old = f, keep, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.f(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = found
        return found
