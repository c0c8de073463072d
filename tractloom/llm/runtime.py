"""What the operators share: reading tables, Arrow passes with carried columns, shared folders, folds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Set only where the session names no folder, as in tests.
TEST_CHECKPOINTS = "/tmp/checkpoints/tractloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        where = TEST_CHECKPOINTS
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends; what it wrote is all that later steps read. The session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tractloom-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._stored_path = path
    return got


def discarded(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, which at its end returns what it freed to the system: Spark keeps Python workers between tasks, beside those of the next."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return f


def fold(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def held_out(modulus: int, remainder: int = 2) -> Column:
    """Whether a document is kept from training: a row without id is, since it can't be labelled."""
    return F.coalesce(fold(modulus) == remainder, F.lit(True))


#: Rows in an Arrow batch of texts. Spark's own default is meant for short rows; it is only replaced where nobody chose another.
BATCH_ROWS, DEFAULT_ROWS = 2000, 10000


def short_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def arrow_pass(
    df: DataFrame,
    inputs: dict[str, Column],
    carry: Iterable[str],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    out: T.StructType,
) -> DataFrame:
    """One narrow pass over df: carried columns come back, and after them the results as one struct, named by out_name().

    make() runs once per task and returns the function that is called with each Arrow batch of the inputs.
    On the way carried columns are numbered inside a struct, so no name of theirs can clash with a result's.
    """
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    names = list(carry)
    ins = list(inputs)
    src = df.select(F.struct(F.lit(0).alias("c"), *carried).alias("_row"), *[inputs[k].alias(f"i{i}") for i, k in enumerate(ins)])
    schema = T.StructType([src.schema["_row"], T.StructField("_out", out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if not b.num_rows:
                continue
            got = f(pa.RecordBatch.from_arrays([b.column(i + 1) for i in range(len(ins))], names=ins))
            o = pa.StructArray.from_arrays([_as(got[x.name], x.dataType) for x in out.fields], names=[x.name for x in out.fields])
            yield pa.RecordBatch.from_arrays([b.column(0), o], names=["_row", "_out"])

    short_batches(df.sparkSession)
    done = src.mapInArrow(given_back(run), schema)
    return done.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)], F.col("_out").alias(out_name(names)))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _as(values: object, kind: T.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    name = kind.simpleString()
    if name.startswith("array<"):
        return pa.array(values, pa.list_(_ARROW[name[6:-1]]))
    return pa.array(values, _ARROW[name])


def out_name(carry: Iterable[str]) -> str:
    """_out, with as many more underscores as it takes to differ from all carried columns."""
    name, taken = "_out", {c.lower() for c in carry}
    while name in taken:
        name += "_"
    return name


def result(df: DataFrame, field: str) -> Column:
    """A field of the results of arrow_pass()."""
    return F.col(f"`{df.columns[-1]}`.{field}")


def flat(df: DataFrame) -> DataFrame:
    """Results beside the carried columns."""
    return df.select(*[f"`{c}`" for c in df.columns[:-1]], f"`{df.columns[-1]}`.*")
