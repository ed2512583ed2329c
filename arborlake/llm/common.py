"""What several operators of this package share: scratch space and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and give checkpoints a folder.

    A cluster sets ``spark.checkpoint.dir``; only a local session without one gets
    a folder of its own.
    """
    context = spark.sparkContext
    context.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    scratch_root(spark)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share for written intermediates."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='arborlake-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back, which cuts lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/arborlake/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame,
    per_batch: Callable[[pa.RecordBatch], dict[str, object]],
    schema: str,
) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = per_batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [_as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _as_arrow(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows and bytes up to which a small side is broadcast after it was counted.
_BROADCAST_ROWS, _BROADCAST_BYTES = 100_000, 32 << 20


def if_small(side: DataFrame, size: Column | None = None) -> tuple[DataFrame, bool]:
    """A checkpointed side, marked for broadcast if its counted rows are few; and whether they are.

    size: bytes of a row where rows can be large.
    """
    side = side.checkpoint()
    rows, size_sum = side.agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    small = rows <= _BROADCAST_ROWS and (size_sum or 0) <= _BROADCAST_BYTES
    return (F.broadcast(side) if small else side), small


def sampled_per_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of key: a bounded, repeatable sample.

    The classes are counted first (one small aggregate) and each row compares its hash
    with its class's rate, so no class is gathered in one task.  The counts are broadcast
    where classes are few, so that rows stay where they are.  A null label has no rows.
    """
    prepare(rows.sparkSession)
    counts, _ = if_small(rows.groupBy(F.col(label).alias("__class")).agg(F.count(F.lit(1)).alias("__n")))
    unit = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.join(counts, F.col(label) == F.col("__class")).where(unit * F.col("__n") < most).drop("__class", "__n")


#: Scaled components beyond this count as this, so that integers and their sums stay exact.
_FARTHEST = 1 << 58


def scaled(
    vectors: DataFrame, vector: str, factor: float, dim: int | None = None, extra: dict[str, Column] | None = None
) -> tuple[DataFrame, int | None]:
    """(extra columns, x) with x = floor(factor * component) as integers, and x's length.

    Vectors that are null, empty or hold null or non-finite components are left out, and
    so are those of another length than dim (by default the commonest; of equally common
    ones the shortest).  Components beyond 2 ** 58 in size count as 2 ** 58.
    """
    slim = vectors.select(*[c.alias(name) for name, c in (extra or {}).items()], F.col(vector).cast("array<double>").alias("__v"))
    bad = F.exists("__v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = slim.where(F.col("__v").isNotNull() & (F.size("__v") > 0) & ~bad)
    if dim is None:
        lengths = whole.groupBy(F.size("__v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
        common = lengths.orderBy(F.desc("n"), "dim").first()
        dim = common["dim"] if common else None
    edge = F.lit(_FARTHEST)
    whole_part = lambda c: F.greatest(F.least(F.floor(c * factor), edge), -edge)
    x = F.transform("__v", whole_part).alias("x")
    return whole.where(F.size("__v") == (dim or 0)).select(*(extra or {}), x), dim
