"""Helpers shared by the training-data operators: tables, lineage cuts and distributed prefix sums."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without; a cluster
    where it is unset is an error, since its executors would not see the driver's own folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='breakline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: short lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/breakline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever case it is compared in."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Files up to which their numbers are broadcast to the rows.
BROADCAST_FILES = 100_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, the same in every read, and its name.

    Rows of a table read from files are numbered by their file and their place in it, which depend neither on how the
    files are split nor on how many executors there are. Any other result is written once, and read from there.
    """
    name = fresh(docs, "row")
    plain = docs._jdf.queryExecution().analyzed().children().isEmpty()  # a read without joins or other steps after it
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name}_f"), F.col("_metadata.row_index").alias(f"{name}_i")) if plain else None
    except AnalysisException:
        placed = None
    if placed is None:
        return numbered(cut(docs, "rows"))
    files = placed.select(f"{name}_f").distinct()
    files = cut(files.select(f"{name}_f", F.row_number().over(Window.orderBy(f"{name}_f")).cast("long").alias(f"{name}_n")), "files")  # a row for each file
    own = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    return placed.join(own, f"{name}_f").select(*docs.columns, (F.col(f"{name}_n") * (1 << 40) + F.col(f"{name}_i")).alias(name)), name


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """``df`` with, for each of ``sums``, the total of the rows that stand before a row in ``order`` (exclusive).

    Two passes and no global window: rows are dealt by range of ``order``, each range is summed by itself, and the
    ranges' own totals (one row per partition) are added up. Ties in ``order`` must be broken by the caller. The
    dealt rows are written out once, so the ranges cannot differ between the passes.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_o_{k}") for k, c in sums.items()])
    out = own.join(F.broadcast(starts), "_part", "left")  # one row per partition
    return out.select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])
