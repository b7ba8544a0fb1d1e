"""What the operators of this subpackage share: tables, keys, components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: ASCII white space, as in ``[^\x20\x09-\x0D]+`` for words; ``bytes.split()``
#: splits on the same six characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine that names none (tests, a laptop) gets a temporary
    one; on a cluster that is an error, as executors don't share such a folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    chosen = context._jsc.sc().getCheckpointDir()
    if not found and chosen.isDefined():
        return chosen.get().rstrip("/")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or "file://" + tempfile.mkdtemp(prefix="talusgrid-")
    if not chosen.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths in the shared folder that this process has written.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/talusgrid/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later reads start from the files, so a lost executor costs a read, not the
    work that made the rows. ``clear`` deletes the files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many paths ``new_path`` has given out and ``clear`` has not deleted."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what ``table`` and ``new_path`` wrote after the first ``since`` paths, but for the last ``keep``.

    Results are read lazily: call it once they are written elsewhere.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    upto = len(_WRITTEN) - keep
    for gone in _WRITTEN[since:upto]:
        path = jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(conf).delete(path, True)
    del _WRITTEN[since:upto]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches, as one text can be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pieces_for(size: int, each: int) -> int:
    """How many parts of about ``each`` a total of ``size`` makes, one at least."""
    return max(1, math.ceil((size or 0) / each))


def row_key(id_col: Column, text: Column) -> tuple[Column, Column]:
    """Two longs that tell rows apart: the id (null: the least long) and a hash.

    Rows repeated with the same id and text share a key, so they share every
    result that is joined back by it.
    """
    return (
        F.coalesce(id_col.cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(id_col.cast("long"), text).alias("_h"),
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as ``(node, root)``.

    Alternates large-star and small-star steps: each links nodes straight to
    the least neighbour they know of, by one grouping and one join, until
    nothing changes. No component is ever gathered in one place; only the two
    counters that tell whether links changed reach the driver. ``root`` is the
    least node of a component. Nodes without links don't appear.

    The least neighbours are written before they are joined: both sides of the
    join are then shuffled for it alone, so that Spark can split the partition
    of a node with very many neighbours.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
        .checkpoint()
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        return row["n"], row["s"]

    seen = mark(links)
    while seen[0]:
        # large star: every larger neighbour of u goes to u's least neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = table(
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct(),
            "large",
        )
        # small star: u and its smaller neighbours go to the least of them
        low = table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = small.checkpoint()
        now = mark(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def numbered(df: DataFrame, group: list[str], order: list[str], column: str, few: bool = False) -> DataFrame:
    """Rows with their place in their group, gapless from 0, ordered by ``order``, nulls first.

    One sort by range over all tasks: a group that holds a third of the rows is
    spread like any other, and rows that are equal in all keys are spread by
    where they were read. A row's place is its place in its partition, moved by
    the rows that its group has in partitions before. The sorted rows are
    written, so partitions stay as they are when executors are lost. The moves
    have at most a row for each partition and group; ``few`` says that groups
    are few, and only then are they broadcast. Group columns must not be null.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*group, *order]] + [F.col("_numbered_read")]
    read = df.withColumn("_numbered_read", F.monotonically_increasing_id())
    sorted_ = read.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_numbered_read")
    rows = table(
        sorted_.withColumn("_numbered_part", F.spark_partition_id()).withColumn(
            "_numbered_at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
        ),
        "numbered",
    )
    before = Window.partitionBy(*group).orderBy("_numbered_part").rowsBetween(Window.unboundedPreceding, -1)
    moves = (
        rows.groupBy("_numbered_part", *group)
        .agg(F.min("_numbered_at").alias("_numbered_first"), F.count("*").alias("_numbered_n"))
        .select(
            "_numbered_part", *group, (F.coalesce(F.sum("_numbered_n").over(before), F.lit(0)) - F.col("_numbered_first")).alias("_numbered_move")
        )
    )
    joined = rows.join(F.broadcast(moves) if few else moves, ["_numbered_part", *group])
    return joined.select(*df.columns, (F.col("_numbered_at") + F.col("_numbered_move")).alias(column))
