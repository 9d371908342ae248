"""Session settings, and tables written between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


SHUFFLE_PARTITION_BYTES = 128 << 20
#: Reducers at most: the driver keeps a size per mapper and reducer, and fetches get tiny.
MOST_SHUFFLE_PARTITIONS = 20_000


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for an input of that size.

    The largest shuffle moves the text once, so partitions of the size of an input
    split do up to some terabytes; beyond, partitions grow instead of their number
    (5 GB at 100 TB), which sorts and aggregates spill through. Adaptive execution
    merges those that turn out small.
    """
    return min(MOST_SHUFFLE_PARTITIONS, max(200, -(-input_bytes // SHUFFLE_PARTITION_BYTES)))


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes under the paths, as the file systems' own summaries give them."""
    total = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return total


def build_session(
    app_name: str = "lexitally", master: str | None = None, expected_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution and UTC; anything else is left to the cluster.

    Give ``expected_bytes`` for large inputs, or set the partitions once the input's
    size is known: Spark's default of 200 is meant for some gigabytes.
    """
    if expected_bytes is not None:
        conf.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions(expected_bytes)))
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """The shared folder for tables between steps.

    It is the folder the session names in ``spark.checkpoint.dir``, else the
    checkpoint folder set on the context, else a folder in the warehouse. All three
    are configured by whoever runs the cluster; nothing is written elsewhere.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return warehouse.rstrip("/") + "/_staged"


def stage_path(spark: SparkSession) -> str:
    """A new, unused path under the stage root."""
    return "/".join([stage_root(spark), spark.sparkContext.applicationId, uuid.uuid4().hex])


def stage(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as a table in the shared folder and return the written table.

    The lineage ends there, so later steps neither recompute it nor lose it with
    an executor, and the planner sees its true size. ``metrics`` are aggregates
    taken while writing, without a job of their own.
    """
    path = stage_path(df.sparkSession)
    seen = None
    if metrics:
        seen = Observation()
        df = df.observe(seen, *[m.alias(name) for name, m in metrics.items()])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get if seen else {})


def stage_buckets(df: DataFrame, buckets: int, by: str, sort: str) -> DataFrame:
    """Write ``df``, which is partitioned by ``by`` into that many partitions, as a table bucketed by it.

    What groups or joins the written table by that column needs no exchange. Files are sorted by
    another column, so that a filter on it skips what it does not want. Spark takes buckets from a
    catalog only, so the table has an entry there while it is written; its files lie with the other
    staged tables.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).sortBy(sort).option("path", stage_path(spark)).saveAsTable(name)
    table = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return table


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this application has staged; for the end of a run."""
    place = spark._jvm.org.apache.hadoop.fs.Path("/".join([stage_root(spark), spark.sparkContext.applicationId]))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_single_file(df: DataFrame, *cols: str) -> DataFrame:
    """Hash a table of one file, which one task may have to read, over all cores.

    A large table is many files and is returned as it is, whatever the cluster's size.
    """
    return df.repartition(*cols) if len(df.inputFiles()) == 1 else df
