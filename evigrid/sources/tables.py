"""Reading the catalogue's tables, and the session's settings."""
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Up to so many rows a dimension may be broadcast; above, joins are left to the planner.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; counting stops there."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def session(name: str = "evigrid", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the jobs are tested under."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate())


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder that the session names. A local session without one gets a
    temporary folder; on a cluster, where executors could not see it, that is an error."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, below the one that the session names."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept_once(df: DataFrame, tag: str) -> DataFrame:
    """df written to a new folder below the shared one and read back: computed once, however often it is used."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a query's shuffle files go when the query has ended: for rounds that write their results out.
    Nothing may be persisted there, as it could not be computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
