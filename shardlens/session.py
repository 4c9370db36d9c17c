"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job wants, whatever cluster it lands on.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even when the split costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_DEFAULTS`` where neither the cluster nor the session has chosen something else.

    A setting counts as chosen if its value is not Spark's own default, however it was set.
    """
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    defaults = spark._jvm.org.apache.spark.sql.internal.SQLConf()
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in given and spark.conf.get(key) == defaults.getConfString(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shardlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall back on a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="shardlens-")
    return _LOCAL["folder"]


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# Where tables are large: input, as stored, of one partition of a shuffle before adaptive execution merges small ones, and
# what it merges them to.  Shuffled rows are compressed several times over, so a task holds far more than it reads.
BYTES_A_PARTITION, MOST_PARTITIONS, MERGED = 4 * 2**20, 8192, "12MB"
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
MERGED_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_WIDENED: dict[str, set[str]] = {FIRST_PARTITIONS: set(), MERGED_SIZE: set()}


def first_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle begins with, for work that adaptive execution does not reach."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(FIRST_PARTITIONS, None) or 0))


def widened(spark: SparkSession) -> int:
    """Partitions that ``widen`` has chosen, 0 where tables are small."""
    now = spark.conf.get(FIRST_PARTITIONS, None)
    return int(now) if now in _WIDENED[FIRST_PARTITIONS] else 0


def widen(spark: SparkSession, folder: str) -> None:
    """Let shuffles have more and smaller partitions where the tables in ``folder`` are large.

    With a fixed number a task's share, and its memory, grows with the input.  A value that the cluster or the session
    has chosen stays.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = min(MOST_PARTITIONS, stored // BYTES_A_PARTITION)
    large = wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    defaults = spark._jvm.org.apache.spark.sql.internal.SQLConf()
    for key, value in ((FIRST_PARTITIONS, str(wanted)), (MERGED_SIZE, MERGED)):
        now = spark.conf.get(key, None)
        ours = now in _WIDENED[key]
        if not ours and now is not None and (key == FIRST_PARTITIONS or now != defaults.getConfString(key)):
            continue
        if large:
            _WIDENED[key].add(value)
            spark.conf.set(key, value)
        elif ours:
            spark.conf.unset(key)
