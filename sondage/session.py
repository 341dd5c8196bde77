"""Session settings, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Rows that one Python task or one packed row handles at a time.
BLOCK_ROWS = 2048
# Bytes of a value that is sent to every executor on purpose.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of a part below which a table is not spread further, and above which it is, however few cores there are.
PART_ROWS, MOST_PART_ROWS = 4096, 200_000
# The setting under which a query is made whose shuffle files go at its end; threads share a session's settings.
SHUFFLES_GO, _ASKING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()


def local_session(cores: str = "*", name: str = "sondage") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_slots(spark: SparkSession) -> int:
    """Tasks that can run at one time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, int(context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sondage-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


# Folders of the checkpoints made since the round of a loop began; None outside of loops.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _passing(df: DataFrame) -> DataFrame:
    """The same rows by a query whose shuffle files Spark removes as it ends; others stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    with _ASKING:
        before = conf.get(SHUFFLES_GO, "false")
        conf.set(SHUFFLES_GO, "true")
        try:
            return df.select("*")
        finally:
            conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read back from reliable storage, so loops keep short plans; what was shuffled for them is not kept beside."""
    ensure_checkpoint_dir(df.sparkSession)
    out, made = _passing(df).checkpoint(eager=True), _MADE.get()
    if made is not None:
        made += _folder(out)
    return out


def _folder(df: DataFrame) -> list[str]:
    """Where a table lies that is a checkpoint and nothing more."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return []
    found = plan.rdd().getCheckpointFile()
    return [found.get()] if found.isDefined() else []


class Rounds:
    """Checkpoints of a loop: what a round leaves behind goes at its end; of the tables that rounds hand on the last two stay.

    The newest table is complete before an older one goes, and the one before it stays for readers that still hold it.
    A loop within a round leaves its last two tables to that round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    @contextmanager
    def round(self) -> Iterator[None]:
        made: list[str] = []
        token = _MADE.set(made)
        try:
            yield
        finally:
            _MADE.reset(token)
            old, self.tables = self.tables[:-2], self.tables[-2:]
            outer = _MADE.get()
            if outer is not None:
                outer += [f for f in self.tables if f not in outer]
            for folder in dict.fromkeys([*made, *old]):
                if folder not in self.tables:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def hand_on(self, df: DataFrame) -> DataFrame:
        """The rows as the table that the next round starts from; a checkpoint of this round is not written again."""
        made = _MADE.get() or []
        out = df if any(f in made for f in _folder(df)) else cut_lineage(df)
        self.tables += _folder(out)
        return out


def spread(df: DataFrame) -> DataFrame:
    """The same rows in enough parts for all cores: a file of one row group is one part, whatever is derived from its rows.

    Rows are dealt evenly, not by a key; a table that has the parts already, or few rows, stays as it is.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-rows // PART_ROWS), 3 * cores), -(-rows // MOST_PART_ROWS))
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES
