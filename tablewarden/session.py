"""Session helpers: sizes Spark already knows, and the shared folder for written intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tablewarden", **extra: str) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    Only a session that runs on one machine may go without it; there a temporary folder is set.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablewarden-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """What a write shuffles inside is deleted as it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there, for plans that use it several times.

    Unlike a checkpoint this computes ``df`` only once, keeps columns apart, and gives the optimiser the real size.  Nothing reads the
    shuffles of the write again, so they are deleted at once.
    """
    path = fresh_path(df.sparkSession, "stage")
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(stored)
    return stored


@contextmanager
def stages_pass():
    """What ``cut_lineage`` writes inside is deleted at the end, but for what is taken out of the list this gives."""
    made: list[DataFrame] = []
    token = _PASSING.set(made)
    try:
        yield made
    finally:
        _PASSING.reset(token)
        drop_stages(*made)


def drop_stages(*stored: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for these, once all that was made from them is stored itself."""
    for df in stored:
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
        for folder in folders:
            if "/stage-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df``, taken from the optimised plan without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts by itself (``spark.sql.autoBroadcastJoinThreshold``)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for suffix, factor in units.items():
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)]) * factor)
    return int(text)
