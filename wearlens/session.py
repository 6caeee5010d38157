"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
#: Folders made since the innermost `written_alone` of this thread began.
_INSIDE: ContextVar[list[str] | None] = ContextVar("_INSIDE", default=None)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, name: str = "wearlens") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's own session is used as it is."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a local one is made only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="wearlens-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written table; never reused, so a retried job cannot meet older files."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    inside = _INSIDE.get()
    if inside is not None:
        inside.append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard_scratch(spark: SparkSession) -> int:
    """Remove the folders this application's queries have written for themselves; call it after the last action on them."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    _remove(spark, paths)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: computed once, safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """`written` for the rows that `make` gives. The tables it has written for itself are removed then, so no other frame may
    read them; tables made before, or by other threads, stay."""
    inside: list[str] = []
    before = _INSIDE.set(inside)
    try:
        rows = make()
    finally:
        _INSIDE.reset(before)
    kept = written(rows, name)
    _remove(spark, inside)
    made = _MADE.get(spark.sparkContext.applicationId, [])
    made[:] = [path for path in made if path not in inside]
    return kept
