"""Compaction of old days into block tables that a manifest describes.

A block holds `block_days` days. Every run writes the blocks it touches anew, old rows and new ones, into a folder of its own
(a generation); the manifest says which generation of each block counts, with the rows of each day. A run becomes visible
by one rename of the next manifest, which fails if that version exists already. What fails before the rename leaves only
a folder that no manifest names; what fails after it leaves source files that the manifest names and that the next run
removes before it starts. Folder names of generations are random, so a retried task or run cannot meet older files.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .tables import CLUSTER, DATE

BLOCK = "event_block"
GENERATION = "generation"
MANIFESTS = "_manifests"
NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Store:
    """The few file operations that Spark's readers and writers do not offer, on whatever file system the path is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.files = self.path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(path)) if self.files.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, name: str) -> None:
        """Write beside the final name, then rename; raises if the final name exists."""
        draft = self.path(f"{self.root}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kinds = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self.jvm.java.lang.reflect.Array.newInstance(kinds, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, self.path(name), none)

    def remove(self, name: str, whole: bool = False) -> None:
        self.files.delete(self.path(name), whole)


def _manifest(store: Store) -> dict:
    """The newest manifest; an empty one while nothing was compacted."""
    versions = [n for n in store.names(f"{store.root}/{MANIFESTS}") if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return {"version": 0, "block_days": None, "blocks": {}, "moved": []}
    return json.loads(store.read(f"{store.root}/{MANIFESTS}/{versions[-1]}"))


def _block_rows(spark: SparkSession, store: Store, blocks: dict[str, dict]) -> DataFrame | None:
    paths = [f"{store.root}/{GENERATION}={b['generation']}/{BLOCK}={n}" for n, b in sorted(blocks.items())]
    if not paths:
        return None
    return spark.read.option("mergeSchema", True).option("basePath", store.root).parquet(*paths).drop(GENERATION)


def read_blocks(spark: SparkSession, target: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """Rows of the current generation of each block whose days meet [start, end]; None if there are none.

    A column that only some files have is null in the rows of the others.
    """
    store = Store(spark, target)
    wanted = {
        n: b for n, b in _manifest(store)["blocks"].items()
        if any((start is None or day >= start) and (end is None or day <= end) for day in b["days"])
    }
    rows = _block_rows(spark, store, wanted)
    if rows is not None and start is not None:
        rows = rows.where(F.col(DATE) >= F.lit(start).cast("date"))
    if rows is not None and end is not None:
        rows = rows.where(F.col(DATE) <= F.lit(end).cast("date"))
    return rows


def finish_moves(spark: SparkSession, target: str) -> int:
    """Remove the source files that the newest manifest has taken in; after a run that ended between its two steps they are
    still there. Files are named singly, so rows that reached a moved day later stay. Returns files removed."""
    store, done = Store(spark, target), 0
    folders = set()
    for name in _manifest(store)["moved"]:
        path = store.path(name)
        files = path.getFileSystem(store.conf)
        done += bool(files.delete(path, False))
        folders.add(path.getParent().toString())
    for name in folders:
        folder = store.path(name)
        files = folder.getFileSystem(store.conf)
        if files.exists(folder) and not files.listStatus(folder):
            files.delete(folder, False)
    return done


def _old_days(spark: SparkSession, source: str, cutoff: str) -> tuple[DataFrame | None, list[str]]:
    """Rows and files of the days before the cutoff, as they are listed now; files that come later are not among them."""
    try:
        table = spark.read.option("mergeSchema", True).parquet(source)
    except AnalysisException as error:
        if error.getCondition() not in NO_TABLE:
            raise
        return None, []
    days = [r[0] for r in table.where(F.col(DATE) < F.lit(cutoff).cast("date")).select(DATE).distinct().collect()]  # one value per calendar day
    if not days:
        return None, []
    listed = spark.read.option("mergeSchema", True).option("basePath", source).parquet(*[f"{source.rstrip('/')}/{DATE}={d}" for d in days])
    return listed, listed.inputFiles()


def _counted(rows: DataFrame) -> dict[str, int]:
    return {r[0].isoformat(): r[1] for r in rows.groupBy(DATE).count().collect()}


def compact_before(spark: SparkSession, source: str, target: str, cutoff: str, block_days: int = 30) -> int:
    """Move the rows of the days before `cutoff` into zstd files, one folder per block of `block_days` days. Returns rows moved.

    Any sequence of cutoffs keeps every row and every column. Rows that arrive in a day after it was moved are taken in by the
    next run. The source loses its files only after the new manifest counts. An empty or absent source changes nothing;
    another `block_days` than the target's raises, and so does a second run that publishes the same version.
    """
    store = Store(spark, target)
    finish_moves(spark, target)
    before = _manifest(store)
    if before["block_days"] not in (None, block_days):
        raise ValueError(f"{target} has blocks of {before['block_days']} days, not {block_days}.")
    fresh, moved = _old_days(spark, source, cutoff)
    if fresh is None:
        return 0
    added = _counted(fresh)
    block_of = {day: str((date.fromisoformat(day) - date(1970, 1, 1)).days // block_days) for day in added}
    touched = {n: b for n, b in before["blocks"].items() if n in block_of.values()}
    rows = fresh.withColumn(BLOCK, F.floor(F.unix_date(DATE) / block_days).cast("int"))
    stored = _block_rows(spark, store, touched)
    if stored is not None:
        rows = stored.unionByName(rows, allowMissingColumns=True)
    generation = uuid.uuid4().hex
    folder = f"{store.root}/{GENERATION}={generation}"
    (
        rows.repartitionByRange(BLOCK, DATE, *CLUSTER).sortWithinPartitions(BLOCK, *CLUSTER)
        .write.option("compression", "zstd").partitionBy(BLOCK).parquet(folder)
    )
    blocks: dict[str, dict] = {}
    for day, n in [*added.items(), *((d, n) for b in touched.values() for d, n in b["days"].items())]:
        block = block_of.get(day) or str((date.fromisoformat(day) - date(1970, 1, 1)).days // block_days)
        days = blocks.setdefault(block, {"generation": generation, "days": {}})["days"]
        days[day] = days.get(day, 0) + n
    found = _counted(spark.read.option("mergeSchema", True).parquet(folder))
    if found != {d: n for b in blocks.values() for d, n in b["days"].items()}:
        raise RuntimeError(f"{folder} does not hold all rows before {cutoff}; {source} and {target} are left as they are.")
    after = {"version": before["version"] + 1, "block_days": block_days, "blocks": before["blocks"] | blocks, "moved": moved}
    store.publish(json.dumps(after), f"{store.root}/{MANIFESTS}/{after['version']:09d}.json")
    finish_moves(spark, target)
    return sum(added.values())


def discard_generations(spark: SparkSession, target: str) -> int:
    """Remove the folders that the newest manifest does not name, once no reader or run uses them. Returns folders removed."""
    store = Store(spark, target)
    kept = {f"{GENERATION}={b['generation']}" for b in _manifest(store)["blocks"].values()}
    gone = [n for n in store.names(store.root) if n.startswith(f"{GENERATION}=") and n not in kept]
    for name in gone:
        store.remove(f"{store.root}/{name}", whole=True)
    return len(gone)
