"""Revisioned windows as Parquet: each append is a folder of its own, complete once its manifest stands; which append counts is the control store's matter."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, CubeError
from .control import ControlStore


class WindowStore:
    """Tables of one cube under ``root``: ``states`` (window_id, revision, run_id and the states) and ``registry``."""

    def __init__(self, spark: SparkSession, root: str, cube: str, control: ControlStore):
        self.spark, self.cube, self.control = spark, cube, control
        self.base = f"{root.rstrip('/')}/{_safe(cube)}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def create(self) -> None:
        """Makes the tables' folders; again is no change."""
        for name in ("states", "registry"):
            fs, p = self._fs(f"{self.base}/{name}")
            fs.mkdirs(p)

    def _folder(self, table: str, window: str, revision: int, run_id: str) -> str:
        return f"{self.base}/{table}/{_safe(window)}/r{revision}/{_safe(run_id)}"

    def append(self, window: str, revision: int, run_id: str, states: DataFrame, registry: DataFrame) -> int:
        """Registry first, then states, clustered by day and sorted; returns the snapshot. A folder without manifest is a failed try and is written anew."""
        if self.snapshot_of(window, revision, run_id) is not None:
            raise ConflictError("DuplicateAppend", f"run {run_id!r} has appended window {window!r} already")
        registry.select("xunit_id", "xunit_canonical").distinct().write.mode("overwrite").parquet(self._folder("registry", window, revision, run_id))
        tagged = states.select(F.lit(window).alias("window_id"), F.lit(revision).cast("long").alias("revision"), F.lit(run_id).alias("run_id"), "*")
        tagged = tagged.withColumn("bucket_day", F.to_date("bucket_start"))
        place = self._folder("states", window, revision, run_id)
        tagged.repartitionByRange("bucket_day", "xunit_id").sortWithinPartitions("bucket_day", "bucket_start", "xunit_id").write.mode("overwrite").partitionBy("bucket_day").parquet(f"{place}/data")
        snapshot = zlib.crc32(f"{self.cube}|{window}|{revision}|{run_id}".encode()) + (revision << 32)
        manifest = json.dumps({"window": window, "revision": revision, "run": run_id, "snapshot": snapshot})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
        return snapshot

    def snapshot_of(self, window: str, revision: int, run_id: str) -> int | None:
        """The snapshot of a finished append, or None."""
        place = f"{self._folder('states', window, revision, run_id)}/manifest"
        if not self._exists(f"{place}/_SUCCESS"):
            return None
        return json.loads(self.spark.read.text(place).first()["value"])["snapshot"]

    def _current(self, window: str) -> str:
        now = self.control.current(self.cube, window)
        if now is None:
            raise CubeError(f"window {window!r} is not published")
        return f"{self._folder('states', window, now.revision, now.run_id)}/data"

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*folders)

    def read(self, window: str) -> DataFrame:
        """Rows of the window's current revision, from the folder of its run alone."""
        return self._rows([self._current(window)])

    def read_many(self, windows: list[str]) -> DataFrame | None:
        """Rows of several windows in one scan; None of no window."""
        return self._rows([self._current(w) for w in dict.fromkeys(windows)]) if windows else None

    def visible(self) -> DataFrame:
        """All published rows: the folders of the runs that the publications name, joined with these on (window, revision, run), so that nothing else counts that a folder may hold."""
        pubs = [(w, p.revision, p.run_id) for w, p in self.control.publications(self.cube).items()]
        names = self.spark.createDataFrame(pubs, "window_id string, revision long, run_id string")
        folders = [f"{self._folder('states', *p)}/data" for p in pubs]
        every = self._rows(folders) if folders else self._rows([f"{self.base}/states"])
        return every.join(names, ["window_id", "revision", "run_id"], "left_semi")

    def registry(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.base}/registry").distinct()


def _safe(name: str) -> str:
    """A folder name: readable, and unlike that of any other name."""
    return re.sub(r"[^A-Za-z0-9_.-]", "-", name) + f"-{zlib.crc32(name.encode()):08x}"
