"""File-change streams: debounced change sets, branch switches, and micro-batch runs."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.window import Window

QUIET = "500 milliseconds"
# Limits of a watch: files a batch, and folders that are never watched.
MAX_FILES, MAX_DEPTH = 1000, 10
SKIPPED = (".git", "node_modules", ".siltstone")


def file_stream(spark: SparkSession, root: str, extensions: list[str] | None = None, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """New files under a folder, at most so many folders deep, as a stream of (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    skipped = "|".join(re.escape(name) for name in SKIPPED)
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(root)
    below = F.substring_index("path", root.rstrip("/").removeprefix("file:").rstrip("/") + "/", -1)
    return files.filter(~F.col("path").rlike(f"/(?:{skipped})/") & (F.size(F.split(below, "/")) - 1 <= max_depth))


def debounced(events: DataFrame, keys: list[str], time_col: str, item_col: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Sets of items that changed together: sessions that end after a quiet gap.

    Works on batches and, with a watermark, on streams (append mode).
    """
    source = events.withWatermark(time_col, watermark) if watermark else events
    window = F.session_window(time_col, gap)
    out = source.groupBy(*keys, window).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item_col)).alias("items"))
    return out.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n", "items")


def branch_changes(heads: DataFrame, keys: list[str], time_col: str, branch_col: str) -> DataFrame:
    """Rows at which the branch differs from the one before: (keys, time, from, to)."""
    order = Window.partitionBy(*keys).orderBy(time_col)
    before = F.lag(branch_col).over(order)
    return heads.withColumn("from_branch", before).filter(F.col("from_branch").isNotNull() & (F.col("from_branch") != F.col(branch_col))).select(
        *keys, time_col, "from_branch", F.col(branch_col).alias("to_branch")
    )


class Watcher:
    """Runs a function over each micro-batch's distinct paths; can pause and resume.

    While paused, changes stay in the source; on resume the same checkpoint picks
    them up at once. Batches run one after another, so none is lost.
    """

    def __init__(self, stream: DataFrame, path_col: str, checkpoint: str, on_change: Callable[[DataFrame], None], extensions: list[str] | None = None, interval: str | None = QUIET):
        self.stream, self.path_col, self.checkpoint, self.on_change, self.interval = stream, path_col, checkpoint, on_change, interval
        self.extensions = extensions
        self.query: StreamingQuery | None = None

    def _batch(self, batch: DataFrame, _: int) -> None:
        paths = batch.select(self.path_col).distinct()
        if self.extensions:
            paths = paths.filter(F.regexp_extract(self.path_col, r"\.([^./]*)$", 1).isin(self.extensions))
        if not paths.isEmpty():
            self.on_change(paths)

    def start(self) -> StreamingQuery:
        """Begin, or go on where the checkpoint ended."""
        writer = self.stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        writer = writer.trigger(processingTime=self.interval) if self.interval else writer.trigger(availableNow=True)
        self.query = writer.start()
        return self.query

    resume = start

    def pause(self) -> None:
        """Stop after the running batch."""
        if self.query is not None:
            self.query.stop()
            self.query = None


class BranchSwitch:
    """Indexes anew when the branch changes: the watcher pauses, the whole index is made, the watcher goes on.

    What changes meanwhile waits in the stream's source; the watcher resumes
    even if indexing fails.
    """

    def __init__(self, watcher: Watcher, reindex: Callable[[str], None], branch: str | None = None):
        self.watcher, self.reindex, self.branch = watcher, reindex, branch

    def saw(self, branch: str) -> bool:
        """Take note of the branch; true if it changed and the index was made anew."""
        if branch == self.branch:
            return False
        before, self.branch = self.branch, branch
        if before is None:
            return False
        self.watcher.pause()
        try:
            self.reindex(branch)
        finally:
            self.watcher.resume()
        return True


class ReloadMetrics:
    """Counters of reloads: how many, how many failed, the last duration and error."""

    def __init__(self) -> None:
        self.reloads = self.failures = 0
        self.last_ms, self.last_error = 0.0, ""

    def record(self, took_ms: float, error: Exception | None = None) -> None:
        self.reloads += 1
        self.failures += error is not None
        self.last_ms, self.last_error = took_ms, str(error or "")

    def snapshot(self) -> dict:
        """The counters as a dict."""
        return dict(vars(self))


class ProgressLog(StreamingQueryListener):
    """The last events of streaming queries, in a ring that drops the oldest."""

    def __init__(self, size: int = 10) -> None:
        self.events: deque[dict] = deque(maxlen=size)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.events.append({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.events.append({"event": "progress", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.events.append({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.events.append({"event": "ended", "id": str(event.id), "error": event.exception})
