"""Matching on streams; the rules may change between micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import match_wide
from ..operators.rules import Manager, RuleSet
from ..sources import io


def match_stream(rows: DataFrame, rules: RuleSet, keys: list[str]) -> DataFrame:
    """(keys, rule_ids) of each row of a stream; stateless, so it has no state store and no watermark."""
    return match_wide(rows, rules, keys)


class RuleFile:
    """Live rules of a JSON file that are read again when its time has changed; a missing file changes nothing."""

    def __init__(self, spark: SparkSession, path: str, manager: Manager, on_reload: Callable[[int, int], None] | None = None):
        self.spark, self.path, self.manager, self.on_reload = spark, path, manager, on_reload
        self.last = self._time()

    def _time(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else 0

    def refresh(self) -> bool:
        """Reads the file if it is newer; whether it was."""
        now = self._time()
        if now <= self.last:
            return False
        self.last = now
        loaded, failed = self.manager.replace(io.read_rules(self.spark, self.path))
        if self.on_reload:
            self.on_reload(loaded, failed)
        return True


def match_with_reload(rows: DataFrame, source: RuleFile, keys: list[str], write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's matches by write(matches, batch id), with the rules as they are when it begins.

    A batch that is repeated after a failure has the same id, by which `write` can make its output exactly once.
    """

    def batch(df: DataFrame, number: int) -> None:
        source.refresh()
        write(match_wide(df, source.manager.live, keys), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
