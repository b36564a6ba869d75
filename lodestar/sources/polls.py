"""A streaming source over landed polls: a folder with one entry a poll, whose names sort in the order they came.

An entry is a file of JSON lines or a folder of such files.

A poll asks for what is newer than the last one less a look-back, so polls overlap. The source's offset is the name of the last poll that
was read; a batch covers the polls after it, a task a poll, and only hits within the look-back of their poll's newest are taken. Replaying an offset range
gives the same rows. Overlaps are left to deduplication by key (streams.unique_mentions).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Poll(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.lookback = options["path"], int(options.get("lookback_seconds", 2 * 86_400))

    def _names(self) -> list[str]:
        from pyarrow import fs

        store, root = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=False))
        return sorted(f.base_name for f in found if f.base_name[0] not in "._")

    def _hits(self, poll: str) -> Iterator[tuple[str, int, str]]:
        """(id, time, line) of each hit of a poll; what has neither is none."""
        from pyarrow import fs

        store, root = _filesystem(self.path)
        entry = store.get_file_info(f"{root}/{poll}")
        files = [entry] if entry.is_file else store.get_file_info(fs.FileSelector(entry.path, recursive=True))
        for f in sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path):
            with store.open_input_stream(f.path) as lines:
                for x in io.TextIOWrapper(lines, "utf-8", "replace"):
                    try:
                        hit = json.loads(x)
                        yield str(hit["objectID"]), int(hit["created_at_i"]), x.rstrip("\n")
                    except (ValueError, KeyError, TypeError):
                        continue

    def initialOffset(self) -> dict:
        return {"poll": ""}

    def latestOffset(self) -> dict:
        return {"poll": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Poll]:
        return [_Poll(n) for n in self._names() if start["poll"] < n <= end["poll"]]

    def read(self, partition: _Poll) -> Iterator[tuple]:
        newest = max((t for _, t, _ in self._hits(partition.name)), default=0)
        for uid, t, x in self._hits(partition.name):
            if t >= newest - self.lookback:
                yield partition.name, uid, t, x

    def commit(self, end: dict) -> None:
        pass


class PollSource(DataSource):
    """Format landed_polls: poll, source_uid, created_at_i, value (the hit's JSON). Options: path, lookback_seconds."""

    @classmethod
    def name(cls) -> str:
        return "landed_polls"

    def schema(self) -> str:
        return "poll string, source_uid string, created_at_i long, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_polls(spark: SparkSession, path: str, lookback_seconds: int = 2 * 86_400) -> DataFrame:
    """The landed polls as a stream."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("landed_polls").option("path", path).option("lookback_seconds", str(lookback_seconds)).load()
