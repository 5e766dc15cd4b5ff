"""Changes of a folder as a stream: a Python data source whose offset numbers listings and whose batches are their differences.

A listing is (path, length, time of change) of every file that counts. Asked for the latest offset, the source lists the folder; if
anything differs from the last listing, that one is written to the state folder and gets the next number. A batch is the difference of
two listings, one row per path: added, modified or deleted. So a file that is written again, goes, or comes back is an event each time, and
a restart from a checkpoint goes on from the listing that the checkpoint names. Listings that are committed over are removed.

The folder and the state are read by the driver, by a plain path or any URI that pyarrow knows; contents are not read.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.corpus import INDEX_FOLDER

# Folders whose changes do not count.
IGNORED = rf"(?:^|/)(?:\.git|{INDEX_FOLDER.replace('.', chr(92) + '.')}|node_modules|dist|build|out|target|coverage|vendor|generated|\.generated)(?:/|$)"
NAME, SCHEMA = "graphloom_changes", "path string, change string, ts timestamp"
#: Changed paths that one partition of a batch holds.
PART = 10_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(root: str) -> dict[str, tuple[int, int]]:
    """path below root -> (length, nanoseconds of the last change); files that go meanwhile stay out."""
    store, base = _at(root)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    ignored, cut = re.compile(IGNORED), len(base.rstrip("/")) + 1
    return {p: (i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and not ignored.search(p := i.path[cut:].replace("\\", "/"))}


def difference(before: dict, after: dict) -> list[tuple[str, str]]:
    """(path, change) in order of path."""
    gone = [(p, "deleted") for p in before.keys() - after.keys()]
    return sorted(gone + [(p, "added" if p not in before else "modified") for p, seen in after.items() if before.get(p) != seen])


@dataclass
class Changes(InputPartition):
    rows: list[tuple[str, str]]
    ts: float


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"], options["state"].rstrip("/")
        self.store, self.base = _at(self.state)
        self.store.create_dir(self.base, recursive=True)

    def _file(self, n: int) -> str:
        return f"{self.base}/listing-{n:012d}.json"

    def _read(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        with self.store.open_input_stream(self._file(n)) as f:
            return {p: tuple(seen) for p, seen in json.loads(f.read())["files"].items()}

    def _last(self) -> int:
        names = [i.base_name for i in self.store.get_file_info(fs.FileSelector(self.base)) if i.base_name.startswith("listing-") and i.base_name.endswith(".json")]
        return max((int(n[8:-5]) for n in names), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last, now = self._last(), listing(self.root)
        if (now if last == 0 else now != self._read(last)) if last or now else False:
            last += 1
            with self.store.open_output_stream(f"{self._file(last)}.part") as f:
                f.write(json.dumps({"files": now, "at": time.time()}).encode())
            self.store.move(f"{self._file(last)}.part", self._file(last))
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["listing"] == end["listing"]:
            return []
        rows, now = difference(self._read(start["listing"]), self._read(end["listing"])), time.time()
        return [Changes(rows[i : i + PART], now) for i in range(0, len(rows), PART)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        ts = datetime.fromtimestamp(partition.ts, UTC).replace(tzinfo=None)
        for path, change in partition.rows:
            yield path, change, ts

    def commit(self, end: dict) -> None:
        for n in range(end["listing"] - 1, 0, -1):
            if self.store.get_file_info(self._file(n)).type == fs.FileType.NotFound:
                break
            self.store.delete_file(self._file(n))


class ChangeSource(DataSource):
    """Options: path, the folder to watch, and state, a folder for its listings."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def change_events(spark: SparkSession, root: str, state: str) -> DataFrame:
    """A stream (path, change, ts) of the files below root that are added, modified or deleted; the first batch has all that are there."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(NAME).option("state", state).load(root)
