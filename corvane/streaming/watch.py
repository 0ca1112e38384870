"""A folder as a stream of changes: a source whose offsets are listings, and a window of quiet before a change counts."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupStateTimeout

EVENT = "path string, type string, size long, modified long, listing long"
PARTS = 8


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


class Slice(InputPartition):
    def __init__(self, start: int, end: int, part: int) -> None:
        self.start, self.end, self.part = start, end, part


class ListingReader(DataSourceStreamReader):
    """An offset is the number of a listing, kept as Parquet in the folder `state`; a batch is how one listing became the other."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.pattern, self.ignore = options.get("pattern", "*"), options.get("ignore", "")
        self.known: int | None = None

    def _file(self, n: int) -> tuple[pafs.FileSystem, str]:
        fs, base = _open(self.state)
        return fs, f"{base}/{n:012d}.parquet"

    def _listed(self, n: int) -> dict[str, tuple[int, int]]:
        fs, file = self._file(n)
        if n == 0 or fs.get_file_info(file).type == pafs.FileType.NotFound:
            return {}
        t = pq.read_table(file, filesystem=fs)
        return dict(zip(t["path"].to_pylist(), zip(t["size"].to_pylist(), t["modified"].to_pylist())))

    def _now(self) -> dict[str, tuple[int, int]]:
        fs, base = _open(self.path)
        files = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        named = {f.path[len(base) :].lstrip("/"): (f.size, f.mtime_ns or 0) for f in files if f.is_file}
        return {p: v for p, v in named.items() if fnmatch.fnmatch(p.rsplit("/", 1)[-1], self.pattern) and not (self.ignore and re.search(self.ignore, p))}

    def _last(self) -> int:
        """The last listing kept: of a stream that ran before, too."""
        fs, base = _open(self.state)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return max((int(f.base_name.split(".")[0]) for f in found if re.fullmatch(r"\d{12}\.parquet", f.base_name)), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self._last()
        now = self._now()
        if now != self._listed(self.known):
            fs, file = self._file(self.known + 1)
            fs.create_dir(file.rsplit("/", 1)[0], recursive=True)
            rows = sorted(now)
            pq.write_table(pa.table({"path": pa.array(rows, pa.string()), "size": pa.array([now[p][0] for p in rows], pa.int64()), "modified": pa.array([now[p][1] for p in rows], pa.int64())}), f"{file}.tmp", filesystem=fs)
            fs.move(f"{file}.tmp", file)
            self.known += 1
        return {"listing": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(start["listing"], end["listing"], k) for k in range(PARTS)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        import zlib

        for n in range(partition.start + 1, partition.end + 1):
            old, new = self._listed(n - 1), self._listed(n)
            for p in sorted(old.keys() | new.keys()):
                if zlib.crc32(p.encode()) % PARTS == partition.part and old.get(p) != new.get(p):
                    kind = "add" if p not in old else "delete" if p not in new else "change"
                    yield (p, kind, *new.get(p, (None, None)), n)

    def commit(self, end: dict) -> None:
        """Listings before the committed one are not read again."""
        fs, base = _open(self.state)
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if re.fullmatch(r"\d{12}\.parquet", f.base_name) and int(f.base_name[:12]) < end["listing"] - 1:
                fs.delete_file(f.path)


class ListingSource(DataSource):
    """Format `listing`. Options: path; state, a folder that driver and executors share, of this stream alone; pattern of file names; ignore, a pattern of paths."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(dict(self.options))


def file_events(spark: SparkSession, path: str, state: str, pattern: str = "*", ignore: str = "") -> DataFrame:
    """EVENT rows of a folder, as a stream: every file once as an add, then what changes."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").options(path=path, state=state, pattern=pattern, ignore=ignore).load()


# what a change makes of one that still waits; None: as if nothing had been
FOLD = {("add", "change"): "add", ("add", "delete"): None, ("change", "change"): "change", ("change", "delete"): "delete", ("delete", "add"): "change", ("delete", "change"): "change"}


def quiet_changes(events: DataFrame, quiet_ms: int = 250) -> DataFrame:
    """path, type, size, modified: what became of a file once nothing has happened to it for `quiet_ms`, one row for all its events till then."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, size, modified = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "type": [kind], "size": pd.array([size], "Int64"), "modified": pd.array([modified], "Int64")})
            return
        waiting = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("listing")
        for kind, size, modified in zip(rows["type"], rows["size"], rows["modified"]):
            folded = FOLD.get((waiting[0], kind), kind) if waiting else kind
            waiting = None if folded is None else (folded, None if pd.isna(size) else int(size), None if pd.isna(modified) else int(modified))
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update(waiting)
            state.setTimeoutDuration(quiet_ms)
        yield from ()

    out = "path string, type string, size long, modified long"
    return events.groupBy("path").applyInPandasWithState(run, out, "type string, size long, modified long", "append", GroupStateTimeout.ProcessingTimeTimeout)
