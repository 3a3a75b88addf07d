"""The stream reader behind ``feed``: a table's rows first, then its changes, version by version.

The classes go to Spark's Python workers by value, so they use nothing else of this package.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "rewindle_feed"
_VERSION = "_commit_version"
#: A file of more bytes is read by several tasks, each with some of its row groups.
SPLIT = 128 << 20


def _store(path: str):
    """The file system a path belongs to, and the path there."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    path: str
    version: int
    first: int | None = None
    last: int | None = None


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, dict(self.options.items()))


class FeedReader(DataSourceStreamReader):
    """Offsets are ``{"snapshot": files read, "version": the last version read}``.

    While files of the snapshot are left, an offset moves on in them alone; then it moves from version to
    version. A version counts once its write is complete, and is never split between batches. The next
    offset starts from the newest one in the checkpoint, so a restart goes on in either phase.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.types = schema.json()
        get = {k.lower(): v for k, v in options.items()}
        self.log, self.snapshot, self.checkpoint = get["log"], get.get("snapshot"), get["checkpoint"]
        self.base = int(get["base"])
        self.max_files, self.max_versions = (int(get.get(k, 0)) or None for k in ("maxfiles", "maxversions"))

    def _list(self, path: str, deep: bool = True) -> list:
        from pyarrow import fs

        store, inner = _store(path)
        return store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=deep))

    def _data(self, path: str) -> list:
        """Complete parquet files below ``path``, in the order of their names."""
        found = self._list(path)
        done = {f.path.rsplit("/", 1)[0] for f in found if f.base_name == "_SUCCESS"}
        keep = lambda f: f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._"
        whole = lambda f: f.path.rsplit("/", 1)[0] in done or "/_writer=load/" in f.path
        return sorted((f for f in found if keep(f) and whole(f)), key=lambda f: f.path)

    def _versions(self) -> list[int]:
        folders = [re.fullmatch(rf"{_VERSION}=(\d+)", f.base_name) for f in self._list(self.log, False) if not f.is_file]
        return sorted(int(m[1]) for m in folders if m)

    def recorded(self, committed: bool = False) -> dict:
        """The newest offset in the checkpoint, planned or ``committed``, or where a new stream begins."""
        kind = "commits" if committed else "offsets"
        batches = [int(f.base_name) for f in self._list(f"{self.checkpoint}/{kind}", False) if f.base_name.isdigit()]
        if not batches:
            return self.initialOffset()
        store, path = _store(self.checkpoint)
        with store.open_input_stream(f"{path}/offsets/{max(batches)}") as file:
            return json.loads(file.read().decode().splitlines()[2])

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "version": self.base}

    def latestOffset(self) -> dict:
        at = self.recorded()
        files = len(self._data(self.snapshot)) if self.snapshot else 0
        if at["snapshot"] < files:
            return {"snapshot": min(files, at["snapshot"] + (self.max_files or files)), "version": at["version"]}
        later = [v for v in self._versions() if v > at["version"]]
        while later and not self._data(f"{self.log}/{_VERSION}={later[-1]}"):
            later.pop()  # still being written
        later = later[: self.max_versions]
        return {"snapshot": at["snapshot"], "version": later[-1] if later else at["version"]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        if end["snapshot"] > start["snapshot"]:
            for f in self._data(self.snapshot)[start["snapshot"] : end["snapshot"]]:
                parts += self._split(f, self.base)
        for version in self._versions():
            if start["version"] < version <= end["version"]:
                for f in self._data(f"{self.log}/{_VERSION}={version}"):
                    parts += self._split(f, version)
        return parts

    def _split(self, file, version: int) -> list[Part]:
        if file.size <= SPLIT:
            return [Part(file.path, version)]
        from pyarrow import parquet

        store, _ = _store(self.log)
        groups = parquet.ParquetFile(store.open_input_file(file.path)).num_row_groups
        step = max(1, groups * SPLIT // file.size)
        return [Part(file.path, version, i, min(groups, i + step)) for i in range(0, groups, step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(StructType.fromJson(json.loads(self.types)))
        store, _ = _store(self.log)
        file = parquet.ParquetFile(store.open_input_file(partition.path), coerce_int96_timestamp_unit="us")
        there = {n.lower(): n for n in file.schema_arrow.names}
        groups = None if partition.first is None else list(range(partition.first, partition.last))
        asked = [there[n.lower()] for n in self.names if n.lower() in there]
        for batch in file.iter_batches(8192, row_groups=groups, columns=asked):
            columns = []
            for field in want:
                if field.name == _VERSION:
                    column = pa.array([partition.version] * batch.num_rows, field.type)
                elif field.name.lower() in there:
                    column = batch.column(there[field.name.lower()]).cast(field.type)
                else:
                    column = pa.nulls(batch.num_rows, field.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, schema=want)
