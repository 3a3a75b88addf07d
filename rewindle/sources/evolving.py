"""A table whose columns may be replaced, and which still reads as of any version with the columns it had then."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.versions import as_of, change_feed_diff
from rewindle.sources.changelog import ChangeLog

_SCHEMAS = "version bigint, place int, id int, name string, type string"


@dataclass(frozen=True)
class EvolvingTable:
    """Rows by key in a change log whose columns are numbered, and for each version the names and types of its numbers.

    A number is never used for another column: a renamed column keeps its number, so its values stay where they are; a new column, or one
    of another type, gets a new number, and one that is left out keeps its values for the versions that had it. A version counts once
    its columns are recorded, which happens after its rows are written.
    """

    path: str
    keys: tuple[str, ...]

    def _recorded(self, spark: SparkSession) -> DataFrame:
        path = f"{self.path}/columns"
        spark.createDataFrame([], _SCHEMAS).coalesce(1).write.mode("append").parquet(path)
        return spark.read.schema(_SCHEMAS).parquet(path)

    def head(self, spark: SparkSession) -> int:
        """The newest version, -1 for a table that was never written."""
        newest = self._recorded(spark).agg(F.max("version")).first()[0]
        return -1 if newest is None else newest

    def _columns(self, spark: SparkSession, version: int) -> list[tuple[int, str, T.DataType]]:
        """Number, name and type of each column at a version: as many rows as the table has columns."""
        rows = self._recorded(spark).where(F.col("version") == version).orderBy("place").collect()
        return [(r.id, r.name, T._parse_datatype_json_string(r.type)) for r in rows]

    def _log(self, columns: list[tuple[int, str, T.DataType]]) -> ChangeLog:
        return ChangeLog(f"{self.path}/log", T.StructType([T.StructField(f"c{i}", kind) for i, _, kind in columns]))

    def _numbered_keys(self, columns: list[tuple[int, str, T.DataType]]) -> list[str]:
        by_name = {name.lower(): i for i, name, _ in columns}
        return [f"c{by_name[k.lower()]}" for k in self.keys]

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table as it was at ``version`` (``None``: now), with its columns of that time."""
        head = self.head(spark)
        version = head if version is None else version
        if not 0 <= version <= head:
            raise ValueError(f"the table has no version {version}")
        columns = self._columns(spark, version)
        rows = as_of(self._log(columns).read(spark, end=version), self._numbered_keys(columns), version)
        return rows.select(*[F.col(f"c{i}").alias(name) for i, name, _ in columns])

    def replace(self, spark: SparkSession, rows: DataFrame, renamed: Mapping[str, str] | None = None) -> int:
        """Make ``rows`` the table, its columns included, as a new version, and return that.

        Columns are those of before where name and type agree; ``renamed`` gives the old name of a column under its new one. Only
        rows that differ are written. The keys must stay; a key that repeats fails the job.
        """
        old_name = {k.lower(): v.lower() for k, v in (renamed or {}).items()}
        missing = {k.lower() for k in self.keys} - {c.lower() for c in rows.columns}
        if missing:
            raise ValueError(f"the rows lack the keys {sorted(missing)}")
        head = self.head(spark)
        before = self._columns(spark, head) if head >= 0 else []
        known = {(name.lower(), kind): i for i, name, kind in before}
        used = self._recorded(spark).agg(F.max("id")).first()[0]
        following = 0 if used is None else used + 1
        columns = []
        for field in rows.schema:
            name = old_name.get(field.name.lower(), field.name.lower())
            number = known.get((name, field.dataType))
            if number is None:
                if field.name.lower() in {k.lower() for k in self.keys} and before:
                    raise ValueError(f"the key {field.name} changed its type")
                number, following = following, following + 1
            columns.append((number, field.name, field.dataType))
        log = self._log(columns)
        new = rows.select(*[F.col(f"`{name}`").alias(f"c{i}") for i, name, _ in columns])
        keys = self._numbered_keys(columns)
        if head < 0:
            log.create(spark)
            changes = new
        else:
            there = {i for i, _, _ in before}
            held = as_of(self._log(before).read(spark, end=head), keys, head)
            kept = [F.col(f"c{i}") if i in there else F.lit(None).cast(kind).alias(f"c{i}") for i, _, kind in columns]
            changes = change_feed_diff(held.select(*kept), new, keys)
        version = head + 1
        log.append(changes, version, "replace", version)
        recorded = [(version, place, i, name, kind.json()) for place, (i, name, kind) in enumerate(columns)]
        spark.createDataFrame(recorded, _SCHEMAS).coalesce(1).write.mode("append").parquet(f"{self.path}/columns")
        return version
