"""CSV files taken in as they come, with columns that appear, change their type or go missing from file to file."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rewindle.sources.files import INGEST_TIME, csv_header_schema, path_exists

RESCUED, FILE = "_rescued", "_file"
_COLUMNS = "place int, name string, type string, given boolean, batch bigint"
_NUMBER = "decimal(38,9)"
#: What a text must look like to be a value of a kind without loss, the narrowest kind first.
_KINDS = {
    "bigint": r"^(0|-?[1-9][0-9]{0,17})$",
    _NUMBER: r"^-?(0|[1-9][0-9]{0,27})(\.[0-9]{1,9})?$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$",
}


def wider(one: str | None, two: str | None) -> str | None:
    """The narrowest kind that holds the values of both; None stands for no values."""
    if one is None or two is None or one == two:
        return one or two
    return _NUMBER if {one, two} == {"bigint", _NUMBER} else "string"


@dataclass(frozen=True)
class EvolvingIngest:
    """A table of all files ever seen, and a log of its columns by batch.

    Values are kept as the text the files hold; a column's type, found from its values and widened when a batch needs it,
    is applied on reading. So a type that changes loses nothing and rewrites nothing. Columns named in ``given`` keep their
    type, and a value that does not fit is null there and stands in the map ``_rescued``. Column names count without case;
    a quote inside quotes is doubled. A batch counts once its columns are recorded, and is replaced if it is repeated.
    """

    path: str
    landing: str
    given: Mapping[str, str] = field(default_factory=dict)

    def follow(self, spark: SparkSession, max_files: int = 1000) -> StreamingQuery:
        """Take in the files that have come, each once, to the present end; a batch looks at ``max_files`` at most."""
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        paths = files.option("maxFilesPerTrigger", max_files).load(self.landing).select("path")

        def step(batch: DataFrame, number: int) -> None:
            # At most max_files names.
            self.take(spark, [r.path for r in batch.collect()], number)

        return paths.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def take(self, spark: SparkSession, files: Sequence[str], number: int) -> None:
        """Take in some files as batch ``number``."""
        if not files:
            return
        with ThreadPoolExecutor(8) as pool:
            headers = list(pool.map(inheritable_thread_target(spark)(lambda f: tuple(csv_header_schema(spark, f).names)), files))
        alike = defaultdict(list)
        for header, file in zip(headers, files, strict=True):
            alike[header].append(file)
        before = self.columns(spark, number - 1)
        spelled = {name.lower(): name for name, *_ in before}
        for header in alike:
            for name in header:
                spelled.setdefault(name.lower(), name)
        rows = None
        for header, own in alike.items():
            texts = T.StructType([T.StructField(spelled[n.lower()], T.StringType()) for n in header])
            part = spark.read.schema(texts).option("header", True).option("enforceSchema", True).option("escape", '"').csv(own)
            part = part.withColumns({FILE: F.col("_metadata.file_name"), INGEST_TIME: F.current_timestamp()})
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch={number}")
        names = [c for c in rows.columns if c not in (FILE, INGEST_TIME)]
        kinds = self._kinds(spark.read.schema(rows.schema).parquet(f"{self.path}/data/batch={number}"), names)
        known = {name: kind for name, kind, _ in before}
        given = {k.lower(): v for k, v in self.given.items()}
        recorded = []
        for place, name in enumerate([*known, *[n for n in names if n not in known]]):
            fixed = given.get(name.lower())
            recorded.append((place, name, fixed or wider(known.get(name), kinds.get(name)), fixed is not None, number))
        spark.createDataFrame(recorded, _COLUMNS).coalesce(1).drop("batch").write.mode("overwrite").parquet(f"{self.path}/columns/batch={number}")

    def _kinds(self, rows: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
        """The narrowest kind of each column's values: all counts in one pass."""
        counts = []
        for i, name in enumerate(names):
            text = F.col(f"`{name}`")
            counts.append(F.count(text).alias(f"n{i}"))
            counts += [F.count_if(_fits(text, kind)).alias(f"n{i}_{j}") for j, kind in enumerate(_KINDS)]
        found = rows.agg(*counts).first()
        kinds = {}
        for i, name in enumerate(names):
            fit = [kind for j, kind in enumerate(_KINDS) if found[f"n{i}_{j}"] == found[f"n{i}"]]
            kinds[name] = (fit or ["string"])[0] if found[f"n{i}"] else None
        return kinds

    def _log(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, f"{self.path}/columns"):
            return spark.createDataFrame([], _COLUMNS)
        return spark.read.schema(_COLUMNS).parquet(f"{self.path}/columns")

    def columns(self, spark: SparkSession, batch: int | None = None) -> list[tuple[str, str | None, bool]]:
        """Name, type and whether it was given, of each column as of a batch (``None``: now)."""
        log = self._log(spark)
        log = log if batch is None else log.where(F.col("batch") <= batch)
        newest = log.agg(F.max("batch")).first()[0]
        return [] if newest is None else [(r.name, r.type, r.given) for r in log.where(F.col("batch") == newest).orderBy("place").collect()]

    def read(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """All rows up to a batch with the columns and types as of then, ``_rescued``, the file's name and the time it was taken in."""
        columns = self.columns(spark, batch)
        done = self._log(spark).select("batch").distinct()
        done = done if batch is None else done.where(F.col("batch") <= batch)
        texts = T.StructType([T.StructField(n, T.StringType()) for n, *_ in columns] + [T.StructField(FILE, T.StringType()), T.StructField(INGEST_TIME, T.TimestampType()), T.StructField("batch", T.LongType())])
        if not columns:
            return spark.createDataFrame([], texts).drop("batch")
        rows = spark.read.schema(texts).parquet(f"{self.path}/data")
        # One row a batch.
        rows = rows.join(F.broadcast(done), "batch", "left_semi")
        typed = {n: F.col(f"`{n}`").try_cast(kind or "string") for n, kind, _ in columns}
        unfit = [F.when(F.col(f"`{n}`").isNotNull() & typed[n].isNull(), F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("text"))) for n in typed]
        held = F.map_from_entries(F.array_compact(F.array(*unfit)))
        return rows.select(*[c.alias(n) for n, c in typed.items()], F.when(F.size(held) > 0, held).alias(RESCUED), FILE, INGEST_TIME)


def _fits(text: Column, kind: str) -> Column:
    return text.rlike(_KINDS[kind]) & text.try_cast(kind).isNotNull()
