"""Column expressions of the cleaning stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results must equal those of other users of the same keys and codes.
KEY_PREFIX = ("AFS", "AF")
KEY_WIDTH = 9
OPEN_END = "2999-12-31"
UNKNOWN = "UNKWN"
PIPELINE_WORD, PIPELINE_ID = "pipeline", "pipelines.pipelineId"
PIPELINE_TABLE, OTHER_TABLE = "dlt", "delta"


def surrogate_key(
    number: Column, prefix: Sequence[str] = KEY_PREFIX, width: int = KEY_WIDTH
) -> Column:
    """MD5 of the prefixes and the zero-padded number. Longer numbers are cut to ``width``."""
    padded = F.lpad(number.cast("string"), width, "0")
    return F.md5(F.concat_ws("", *[F.lit(p) for p in prefix], padded))


def until_or_open(day: Column, kind: str = "timestamp") -> Column:
    """The date as ``kind``, or the far end of time where there is none."""
    return F.coalesce(day.cast(kind), F.lit(OPEN_END).cast(kind))


def code_or_unknown(code: Column) -> Column:
    return F.coalesce(code, F.lit(UNKNOWN))


def first_match(rules: Sequence[tuple[dict[str, str], str]], otherwise: str) -> Column:
    """The label of the first rule whose columns all have the given values."""
    label = None
    for wanted, value in rules:
        hit = None
        for column, v in wanted.items():
            same = F.col(column) == v
            hit = same if hit is None else hit & same
        label = F.when(hit, value) if label is None else label.when(hit, value)
    return F.lit(otherwise) if label is None else label.otherwise(otherwise)


def list_items(text: Column) -> Column:
    """The items of a list written as ``[a, b]``."""
    return F.split(F.regexp_replace(text, r"[\[\]]", ""), r",\s*")


def checkpoint_path(target: Column, incremental: Column, file: Column, source: Column) -> Column:
    """Where a stream keeps its progress, by what its configuration names.

    One incremental source has one path. Several sources have one each below
    the file, which is named after the target if it has no name.
    """
    several = F.coalesce(file, F.concat(target, F.lit(".sql")))
    return F.when(incremental.isNotNull(), F.concat_ws("/", target, incremental)).otherwise(
        F.concat_ws("/", target, several, source)
    )


def table_kind(properties: Column) -> Column:
    """Whether a pipeline keeps the table, by its property names."""
    kept = F.exists(F.map_keys(properties), lambda k: k.contains(PIPELINE_WORD))
    return F.when(F.coalesce(kept, F.lit(False)), PIPELINE_TABLE).otherwise(OTHER_TABLE)


def pipeline_id(properties: Column, key: str = PIPELINE_ID) -> Column:
    """The pipeline's id in the form that names allow."""
    return F.replace(F.try_element_at(properties, F.lit(key)), F.lit("-"), F.lit("_"))


def json_field(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")


def has_map(kind: T.DataType) -> bool:
    """Whether a value of this type holds a map, which Spark neither compares nor hashes."""
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.MapType)


def comparable(value: Column, kind: T.DataType) -> Column:
    """The value with each map as its entries in the order of their keys; other values unchanged."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))

    def entry(e: Column) -> Column:
        return F.struct(
            comparable(e["key"], kind.keyType).alias("key"),
            comparable(e["value"], kind.valueType).alias("value"),
        )

    return F.array_sort(F.transform(F.map_entries(value), entry))


def comparable_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [comparable(F.col(n), df.schema[n].dataType).alias(n) for n in names]
