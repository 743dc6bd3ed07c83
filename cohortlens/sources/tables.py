"""Loaders that resolve the eleven tables to DataFrames with the declared columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import BUCKET, bucket_of
from cohortlens.schemas import INPUTS, PROGRAMME_COLUMN
from cohortlens.session import configure, size_shuffles

_ACCEPTED = {
    "string": (T.StringType, T.VarcharType, T.CharType),
    "int": (T.IntegerType, T.LongType),
    "flag": (T.IntegerType, T.LongType, T.BooleanType),
    "double": (T.DoubleType,),
    "boolean": (T.BooleanType,),
    "timestamp": (T.TimestampType,),
}
_CONVERTED = {
    "int": (T.ShortType, T.ByteType),
    "double": (T.FloatType, T.DecimalType, T.IntegerType, T.LongType),
    "timestamp": (T.TimestampNTZType, T.DateType),
}


def conform_input(df: DataFrame, name: str, columns: Mapping[str, str]) -> DataFrame:
    """Keep the declared columns only, so that scans prune the rest, and settle their types."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns if c not in fields]
    if missing:
        raise ValueError(f"table {name} lacks the columns {', '.join(missing)}")
    selected = []
    for column, kind in columns.items():
        if isinstance(fields[column], _ACCEPTED[kind]):
            selected.append(F.col(column))
        elif isinstance(fields[column], (T.TimestampNTZType, T.DateType)) and kind == "timestamp":
            selected.append(_in_utc(F.col(column)).alias(column))
        elif isinstance(fields[column], _CONVERTED.get(kind, ())):
            selected.append(F.col(column).cast(kind).alias(column))
        else:
            found = fields[column].simpleString()
            raise TypeError(f"table {name}, column {column}: expected {kind}, found {found}")
    return df.select(*selected)


def _in_utc(local: Column) -> Column:
    """A date, or a time without a zone, as a moment in UTC."""
    time = local.cast("timestamp_ntz")
    parts = [F.date_part(F.lit(p), time) for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")]
    return F.make_timestamp(*parts, F.lit("UTC"))


class Tables:
    """The input tables as attributes, each resolved when it is first used."""

    def __init__(self, resolve: Callable[[str], DataFrame]):
        self._resolve = resolve
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, key: str) -> DataFrame:
        if key.startswith("_") or key not in INPUTS:
            raise AttributeError(key)
        if key not in self._frames:
            name, columns = INPUTS[key]
            self._frames[key] = conform_input(self._resolve(name), name, columns)
        return self._frames[key]

    def table(self, name: str) -> DataFrame:
        """A table by its own name, with whatever columns it has."""
        return self._resolve(name)

    def for_programme(self, programme_id: str) -> Tables:
        """The same tables filtered to one programme; the filter reaches every scan.

        Of tables stored by programme only the folder is read that the programme is in.
        """

        def restricted(name: str) -> DataFrame:
            key = next(k for k, (table, _) in INPUTS.items() if table == name)
            column = PROGRAMME_COLUMN.get(key)
            if column is None:
                return getattr(self, key)
            df = self._resolve(name)
            one = F.lit(programme_id)
            if BUCKET in df.columns:
                df = df.filter(F.col(BUCKET) == bucket_of(one))
            return conform_input(df, *INPUTS[key]).filter(F.col(column) == one)

        return Tables(restricted)


def parquet_tables(spark: SparkSession, root: str) -> Tables:
    """One Parquet dataset per table: ``<root>/<TableName>``."""
    size_shuffles(configure(spark), root)
    return Tables(lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}"))


def catalog_tables(spark: SparkSession, namespace: str) -> Tables:
    """Tables of one catalog namespace, e.g. ``catalog.schema``."""
    configure(spark)
    return Tables(lambda name: spark.table(f"{namespace}.{name}"))


def frame_tables(frames: Mapping[str, DataFrame]) -> Tables:
    """Ready DataFrames by table name."""
    for df in list(frames.values())[:1]:
        configure(df.sparkSession)
    return Tables(lambda name: frames[name])
