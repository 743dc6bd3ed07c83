"""The typed output contract: conversion, violations, quarantine and field selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The contract's integers have 32 bits.
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def _same_shape(found: T.DataType, wanted: T.DataType, path: str) -> None:
    if isinstance(wanted, T.StructType):
        if not isinstance(found, T.StructType) or found.names != wanted.names:
            raise TypeError(f"{path or 'row'}: expected the fields {', '.join(wanted.names)}")
        for a, b in zip(found.fields, wanted.fields):
            _same_shape(a.dataType, b.dataType, f"{path}.{b.name}".lstrip("."))
    elif isinstance(wanted, T.ArrayType):
        if not isinstance(found, T.ArrayType):
            raise TypeError(f"{path}: expected a list")
        _same_shape(found.elementType, wanted.elementType, path)


def conform(df: DataFrame, contract: T.StructType, extra: Sequence[str] = ()) -> DataFrame:
    """Cast to the contract's fields and types; an integer beyond 32 bits is an error.

    ``extra`` names columns to keep besides the contract's.
    """
    found = T.StructType([df.schema[f.name] for f in contract.fields])
    _same_shape(found, contract, "")
    kinds = {f.name: f.dataType for f in found.fields}
    cast = (_cast(F.col(f.name), kinds[f.name], f.dataType).alias(f.name) for f in contract.fields)
    return df.select(*extra, *cast)


def _cast(column: Column, found: T.DataType, wanted: T.DataType) -> Column:
    # Casting keeps the source's nullability, so required parts are cast to their nullable form;
    # ``violations`` checks what is required.
    return _in_range(column, found, wanted).cast(_nullable(wanted))


def _in_range(column: Column, found: T.DataType, wanted: T.DataType) -> Column:
    """``column``, failing on an integer beyond 32 bits whether or not the session casts strictly."""
    if isinstance(wanted, T.IntegerType) and isinstance(found, T.LongType):
        fits = column.isNull() | column.between(INT_MIN, INT_MAX)
        said = F.concat(F.lit("integer out of range: "), column.cast("string"))
        return F.when(fits, column).otherwise(F.raise_error(said))
    if isinstance(wanted, T.ArrayType) and _has_long(found):
        return F.transform(column, lambda e: _in_range(e, found.elementType, wanted.elementType))
    if isinstance(wanted, T.StructType) and _has_long(found):
        fields = [
            _in_range(column[w.name], f.dataType, w.dataType).alias(w.name)
            for f, w in zip(found.fields, wanted.fields)
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def _has_long(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_long(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_long(f.dataType) for f in kind.fields)
    return isinstance(kind, T.LongType)


def _nullable(wanted: T.DataType) -> T.DataType:
    if isinstance(wanted, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in wanted.fields])
    if isinstance(wanted, T.ArrayType):
        return T.ArrayType(_nullable(wanted.elementType), True)
    return wanted


def _broken(
    rows: DataFrame, required: Iterable[str], integers: Iterable[str]
) -> list[tuple[str, Column, str]]:
    # Columns whose type already rules the fault out are not read at all.
    kinds = {f.name: f for f in rows.schema.fields}
    found = [(c, F.col(f"`{c}`").isNull(), "null") for c in required if kinds[c].nullable]
    return found + [
        (c, ~F.col(f"`{c}`").between(INT_MIN, INT_MAX), "integer out of range")
        for c in integers
        if not isinstance(kinds[c].dataType, T.IntegerType)
    ]


def violations(
    rows: DataFrame,
    level: str,
    keys: dict[str, str],
    required: Iterable[str] = (),
    integers: Iterable[str] = (),
) -> DataFrame:
    """(level, programme_id, user_id, item_id, field, reason) for each field that breaks the contract.

    ``keys`` maps the three key columns to columns of ``rows``; those left out are null.
    """
    findings = [
        F.when(wrong, F.struct(F.lit(c).alias("field"), F.lit(reason).alias("reason")))
        for c, wrong, reason in _broken(rows, required, integers)
    ]
    if not findings:
        rows = rows.limit(0)
        findings = [F.struct(F.lit("").alias("field"), F.lit("").alias("reason"))]
    return rows.select(
        F.lit(level).alias("level"),
        *(
            (F.col(keys[k]) if k in keys else F.lit(None).cast("string")).alias(k)
            for k in ("programme_id", "user_id", "item_id")
        ),
        F.explode(F.array_compact(F.array(*findings))).alias("finding"),
    ).select("level", "programme_id", "user_id", "item_id", "finding.*")


def fields_of(
    contract: T.StructType, path: str = "", prefix: str = ""
) -> Iterator[tuple[str, str, T.StructField]]:
    """Every plain field below a contract: the dotted path of the list it is in, its own path there, and the field."""
    for f in contract.fields:
        kind = f.dataType
        if isinstance(kind, T.StructType):
            yield from fields_of(kind, path, f"{prefix}{f.name}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            yield from fields_of(kind.elementType, f"{path}.{prefix}{f.name}".lstrip("."))
        else:
            yield path, prefix + f.name, f


@dataclass(frozen=True)
class Level:
    """Rows of one list of a document, or of the document itself, before they are nested.

    ``keys`` maps ``programme_id``, ``user_id`` and ``item_id`` to columns; ``columns`` maps fields of the contract to
    columns where they have other names.  ``only`` names the fields that these rows hold, if not all.
    """

    name: str
    rows: DataFrame
    keys: dict[str, str]
    columns: Mapping[str, str] = field(default_factory=dict)
    only: Sequence[str] | None = None


def tree_violations(contract: T.StructType, levels: Mapping[str, Sequence[Level]]) -> DataFrame:
    """Every field of a document, however deep in its lists, that breaks the contract.

    The contract is walked field by field; ``levels`` maps the path of each list ("" for the document) to the rows
    it is made of.  A field that could break the contract and is in none of the rows is an error.
    """
    wanted: dict[str, dict[str, T.StructField]] = {}
    for path, name, found in fields_of(contract):
        if not found.nullable or isinstance(found.dataType, T.IntegerType):
            wanted.setdefault(path, {})[name] = found
    checks = []
    for path, fields in wanted.items():
        missing = set(fields)
        for level in levels.get(path, ()):
            mine = {n: f for n, f in fields.items() if level.only is None or n in level.only}
            missing -= set(mine)
            columns = {n: F.col(level.columns.get(n, n)) for n in mine}
            keys = {k: F.col(c).cast("string").alias(f"_{k}") for k, c in level.keys.items()}
            rows = level.rows.select(*keys.values(), *(c.alias(n) for n, c in columns.items()))
            required = [n for n, f in mine.items() if not f.nullable]
            integers = [n for n, f in mine.items() if isinstance(f.dataType, T.IntegerType)]
            if _broken(rows, required, integers):
                checks.append(violations(rows, level.name, {k: f"_{k}" for k in keys}, required, integers))
        if missing:
            raise ValueError(f"no rows hold {', '.join(sorted(missing))} of {path or 'the document'}")
    if not checks:
        some = next(iter(levels.values()))[0]
        return violations(some.rows, "", {})
    return reduce(DataFrame.unionByName, checks)


def quarantine(
    rows: DataFrame, required: Iterable[str], integers: Iterable[str]
) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that keep the contract and those that break it."""
    wrong = F.lit(False)
    for _, broken, _ in _broken(rows, required, integers):
        wrong = wrong | F.coalesce(broken, F.lit(False))
    return rows.filter(~wrong), rows.filter(wrong)


def field_tree(fields: Iterable[str]) -> dict:
    """Dotted names as nested dictionaries; an empty one stands for the whole field."""
    tree: dict = {}
    whole = dict.fromkeys(fields)
    for name in whole:
        steps = name.split(".")
        if any(".".join(steps[:i]) in whole for i in range(1, len(steps))):
            continue
        node = tree
        for step in steps:
            node = node.setdefault(step, {})
    return tree


def wants(tree: dict, *path: str) -> bool:
    """Whether a selection includes (a part of) the field at ``path``."""
    for name in path:
        if not tree:
            return True
        if name not in tree:
            return False
        tree = tree[name]
    return True


def conform_selected(
    df: DataFrame, contract: T.StructType, fields: Sequence[str] | None, extra: Sequence[str] = ()
) -> DataFrame:
    """:func:`conform` for the selected fields, or for all of them if ``fields`` is None."""
    if fields is None:
        return conform(df, contract, extra)
    tree = field_tree(fields)
    unknown = [n for n in tree if n not in contract.names]
    if unknown:
        raise ValueError(f"unknown field {unknown[0]}")
    top = T.StructType([contract[n] for n in tree])
    return select_fields(conform(df, top, extra), [*extra, *fields])


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep the named fields only; ``courses.modules.module_id`` reaches into lists and structs."""
    tree = field_tree(fields)

    def pruned(value: Column, kind: T.DataType, wanted: dict, path: str) -> Column:
        if not wanted:
            return value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda e: pruned(e, kind.elementType, wanted, path))
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{path} has no fields")
        unknown = [n for n in wanted if n not in kind.names]
        if unknown:
            raise ValueError(f"unknown field {path}.{unknown[0]}".replace(" .", " "))
        kept = F.struct(
            *(
                pruned(value[n], kind[n].dataType, sub, f"{path}.{n}").alias(n)
                for n, sub in wanted.items()
            )
        )
        return F.when(value.isNotNull(), kept)

    unknown = [n for n in tree if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown field {unknown[0]}")
    return df.select(
        *(pruned(F.col(n), df.schema[n].dataType, sub, n).alias(n) for n, sub in tree.items())
    )
