"""Declared table schemas: JSON description -> Spark schema with roles and keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

# The type names a declared schema may use.
DECLARED_TYPES: dict[str, T.DataType] = {
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "LONG": T.LongType(),
    "BYTES": T.BinaryType(),
    "JSON": T.StringType(),
}

# The blocks of a declared schema, in column order.
FIELD_BLOCKS = (
    ("dimensionFieldSpecs", "dimension"),
    ("metricFieldSpecs", "metric"),
    ("dateTimeFieldSpecs", "dateTime"),
)


@dataclass(frozen=True)
class DeclaredColumn:
    name: str
    type_name: str
    role: str
    format: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return DECLARED_TYPES[self.type_name]


@dataclass(frozen=True)
class DeclaredTable:
    name: str
    columns: tuple[DeclaredColumn, ...]
    primary_keys: tuple[str, ...] = field(default=())

    @property
    def column_names(self) -> list[str]:
        return [column.name for column in self.columns]

    def to_struct(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(
                    c.name, c.spark_type, True, {"role": c.role, "declaredType": c.type_name}
                )
                for c in self.columns
            ]
        )


def parse_declared(spec: dict[str, Any]) -> DeclaredTable:
    """Read a declared schema; dimensions are required, other blocks optional.

    A primary key has to name a dimension or a metric.
    """
    if "dimensionFieldSpecs" not in spec:
        raise KeyError("dimensionFieldSpecs")
    columns = []
    for block, role in FIELD_BLOCKS:
        for item in spec.get(block, ()):
            type_name = item["dataType"].upper()
            if type_name not in DECLARED_TYPES:
                raise KeyError(f"unknown type {type_name} of column {item['name']}")
            columns.append(DeclaredColumn(item["name"], type_name, role, item.get("format")))
    keyable = {c.name for c in columns if c.role != "dateTime"}
    keys = tuple(spec.get("primaryKeyColumns", ()))
    for key in keys:
        if key not in keyable:
            raise KeyError(f"primary key {key} is not a dimension or metric")
    return DeclaredTable(spec["schemaName"], tuple(columns), keys)


def load_declared(path: str) -> DeclaredTable:
    return parse_declared(json.loads(Path(path).read_text(encoding="utf-8")))
