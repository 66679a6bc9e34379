"""Column types named in definitions, as Spark types and back."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "serial": T.IntegerType(), "smallint": T.ShortType(),
    "bigint": T.LongType(), "int8": T.LongType(), "bigserial": T.LongType(), "text": T.StringType(), "string": T.StringType(),
    "varchar": T.StringType(), "character varying": T.StringType(), "char": T.StringType(), "character": T.StringType(), "uuid": T.StringType(),
    "json": T.StringType(), "jsonb": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "float": T.DoubleType(),
    "real": T.FloatType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "numeric": T.DecimalType(38, 10), "decimal": T.DecimalType(38, 10),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampType(), "timestamptz": T.TimestampType(), "blob": T.BinaryType(), "bytea": T.BinaryType(), "": T.StringType(),
}
_SHAPE = re.compile(r"\s*([A-Za-z][A-Za-z0-9_ ]*?)?\s*(?:\(\s*(\d+)\s*(?:(?:char|byte)\s*)?(?:,\s*(\d+)\s*)?\))?\s*(with time zone|without time zone)?\s*((?:\[\])*)\s*", re.I)


def spark_type(name: str | None) -> T.DataType:
    """``integer``, ``varchar(20)``, ``numeric(10, 2)``, ``text[]`` …; unsigned integers widen; no name is text."""
    m = _SHAPE.fullmatch(name or "")
    if not m:
        raise ValueError(f"unknown type: {name}")
    base, a, b = (m[1] or "").lower().strip(), m[2], m[3]
    wide = base.endswith((" unsigned", " zerofill"))
    base = base.replace(" unsigned", "").replace(" zerofill", "")
    if m[4]:
        base = f"{base} {m[4].lower()}"
    if base in ("numeric", "decimal") and a:
        out: T.DataType = T.DecimalType(int(a), int(b or 0))
    elif base in _PLAIN:
        out = _PLAIN[base]
    else:
        try:
            out = T.StructType.fromDDL(f"c {name}")[0].dataType
        except Exception as e:
            raise ValueError(f"unknown type: {name}") from e
        return out
    if wide:
        out = {T.ShortType(): T.IntegerType(), T.IntegerType(): T.LongType(), T.LongType(): T.DecimalType(20, 0)}.get(out, out)
    for _ in range(len(m[5] or "") // 2):
        out = T.ArrayType(out)
    return out


def type_name(kind: T.DataType) -> str:
    """The name that definitions use for a Spark type."""
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    names = {"int": "integer", "string": "text", "double": "double precision", "float": "real", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone"}
    return names.get(kind.simpleString(), kind.simpleString())
