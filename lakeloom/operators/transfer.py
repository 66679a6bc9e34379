"""Rows to bytes and bytes to rows: the ``text`` and ``csv`` formats of COPY.

Text: one line a row, fields parted by a tab, ``\\N`` for null, backslash escapes for tabs, line ends and backslashes, so a
line is always a row and files can be read in splits. CSV: quotes are doubled, null is an empty field, an empty string ``""``;
a quoted line end keeps a file from being split, so one file is one task. Booleans are ``t`` and ``f``, bytes are hexadecimal
after ``\\x``; arrays are ``{1,2,NULL}``, their texts in double quotes where need be; maps and structs are an error. A sink or source is a path (folder of part files, each made or
read by its own task) or a binary file object (streamed: the driver holds one partition or one block of bytes at a time).
"""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import QueryError
from ..sources.files import Files

FORMATS = ("text", "csv")
BLOCK = 1 << 20
_ESCAPES = (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


#: An array's text in pieces: quoted elements, plain ones, and the marks between them. Nothing is tried twice, so long elements need no stack.
_PIECE = r'''(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|(?:[^{},"\\]|\\.)++|[{},]'''
#: Elements of an array without inner ones, as this writer shows them.
_SIMPLE = r'''(?s)(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^{},"\\\s]++)(?=[,}])'''
#: Elements that are written in quotes.
_QUOTED = r'''(?s)^$|^(?i:null)$|[{},"\\\s]'''


def _shown(name: str, kind: T.DataType) -> Column:
    """A value as COPY writes it, null as null."""
    return _text_of(F.col(f"`{name}`"), kind, name)


def _text_of(c: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, (T.MapType, T.StructType)):
        raise QueryError(f"column {name} holds maps or structs, which COPY can't write here")
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: _element(x, kind.elementType, name)), ","), F.lit("}"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "t").when(~c, "f")
    return F.concat(F.lit("\\x"), F.lower(F.hex(c))) if isinstance(kind, T.BinaryType) else c.cast("string")


def _element(x: Column, kind: T.DataType, name: str) -> Column:
    text = _text_of(x, kind, name)
    if not isinstance(kind, T.ArrayType):
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        text = F.when(text.rlike(_QUOTED), quoted).otherwise(text)
    return F.coalesce(text, F.lit("NULL"))


def _read_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return _read_array(c, kind)
    return F.unhex(F.substring(c, 3, 2**31 - 1)) if isinstance(kind, T.BinaryType) else c.cast(kind)


def _read_array(c: Column, kind: T.ArrayType) -> Column:
    """``{a,"b c",{…}}`` by way of the JSON text of the same shape; what is left over between its pieces is an error, as is another depth."""

    def as_json(t: Column) -> Column:
        marks = F.when(t == "{", "[").when(t == "}", "]").when((t == ",") | (F.trim(t) == ""), F.trim(t)).when(F.lower(F.trim(t)) == "null", "null")
        bare = F.when(t.startswith('"'), F.substring(t, 2, F.length(t) - 2)).otherwise(F.trim(t))
        text = F.to_json(F.struct(F.regexp_replace(bare, r"(?s)\\(.)", "$1").alias("v")))
        return marks.otherwise(text.substr(F.lit(6), F.length(text) - 6))

    texts, element = T.ArrayType(T.StringType()), kind.elementType
    while isinstance(element, T.ArrayType):
        texts, element = T.ArrayType(texts), element.elementType
    wrong = F.raise_error(F.concat(F.lit("COPY: not an array: "), c))

    def any_shape(c: Column) -> Column:
        pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
        whole = F.when((F.array_join(pieces, "") == c) & F.trim(c).startswith("{") & F.trim(c).endswith("}"), F.array_join(F.transform(pieces, as_json), ""))
        return F.from_json(F.concat(F.lit('{"a":'), F.coalesce(whole, wrong), F.lit("}")), T.StructType([T.StructField("a", texts)]), {"mode": "FAILFAST"})["a"]

    def simple(x: Column) -> Column:
        inside = F.substring(x, 2, F.length(x) - 2)
        inside = F.when(F.instr(inside, "\\") == 0, inside).otherwise(F.regexp_replace(inside, r"(?s)\\(.)", "$1"))
        return F.when(x.startswith('"'), inside).when((F.length(x) != 4) | (F.lower(x) != "null"), x)

    def deep(a: Column, kind: T.ArrayType) -> Column:
        inner = kind.elementType
        if isinstance(inner, T.StringType):
            return a
        return F.transform(a, lambda x: deep(x, inner) if isinstance(inner, T.ArrayType) else _read_value(x, inner))

    read = any_shape(c)
    if not isinstance(kind.elementType, T.ArrayType):
        # what is put together again from its elements is all there was, and needs no JSON; a list of one array holds them, so that they are made once
        found = F.array(F.regexp_extract_all(c, F.lit(_SIMPLE), F.lit(0)))
        made = F.transform(found, lambda xs: F.when(F.concat(F.lit("{"), F.array_join(xs, ","), F.lit("}")) == c, F.transform(xs, simple)))[0]
        read = F.coalesce(made, read)
    return F.when(c.isNotNull(), deep(read, kind))


def _csv_options(delimiter: str, null: str) -> dict[str, str]:
    return {"sep": delimiter, "escape": '"', "nullValue": null, "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _settings(fmt: str, delimiter: str | None, null: str | None) -> tuple[str, str]:
    if fmt not in FORMATS:
        raise QueryError(f"COPY has the formats {', '.join(FORMATS)}, not {fmt}")
    delimiter = delimiter or ("\t" if fmt == "text" else ",")
    if len(delimiter) != 1 or delimiter in "\\\n\r":
        raise QueryError(f"not a delimiter: {delimiter!r}")
    if fmt == "csv" and null:
        raise QueryError("in csv, null is the empty field")
    return delimiter, null if null is not None else ("\\N" if fmt == "text" else "")


def lines_of(df: DataFrame, fmt: str = "text", delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """One column ``value``: each row as a line of the format, without its end."""
    delimiter, null = _settings(fmt, delimiter, null)
    cells = {f.name: _shown(f.name, f.dataType) for f in df.schema}
    if fmt == "csv":
        row = F.struct(*[c.alias(n) for n, c in cells.items()])
        return df.select(F.to_csv(row, _csv_options(delimiter, null)).alias("value"))

    def escaped(c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (*_ESCAPES, *([(delimiter, "\\" + delimiter)] if delimiter != "\t" else [])):
            c = F.replace(c, F.lit(raw), F.lit(shown))
        return F.coalesce(c, F.lit(null))

    return df.select(F.concat_ws(delimiter, *[escaped(c) for c in cells.values()]).alias("value"))


def write_rows(df: DataFrame, output: Any, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> int:
    """Rows to a path or a binary file object; how many. A ``header`` (csv) is the first line of a stream, or of each part file."""
    sep, none = _settings(fmt, delimiter, null)
    if header and fmt != "csv":
        raise QueryError("only csv has a header")
    if isinstance(output, str):
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if fmt == "csv":
            cells = [_shown(f.name, f.dataType).alias(f.name) for f in df.schema]
            df.select(*cells).write.options(header=header, **_csv_options(sep, none)).csv(output)
        else:
            lines_of(df, fmt, delimiter, null).write.text(output)
        return int(seen.get["n"])
    if header:
        names = df.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in df.columns])
        output.write((lines_of(names, fmt, delimiter, null).first()["value"] + "\n").encode())
    n = 0
    for r in lines_of(df, fmt, delimiter, null).toLocalIterator(prefetchPartitions=True):
        output.write((r["value"] + "\n").encode())
        n += 1
    return n


def spool(spark: SparkSession, source: Any, path: str) -> None:
    """A binary file object's bytes as one file that all executors read, block by block."""
    p, fs = Files(spark)._at(path)
    out = fs.create(p, True)
    try:
        while block := source.read(BLOCK):
            out.write(bytearray(block))
    finally:
        out.close()


def read_rows(spark: SparkSession, path: str, kind: T.StructType, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """Lines of a file or folder as rows of ``kind``; a line with another number of fields is an error."""
    sep, none = _settings(fmt, delimiter, null)
    if fmt == "csv":
        raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(kind))])
        # the parser gives an empty field this mark, which no text holds; a quoted one stays empty
        marks = {"nullValue": uuid.uuid4().hex, "emptyValue": ""}
        rows = spark.read.schema(raw).options(header=header, enforceSchema=True, multiLine=True, mode="FAILFAST", **{**_csv_options(sep, none), **marks}).csv(path)
        return rows.select(*[_read_value(F.col(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind)])
    lines = spark.read.option("lineSep", "\n").text(path)
    if sep == "\t":
        cells = F.split("value", "\t", -1)
    else:  # a delimiter after an odd run of backslashes is part of a value
        cells = F.split("value", rf"(?<=(?<!\\)(?:\\\\){{0,1000}}){re.escape(sep)}", -1)
    fields = lines.select(F.when(F.size(cells) == len(kind), cells).otherwise(F.raise_error(F.concat(F.lit("COPY: a line has another number of fields: "), "value"))).alias("f"))

    def plain(c: Column) -> Column:
        def unescaped(part: Column) -> Column:
            for raw, shown in (*_ESCAPES, *([(sep, "\\" + sep)] if sep != "\t" else [])):
                part = F.replace(part, F.lit(shown), F.lit(raw))
            return part

        whole = F.array_join(F.transform(F.split(c, r"\\\\", -1), unescaped), "\\")
        return F.when(c != none, F.when(F.instr(c, "\\") == 0, c).otherwise(whole))

    texts = fields.select(*[plain(F.col("f")[i]).alias(f"c{i}") for i in range(len(kind))])  # apart, as arrays look at theirs several times
    return texts.select(*[_read_value(F.col(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind)])
