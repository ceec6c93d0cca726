"""Attribute-relation text tables, dense and sparse."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.tables import domain_of


_LABEL = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^,\s][^,]*"""


# What a backslash and a letter stand for inside quotes.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _unquote(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
    return text


def parse_header(lines: Sequence[str]) -> T.StructType:
    """Attribute lines to a schema; nominal domains go to column metadata."""
    fields = []
    for line in lines:
        found = re.match(r"""(?i)@attribute\s+('(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|\S+)\s+(.*)$""", line.strip())
        if not found:
            continue
        name, kind = _unquote(found[1]), found[2].strip()
        domain = re.search(r"\{(.*)\}", kind)
        if domain:
            values = [_unquote(v) for v in re.findall(_LABEL, domain[1])]
            fields.append(T.StructField(name, T.StringType(), True, {"nominal": values}))
        elif kind.lower().startswith("string"):
            fields.append(T.StructField(name, T.StringType()))
        elif re.match("(?i)(numeric|real|integer)", kind):
            fields.append(T.StructField(name, T.DoubleType()))
        else:
            raise ValueError(f"type {kind!r} of {name} is not supported")
    return T.StructType(fields)


_MARK = "\ue000"  # stands for an escaped backslash while the other escapes are resolved
# a field from the line's start or a comma on; quotes of either kind stay around it
_FIELD = r"""(?s)(?:^|,)\s*('(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^,]*?)\s*(?=,|$)"""


def _is_data(line: Column) -> Column:
    return line.rlike(r"\S") & ~line.rlike(r"(?i)^\s*(%|@(relation|attribute|data|end)\b)")


def _plain(raw: Column) -> Column:
    """A field's text without its quotes and escapes; an unquoted ``?`` is NULL, a quoted one is text."""
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("\\\\"), F.lit(_MARK))
    for letter, char in _ESCAPES.items():
        inner = F.replace(inner, F.lit(f"\\{letter}"), F.lit(char))
    inner = F.replace(F.regexp_replace(inner, r"\\(.)", "$1"), F.lit(_MARK), F.lit("\\"))
    return F.when(raw.rlike(r"""(?s)^(['"]).*\1$""") & (F.length(raw) > 1), inner).when(raw != "?", raw)


def read_header(spark: SparkSession, path: str) -> T.StructType:
    """The schema from the first file of a path, of which only the lines up to ``@data`` are read."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]  # names only
    lines, n = spark.read.text(first), 200
    while True:
        head = [r["value"] for r in lines.take(n)]
        end = next((i for i, line in enumerate(head) if line.strip().lower().startswith("@data")), None)
        if end is not None or len(head) < n:
            return parse_header(head[:end])
        n *= 10


def read_table_arff(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A table (also ``.gz``) of dense and sparse rows; quotes of both kinds, unquoted ``?`` is NULL.

    The header of the first path gives the schema. A number that cannot be read is NULL.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = read_header(spark, paths[0])
    rows = spark.read.text(paths).filter(_is_data(F.col("value")))
    line = F.trim("value")
    sparse = line.startswith("{")
    fields = F.when(~sparse, F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)))
    found = _sparse_fields(F.when(sparse, line))
    rows = rows.select(sparse.alias("_s"), fields.alias("_f"), found[0].alias("_k"), found[1].alias("_v"))
    out = []
    for i, f in enumerate(schema.fields):
        dense = _plain(F.get("_f", F.lit(i)))
        value = F.when(F.col("_s"), _sparse_value(i, f)).otherwise(dense)
        out.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(f.name, metadata=f.metadata))
    return rows.select(*out)


def _sparse_fields(line: Column) -> tuple[Column, Column]:
    pattern = F.lit(r"""(?s)(\d+)\s+('(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^,}\s]+)""")
    return F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))


def _sparse_value(i: int, f: T.StructField) -> Column:
    """The field from (_k, _v); one not listed has the first nominal label, or 0 for a number."""
    place = F.nullif(F.array_position("_k", str(i)), F.lit(0).cast("long")).cast("int")
    domain = f.metadata.get("nominal")
    absent = F.lit(domain[0] if domain else ("0" if not isinstance(f.dataType, T.StringType) else None)).cast("string")
    return F.when(place.isNull(), absent).otherwise(_plain(F.try_element_at("_v", place)))


def read_sparse_rows(df: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """``{index value, …}`` lines to columns.

    An index not listed has the first nominal label, or 0 for a number.
    """
    line = F.col(col)
    keys, values = _sparse_fields(line)
    rows = df.filter(_is_data(line)).select("*", keys.alias("_k"), values.alias("_v"))
    out = []
    for i, f in enumerate(schema.fields):
        value = _sparse_value(i, f)
        out.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(f.name, metadata=f.metadata))
    kept = [c for c in df.columns if c != col]
    return rows.select(*kept, *out)


def _quoted(value: Column) -> Column:
    escaped = F.regexp_replace(value, r'(["\\])', r"\\$1")
    for letter, char in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(f"\\{letter}"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _quote(text: str) -> str:
    text = re.sub(r'(["\\])', r"\\\1", text)
    for letter, char in _ESCAPES.items():
        text = text.replace(char, f"\\{letter}")
    return f'"{text}"'


def header_lines(df: DataFrame, relation: str) -> list[str]:
    lines = [f"@relation {relation}", ""]
    for f in df.schema.fields:
        domain = domain_of(df, f.name)
        if domain is not None:
            kind = "{" + ",".join(_quote(v) for v in sorted(domain)) + "}"
        else:
            kind = "string" if isinstance(f.dataType, T.StringType) else "numeric"
        name = f.name if re.fullmatch(r"[^\s'\"{}%,]+", f.name) else _quote(f.name)
        lines.append(f"@attribute {name} {kind}")
    return [*lines, "", "@data"]


def write_table_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """Header part first, then the data parts; strings quoted, NULL as ``?``."""
    cells = []
    for f in df.schema.fields:
        text = _quoted(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast("string")
        cells.append(F.coalesce(text, F.lit("?")))
    data = df.select(F.concat_ws(",", *cells).alias("value"))
    header = df.sparkSession.createDataFrame([("\n".join(header_lines(df, relation)),)], "value string")
    header.coalesce(1).union(data).write.mode("overwrite").text(path)
