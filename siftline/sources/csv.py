"""CSV with a header line and ``#`` comments, read by column name."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.naming import col
from siftline.functions.scaling import missing_as_null
from siftline.operators.tables import require_columns

#: A line up to the first ``#`` outside double quotes.
_BEFORE_COMMENT = r'^((?:[^"#]++|"(?:[^"]++|"")*+")*+)#.*$'
_COMMENT = re.compile(_BEFORE_COMMENT)
#: Bytes of a file that are read for its header at first, and files that are read together.
HEAD_BYTES, HEADS_AT_ONCE = 16_384, 16
#: Splits no line and quotes nothing, so that the reader gives whole lines.
_WHOLE_LINES = {"sep": "\u0001", "quote": "", "comment": "#", "header": True}
#: A quote in a quoted cell is written twice.
DIALECT = {"escape": '"'}
_MARK, _END, _CORRUPT = "\u0002", "_end_of_line", "_corrupt_line"


def _head_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is neither blank nor a comment, from as much of its head as that takes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    size = HEAD_BYTES
    while True:
        stream = path.getFileSystem(conf).open(path)
        try:
            head = bytes((codec.createInputStream(stream) if codec else stream).readNBytes(size))
        finally:
            stream.close()
        ended = len(head) < size
        lines = re.split(r"\r\n|\n|\r", head.decode("utf-8", "replace"))
        for line in lines if ended else lines[:-1]:
            if not line.startswith("#") and line.strip(" "):
                return line
        if ended:
            return None
        size *= 2


def _headers(
    spark: SparkSession, path: str | list[str], trailing_comments: bool
) -> dict[tuple[str, ...], list[str]]:
    """The files below each distinct header line, which is a file's first line that is no comment.

    Only the heads of files are read, some at a time; Spark's list of the files is on the driver anyway.
    """
    files = sorted(unquote(file) for file in spark.read.text(path).inputFiles())  # the list has URIs
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(lambda file: _head_line(spark, file)), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            if trailing_comments:
                line = _COMMENT.sub(r"\1", line).rstrip(" ")
            found.setdefault(tuple(name.strip() for name in next(csv.reader([line]))), []).append(file)
    if not found:
        raise ValueError(f"no header line in {path}")
    return found


def header_groups(
    spark: SparkSession, path: str | list[str], trailing_comments: bool = False
) -> dict[tuple[str, ...], list[str]]:
    """The files of each header; files without a header line are in none."""
    try:
        return _headers(spark, path, trailing_comments)
    except ValueError:
        return {}


def header_names(spark: SparkSession, path: str, trailing_comments: bool = False) -> list[str]:
    """Column names of the first line that is not a comment, of the first file."""
    return list(next(iter(_headers(spark, path, trailing_comments))))


def _parsed(
    spark: SparkSession, files: str | list[str], names: Sequence[str], trailing_comments: bool
) -> DataFrame:
    """Every data line as texts, with the line in ``_CORRUPT`` where it has more cells than the header."""
    lines = spark.read.options(**_WHOLE_LINES).schema("line string").csv(files)
    if trailing_comments:
        cut = F.rtrim(F.regexp_replace("line", _BEFORE_COMMENT, "$1"))
        lines = lines.select(cut.alias("line")).where("line <> ''")
    # A cell of its own behind the last one shows where a line ends; an empty last cell alone would be lost.
    fields = [T.StructField(name, T.StringType()) for name in [*names, _END]]
    cells = F.from_csv(F.concat("line", F.lit(f",{_MARK}")), T.StructType(fields).toDDL(), DIALECT)
    rows = lines.select("line", cells.alias("cells"))
    found = {name: F.col("cells").getField(name) for name in [*names, _END]}
    ended = reduce(lambda a, b: a | b, [value.eqNullSafe(F.lit(_MARK)) for value in found.values()])
    values = [F.nullif(found[name], F.lit(_MARK)).alias(name) for name in names]
    return rows.select(*values, F.when(~ended, F.col("line")).alias(_CORRUPT))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str] | None = None,
    trailing_comments: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """All columns of the files, those in ``types`` cast, unreadable values as NULL.

    Lines that start with ``#`` are skipped. With ``trailing_comments`` the rest of a line after a
    ``#`` outside double quotes is cut as well. Without ``types`` each column, by its name over all files,
    gets the narrowest type that all its cells have, see ``inferred_types``.

    The first line of each file that is no comment is its header; a data row that equals it stays.
    Files may have their columns in different orders, and columns that others lack. A row with
    fewer cells than its header is filled up with NULL. One with more is an error, or, if
    ``corrupt`` names a column for it, kept there as a whole line (NULL for other rows).
    """
    groups = _headers(spark, path, trailing_comments)
    whole = len(groups) == 1
    parts = [
        _parsed(spark, path if whole else files, names, trailing_comments) for names, files in groups.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = list(dict.fromkeys(name for header in groups for name in header))
    if types is None:
        types = inferred_types(rows, names)
    message = F.concat(F.lit("more cells than the header has: "), F.col(_CORRUPT))
    fine = F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(message)).otherwise(F.lit(True))
    checked = rows if corrupt else rows.where(fine)
    columns = [_typed(name, types.get(name)) for name in names]
    return checked.select(*columns, *([F.col(_CORRUPT).alias(corrupt)] if corrupt else []))


# The types that a text may have, the narrower ones first, and what such a text looks like.
_TYPES = {
    "int": r"^[+-]?\d{1,10}$",
    "bigint": r"^[+-]?\d{1,19}$",
    "double": r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$",
    "boolean": r"(?i)^(true|false)$",
    "date": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "timestamp": r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$",
}


def inferred_types(rows: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """For each column of texts the first of _TYPES that all its cells can be read as, else string; one pass for all.

    Missing and blank cells have any type; a column without others is a string.
    """
    counts = []
    for i, name in enumerate(names):
        text = F.trim(col(name))
        filled = F.when(text != "", text)
        counts.append(F.count(filled).alias(f"cells:{i}"))
        for kind, pattern in _TYPES.items():
            fits = filled.rlike(pattern) & filled.try_cast(kind).isNotNull()
            counts.append(F.count_if(fits).alias(f"{kind}:{i}"))
    found = rows.agg(*counts).first()
    types = {}
    for i, name in enumerate(names):
        cells = found[f"cells:{i}"]
        types[name] = next((kind for kind in _TYPES if cells and found[f"{kind}:{i}"] == cells), "string")
    return types


def _typed(name: str, kind: str | None) -> Column:
    return F.trim(col(name)).try_cast(kind).alias(name) if kind and kind != "string" else col(name)


def read_features_csv(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """A user's file for scoring: every feature must be there, other columns are kept."""
    df = require_columns(read_csv(spark, path, {name: "double" for name in features}), features)
    return df.withColumns({name: missing_as_null(col(name)) for name in features})


def normalise_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({name: missing_as_null(col(name)) for name in columns})


def stamped(folder: str, name: str, at: datetime | None = None) -> str:
    """``name`` with a given second, or with the present moment to the microsecond, so that two exports don't meet."""
    text = at.strftime("%Y%m%d_%H%M%S") if at else datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    return f"{folder.rstrip('/')}/{name}_{text}"


def write_csv(df: DataFrame, folder: str, name: str, at: datetime | None = None) -> str:
    """Write below a time-stamped name and return the path."""
    path = stamped(folder, name, at)
    df.write.options(**DIALECT).csv(path, header=True)
    return path
