"""Readers and writers. Every reader takes an explicit schema; inference is opt-in."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from caseflow.functions.scalars import parse_date, quoted
from caseflow.schema import CANON, all_strings, enforce
from caseflow.session import settings


# -- CSV ----------------------------------------------------------------------

NULL = r"\N"  # stands for null, so that empty text stays empty text
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # FIXED: the folder name Spark gives to null

# Quotes are doubled, white space around values is kept.
_DIALECT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# One task per file, which reads one row.
_WHOLE_FILES = {
    "spark.sql.files.maxPartitionBytes": str(1 << 50),
    "spark.sql.files.openCostInBytes": str(1 << 50),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
}


def csv_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> the files that begin with it, in order of their names.

    A job with one task per file, which stops after the first line. Files without any
    line are left out. File names and headers come to the driver, no data does.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    with settings(spark, _WHOLE_FILES):
        lines = spark.read.text(path).select("value", "_metadata.file_path").mapInArrow(first, "value string, file_path string")
        found = sorted((unquote(r.file_path), r.value) for r in lines.collect())
    headers: dict[str, list[str]] = {}
    for file, line in found:
        headers.setdefault(line, []).append(re.sub(r"([\\\[\]{}*?])", r"\\\1", file))
    return headers


def _names(line: str) -> list[str]:
    """Column names of a header; empty and repeated ones get their position."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    seen = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)]


def _load(reader: DataFrameReader, path: str, headers: Mapping[str, Sequence[str]], files: list[str]) -> DataFrame:
    """The files with one header; as one folder if there is no other header."""
    if len(headers) == 1:
        return reader.csv(path)
    if not re.search(r"[\[{*?]", path):
        reader = reader.option("basePath", path)  # files of a folder keep its partition columns
    return reader.csv(files)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = CANON,
    *,
    null_value: str = NULL,
    multi_line: bool = False,
    escaped: bool | None = None,
) -> DataFrame:
    """CSV with a header, brought to ``schema`` by the names in the header of each file.

    Absent columns are null, others are left out, and values that do not fit are null
    (see ``cast_sql``). ``schema=None`` infers types, at the price of one more pass; a
    column that files give different types is text. Blank values and ``null_value`` are
    null, quoted empty ones are empty text; with ``null_value=""`` both are null.
    ``multi_line`` reads values with line breaks; files are then no longer split, so it
    is off by default. ``escaped`` is explained at :func:`write_csv`.
    """
    if schema:
        return enforce(read_csv_strings(spark, path, schema, null_value=null_value, multi_line=multi_line, escaped=escaped), schema)
    reader = spark.read.options(**_DIALECT, nullValue=null_value, multiLine=multi_line, inferSchema=True)
    types: dict[str, set] = {}
    headers = csv_headers(spark, path)
    for files in headers.values():
        for field in _load(reader, path, headers, files).schema:
            types.setdefault(field.name, set()).add(field.dataType)
    inferred = T.StructType([T.StructField(n, t.pop() if len(t) == 1 else T.StringType()) for n, t in types.items()])
    return read_csv(spark, path, inferred, null_value=null_value, multi_line=multi_line, escaped=escaped) if types else reader.csv(path)


def read_csv_strings(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    null_value: str = NULL,
    multi_line: bool = False,
    escaped: bool | None = None,
) -> DataFrame:
    """CSV with a header, every column text; cast later with ``schema.enforce``.

    A folder's files may have different headers: those with the same first line are read
    together, and what they give is appended by column name. Columns are those of all
    headers and the folder's partition columns, or those that ``schema`` names.
    """
    headers = csv_headers(spark, path)
    parts = []
    for line, files in headers.items():
        names = _names(line)
        reader = spark.read.options(**_DIALECT, nullValue=null_value, multiLine=multi_line)
        # the value of a partition column is the text in the folder's name
        with settings(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
            part = _load(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])), path, headers, files)
        wanted = [c for c in part.columns if schema is None or c in schema.fieldNames()]
        # partition columns are escaped by their own rule, see write_csv
        undo = {c: _plain_cell(c) if c in names else _plain_folder(c) for c in wanted}
        if null_value != NULL if escaped is None else not escaped:
            undo |= {c: quoted(c) for c in wanted if c in names}
        parts.append(part.selectExpr(*[f"{sql} AS {quoted(c)}" for c, sql in undo.items()]))
    if not parts:
        parts = [spark.createDataFrame([], all_strings(schema or T.StructType([])))]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return enforce(found, all_strings(schema or found.schema))


def write_csv(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    files: int | None = None,
    order_by: Sequence[str] = (),
    null_value: str = NULL,
    escaped: bool | None = None,
) -> None:
    """CSV with a header, replacing what is there.

    Null is written as ``null_value``, empty text as ``""``. Text that could be taken for
    the marker ``\\N``, with any number of backslashes before it, gets one more, which the
    readers take away: every text comes back. ``escaped=False`` does without, on either
    side, and is the rule where ``null_value`` is another: with ``'""'``, as the reports
    have it, empty text is read back as null by ``null_value=""``. Values with line breaks
    are quoted and need ``multi_line`` when read, and so does white space alone in a file
    of one column, whose line passes for a blank one.

    With ``partition_by`` the rows are first rebalanced on those columns: a value gets few
    files, and a value holding much of the data is split over several tasks instead of
    flowing through one. In the folders' names null is Spark's, and text that is empty,
    that name, or begins with a backslash has a backslash before it; it is read as text,
    so ``007`` stays so. ``files`` writes so many files, each in the order of ``order_by``
    if given, and suits small reports only; the tasks that compute the rows are not capped.
    """
    texts = [f.name for f in df.schema if f.dataType == T.StringType()]
    if (null_value == NULL) if escaped is None else escaped:
        df = df.withColumns({c: F.expr(_safe_cell(c)) for c in texts if c not in partition_by})
    df = df.withColumns({c: F.expr(_safe_folder(c)) for c in texts if c in partition_by})
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    elif files:
        df = df.repartition(files)
        df = df.sortWithinPartitions(*order_by) if order_by else df
    df.write.mode("overwrite").options(**_DIALECT, nullValue=null_value).partitionBy(*partition_by).csv(path)


def _safe_cell(name: str) -> str:
    return rf"CASE WHEN {quoted(name)} RLIKE '^\\\\+N$' THEN concat('\\', {quoted(name)}) ELSE {quoted(name)} END"


def _plain_cell(name: str) -> str:
    return rf"CASE WHEN {quoted(name)} RLIKE '^\\\\{{2,}}N$' THEN substring({quoted(name)}, 2) ELSE {quoted(name)} END"


def _safe_folder(name: str) -> str:
    return rf"CASE WHEN {quoted(name)} IN ('', '{_NO_VALUE}') OR startswith({quoted(name)}, '\\') THEN concat('\\', {quoted(name)}) ELSE {quoted(name)} END"


def _plain_folder(name: str) -> str:
    return rf"CASE WHEN startswith({quoted(name)}, '\\') THEN substring({quoted(name)}, 2) ELSE {quoted(name)} END"


# -- Parquet ------------------------------------------------------------------

def read_parquet(spark: SparkSession, path: str, schema: T.StructType = CANON) -> DataFrame:
    """Parquet, brought to ``schema``; date text or timestamps become dates.

    Columns are those of all files together: later files may have more.
    """
    return enforce(spark.read.option("mergeSchema", True).parquet(path), schema)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


# -- JSON Lines ---------------------------------------------------------------

def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CANON, *, mode: str = "FAILFAST") -> DataFrame:
    """A folder of JSON Lines part files is one dataset.

    Values are read as text and cast, so ``5.0`` is a whole number. A line that is no
    JSON fails the job; ``mode="PERMISSIVE"`` makes it a row of nulls, ``DROPMALFORMED``
    leaves it out.

    The writer leaves null fields out, so a column that is null everywhere is gone
    from the files; the schema brings it back.
    """
    return enforce(spark.read.schema(all_strings(schema)).option("mode", mode).json(path), schema)


def write_jsonl(df: DataFrame, path: str, *, max_files: int | None = None) -> None:
    """JSON Lines. ``max_files`` caps the part files and writing tasks, not those that compute the rows."""
    (df.repartition(max_files) if max_files else df).write.mode("overwrite").json(path)


def compact_jsonl(spark: SparkSession, source: str, target: str, *, max_files: int | None = None, pattern: str = "*") -> None:
    """Rewrite many part files, those whose names match ``pattern``, as fewer.

    Lines are moved as text, neither parsed nor reformatted. By default adaptive
    execution picks the file sizes (its advisory partition size) and keeps the
    writing parallel; ``max_files=1`` gives the single file of a small export.
    """
    lines = spark.read.text(source, pathGlobFilter=pattern)
    lines = lines.repartition(max_files) if max_files else lines.hint("rebalance")
    lines.write.mode("overwrite").text(target)


# -- Document collections -------------------------------------------------------

def read_documents(
    spark: SparkSession,
    fmt: str,
    options: Mapping[str, str],
    schema: T.StructType = CANON,
    *,
    id_column: str | None = None,
) -> DataFrame:
    """A document collection through any installed data source named by ``fmt``.

    How the collection is split for reading is the source's own option. Dates are
    stored as text and parsed here; whole numbers are asked for as text, since a store
    may hold them as ``5.0``. The store's own id is kept only on request.
    """
    stored = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.DateType, T.IntegralType)) else f.dataType) for f in schema]
    )
    wanted = schema
    if id_column:
        ident = T.StructField(id_column, T.StringType())
        stored, wanted = (T.StructType([ident, *s.fields]) for s in (stored, schema))
    df = spark.read.format(fmt).options(**options).schema(stored).load()
    dates = [f.name for f in schema if f.dataType == T.DateType()]
    return enforce(df.withColumns({d: parse_date(F.col(d)) for d in dates}), wanted)


def write_documents(df: DataFrame, fmt: str, options: Mapping[str, str]) -> None:
    df.write.format(fmt).mode("overwrite").options(**options).save()
