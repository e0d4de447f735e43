"""File datasets: one path or pattern read as one table, unified by column name."""

from __future__ import annotations

import csv
import fnmatch
from collections.abc import Callable, Hashable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The format each extension names; `.gz` may follow any of them.
FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
}
# How many files' first lines are read at a time.
FIRST_LINE_READS = 16


class NoSuchFiles(ValueError):
    """A pattern that matches no file, too many, or one that Spark would pass over."""


def format_of(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    for extension, name_of_format in FORMATS.items():
        if name.endswith(extension):
            return name_of_format
    raise ValueError(f"no format is known for {path!r}")


def separator_of(path: str) -> str:
    return "\t" if path.lower().removesuffix(".gz").endswith(".tsv") else ","


def expand(
    spark: SparkSession, root: str, pattern: str, most_files: int | None = None
) -> list[str]:
    """The files a pattern matches below a root, sorted; none is an error.

    Nothing is left out: files named `_*`, which Spark takes for its own and
    does not read, are refused by name, and so are more than `most_files`.
    Hadoop's file system lists them; a pattern with `**`, which matches any
    number of folders, lists all below its fixed part. Names starting with `.`
    match only a segment that starts with one.
    """
    segments = pattern.split("/")
    fixed = []
    while segments and not set("*?[]") & set(segments[0]):
        fixed.append(segments.pop(0))
    base = "/".join([root.rstrip("/"), *fixed])
    if not segments:
        found = [base]
    else:
        below = len(_plain(base).rstrip("/")) + 1
        listed = _listed(spark, base, segments)
        found = [name for name in listed if _matches(_plain(name)[below:].split("/"), segments)]
    if not found:
        raise NoSuchFiles(f"no file matches {pattern!r}")
    if most_files is not None and len(found) > most_files:
        raise NoSuchFiles(f"{pattern!r} matches more than {most_files} files")
    unread = sorted(name for name in found if name.rsplit("/", 1)[-1].startswith("_"))
    if unread:
        raise NoSuchFiles(f"Spark does not read files named _*: {', '.join(unread[:5])}")
    return sorted(set(found))


def _plain(path: str) -> str:
    """A path without scheme and authority, to compare listed paths with given ones."""
    scheme, colon, rest = path.partition(":/")
    if not colon or "/" in scheme:
        return path
    rest = f"/{rest}"
    return f"/{rest[2:].partition('/')[2]}" if rest.startswith("//") else rest


def _listed(spark: SparkSession, base: str, segments: list[str]) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    top = hadoop.Path(base)
    system = top.getFileSystem(conf)
    if "**" not in segments:
        named = "/".join([base, *segments]).replace("[!", "[^")
        found = system.globStatus(hadoop.Path(named))
        return [f.getPath().toString() for f in found or [] if f.isFile()]
    if not system.exists(top):
        return []
    files, names = system.listFiles(top, True), []
    while files.hasNext():
        names.append(files.next().getPath().toString())
    return names


def _matches(names: list[str], segments: list[str]) -> bool:
    """Whether path segments match pattern segments, `**` any number of them."""
    fits = [True] + [False] * len(names)  # of the first so many names
    for head in segments:
        if head == "**":
            for i, name in enumerate(names):
                fits[i + 1] = fits[i + 1] or (fits[i] and not name.startswith("."))
            continue
        hidden = head.startswith(".")
        one = [
            fits[i] and name.startswith(".") <= hidden and fnmatch.fnmatchcase(name, head)
            for i, name in enumerate(names)
        ]
        fits = [False, *one]
    return fits[-1]


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that is not blank, without a job; "" if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        opened = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip("\ufeff \t"):
            line = reader.readLine()
        return (line or "").removeprefix("\ufeff")
    finally:
        stream.close()


def read_files(
    spark: SparkSession,
    root: str,
    pattern: str,
    schema: T.StructType | None = None,
    most_files: int | None = None,
) -> DataFrame:
    """A file or a pattern as one DataFrame, a column a file lacks being NULL.

    Give `schema` to save the pass over the data that infers types.
    """
    files = expand(spark, root, pattern, most_files)
    kind = format_of(pattern)
    if kind == "parquet":
        return _parquet(spark, files)
    return _csv(spark, files, schema) if kind == "csv" else _json(spark, files, schema)


def grouped(files: list[str], kind: Callable[[str], Hashable]) -> dict[Hashable, list[str]]:
    """Files by what their first line says; many first lines are read at once."""
    with ThreadPoolExecutor(FIRST_LINE_READS) as pool:
        kinds = list(pool.map(kind, files))
    groups: dict[Hashable, list[str]] = {}
    for found, path in zip(kinds, files, strict=True):
        groups.setdefault(found, []).append(path)
    return groups


def _parquet(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", len(files) > 1).parquet(*files)


def _csv(spark: SparkSession, files: list[str], schema: T.StructType | None) -> DataFrame:
    """One read per distinct header: Spark matches CSV columns by position.

    Types are inferred over all files together, so that one column has one type.
    Times without an offset are wall times, whatever the session's zone.
    """

    def reader(path: str):
        return spark.read.option("header", True).option("sep", separator_of(path))

    def header(path: str) -> tuple[str, ...]:
        sep = separator_of(path)
        names = next(csv.reader([first_line(spark, path)], delimiter=sep), [])
        if not all(names) or len({n.lower() for n in names}) < len(names):
            names = reader(path).csv(path).columns  # as Spark names such columns
        return (sep, *names)

    groups = grouped(files, header)
    if schema is None:
        with wall_times(spark):
            inferred = [
                reader(paths[0]).option("inferSchema", True).csv(paths).schema
                for paths in groups.values()
            ]
        types = one_type_per_column(inferred)
    else:
        types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for found, paths in groups.items():
        fields = [T.StructField(name, types.get(name, T.StringType())) for name in found[1:]]
        parts.append(reader(paths[0]).schema(T.StructType(fields)).csv(paths))
    return union_by_name(parts)


@contextmanager
def wall_times(spark: SparkSession) -> Iterator[None]:
    """While types are inferred: a time without an offset is a TIMESTAMP_NTZ."""
    name = "spark.sql.timestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_NTZ")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def one_type_per_column(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """Each column's type over all its files; text where they disagree."""
    types: dict[str, T.DataType] = {}
    for field in [f for schema in schemas for f in schema.fields]:
        have = types.get(field.name)
        types[field.name] = field.dataType if have is None else _wider(have, field.dataType)
    return types


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    whole = [T.IntegerType(), T.LongType()]
    if a == b:
        return a
    if a in whole and b in whole:
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    for date, time in ((a, b), (b, a)):
        if isinstance(date, T.DateType) and isinstance(time, T.TimestampNTZType):
            return time
    # Instants beside wall times or dates stay as they are written.
    return T.StringType()


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """DataFrames of different columns as one, matched by name, else NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _json(spark: SparkSession, files: list[str], schema: T.StructType | None) -> DataFrame:
    """Objects one per line, or a `.json` file holding one array of them.

    One column has one type over all files; text where they disagree.
    """
    groups = grouped(files, lambda path: _is_array(spark, path))

    def reader(is_array: bool):
        return spark.read.option("multiLine", is_array)

    found = {a: schema or reader(a).json(paths).schema for a, paths in groups.items()}
    types = one_type_per_column(list(found.values()))
    parts = []
    for is_array, paths in groups.items():
        fields = [T.StructField(f.name, types[f.name]) for f in found[is_array].fields]
        parts.append(reader(is_array).schema(T.StructType(fields)).json(paths))
    return union_by_name(parts)


def _is_array(spark: SparkSession, path: str) -> bool:
    if not path.lower().removesuffix(".gz").endswith(".json"):
        return False
    return first_line(spark, path).lstrip().startswith("[")
