"""Raw feed scans.

Raw feeds are read as text: every column is a string, typing happens in
``conform`` where cast failures are counted.  Several sources may share one
landing directory (US and India card feeds do); files are then routed to a
source by a glob pattern when the config has one, otherwise by their header
line: a file belongs to a source when its header holds every raw column of
the source's mapping.  Header lines are read by a Spark job that stops at
the first lines of each file; the driver gets a row per distinct header.
Files of one day may differ in their columns: each header or schema is a scan
of its own, and the scans are united by column name.
"""

from __future__ import annotations

import csv
import fnmatch
import io
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.config import SourceConfig


FILE = "_file"


@dataclass(frozen=True)
class FileGroup:
    """Files that are scanned alike: one header or one schema (None: none that matters)."""

    files: tuple[str, ...]
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Routed:
    """The files of a source, grouped, and their sizes in bytes."""

    groups: tuple[FileGroup, ...]
    sizes: dict[str, int]

    @property
    def files(self) -> tuple[str, ...]:
        return tuple(sorted(self.sizes))

    @property
    def bytes(self) -> int:
        return sum(self.sizes.values())


@dataclass(frozen=True)
class RawScan:
    """A raw scan plus the files behind it (for lineage)."""

    parts: tuple[DataFrame, ...]
    routed: Routed
    path: str

    @property
    def df(self) -> DataFrame:
        """All rows; a column that only some files have is null in the others."""
        return _by_name(self.parts)

    @property
    def tracked(self) -> DataFrame:
        """The rows with the file each comes from, in column ``_file``."""
        return _by_name([p.select("*", F.col("_metadata.file_path").alias(FILE)) for p in self.parts])

    @property
    def files(self) -> tuple[str, ...]:
        return self.routed.files

    @property
    def bytes(self) -> int:
        return self.routed.bytes


def _by_name(parts) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# File system helpers (Hadoop FileSystem API, so any cluster scheme works)
# ---------------------------------------------------------------------------
def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.exists(p))


def list_data_files(spark: SparkSession, path: str, with_sizes: bool = False):
    """Data files under ``path`` and its sub-folders (hidden and ``_`` names skipped)."""
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    root, out = fs.getFileStatus(p).getPath().toString().rstrip("/"), []
    found = fs.listFiles(p, True)
    while found.hasNext():
        st = found.next()
        name = st.getPath().toString()
        if not any(part.startswith((".", "_")) for part in name[len(root) + 1 :].split("/")):
            out.append((name, int(st.getLen())))
    out.sort()
    return out if with_sizes else [f for f, _ in out]


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.delete(p, True)) if fs.exists(p) else False


# ---------------------------------------------------------------------------
# A3: headers, patterns and schemas
# ---------------------------------------------------------------------------
#: More bytes than a text file has, so that the header scan makes one task of each file.
WHOLE_FILE = 1 << 40
HEADER_LINES = 64


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, value``: the first line of each file, read by a Spark job.

    Each file is a task of its own, which stops after the first few lines
    have arrived, so no file is read whole.  The settings for that belong to a
    session of their own and leave the caller's alone.
    """
    own = spark.newSession()
    for key, value in {
        "spark.sql.files.maxPartitionBytes": WHOLE_FILE,
        "spark.sql.files.openCostInBytes": WHOLE_FILE,
        "spark.sql.execution.arrow.maxRecordsPerBatch": HEADER_LINES,
    }.items():
        own.conf.set(key, str(value))

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = own.read.text(files).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.mapInArrow(first, "file string, value string")


def split_header(line: str, delimiter: str | None) -> tuple[str, ...]:
    return tuple(c.strip() for c in next(csv.reader(io.StringIO(line.lstrip("\ufeff")), delimiter=delimiter or ","), []))


def header_groups(spark: SparkSession, files: list[str], delimiter: str | None) -> list[FileGroup]:
    """Files by their header; a row per distinct header reaches the driver, with its files' names.  An empty file has the empty header."""
    if not files:
        return []
    lines = first_lines(spark, files).groupBy("value").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in lines.collect():
        groups.setdefault(split_header(row.value, delimiter), []).extend(unquote(f) for f in row.files)
    known = {f.split(":", 1)[-1].lstrip("/"): f for f in files}  # file:/x and file:///x are one file
    out = [FileGroup(tuple(sorted(known[f.split(":", 1)[-1].lstrip("/")] for f in fs)), h) for h, fs in groups.items()]
    empty = sorted(set(files) - {f for g in out for f in g.files})
    return sorted(out + ([FileGroup(tuple(empty), ())] if empty else []), key=lambda g: g.files)


def _merged(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """All columns of both schemas; None if they disagree on a type."""
    types = {f.name.lower(): f for f in a.fields}
    if any(types.get(f.name.lower(), f).dataType != f.dataType for f in b.fields):
        return None
    return T.StructType([*a.fields, *[f for f in b.fields if f.name.lower() not in types]])


def schema_groups(spark: SparkSession, fmt: str, files: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Parquet or ORC files in groups that one schema can read without loss.

    Spark reads the footers of all files in one job and merges their schemas.
    Only if two files give a column different types is the list halved, and
    the halves that agree are put together again.
    """

    def pieces(part: list[str]) -> list[tuple[T.StructType, list[str]]]:
        try:
            return [(spark.read.option("mergeSchema", "true").format(fmt).load(part).schema, part)]
        except (PySparkException, Py4JJavaError) as exc:  # ORC and Parquet raise it differently
            if len(part) == 1 or "MERGE" not in str(exc).upper():
                raise
        half = len(part) // 2
        return pieces(part[:half]) + pieces(part[half:])

    groups: list[tuple[T.StructType, list[str]]] = []
    for schema, part in pieces(list(files)):
        for i, (known, fs) in enumerate(groups):
            if (both := _merged(known, schema)) is not None:
                groups[i] = (both, fs + part)
                break
        else:
            groups.append((schema, list(part)))
    return groups


def route_files(spark: SparkSession, cfg: SourceConfig, path: str, headers: dict | None = None) -> Routed:
    """A3: the files of ``cfg`` under ``path``, grouped by header.

    With a file pattern, whatever the format, those whose names match.
    Delimited files with headers belong to the source when their header holds
    every mapped raw column, in any order and beside any other columns; one
    that only the pattern chose but that lacks such a column is an error.
    ``headers`` remembers headers already read of a folder, for the sources
    that share it.
    """
    listed = dict(list_data_files(spark, path, with_sizes=True))
    if cfg.file_pattern:
        listed = {f: n for f, n in listed.items() if fnmatch.fnmatch(f.rsplit("/", 1)[-1], cfg.file_pattern)}
    if (cfg.file_format or "csv").lower() != "csv" or not cfg.has_header:
        return Routed((FileGroup(tuple(sorted(listed))),) if listed else (), listed)
    headers = {} if headers is None else headers
    key = (path, cfg.delimiter, cfg.file_pattern)
    if key not in headers:
        headers[key] = header_groups(spark, sorted(listed), cfg.delimiter)
    wanted = {raw for raw, _ in cfg.column_mapping}
    chosen = tuple(g for g in headers[key] if wanted <= set(g.columns))
    if cfg.file_pattern and len(chosen) < len(headers[key]):
        odd = next(g for g in headers[key] if not wanted <= set(g.columns))
        raise ValueError(f"{cfg.source_id}: {odd.files[0]} lacks {sorted(wanted - set(odd.columns))}")
    return Routed(chosen, {f: listed[f] for g in chosen for f in g.files})


def unclaimed_files(spark: SparkSession, configs: list[SourceConfig], path: str, headers: dict | None = None) -> list[str]:
    """A3: files under a landing directory that none of its sources takes (say, after a column was renamed)."""
    claimed: set[str] = set()
    for cfg in configs:
        claimed.update(route_files(spark, cfg, path, headers).files)
    return [f for f in list_data_files(spark, path) if f not in claimed]


# ---------------------------------------------------------------------------
# scans
# ---------------------------------------------------------------------------
CORRUPT = "_corrupt_record"
RAW_JSON = "_raw_json"


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_source(spark: SparkSession, cfg: SourceConfig, processing_date: str, headers: dict | None = None) -> RawScan | None:
    """A1-A4 + A6: the raw feed of one source and day, all columns as text.

    Files that differ in their columns are scanned group by group and united
    by column name, so each file keeps all it has.  Returns None when the
    day's directory does not exist or holds no file of the source (A6: the
    source is skipped, the run goes on).
    """
    path = cfg.raw_path_for(processing_date)
    if not path_exists(spark, path):
        return None
    fmt = (cfg.file_format or "csv").lower()
    if fmt not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"{cfg.source_id}: unsupported file format {cfg.file_format!r}")
    routed = route_files(spark, cfg, path, headers)
    if not routed.files:
        return None
    raw_cols = [raw for raw, _ in cfg.column_mapping]
    if fmt == "csv":
        parts = [_scan_csv(spark, cfg, list(g.columns or raw_cols), list(g.files)) for g in routed.groups]
    elif fmt == "json":
        # The whole line goes along, so the rejected zone loses no field of it.
        parsed = F.from_json("value", string_schema([*raw_cols, CORRUPT]), {"columnNameOfCorruptRecord": CORRUPT})
        lines = spark.read.text(list(routed.files)).filter(F.trim("value") != "")
        parts = [lines.select(parsed.alias("_j"), F.col("value").alias(RAW_JSON)).select("_j.*", RAW_JSON)]
    else:
        parts = []
        for schema, files in schema_groups(spark, fmt, list(routed.files)):
            df = spark.read.schema(schema).format(fmt).load(files)
            parts.append(df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("string").alias(c) for c in df.columns]))
    return RawScan(tuple(parts), routed, path)


def _scan_csv(spark: SparkSession, cfg: SourceConfig, columns: list[str], files: list[str]) -> DataFrame:
    return (
        spark.read.schema(string_schema([*columns, CORRUPT]))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", "false")  # else a surplus field goes unseen when few columns are read
        .option("header", str(bool(cfg.has_header)).lower())
        .option("sep", cfg.delimiter or ",")
        .option("enforceSchema", "false" if cfg.has_header else "true")
        .option("mode", "PERMISSIVE")
        .option("multiLine", "false")
        .csv(files)
    )


def expected_rows(spark: SparkSession, cfg: SourceConfig, scan: RawScan) -> DataFrame:
    """G1: ``_file, rows_expected``, counted apart from the scan that parses the rows.

    Lines of text formats, blank ones and headers aside; rows of the others.
    One count over the raw files, in which no field is parsed.
    """
    fmt = (cfg.file_format or "csv").lower()
    if fmt in ("csv", "json"):
        rows = spark.read.text(list(scan.files)).filter(F.trim("value") != "")
        lines = F.count(F.lit(1)) - (1 if fmt == "csv" and cfg.has_header else 0)
    else:
        rows, lines = spark.read.format(fmt).schema("`_none` string").load(list(scan.files)), F.count(F.lit(1))
    return rows.groupBy(F.col("_metadata.file_path").alias(FILE)).agg(lines.alias("rows_expected"))


def read_headerless(spark: SparkSession, path: str, ddl: str, delimiter: str = ",") -> DataFrame:
    """A5: headerless delimited files with declared column types."""
    return spark.read.schema(ddl).option("header", "false").option("sep", delimiter).csv(path)


def read_format(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A4: any file format by name (JSON always with an explicit schema)."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "json":
        raise ValueError("JSON is read with an explicit schema")
    return reader.load(path)


def try_read(spark: SparkSession, path: str, fmt: str, schema=None, **options) -> DataFrame | None:
    """A scan that yields None instead of failing on a missing path."""
    try:
        return read_format(spark, path, fmt, schema, **options)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None
        raise


# ---------------------------------------------------------------------------
# Landing manifest
# ---------------------------------------------------------------------------
def landing_manifest(spark: SparkSession, root: str) -> DataFrame:
    """File count and bytes per source directory and processing date.

    Lists the whole tree with the binary-file source, selecting only
    ``path`` and ``length`` so that no file content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "[!._]*")
        .load(root)
        .select("path", "length")
    )
    parts = files.select(
        F.regexp_extract("path", r"/([^/]+)/processing_date=[^/]+/[^/]+$", 1).alias("source_dir"),
        F.regexp_extract("path", r"processing_date=([^/]+)/", 1).alias("processing_date"),
        "length",
    )
    return parts.groupBy("source_dir", "processing_date").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").cast("bigint").alias("total_bytes")
    )
