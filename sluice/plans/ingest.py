"""Ingestion run of one source and day, and of all active sources.

Plan of ``run_source`` (one source, one processing date, one run id):

1. scan the raw feed as text (routed files of the day's directory);
2. one narrow projection: map names, cast safely (cast failures listed),
   parse event times with the source pattern, evaluate every rule;
3. stage that rule verdict as a Parquet table under ``spark.checkpoint.dir``:
   this cuts the lineage (the row-id tiebreak is frozen, lost executors
   recompute from the staged files, not from the raw scan); each row carries
   the name of its raw file;
4. dedup on the primary key among rows that passed (see ``operators.dedup``);
   each consumer below reads the columns it needs of the staged files;
5. silver: passing rows, then currency conversion, status vocabulary, UTC,
   audit columns -> dynamic overwrite of ``(processing_date, source_id)``;
   rejected: failing rows as raw text plus ``failed_rules``;
6. metrics from one aggregate over the staged verdict's ``failed_rules``, by
   raw file (file accounting) and summed up;
   dq_results / dq_summary / pipeline_lineage appended;
7. written-back check: rows and a checksum of the content, observed in the
   write and taken again from the written partition;
8. profiles of the day's raw and silver columns, kept as states and merged
   into the schema registry.

Everything data-sized runs on executors; the driver handles config rows and
one-row aggregates only.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schemas
from sluice.config import SourceConfig
from sluice.functions.rules import compile_rules
from sluice.functions.timefmt import to_utc
from sluice.operators import quality
from sluice.operators.convert import STATUS_MAP, convert_currency, latest_rates, normalise_status
from sluice.operators.dedup import ROW_ID, with_row_id
from sluice.operators.lineage import transformation_log
from sluice.operators.mapping import CAST_FAILURES, conform, with_audit_columns
from sluice.operators.registry import merge_states, profile_states, registry_rows
from sluice.plans.assess import dedup_verdict, rule_verdict
from sluice.session import ensure_settings, local_frame, scratch_path, sized_shuffles
from sluice.sinks.writers import (
    append, dealt_for, overwrite_partitions, overwrite_table_partitions, partition_path, replace_partition,
)
from sluice.sources.files import (
    CORRUPT, FILE, RawScan, delete_path, expected_rows, path_exists, read_source, unclaimed_files,
)
from sluice.sources.tables import read_table

RAW = "_raw"
MALFORMED = "raw:malformed"
# Concurrent jobs must not commit into the same directory at once (they would
# share the committer's temporary folder).  Audit tables are shared by every
# source, so their (tiny) appends are serialised; silver and rejected paths are
# written by one source group at a time.
_AUDIT_LOCK = threading.Lock()


def append_audit(df: DataFrame, path: str, partition_cols) -> None:
    """Compute the audit rows (one per run, rule or column) first; only the small write holds the lock."""
    rows = local_frame(df.sparkSession, df.collect(), df.schema)
    with _AUDIT_LOCK:
        append(rows, path, partition_cols)


@dataclass(frozen=True)
class Layout:
    """Where the audit tables live (sibling directories, never nested)."""

    root: str

    @property
    def dq_results(self) -> str:
        return f"{self.root}/hive/dq_results"

    @property
    def dq_summary(self) -> str:
        return f"{self.root}/hive/dq_summary"

    @property
    def lineage(self) -> str:
        return f"{self.root}/hive/lineage"

    @property
    def registry(self) -> str:
        return f"{self.root}/hive/config/schema_registry"

    @property
    def raw_registry(self) -> str:
        return f"{self.root}/hive/config/raw_registry"

    @property
    def profile_states(self) -> str:
        return f"{self.root}/hive/config/profile_states"

    @property
    def files(self) -> str:
        return f"{self.root}/hive/file_accounting"


@dataclass
class RunResult:
    source_id: str
    processing_date: str
    run_id: str
    status: str
    rows_read: int = 0
    rows_written: int = 0
    rows_rejected: int = 0
    rules: list[dict] = field(default_factory=list)
    message: str | None = None


def _lit_ts(value: dt.datetime):
    return F.to_timestamp(F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")))


def _target_fields(cfg: SourceConfig) -> list[T.StructField]:
    return schemas.data_fields(cfg.target_table)


def prepare(spark: SparkSession, cfg: SourceConfig, raw: DataFrame) -> DataFrame:
    """Steps 2: raw text -> typed silver columns, ``_cast_failures``, ``_raw``, ``_rid``."""
    formats = {cfg.date_silver: cfg.date_format}
    keep_raw = F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != FILE]).alias(RAW)
    tracked = raw if FILE in raw.columns else raw.withColumn(FILE, F.lit(None).cast("string"))
    with_raw = with_row_id(tracked.select("*", keep_raw))
    out = conform(with_raw, cfg.column_mapping, _target_fields(cfg), formats, keep=[RAW, ROW_ID, FILE])
    if CORRUPT in raw.columns:  # a line with too many or too few fields, or broken JSON
        broken = F.when(F.col(RAW)[CORRUPT].isNotNull(), F.array(F.lit(MALFORMED))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(CAST_FAILURES, F.concat(broken, F.col(CAST_FAILURES)))
    return out


def retype(spark: SparkSession, cfg: SourceConfig, staged: DataFrame) -> DataFrame:
    """Typed silver columns recomputed from the staged raw text (same projection as ``prepare``)."""
    formats = {cfg.date_silver: cfg.date_format}
    kept = [RAW, ROW_ID, FILE, quality.FAILED]
    flat = staged.select(f"{RAW}.*", *kept)
    return conform(flat, cfg.column_mapping, _target_fields(cfg), formats, keep=kept).drop(CAST_FAILURES)


def dedup_order(cfg: SourceConfig) -> list[str]:
    """Newest event time first, then the whole raw row (a total order on content)."""
    return [cfg.date_silver, RAW]


def currency_of(cfg: SourceConfig) -> str | None:
    """The currency of a source's amounts; None if its silver table has no amounts.

    A source that maps its amount to ``amount_usd`` is in USD.  One that maps
    it to ``original_amount`` has to name its currency.
    """
    fields = {f.name for f in _target_fields(cfg)}
    if not {"amount_usd", "original_amount"} <= fields:
        return None
    mapped = set(cfg.mapping.values())
    if cfg.source_currency:
        return cfg.source_currency.upper()
    if "original_amount" in mapped or "amount_usd" not in mapped:
        raise ValueError(f"{cfg.source_id}: the currency of original_amount is not configured (source_currency)")
    return "USD"


def check_rate(cfg: SourceConfig, processing_date: str, rates: DataFrame | None) -> None:
    """A source in another currency than USD needs its rate, or no amount could be told in USD."""
    currency = currency_of(cfg)
    if currency in (None, "USD"):
        return
    known = rates is not None and latest_rates(rates, processing_date).filter(
        (F.col("currency") == currency) & F.col("rate_to_usd").isNotNull()).limit(1).count()
    if not known:
        raise ValueError(f"{cfg.source_id}: no rate from {currency} to USD as of {processing_date}")


def finish_silver(df: DataFrame, cfg: SourceConfig, processing_date: str, rates: DataFrame | None) -> DataFrame:
    """Step 5 for passing rows: currency, status vocabulary, UTC.  No mapped column is overwritten."""
    fields = {f.name: f for f in _target_fields(cfg)}
    out = df
    currency, mapped = currency_of(cfg), set(cfg.mapping.values())
    if currency == "USD":
        filled = {"source_currency": F.lit("USD"), "original_amount": F.lit(None).cast("double")}
        if "amount_usd" not in mapped:
            filled["amount_usd"] = F.col("original_amount")
        out = out.withColumns({k: v for k, v in filled.items() if k not in mapped})
    elif currency is not None:
        out = convert_currency(out, rates, "original_amount", F.lit(currency), as_of=processing_date)
    if cfg.target_table == "card_transactions_silver":
        out = normalise_status(out, "status", STATUS_MAP)
    for name, f in fields.items():
        if isinstance(f.dataType, T.TimestampType):
            out = out.withColumn(name, to_utc(F.col(name), cfg.source_timezone))
    return out


def content(columns: list[str]) -> list:
    """Aggregates that tell the content of rows, whatever their order: rows, and two sums over row hashes."""
    row = F.xxhash64(*[F.col(c) for c in columns])
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"),
            F.coalesce(F.sum(F.shiftright(row, 44)), F.lit(0)).alias("sum")]


def unreconciled_counts(read: int, written: int, rejected: int, found: int) -> str | None:
    """What is wrong with the counts of a run, each observed where it arises; None if they reconcile."""
    if read != written + rejected:
        return f"read {read} != written {written} + rejected {rejected}"
    if found != written:
        return f"written {written} != re-read {found}"
    return None


def account_files(spark: SparkSession, cfg: SourceConfig, scan: RawScan, counts: DataFrame, check_files: bool) -> DataFrame:
    """G1 by raw file: bytes, rows read, written and rejected, for every file of the source, empty ones too.

    ``check_files`` counts each file's rows once more, apart from the scan
    (one more pass over the raw bytes), so that a file read short shows.
    """
    listed = spark.read.format("binaryFile").load(list(scan.files)).select(
        F.col("_metadata.file_path").alias(FILE), F.col("length").alias("bytes"))
    read = F.coalesce(F.col("_total"), F.lit(0))
    out = listed.join(counts.select(FILE, "_total", "_passed"), FILE, "left")
    if check_files:
        out = out.join(expected_rows(spark, cfg, scan), FILE, "left")
        expected = F.coalesce(F.col("rows_expected"), F.lit(0))
    else:
        expected = F.lit(None).cast("bigint")
    return out.select(
        F.col(FILE).alias("file"), "bytes", read.alias("rows_read"), F.coalesce("_passed", F.lit(0)).alias("rows_written"),
        (read - F.coalesce("_passed", F.lit(0))).alias("rows_rejected"), expected.alias("rows_expected"),
        F.coalesce(expected == read, F.lit(True)).alias("reconciled"),
    )


def short_files(accounts: DataFrame) -> str | None:
    """What is wrong with single files; None if each was read whole."""
    odd = accounts.filter(~F.col("reconciled")).orderBy("file").limit(5).collect()
    return "; ".join(f"{r.file}: read {r.rows_read} of {r.rows_expected} rows" for r in odd) or None


def _stage(spark: SparkSession, cfg: SourceConfig, raw: DataFrame, compiled, path: str) -> tuple[int, DataFrame]:
    """Write the rule verdict of every raw row; also gives the number of rows that the scan delivered."""
    seen = Observation(f"read-{uuid.uuid4().hex}")
    prepared = prepare(spark, cfg, raw.observe(seen, F.count(F.lit(1)).alias("rows")))
    rule_verdict(prepared, compiled).select(RAW, ROW_ID, FILE, quality.FAILED).write.mode("overwrite").parquet(path)
    return int(seen.get["rows"]), spark.read.parquet(path)


def run_source(
    spark: SparkSession,
    cfg: SourceConfig,
    processing_date: str,
    layout: Layout,
    run_id: str | None = None,
    rates: DataFrame | None = None,
    now: dt.datetime | None = None,
    profile_registry: bool = False,
    silver_table: str | None = None,
    check_files: bool = False,
    headers: dict | None = None,
) -> RunResult:
    """Ingest one source for one processing date (see module doc).

    ``silver_table``: write silver through this catalog table (e.g. a bucketed
    one from ``create_all(..., buckets=N)``) instead of by path.
    ``check_files``: count each raw file's rows apart from the scan and fail
    the run if one was read short.  ``headers``: see ``route_files``.
    """
    ensure_settings(spark)
    run_id = run_id or uuid.uuid4().hex
    scan = read_source(spark, cfg, processing_date, headers)
    if scan is None:
        at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        audit_outcome(spark, cfg, processing_date, layout, run_id, "SKIPPED", at)
        return RunResult(cfg.source_id, processing_date, run_id, "SKIPPED", message="no raw data for this day")
    with sized_shuffles(spark, scan.bytes):
        return ingest_frame(spark, cfg, scan.tracked, scan.path, processing_date, layout, run_id, rates, now,
                            profile_registry=profile_registry, silver_table=silver_table, scan=scan, check_files=check_files)


def ingest_frame(
    spark: SparkSession,
    cfg: SourceConfig,
    raw: DataFrame,
    source_path: str,
    processing_date: str,
    layout: Layout,
    run_id: str,
    rates: DataFrame | None = None,
    now: dt.datetime | None = None,
    profile_registry: bool = False,
    silver_table: str | None = None,
    scan: RawScan | None = None,
    check_files: bool = False,
) -> RunResult:
    """Steps 2-8 over an all-text raw DataFrame.

    ``profile_registry``: profile the day's raw and silver columns and append
    a snapshot over all days to the schema registry (H1, H2, H4).  ``scan``:
    the files behind ``raw``, which then carries ``_file``, for the file
    accounting.
    """
    ensure_settings(spark)
    started = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    t0 = time.time()
    spec = {"processing_date": processing_date, "source_id": cfg.source_id}
    silver_part = partition_path(cfg.silver_path, spec)
    rejected_part = partition_path(cfg.rejected_path, spec)

    check_rate(cfg, processing_date, rates)
    compiled = compile_rules(prepare(spark, cfg, raw), cfg.rules)
    # Stage the rule verdict: one narrow pass over the raw feed, and the row-id
    # tiebreak is frozen before any shuffle; dedup reads the staged files.
    # Only raw text, row id and verdict are staged (about the raw size); typed
    # columns are recomputed from the raw text by the same projection.
    stage_path = scratch_path(spark, "stage", run_id, cfg.source_id)
    rows_read, ruled = _stage(spark, cfg, raw, compiled, stage_path)
    try:
        # Every consumer below reads the columns it needs from the staged files.
        staged = dedup_verdict(retype(spark, cfg, ruled), [cfg.pk_silver], dedup_order(cfg), f"{stage_path}-dedup")

        by_file = quality.quality_counts(staged, compiled, [FILE])
        by_file.write.mode("overwrite").parquet(f"{stage_path}-files")
        by_file = spark.read.schema(by_file.schema).parquet(f"{stage_path}-files")
        counts_row = quality.total_counts(by_file, compiled).first()
        judged, rows_written = int(counts_row["_total"]), int(counts_row["_passed"])
        rows_rejected = judged - rows_written

        # silver
        ok = quality.passed(staged)
        data_cols = [f.name for f in _target_fields(cfg)]
        silver = finish_silver(staged.filter(ok).select(*data_cols), cfg, processing_date, rates)
        silver = with_audit_columns(silver, run_id, processing_date, cfg.source_id, ingested_at=_lit_ts(started))
        columns = [f.name for f in schemas.TABLES[cfg.target_table].fields]
        checked = [c for c in columns if c not in schemas.PARTITION_COLUMNS]
        # G1 + G4 cross-check: the writer's own rows and their content, observed during the write
        obs = Observation(f"silver-{uuid.uuid4().hex}")
        silver = dealt_for(silver.select(*columns), schemas.PARTITION_COLUMNS, rows_written / max(1, judged), silver_table).observe(obs, *content(checked))
        if silver_table and rows_written:
            overwrite_table_partitions(silver, silver_table)
        else:
            replace_partition(silver, cfg.silver_path, schemas.PARTITION_COLUMNS, spec, rows_written)
        written = dict(obs.get) if rows_written else {"rows": 0, "xor": 0, "sum": 0}

        # rejected zone: raw text + reasons
        rejected = staged.filter(~ok).select(f"{RAW}.*", quality.FAILED).withColumns(
            {"run_id": F.lit(run_id), "processing_date": F.lit(processing_date), "source_id": F.lit(cfg.source_id)}
        )
        obs_rejected = Observation(f"rejected-{uuid.uuid4().hex}")
        rejected = dealt_for(rejected, schemas.PARTITION_COLUMNS, rows_rejected / max(1, judged)).observe(obs_rejected, F.count(F.lit(1)).alias("rows"))
        replace_partition(rejected, cfg.rejected_path, schemas.PARTITION_COLUMNS, spec, rows_rejected)
        observed_rejected = int(obs_rejected.get["rows"]) if rows_rejected else 0

        # metrics, samples, summary
        counts = local_frame(spark, [tuple(counts_row)],
                             T.StructType([T.StructField(k, T.LongType()) for k in counts_row.asDict()]))
        metrics = quality.rule_metrics(counts, compiled)
        samples = quality.sample_failures(staged, compiled, cfg.pk_silver, data_cols)
        checked_at = _lit_ts(started)
        results = (
            metrics.join(samples, "rule_id", "left")
            .withColumn("sample_failures", F.coalesce(F.col("sample_failures"),
                                                      F.when(F.col("setup_error").isNotNull(),
                                                             F.to_json(F.struct(F.col("setup_error").alias("error"))))))
            .withColumns({
                "run_id": F.lit(run_id), "source_id": F.lit(cfg.source_id), "source_name": F.lit(cfg.source_name),
                "checked_at": checked_at, "processing_date": F.lit(processing_date), "source_id_part": F.lit(cfg.source_id),
            })
            .select(*[f.name for f in schemas.DQ_RESULTS.fields])
        )
        rule_rows = [r.asDict() for r in metrics.collect()]  # one row per rule, from the one-row counts
        append_audit(results, layout.dq_results, schemas.PARTITIONS["dq_results"])

        # written-back verification (G4): what the written partition holds
        found = written
        if rows_written:
            back = read_table(spark, cfg.silver_path, schemas.TABLES[cfg.target_table], spec)
            found = back.agg(*content(checked)).first().asDict()
        summary = quality.summary(counts, compiled).first().asDict()
        status = summary["ingestion_status"]
        message = None
        # G1 + G2: three counts that were taken apart -- at the raw scan, in the
        # silver write and in the rejected write -- and the re-read partition.
        problem = unreconciled_counts(rows_read, written["rows"], observed_rejected, found["rows"])
        if problem is None and written != found:
            problem = f"content written {written} != re-read {found}"
        if scan is not None:
            accounts = account_files(spark, cfg, scan, by_file, check_files)
            if check_files:
                accounts.write.mode("overwrite").parquet(f"{stage_path}-accounts")
                accounts = spark.read.schema(accounts.schema).parquet(f"{stage_path}-accounts")
                problem = short_files(accounts) or problem
            stamped = accounts.withColumns({"run_id": F.lit(run_id), "processing_date": F.lit(processing_date), "source_id": F.lit(cfg.source_id)})
            with _AUDIT_LOCK:
                append(stamped, layout.files, schemas.PARTITION_COLUMNS)
        if problem:
            status, message = "FAILED", problem
        rows_written, rows_rejected = written["rows"], observed_rejected
        completed = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        duration = int(round(time.time() - t0))

        summary_df = (
            quality.summary(counts, compiled)
            .withColumns({
                "run_id": F.lit(run_id), "source_id": F.lit(cfg.source_id), "source_name": F.lit(cfg.source_name),
                "processing_date": F.lit(processing_date), "ingestion_status": F.lit(status),
                "duration_seconds": F.lit(duration).cast("bigint"), "silver_path": F.lit(silver_part),
                "rejected_path": F.lit(rejected_part), "run_completed_at": _lit_ts(completed),
                "processing_date_part": F.lit(processing_date),
            })
            .select(*[f.name for f in schemas.DQ_SUMMARY.fields])
        )
        append_audit(summary_df, layout.dq_summary, schemas.PARTITIONS["dq_summary"])

        lineage = lineage_frame(
            spark, run_id, cfg, source_path, silver_part, rows_read, rows_written, rows_rejected,
            started, completed, status, processing_date,
        )
        append_audit(lineage, layout.lineage, schemas.PARTITIONS["pipeline_lineage"])
        if profile_registry:
            rows = read_table(spark, cfg.silver_path, schemas.TABLES[cfg.target_table], spec, data_cols) if rows_written else None
            register_profiles(spark, cfg, processing_date, layout, staged.select(f"{RAW}.*").drop(CORRUPT), rows, started)
        return RunResult(cfg.source_id, processing_date, run_id, status, rows_read, rows_written, rows_rejected,
                         rule_rows, message)
    finally:
        for part in ("-dedup", "-files", "-accounts"):
            delete_path(spark, stage_path + part)
        delete_path(spark, stage_path)  # every consumer is done (or the run failed); no staged copy is kept


def register_profiles(spark: SparkSession, cfg: SourceConfig, processing_date: str, layout: Layout, raw: DataFrame,
                      silver: DataFrame | None, started: dt.datetime) -> None:
    """H1 + H2 + H4: the day's profile states, and registry snapshots from them.

    One aggregate over the day's raw rows and one over its silver rows give
    states, which replace those of an earlier run of the day.  The registry
    snapshot merges the silver states of all days; the raw registry gets the
    day's own profile, so that drift shows columns that come and go.
    """
    kinds = {"raw": profile_states(raw, raw=True)}
    if silver is not None:
        kinds["silver"] = profile_states(silver)
    out = None
    for kind, states in kinds.items():
        part = states.withColumns({"kind": F.lit(kind), "processing_date": F.lit(processing_date), "source_id_part": F.lit(cfg.source_id)})
        out = part if out is None else out.unionByName(part)
    at = _lit_ts(started)
    with _AUDIT_LOCK:
        overwrite_partitions(out.coalesce(1), layout.profile_states, ["processing_date", "source_id_part"])  # a row per column
        states = spark.read.schema(out.schema).option("basePath", layout.profile_states).parquet(layout.profile_states).filter(
            F.col("source_id_part") == cfg.source_id)
    if silver is not None:
        merged = merge_states(states.filter("kind = 'silver'"))
        append_audit(registry_rows(merged, cfg.source_id, cfg.schema_version, at), layout.registry, schemas.PARTITIONS["schema_registry"])
    today = merge_states(states.filter((F.col("kind") == "raw") & (F.col("processing_date") == processing_date)))
    append_audit(registry_rows(today, cfg.source_id, cfg.schema_version, at), layout.raw_registry, schemas.PARTITIONS["schema_registry"])


def lineage_frame(spark, run_id, cfg: SourceConfig, source_path, target_path, rows_read, rows_written,
                  rows_rejected, started, completed, status, processing_date) -> DataFrame:
    """G3 + D4: the lineage row of one run and source."""
    base = T.StructType([f for f in schemas.PIPELINE_LINEAGE.fields
                         if f.name not in ("transformation_log", "started_at", "completed_at")])
    row = (uuid.uuid4().hex, run_id, cfg.source_id, source_path, cfg.target_table, target_path,
           rows_read, rows_written, rows_rejected, spark.sparkContext.applicationId, status, processing_date)
    df = local_frame(spark, [row], base)
    return df.withColumns({
        "transformation_log": transformation_log(cfg.mapping, [r.rule_id for r in cfg.rules], cfg.pk_silver),
        "started_at": _lit_ts(started),
        "completed_at": _lit_ts(completed) if completed else F.lit(None).cast("timestamp"),
    }).select(*[f.name for f in schemas.PIPELINE_LINEAGE.fields])


def audit_outcome(spark, cfg: SourceConfig, processing_date: str, layout: Layout, run_id: str, status: str, started) -> None:
    """dq_summary and lineage rows of a source that was skipped or failed; its counts are not known."""
    completed = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spec = {"processing_date": processing_date, "source_id": cfg.source_id}
    known = {
        "run_id": run_id, "source_id": cfg.source_id, "source_name": cfg.source_name, "processing_date": processing_date,
        "ingestion_status": status, "duration_seconds": int((completed - started).total_seconds()),
        "silver_path": partition_path(cfg.silver_path, spec), "rejected_path": partition_path(cfg.rejected_path, spec),
        "processing_date_part": processing_date,
    }
    base = T.StructType([f for f in schemas.DQ_SUMMARY.fields if f.name != "run_completed_at"])
    row = local_frame(spark, [tuple(known.get(f.name) for f in base.fields)], base)
    summary = row.withColumn("run_completed_at", _lit_ts(completed)).select(*[f.name for f in schemas.DQ_SUMMARY.fields])
    append_audit(summary, layout.dq_summary, schemas.PARTITIONS["dq_summary"])
    lineage = lineage_frame(spark, run_id, cfg, cfg.raw_path_for(processing_date), None, None, None, None,
                            started, completed, status, processing_date)
    append_audit(lineage, layout.lineage, schemas.PARTITIONS["pipeline_lineage"])


def unclaimed(spark: SparkSession, configs: list[SourceConfig], processing_date: str, run_id: str,
              headers: dict | None = None) -> list[RunResult]:
    """A FAILED result for each landing directory that holds files no source takes."""
    out = []
    for path in sorted({c.raw_path_for(processing_date) for c in configs if c.is_active}):
        sharing = [c for c in configs if c.raw_path_for(processing_date) == path]
        try:
            left = unclaimed_files(spark, sharing, path, headers) if path_exists(spark, path) else []
        except ValueError:  # a file chosen by pattern lacks a column: the source itself fails and says so
            continue
        if left:
            out.append(RunResult(UNCLAIMED, processing_date, run_id, "FAILED", message="no source takes " + ", ".join(left)))
    return out


UNCLAIMED = "(unclaimed)"


def run_all(
    spark: SparkSession,
    configs: list[SourceConfig],
    processing_date: str,
    layout: Layout,
    run_id: str | None = None,
    rates: DataFrame | None = None,
    parallel: int = 1,
    profile_registry: bool = False,
    silver_db: str | None = None,
    check_files: bool = False,
    problems: dict[str, str] | None = None,
) -> list[RunResult]:
    """All active sources of one day; a failing source never stops the others.

    ``problems``: sources that are not to be run at all, and why (see
    ``config_problems``); they fail with audit rows.

    ``silver_db``: write silver through that database's catalog tables
    (keeps their bucketing, see ``catalog.create_all``).

    Sources writing the same silver table run one after another; different
    tables may run concurrently (``parallel`` > 1) as separate Spark jobs.
    """
    run_id = run_id or uuid.uuid4().hex
    headers: dict = {}
    active = [c for c in configs if c.is_active]
    by_table: dict[str, list[SourceConfig]] = {}
    for c in active:
        by_table.setdefault(c.target_table, []).append(c)

    def one(cfg: SourceConfig) -> RunResult:
        started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        try:
            if problems and cfg.source_id in problems:
                raise ValueError(problems[cfg.source_id])
            table = f"{silver_db}.{cfg.target_table}" if silver_db else None
            return run_source(spark, cfg, processing_date, layout, run_id, rates, profile_registry=profile_registry,
                              silver_table=table, check_files=check_files, headers=headers)
        except Exception as exc:  # noqa: BLE001 -- failure isolation per source
            msg = f"{type(exc).__name__}: {exc}"
            try:
                audit_outcome(spark, cfg, processing_date, layout, run_id, "FAILED", started)
            except Exception:  # noqa: BLE001
                traceback.print_exc()
            return RunResult(cfg.source_id, processing_date, run_id, "FAILED", message=msg)

    def table_group(group: list[SourceConfig]) -> list[RunResult]:
        return [one(c) for c in group]

    results: list[RunResult] = []
    if parallel <= 1:
        for group in by_table.values():
            results.extend(table_group(group))
    else:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for rs in pool.map(table_group, by_table.values()):
                results.extend(rs)
    return results + unclaimed(spark, configs, processing_date, run_id, headers)


def config_problems(config_df: DataFrame) -> dict[str, str]:
    """J3 before a run: what is wrong with each active source's config, in words."""
    from sluice.config import validate_configs

    found = validate_configs(config_df.filter(F.col("is_active")))
    per_source = found.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set(
        F.concat_ws(": ", F.coalesce("rule_id", F.lit("rule")), "problem"))), "; ").alias("problems"))
    return {r.source_id: "invalid config: " + r.problems for r in per_source.collect()}


def run_from_config(
    spark: SparkSession,
    config_df: DataFrame,
    processing_date: str,
    layout: Layout,
    run_id: str | None = None,
    rates: DataFrame | None = None,
    parallel: int = 1,
    silver_db: str | None = None,
    profile_registry: bool = True,
    check_files: bool = False,
) -> list[RunResult]:
    """One day for every active source of a config table (A8 + ``run_all``).

    The configs are validated first (J3): a source with a problem fails and
    is not read.  The config rows are the only rows collected to the driver
    (one per source).
    """
    from sluice.config import active_configs

    return run_all(spark, active_configs(config_df), processing_date, layout, run_id, rates, parallel,
                   profile_registry=profile_registry, silver_db=silver_db, check_files=check_files,
                   problems=config_problems(config_df))
