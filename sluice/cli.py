"""Command line: set-up, verification, ingestion and landing manifest.

    spark-submit -m sluice.cli setup  --db ops --root hdfs:///lake [--buckets 512]
    spark-submit -m sluice.cli verify --db ops
    spark-submit -m sluice.cli ingest --db ops --root hdfs:///lake --date 2026-01-01 [--parallel 2] [--check-files]
    spark-submit -m sluice.cli drift  --root hdfs:///lake
    spark-submit -m sluice.cli manifest --root hdfs:///lake

(or ``python -m sluice.cli ...`` with a local session).  Each command uses
the active Spark session and prints one JSON document.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from sluice.session import ensure_settings

    return ensure_settings(SparkSession.builder.getOrCreate())


def setup(spark: SparkSession, db: str, root: str, buckets: int | None = None) -> dict:
    """Idempotent DDL, then the seeded configs (reloaded as in TRUNCATE + INSERT)."""
    from sluice.config import SEED_CONFIGS, config_frame
    from sluice.plans.catalog import create_all
    from sluice.plans.ingest import Layout

    create_all(spark, db, Layout(root), buckets=buckets)
    table = f"{db}.ingestion_config"
    seeds = config_frame(spark, [c.with_root(root) for c in SEED_CONFIGS])
    # Sources that are already configured, the user's own among them, stay as they are.
    seeds.join(spark.table(table).select("source_id"), "source_id", "left_anti").select(seeds.columns).write.insertInto(table)
    return {"database": db, "configs": spark.table(f"{db}.ingestion_config").count()}


def verify(spark: SparkSession, db: str) -> dict:
    """J1 checks against the catalog and the config table."""
    from sluice.plans.checks import catalog_checks, config_checks, expectations

    conf = spark.table(f"{db}.ingestion_config")
    rows = expectations(
        catalog_checks(spark, db) + config_checks(conf, 4, "src_atm_sg", "r014", "src_us_card_txns")
    ).collect()
    return {"ok": all(r.ok for r in rows), "checks": [r.asDict() for r in rows]}


def _rates(spark: SparkSession, name: str | None):
    if name is None:
        return None
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def ingest(spark: SparkSession, db: str, root: str, date: str, parallel: int = 1, rates: str | None = None,
           check_files: bool = False) -> dict:
    """One processing date for every active source of the config table; their profiles go to the registry.

    ``rates``: a catalog table, or a Parquet path, of ``(currency, as_of_date, rate_to_usd)``.
    """
    from sluice.plans.catalog import refresh_partitions
    from sluice.plans.ingest import Layout, run_from_config

    results = run_from_config(spark, spark.table(f"{db}.ingestion_config"), date, Layout(root), parallel=parallel,
                              silver_db=db, rates=_rates(spark, rates), check_files=check_files)
    for t in ("schema_registry", "dq_results", "dq_summary", "pipeline_lineage", "card_transactions_silver", "merchant_silver",
              "atm_silver", "fraud_flags_silver"):
        if spark.catalog.tableExists(f"{db}.{t}"):
            refresh_partitions(spark, db, t)
    return {"date": date, "runs": [{k: v for k, v in r.__dict__.items() if k != "rules"} for r in results]}


def drift(spark: SparkSession, root: str) -> dict:
    """H5 + H6: columns whose newest profile differs from the one before, in the raw feeds and in silver."""
    from pyspark.sql import functions as F

    from sluice.operators.registry import drift_from_registry, raw_drift
    from sluice.plans.ingest import Layout
    from sluice.schemas import SCHEMA_REGISTRY
    from sluice.sources.files import path_exists

    out = {}
    for name, path, compare in (("raw", Layout(root).raw_registry, raw_drift), ("silver", Layout(root).registry, drift_from_registry)):
        rows = []
        if path_exists(spark, path):
            found = compare(spark.read.schema(SCHEMA_REGISTRY).parquet(path))
            changed = (F.col("changes") != "") | F.col("min_changed") | F.col("max_changed") | (F.col("null_rate_delta") != 0)
            rows = found.filter(changed).orderBy("source_id", "column_name").collect()  # a row per changed column
        out[name] = [r.asDict() for r in rows]
    return out


def manifest(spark: SparkSession, root: str) -> dict:
    """A7 over the landing tree."""
    from sluice.sources.files import landing_manifest

    rows = landing_manifest(spark, f"{root.rstrip('/')}/raw").orderBy("source_dir", "processing_date").collect()
    return {"files": [r.asDict() for r in rows]}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sluice")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("setup")
    p.add_argument("--db", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--buckets", type=int, default=None, help="bucket the silver tables on their join keys")
    p = sub.add_parser("verify")
    p.add_argument("--db", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--db", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--date", required=True)
    p.add_argument("--parallel", type=int, default=1)
    p.add_argument("--rates", default=None, help="catalog table or Parquet path of currency rates")
    p.add_argument("--check-files", action="store_true", help="count each raw file's rows apart from the scan")
    p = sub.add_parser("drift")
    p.add_argument("--root", required=True)
    p = sub.add_parser("manifest")
    p.add_argument("--root", required=True)
    args = ap.parse_args(argv)

    spark = _session()
    if args.cmd == "setup":
        out = setup(spark, args.db, args.root, args.buckets)
    elif args.cmd == "verify":
        out = verify(spark, args.db)
    elif args.cmd == "ingest":
        out = ingest(spark, args.db, args.root, args.date, args.parallel, args.rates, args.check_files)
    elif args.cmd == "drift":
        out = drift(spark, args.root)
    else:
        out = manifest(spark, args.root)
    print(json.dumps(out, default=str))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
