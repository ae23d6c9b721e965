"""Scans: raw feeds (CSV / Parquet / JSON / ORC), routing, manifests, silver tables."""
