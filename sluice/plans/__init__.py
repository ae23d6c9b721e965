"""Composed plans: ingestion run, catalog set-up, checks, driver stand-in queries."""
