"""Currency conversion and status vocabulary mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: the status vocabulary of the card silver table and the
# lower-case feed values that map onto it.
# ---------------------------------------------------------------------------
SILVER_STATUSES = ("APPROVED", "DECLINED", "PENDING")
STATUS_MAP = {"success": "APPROVED", "failed": "DECLINED", "pending": "PENDING"}


def normalise_status(df: DataFrame, column: str, mapping: dict[str, str] = STATUS_MAP, out: str | None = None) -> DataFrame:
    """Map feed status values; values absent from the map are kept."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def latest_rates(rates: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Rate per currency as of a date: the newest ``as_of_date <= as_of``.

    ``rates``: ``(currency, as_of_date, rate_to_usd)``.
    """
    r = rates
    if as_of is not None:
        cutoff = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
        r = r.filter(F.col("as_of_date") <= cutoff)
    return r.groupBy("currency").agg(F.max_by("rate_to_usd", "as_of_date").alias("rate_to_usd"))


def convert_currency(
    df: DataFrame,
    rates: DataFrame,
    amount: str,
    currency: str | Column,
    out: str = "amount_usd",
    original: str | None = "original_amount",
    source_currency: str | None = "source_currency",
    digits: int = 2,
    as_of: str | Column | None = None,
) -> DataFrame:
    """``out = round(amount * rate_to_usd, digits)``.

    ``original`` keeps the amount in its own currency and is NULL for USD
    rows; ``source_currency`` records the currency.  Rows whose currency has
    no rate get a NULL ``out``.
    """
    cur = F.col(currency) if isinstance(currency, str) else currency
    rate = latest_rates(rates, as_of).withColumnRenamed("currency", "_cur")
    joined = df.withColumn("_cur", cur).join(rate, "_cur", "left")
    amt = F.col(amount)
    # Exact decimal product, rounded half-up, so that money never rounds on
    # a binary-fraction tie.
    usd = F.round(amt.cast("decimal(20,4)") * F.col("rate_to_usd").cast("decimal(20,8)"), digits).cast("double")
    cols = {out: F.when(F.col("_cur") == "USD", amt).otherwise(usd)}
    if original:
        cols[original] = F.when(F.col("_cur") == "USD", F.lit(None).cast("double")).otherwise(amt)
    if source_currency:
        cols[source_currency] = F.col("_cur")
    return joined.withColumns(cols).drop("_cur", "rate_to_usd")
