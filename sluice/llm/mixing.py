"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import aside, others, restored, stored

SEED = 42
#: Digits of a hash that make a uniform number: 13 hexadecimal digits are 52 bits, exact in a double.
HASH_DIGITS = 13
#: A rate above this is drawn as a sum of Poisson counts of equal smaller rates.
LARGEST_RATE = 8.0
#: The distribution is inverted by adding terms until they no longer change the sum; with rates up to 8, 64 terms do.
TERMS = 64
#: Hexadecimal digits of the shuffle key that say where in the order a copy belongs.
PLACE_DIGITS = 12
#: Equal rows are numbered within blocks of two to the power of this many rows as they are stored, then across blocks.
BLOCK_BITS = 12
#: A row draws at most this many counts at once; a document with more is dealt out in blocks of so many.
DRAWS_AT_ONCE = 128

#: Column names used inside.
INNER = ("_draw", "_order", "_id", "_same", "_row", "_block", "_before", "_within", "_number", "_n", "_source", "_parts", "_table", "_count", "_first")


def uniform(key: Column, seed: int, salt: Column | str) -> Column:
    """A number in [0, 1) from the hash of a row's key; the same on every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)), F.lit(salt) if isinstance(salt, str) else salt.cast("string"))), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(16**HASH_DIGITS)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... of a Poisson distribution, as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), F.array(first).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        start,
        lambda acc, k: F.struct(
            (acc["term"] * rate / k).alias("term"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["term"] * rate / k)).alias("sums"),
        ),
        lambda acc: acc["sums"],
    )


def poisson_count(u: Column, table: Column) -> Column:
    """The smallest count whose cumulative probability exceeds ``u``."""
    return F.size(F.filter(table, lambda c: c <= u))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", text_col: str = "text", total: float = 1.0) -> DataFrame:
    """The target repetition rate of each source, a row per source.

    A source's size is the number of code points of its texts.  The mixture
    is to hold ``total`` times the size of all sources; ``weights`` gives each
    source's share (scaled to sum 1; a source that isn't named has weight 0),
    and without it all sources with any text weigh alike.  The rate is share
    of the mixture over the source's size; a source without text has rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("size"))
    weight: Column = F.lit(1.0)
    if weights is not None:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(named, F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(0.0))
    weighed = stored(sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))), "mixing-sizes")
    sums = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = F.col("weight") / F.lit(float(sums["weight"] or 1)) * F.lit(float(total)) * F.lit(float(sums["size"] or 0)) / F.col("size")
    return weighed.select("source", "size", "weight", F.when(F.col("weight") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``_draw`` and ``_order``, the texts that a row's count and its copies' places are hashed from.

    Both are the id if no other row has it.  Rows with a null or repeated id
    have their other columns hashed too, and equal rows are numbered, in
    blocks, so that a value that many rows share brings no more than a block
    of them together.  Which of several equal rows gets which number changes
    nothing.  Their places all differ; their counts do too, but that equal
    rows with an id draw in pairs.
    """
    key = F.col(id_col)
    repeated = stored(docs.groupBy(key.alias("_id")).count().where("count > 1 or _id is null").select("_id"), "mixing-repeated")
    text = F.coalesce(key.cast("string"), F.lit(""))
    if repeated.isEmpty():
        return docs.withColumn("_draw", text).withColumn("_order", text)
    named, same = docs.where(key.isNotNull()), key == F.col("_id")
    plain = named.join(repeated, same, "left_anti").withColumn("_draw", text).withColumn("_order", text)
    again = named.join(repeated, same, "left_semi").unionByName(docs.where(key.isNull()))
    hashed = F.md5(F.to_json(F.struct(*others(docs))))
    again = stored(again.withColumn("_same", hashed).withColumn("_row", F.monotonically_increasing_id()), "mixing-again")
    rows = again.select("_row", "_same", F.shiftright("_row", BLOCK_BITS).alias("_block"))
    before = F.sum("_n").over(Window.partitionBy("_same").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("_same", "_block").agg(F.count("*").alias("_n")).select("_same", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_same", "_block").orderBy("_row")) - 1
    numbers = rows.withColumn("_within", within).join(blocks, ["_same", "_block"]).select("_row", (F.col("_before") + F.col("_within")).alias("_number"))
    draw = F.when(key.isNull(), F.col("_number")).otherwise(F.shiftright("_number", 1))
    again = again.join(numbers, "_row").withColumn("_draw", F.concat_ws(":", text, "_same", draw)).withColumn("_order", F.concat_ws(":", text, "_same", "_number"))
    return plain.unionByName(again.drop("_row", "_same", "_number"))


def byte_count(size: str) -> int:
    """Bytes of a setting such as ``134217728``, ``128m`` or ``1gb``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def drawn(first: Column, last: Column, seed: int) -> Column:
    """The sum of a row's draws from ``first`` to ``last``."""
    return F.aggregate(F.sequence(first, last), F.lit(0), lambda acc, part: acc + poisson_count(uniform(F.col("_draw"), seed, part), F.col("_table")))


def dealt(heavy: DataFrame, seed: int, partitions: int) -> DataFrame:
    """Documents with very many draws, a row per block of draws, dealt over the partitions.

    ``_count`` is a block's number of copies and ``_first`` the first one's
    number; prefix sums over a document's blocks give the numbers it would
    have if it drew in one row.  All blocks with their texts are less than a
    thousandth of the copies, so they are joined first and dealt then.
    """
    rows = stored(heavy.withColumn("_row", F.monotonically_increasing_id()), "mixing-heavy")
    size = F.lit(DRAWS_AT_ONCE).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_parts") - 1) / size)))
    count = drawn(F.col("_block") * size, F.least(F.col("_parts"), (F.col("_block") + 1) * size) - 1, seed)
    counts = rows.select("_row", "_draw", "_parts", "_table").withColumn("_block", every).repartition(partitions, "_row", "_block").select("_row", "_block", count.alias("_count"))
    before = F.sum("_count").over(Window.partitionBy("_row").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.withColumn("_first", F.coalesce(before, F.lit(0)))
    return rows.withColumn("_block", every).join(firsts, ["_row", "_block"]).repartition(partitions, "_row", "_block")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Repeat each document by a Poisson count whose mean is its source's target rate, then shuffle globally.

    The count inverts the Poisson distribution at a uniform number hashed from
    the seed and the id, or the whole row where the id is null or repeated
    (``identified``), so the result depends on nothing but the rows.  Rates
    above ``LARGEST_RATE`` are sums of draws, in blocks over all partitions if
    they are very many (``dealt``).  The rates, a row per source,
    are a stored table whose file size tells the planner whether to broadcast
    it; a source with very many documents needs no grouping of its own.  The
    copies are ordered globally by a hash of id (or row) and copy.  Being
    uniform, it says itself which partition a copy belongs to, so one pass
    deals them out evenly, whatever the sources and ids are, without sampling
    the input for bounds.
    There are as many partitions as a scan of so much text would have.

    Returns the columns of ``docs``, ``copy`` (from 0) and ``shuffle_key``.
    Cases: a null source is a source; rows with a null id, or an id that other
    rows have too, draw by their other columns; two equal rows with an id get
    the same count, of more each two; equal rows without an id draw each; a
    null or empty text counts nothing for its source's size; input columns
    named ``copy`` or ``shuffle_key`` are replaced, and no other name matters; no rows give no rows; more
    copies of one document than an int can number are an error.
    """
    docs, renamed = aside(docs, *INNER)
    id_col, text_col, source_col = (renamed.get(c, c) for c in (id_col, text_col, source_col))
    rates = source_rates(docs, weights, source_col, text_col, total)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("long")
    tables = rates.select(F.col("source").alias("_source"), parts.alias("_parts"), poisson_table(F.col("rate") / parts).alias("_table"))
    tables = stored(tables, "mixing-rates")
    expected = rates.agg(F.sum(F.col("size") * F.col("rate"))).first()[0] or 0
    spark = docs.sparkSession
    size = byte_count(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    partitions = max(spark.sparkContext.defaultParallelism, ceil(expected / size))
    known = identified(docs, id_col)
    own = [*others(docs, "copy", "shuffle_key"), "_order"]
    at_once = F.col("_parts") <= DRAWS_AT_ONCE
    meets = F.col(source_col).eqNullSafe(F.col("_source"))
    counted = known.join(tables.where(at_once), meets).withColumn("_count", drawn(F.lit(0).cast("long"), F.col("_parts") - 1, seed))
    copies = counted.where("_count > 0").select(*own, F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy"))
    if not (many := tables.where(~at_once)).isEmpty():
        blocks = dealt(known.join(many, meets), seed, partitions).where("_count > 0")
        number = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1))
        copies = copies.unionByName(blocks.select(*own, number.alias("copy")).withColumn("copy", F.col("copy").cast("int")))
    key = F.md5(F.concat_ws(":", "_order", F.lit(str(seed)), F.lit("order"), F.col("copy").cast("string")))
    place = F.conv(F.substring("shuffle_key", 1, PLACE_DIGITS), 16, 10).cast("double") / float(16**PLACE_DIGITS)
    placed = copies.withColumn("shuffle_key", key).drop("_order").repartitionById(partitions, F.floor(place * partitions).cast("int")).sortWithinPartitions("shuffle_key")
    return restored(placed, renamed)
