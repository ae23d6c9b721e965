"""Chat formatting in budgeted windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut, stored

#: Tokens of a window, and of the history that it may repeat.
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2
#: Tokens that a turn's marks cost.
MARK_TOKENS = 4
#: Marks of the template: a turn is OPEN role ROLE_END text CLOSE.
OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"


def escape(text: Column) -> Column:
    """Put a backslash behind each ``[`` and ``<`` and double each backslash, so that no mark is left in a text."""
    return F.regexp_replace(text, r"([\[<])|\\", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\|\\(\\)", "$1$2")


def token_estimate(text: Column) -> Column:
    """One token for each four code points begun, and the marks."""
    return F.ceil(F.length(text) / 4).cast("long") + MARK_TOKENS


def _numbered(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Add each turn's index, prefix sums and window.

    Turns (without their texts) are range-partitioned by conversation and
    order; sums are taken per partition first, then over the partitions, then
    within them.  So a conversation with very many turns is spread over many
    tasks.
    """
    order = ["c", "turn", "role", "tie", "row"]
    dealt = cut(turns.repartitionByRange(*order).withColumn("p", F.spark_partition_id()))
    blocks = dealt.groupBy("c", "p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("c", "p").orderBy(*order))
    indexed = cut(dealt.join(blocks.select("c", "p", before.alias("before")), ["c", "p"]).withColumn("i", F.col("before") + nth - 1).drop("before"))

    system = indexed.where((F.col("i") == 0) & (F.col("role") == "system")).select("c", F.col("tokens").alias("system"))
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce("system", F.lit(0)), F.lit(1))
    spans = indexed.join(system, "c", "left").withColumn("room", room)
    spans = spans.withColumn("large", (F.col("tokens") * 2 > F.col("room")).cast("long")).withColumn("small", F.when(F.col("large") == 0, F.col("tokens")).otherwise(F.lit(0)))
    parts = spans.groupBy("c", "p").agg(F.sum("large").alias("larges"), F.sum("small").alias("smalls"), F.max("small").alias("longest"))
    whole, ahead = Window.partitionBy("c"), Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "c",
        "p",
        F.coalesce(F.sum("larges").over(ahead), F.lit(0)).alias("larges"),
        F.coalesce(F.sum("smalls").over(ahead), F.lit(0)).alias("smalls"),
        F.max("longest").over(whole).alias("longest"),
    )
    within = Window.partitionBy("c", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = spans.join(parts, ["c", "p"]).withColumn("run", F.col("larges") + F.sum("large").over(within)).withColumn("end", F.col("smalls") + F.sum("small").over(within))
    cell = F.floor((F.col("end") - 1) / (F.col("room") - F.col("longest")))
    return summed.withColumn("cell", F.when(F.col("large") == 1, F.lit(-1)).otherwise(cell)).select("c", "i", "role", "row", "tokens", "run", "cell")


def _slim(said: DataFrame) -> DataFrame:
    """Turns without their texts, but for those that nothing else puts in order (``tie``)."""
    keyed = said.select("c", "turn", "role", "tokens", "row").withColumn("k", F.struct("c", "turn", "role"))
    again = stored(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "chat-ties")
    if again.isEmpty():
        return keyed.drop("k").withColumn("tie", F.lit(None).cast("string"))
    rows = keyed.join(again, "k").select("row")
    return keyed.drop("k").join(said.select("row", F.col("text").alias("tie")).join(rows, "row"), "row", "left")


def format_chats(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokens: Column | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Format conversations as windows of whole turns within a token budget.

    Prefix sums of the turns' tokens cut a conversation into spans of turns:
    with what is left of the budget beside the system turn and the history as
    room, and the longest turn of at most half the room as slack, a span ends
    where the sum passes a multiple of room less slack; a turn of over half
    the room is a span of its own.  Each span becomes a window: the system
    turn (the first turn, if its role is ``system``), up to ``history_turns``
    turns before the span of ``history_tokens`` in all, then the span.  All of
    this is found on rows without texts; texts are joined once, to the windows
    that hold them.  Loss
    falls on the texts of the span's assistant turns only, so each target
    counts once, however often it is repeated as history.

    Returns a row per window: the conversation column, ``first_turn`` (index
    of the span's first turn), ``n_repeated`` (leading turns that are repeats),
    ``n_turns``, ``tokens``, ``text``, and ``loss`` (array of start and end in
    code points of ``text``).  Cases: a null text is empty; a null role is the
    empty role; turns are ordered by turn (null first), then role, then text;
    repeated rows are turns each; a null conversation is a conversation; a
    turn larger than the room makes its window exceed the budget; other
    columns are not returned; no rows give no rows.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    tokens = (token_estimate(text) if tokens is None else tokens).cast("long")
    said = conversations.select(F.struct(F.col(conv_col).alias("id")).alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), tokens.alias("tokens"))
    said = stored(said.withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    numbered = cut(_numbered(_slim(said), budget, history_tokens))
    windows = cut(numbered.groupBy("c", "run", "cell").agg(F.min("i").alias("first")))

    columns = ["i", "role", "row", "tokens"]
    own = numbered.join(windows, ["c", "run", "cell"]).select("c", "first", F.lit(2).alias("part"), *columns)
    system = numbered.where("i = 0 and role = 'system'").join(windows.where("first > 0").select("c", "first"), "c")
    system = system.select("c", "first", F.lit(0).alias("part"), *columns)
    back = numbered.where("not (i = 0 and role = 'system')").select("*", F.explode(F.sequence(F.col("i") + 1, F.col("i") + history_turns)).alias("first")) if history_turns > 0 else numbered.where("false").withColumn("first", F.col("i"))
    near = back.join(windows.select("c", "first"), ["c", "first"])
    later = Window.partitionBy("c", "first").orderBy(F.col("i").desc())
    history = near.withColumn("upto", F.sum("tokens").over(later)).where(F.col("upto") <= history_tokens)
    history = history.select("c", "first", F.lit(1).alias("part"), *columns)

    pieces = own.unionByName(system).unionByName(history).join(said.select("row", "text"), "row").select(
        "c",
        "first",
        "part",
        "i",
        "tokens",
        F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(ROLE_END)).alias("head"),
        escape(F.col("text")).alias("body"),
        ((F.col("part") == 2) & (F.col("role") == "assistant")).alias("target"),
    )
    gathered = pieces.groupBy("c", "first").agg(
        F.sort_array(F.collect_list(F.struct("part", "i", "head", "body", "target"))).alias("turns"),
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("part") < 2).alias("n_repeated"),
    )
    at = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return gathered.select(
        F.col("c.id").alias(conv_col),
        F.col("first").cast("long").alias("first_turn"),
        "n_repeated",
        F.size("turns").cast("long").alias("n_turns"),
        "tokens",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"),
        at.alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text, read back: an array of role and text."""
    marked = F.split(text, CLOSE)
    bodies = F.slice(marked, F.lit(1), F.size(marked) - 1)
    begin = len(OPEN) + 1
    return F.transform(
        bodies,
        lambda t: F.struct(
            F.url_decode(F.substring(t, F.lit(begin), F.instr(t, F.lit(ROLE_END)) - begin)).alias("role"),
            unescape(F.substring(t, F.instr(t, F.lit(ROLE_END)) + 1, F.length(t))).alias("text"),
        ),
    )


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, read back, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
