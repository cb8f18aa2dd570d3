"""Quotation linking of conversations, in DataFrame operations only.

A message's lines carry quote levels (the number of leading '>'). Runs of lines of one level are passages; level 0 is the message's own text. Own
passages, own lines and whole own texts are hashed in normal form and joined to the hashes of quoted passages (or of their lines, where a passage as a whole
is not found). A message replies to the message where the first of its linked quotes was written first; replies are ordered under the message that starts their thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.support import cut

MARKS = r"^(?:[ \t]*>)+"
_BLOCK = 1000


def normal(body: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def passages(messages: DataFrame) -> DataFrame:
    """messages with `passages`, an array of (level, lines without marks), from `text`; arrays only, no shuffle. A null text has none."""
    lined = messages.withColumn("lines", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    lined = lined.withColumn("levels", F.when(F.col("text").contains(">"), F.transform("lines", level)).otherwise(F.transform("lines", lambda _: F.lit(0))))
    spots = F.when(F.size("lines") > 0, F.sequence(F.lit(1), F.size("lines"))).otherwise(F.array().cast("array<int>"))
    lined = lined.withColumn("starts", F.filter(spots, lambda i: (i == 1) | (F.get("levels", i - 2) != F.get("levels", i - 1))))

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("lines") + 1)
        own = F.slice("lines", start, stop - start)
        depth = F.get("levels", start - 1)
        return F.struct(depth.alias("level"), F.when(depth > 0, F.transform(own, lambda x: F.regexp_replace(x, MARKS + " ?", ""))).otherwise(own).alias("lines"))

    return lined.withColumn("passages", F.transform("starts", run)).drop("lines", "levels", "starts")


def _ancestors(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of all that have a parent (conv_id, turn, reply_to), by doubling the steps."""
    up = cut(parents.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        on = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("r"), F.col("depth").alias("d"))
        joined = up.join(on, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
        joined = cut(joined.select("conv_id", "turn", F.coalesce("r", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")))
        up = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return up


def _positions(spots: DataFrame) -> DataFrame:
    """`position` of each distinct (conv_id, root_turn, turn) in its conversation, by counts of ever smaller blocks: no window holds more than about _BLOCK rows, or a
    conversation's rows divided by it."""
    block = lambda c: F.floor(F.col(c) / _BLOCK)
    steps = [("a", block("root_turn")), ("b", F.col("root_turn")), ("c", block("turn"))]
    keyed = spots
    for name, value in steps:
        keyed = keyed.withColumn(name, value)
    order = Window.partitionBy("conv_id", "a", "b", "c").orderBy("turn")
    keyed = keyed.withColumn("position", F.row_number().over(order))
    by = ["conv_id", "a", "b", "c"]
    for k in range(3, 0, -1):
        counts = keyed.groupBy(*by[: k + 1]).agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by[:k]).orderBy(by[k])) - F.col("n")).drop("n")
        keyed = keyed.join(before, by[: k + 1]).withColumn("position", F.col("position") + F.col("before")).drop("before")
    return keyed.select("conv_id", "root_turn", "turn", F.col("position").cast("long"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own lines, joined by \\n, trimmed), n_quotes, n_linked, quoted_conv, quoted_turn, reply_to, root_turn, depth, position for each
    row of messages (conv_id, turn, role, text; other columns are ignored).

    A quoted passage's origin is the earliest turn of the same conversation, before the quoting one, whose own text holds it; failing that, the first (conv_id, turn)
    of another conversation. quoted_* is the origin of the message's first linked passage of the lowest level; reply_to is the first origin in the same conversation, null if there
    is none. Sorting by conv_id, position gives each thread after the one that starts before it, replies after what they quote.
    Rows that repeat (conv_id, turn) share reply_to and position. Rows without conv_id or turn keep their own text and counts and get null
    links. Null texts have an empty own text and no quotes. A text of any length is parsed whole, in one row. An empty table gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = passages(rows)
    own = F.filter("passages", lambda p: p["level"] == 0)
    text = F.trim(F.array_join(F.flatten(F.transform(own, lambda p: p["lines"])), "\n"), F.lit(" \n\t\r\x0b\x0c"))
    quotes = F.filter(F.filter("passages", lambda p: p["level"] > 0), lambda p: normal(F.array_join(p["lines"], "\n")) != "")
    rows = cut(rows.select("conv_id", "turn", "role", text.alias("text"), own.alias("own"), quotes.alias("quotes")).withColumn("row", F.monotonically_increasing_id()))

    joined = lambda p: normal(F.array_join(p["lines"], "\n"))
    written = F.array_union(F.array_union(F.transform("own", joined), F.flatten(F.transform("own", lambda p: F.transform(p["lines"], normal)))), F.array(normal(F.col("text"))))
    known = rows.where("conv_id is not null and turn is not null")
    # only what is quoted somewhere needs an origin
    units = known.where(F.size("quotes") > 0).select("conv_id", "turn", "row", F.posexplode("quotes").alias("quote", "p"))
    units = units.select("conv_id", "turn", "row", "quote", F.col("p.level").alias("level"), F.posexplode(F.concat(F.array(joined(F.col("p"))), F.transform(F.col("p.lines"), normal))).alias("unit", "body")).where("body <> ''")
    units = cut(units.withColumn("key", F.md5("body")).drop("body"))
    keys = known.select("conv_id", "turn", F.explode(written).alias("body")).where("body <> ''").select("conv_id", "turn", F.md5("body").alias("key"))
    keys = keys.join(units.select("key").distinct(), "key", "left_semi")
    here = keys.groupBy("conv_id", "key").agg(F.min("turn").alias("here"))
    first = here.groupBy("key").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("there"))
    found = units.join(here, ["conv_id", "key"], "left").join(first, "key", "left")
    found = found.withColumn("here", F.when(F.col("here") < F.col("turn"), F.col("here"))).withColumn("there", F.when(F.col("there.conv_id") != F.col("conv_id"), F.col("there")))
    origin = F.when(F.col("here").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("here").alias("t"))).otherwise(F.struct(F.col("there.conv_id").alias("c"), F.col("there.turn").alias("t")))
    linked = found.withColumn("origin", origin).where("origin.t is not null")
    # of each passage the whole, or else its first line that is found
    linked = linked.groupBy("row", "conv_id", "turn", "quote").agg(F.min_by("origin", "unit").alias("origin"), F.first("level").alias("level"))
    rank = F.struct("level", "quote")
    per_row = linked.groupBy("row").agg(F.count("*").alias("n_linked"), F.min_by("origin", rank).alias("origin"))
    replies = linked.where("origin.c = conv_id").groupBy("conv_id", "turn").agg(F.min_by(F.col("origin.t"), rank).alias("reply_to"))
    replies = cut(replies)
    threads = _ancestors(replies) if not replies.isEmpty() else replies.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).alias("depth"))

    spots = known.select("conv_id", "turn").distinct().join(replies, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    spots = cut(spots.select("conv_id", "turn", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
    spots = spots.join(_positions(spots.select("conv_id", "root_turn", "turn")), ["conv_id", "root_turn", "turn"])
    out = rows.select("row", "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes")).join(per_row, "row", "left").join(spots, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("origin.c").alias("quoted_conv"), F.col("origin.t").alias("quoted_turn"), "reply_to", "root_turn", "depth", "position")
