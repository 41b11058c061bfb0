"""Quotation linking for chats and mail threads, with DataFrame operations only.

A line's quote level is the number of '>' that lead it. Runs of lines of one level are passages; the unquoted ones are the message's own
text. A quoted passage has units: the whole, its paragraphs and its lines. Units are normalised (white space, case, punctuation), hashed, and joined on
(conversation, hash) to the units of the own texts of earlier messages, at any length; of several originals the latest one before the quoting
message counts. The message replied to is that original of the longest unit found at the lowest quote level (of equals the latest); the replies form
trees, which give the conversation its order: thread by thread, and by turn within a thread.

Defined cases: null or empty text is an empty own text; a null conversation or turn is a value, but a null turn is neither before nor after another; lines
that only introduce a quotation ("... wrote:") are dropped before a quoted passage; a quotation that is found nowhere links to nothing; messages of equal
turn and text count once in links but are all returned; an empty table gives an empty result; other columns are ignored.

No conversation is gathered in one task: the latest earlier original is found in range partitions of (conversation, unit, turn), which split a unit of any
frequency, and between them by one row for each partition; joins are on equal keys, thread roots are found by doubling, and positions are counted over range
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

_LEAD = "'^(?:[ \\\\t]*>)+'"
_INTRO = "'(?i)(wrote|writes|schrieb|a écrit|escribió|escribe)[^\\\\n]{0,80}:[ \\\\t]*$|^-{2,} ?(original message|forwarded message|ursprüngliche nachricht|mensaje original|message d.origine).*$'"


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _passages() -> str:
    """array<struct<level, lines>> of _text: maximal runs of lines of one level."""
    level = f"length(regexp_replace(regexp_extract(x, {_LEAD}, 0), '[^>]', ''))"
    lines = f"transform(split(_text, '\\n'), x -> named_struct('level', {level}, 'line', regexp_replace(x, concat({_LEAD}, '[ ]?'), '')))"
    starts = "filter(sequence(0, size(l) - 1), i -> i = 0 or l[i].level <> get(l, i - 1).level)"
    runs = "transform(s, (a, k) -> named_struct('level', l[a].level, 'next', get(l, coalesce(get(s, k + 1), size(l))).level, 'lines', transform(slice(l, a + 1, coalesce(get(s, k + 1), size(l)) - a), x -> x.line)))"
    return _let(lines, "l", _let(starts, "s", runs))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, key, own, n_levels, n_quoted, quotes): quotes are (level, text, lines) of each quoted passage."""
    df = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.select("conv", "turn", "role", "key", F.expr(_passages()).alias("_p"))
    # an introduction is the last line of an unquoted passage that a quoted one follows
    own = f"transform(filter(_p, p -> p.level = 0), p -> if(p.next > 0 and trim(element_at(p.lines, -1)) rlike {_INTRO}, slice(p.lines, 1, size(p.lines) - 1), p.lines))"
    text = f"trim(BOTH '\\n' FROM array_join(flatten({own}), '\\n'))"
    quotes = "transform(filter(_p, p -> p.level > 0), p -> named_struct('level', p.level, 'text', array_join(p.lines, '\\n'), 'lines', p.lines))"
    return df.select("conv", "turn", "role", "key", F.expr(text).alias("own"), F.expr("coalesce(array_max(transform(_p, p -> p.level)), 0)").alias("n_levels"), F.expr(quotes).alias("quotes"))


def _unit_keys(whole: str, lines: str) -> str:
    """Normalised units of a text, largest first and once each: the whole, its paragraphs, its lines."""
    parts = f"concat(array({whole}), split({whole}, '\\n[ \\\\t]*\\n'), {lines})"
    return f"array_distinct(filter(transform({parts}, x -> {_normal('x')}), x -> length(x) > 0))"


def latest_before(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv, hash, turn, source): for each distinct quoted (conv, hash, turn) the latest turn before it of the distinct originals (conv, hash, turn)."""
    both = quotes.select("conv", "hash", "turn", F.lit(0).alias("kind")).unionByName(originals.select("conv", "hash", "turn", F.lit(1).alias("kind")))
    # a quote sorts before an original of its own turn
    ranged = both.repartitionByRange("conv", "hash", "turn", "kind").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "units")
    own = F.when(F.col("kind") == 1, F.col("turn"))
    within = W.partitionBy("part", "conv", "hash").orderBy("turn", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = ranged.withColumn("near", F.last(own, ignorenulls=True).over(within)).where("kind = 0")
    before = W.partitionBy("conv", "hash").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy("conv", "hash", "part").agg(F.max(own).alias("last")).withColumn("far", F.max("last").over(before))
    ends = ends.where("far is not null").select(F.col("conv").alias("_c"), F.col("hash").alias("_h"), F.col("part").alias("_p"), "far")
    found = here.join(ends, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("part") == F.col("_p")), "left")
    return found.select("conv", "hash", "turn", F.coalesce("near", "far").alias("source")).where("source is not null")


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """parsed() with n_quoted, n_linked and reply_to (a turn of the same conversation, or null)."""
    rows = staged(parsed(messages, conv_col, turn_col, role_col, text_col), "messages")
    quoting = rows.where((F.size("quotes") > 0) & F.col("turn").isNotNull())
    passages = quoting.select("conv", "turn", "key", F.posexplode("quotes").alias("n", "q"))
    units = passages.select("conv", "turn", "key", "n", F.col("q.level").alias("level"), F.explode(F.expr(_unit_keys("q.text", "q.lines"))).alias("unit"))
    units = staged(units.select("conv", "turn", "key", "n", "level", F.sha2("unit", 256).alias("hash"), F.length("unit").alias("chars")).distinct(), "quoted")
    # originals only of units that are quoted
    asked = units.select(F.col("conv").alias("_c"), F.col("hash").alias("_h")).distinct()
    convs = asked.select("_c").distinct()
    sources = rows.where(F.col("turn").isNotNull()).join(convs, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    own = sources.select("conv", "turn", F.explode(F.expr(_unit_keys("own", "split(own, '\\n')"))).alias("unit")).select("conv", "turn", F.sha2("unit", 256).alias("hash")).distinct()
    own = own.join(asked, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    near = latest_before(units.select("conv", "hash", "turn").distinct(), own)
    near = near.select(F.col("conv").alias("_c"), F.col("hash").alias("_h"), F.col("turn").alias("_t"), "source")
    found = units.join(near, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("turn") == F.col("_t")))
    pick = F.max_by("source", F.struct((-F.col("level")).alias("l"), F.col("chars"), F.col("source")))
    links = found.groupBy("conv", "turn", "key").agg(pick.alias("reply_to"), F.count_distinct("n").cast("int").alias("n_linked"))
    links = links.select(F.col("conv").alias("_c2"), F.col("turn").alias("_t2"), F.col("key").alias("_k2"), "reply_to", "n_linked")
    same = F.col("conv").eqNullSafe(F.col("_c2")) & (F.col("turn") == F.col("_t2")) & (F.col("key") == F.col("_k2"))
    joined = rows.join(links, same, "left")
    return joined.select("conv", "turn", "role", "key", "own", "n_levels", F.size("quotes").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to")


def _roots(rows: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of the turns that reply; a turn's reply is that of its earliest linked row. Replies go to earlier turns,
    so doubling ends after the logarithm of the longest chain."""
    up = staged(rows.where(F.col("reply_to").isNotNull()).groupBy("conv", "turn").agg(F.min("reply_to").alias("root")).withColumn("depth", F.lit(1)), "replies")
    while True:
        above = up.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        step = up.join(above, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        step = staged(step.select("conv", "turn", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved")), "replies")
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            return up


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message in reply order: (conv_id, turn, role, text, n_levels, n_quoted, n_linked, reply_to, thread_turn, depth, position)."""
    rows = staged(linked(messages, conv_col, turn_col, role_col, text_col), "linked")
    roots = _roots(rows).select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "root", "depth")
    placed = rows.join(roots, F.col("conv").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").drop("_c", "_t")
    # a message without a reply stands in the thread that runs on from the first turn: its root is itself
    placed = placed.withColumn("thread_turn", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    order = ("conv", "thread_turn", "turn", "key")
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = ranged.groupBy("conv", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(F.col("conv").alias("_c"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    done = ranged.join(shift, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return done.select(F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("text"), "n_levels", "n_quoted", "n_linked", "reply_to", "thread_turn", "depth", (F.col("_at") + F.col("_shift")).alias("position"))
