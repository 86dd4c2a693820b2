"""Chat formatting: quotation linking.

Messages may quote earlier ones with > at the start of lines, nested to any depth. A line's level is
the number of its marks; a passage is a run of lines of one level, ended by a blank line or by another
level. Passages of every level are normalised into one line, so that other line breaks make no
difference, hashed, and joined to the message of their conversation that first wrote a passage or a
line with that hash itself. Of a passage without such an original, each line is looked up by itself,
as only a part may have been quoted. Of the levels with an original the shallowest counts: what most
of it comes from is what the message replies to. Without one it is the turn before.

Conversations follow the replies: after each message come its replies in the order of their turns,
each with all that answers it, without quotations. A message's position is the sum, over it and the
messages it answers, of one and of the sizes of the threads that their earlier siblings began. Sizes
and sums are found by doubling the distance looked at, so a chain of any length takes its logarithm of
steps, and earlier siblings are added up over ranges, so a message may have any number of replies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactuslab.llm.common import saved

#: Lines that introduce a quotation, as mail programs write them.
INTRODUCTION = r"^\s*(On\s.*\swrote|Am\s.*\sschrieb.*|Le\s.*\sa écrit|El\s.*\sescribió)\s*:\s*$"
MARKS = r"^((?:[ \t]*>)+)"
#: Positions in one part of a written thread.
PART_TURNS = 64
KEY = ["conv_id", "turn", "th"]


def quote_level(line: Column) -> Column:
    """How many > stand at the start of a line, whatever blanks are between them."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    """Without marks, in lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[ \t\r]+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Add th, which with conv_id and turn names a message, and lines: level, line, and whether it introduces a quotation."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(quote_level(x).alias("level"), x.alias("line")))

    def introduces(a: Column, k: Column) -> Column:
        after, second = F.get(a, k + 1), F.get(a, k + 2)
        blank = (after.level == 0) & (F.btrim(after.line) == "")
        return F.coalesce((after.level > 0) | (blank & (second.level > 0)), F.lit(False))

    marked = F.transform(F.array(lines), lambda a: F.transform(a, lambda x, k: F.struct(x.level.alias("level"), x.line.alias("line"), ((x.level == 0) & F.regexp_like(x.line, F.lit(INTRODUCTION)) & introduces(a, k)).alias("intro"))))[0]
    return messages.withColumn("th", F.xxhash64("role", "text")).withColumn("lines", marked)


def body(lines: Column) -> Column:
    """What a message says itself: lines of level 0 that introduce nothing, without blanks around."""
    own = F.filter(lines, lambda x: (x.level == 0) & ~x.intro)
    return F.btrim(F.array_join(F.transform(own, lambda x: x.line), "\n"), F.lit(" \t\r\n"))


def _passages(messages: DataFrame) -> DataFrame:
    """KEY, level, run and line: the lines of passages of all levels, normalised, with the number of the passage."""
    rows = messages.select(*KEY, F.posexplode("lines").alias("k", "x"))
    rows = rows.select(*KEY, "k", F.when(~F.col("x.intro"), F.col("x.level")).alias("level"), normalised(F.col("x.line")).alias("line"))
    rows = rows.withColumn("level", F.when(F.col("line") != "", F.col("level")))
    message = Window.partitionBy(*KEY).orderBy("k")  # the lines of one row
    starts = ~F.lag("level").over(message).eqNullSafe(F.col("level"))
    return rows.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(message)).where("level IS NOT NULL").select(*KEY, "level", "run", "k", "line")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("line")).withColumn("s", F.sha1(F.encode("line", "UTF-8")))


def quoted_originals(messages: DataFrame) -> DataFrame:
    """Of parsed messages, conv_id, turn and th of those that quote, and the turn and th that they reply to."""
    lines = saved(_passages(messages), "passages")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line), " ")  # of one row
    passages = saved(_hashed(lines.groupBy(*KEY, "level", "run").agg(whole.alias("line"))), "passages")
    own = _hashed(lines).where("level = 0").select(*KEY, "h", "s").unionByName(passages.where("level = 0").select(*KEY, "h", "s"))
    # A table of its own: a line that very many quote is then a key that adaptive execution can split.
    first = saved(own.groupBy("conv_id", "h", "s").agg(F.min(F.struct("turn", "th")).alias("from")), "originals")
    first = first.where("from IS NOT NULL")

    def originals(rows: DataFrame) -> DataFrame:
        return rows.join(first, ["conv_id", "h", "s"]).where(F.col("from.turn") < F.col("turn")).select(*KEY, "level", "run", "from", F.length("line").alias("n"))

    found = saved(originals(passages.where("level > 0")), "quoted")
    rest = _hashed(lines.where("level > 0").join(found.select(*KEY, "run"), [*KEY, "run"], "left_anti"))
    votes = found.unionByName(originals(rest)).groupBy(*KEY, "level", "from").agg(F.sum("n").alias("n"))
    return votes.groupBy(*KEY).agg(F.max_by("from", F.struct(-F.col("level"), "n", "from")).alias("from")).select(*KEY, "from")


def _earlier(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add before: the sum of value over the earlier rows of the same keys.

    Rows are dealt out in ranges of keys and order, so that those of one key may lie in many; sums within a
    range are added to those of the key's ranges before.
    """
    rows = saved(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each range
    sums = rows.groupBy("_range", *keys).agg(F.sum(value).alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)))
    sums = saved(sums.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_{k}") for k in keys], "_ahead"), "sums")
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, on)
    return rows.withColumn("before", F.col("_within") + F.col("_ahead")).drop("_within", "_ahead", "_range", "_r", *[f"_{k}" for k in keys])


def _threads(replies: DataFrame) -> DataFrame:
    """Of messages (conv_id, me, up) the top of their thread, depth, and position in the conversation."""
    columns = ["conv_id", "me", "far", "top", "depth"]
    start = replies.select("conv_id", "me", F.col("up").alias("far"), F.coalesce("up", "me").alias("top"), F.col("up").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size"))
    moving = saved(start, "threads")
    settled, moving = [moving.where("far IS NULL").select(*columns)], moving.where("far IS NOT NULL")
    added = []
    while moving.limit(1).count():
        # far is the message so many replies above, size how many there are within so many below. Only what hasn't
        # come to its root goes on; what is added to the size of a message is kept apart and summed up at the end.
        more = saved(moving.groupBy("conv_id", F.col("far").alias("me")).agg(F.sum("size").alias("more")), "below")
        added.append(more)
        known = reduce(DataFrame.unionByName, settled, moving.select(*columns))
        above = known.select("conv_id", F.col("me").alias("far"), F.col("far").alias("next"), F.col("top").alias("next_top"), F.col("depth").alias("more_depth"))
        grown = moving.join(more, ["conv_id", "me"], "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        grown = grown.join(above, ["conv_id", "far"])
        grown = saved(grown.select("conv_id", "me", F.col("next").alias("far"), F.col("next_top").alias("top"), (F.col("depth") + F.col("more_depth")).alias("depth"), "size"), "threads")
        settled.append(grown.where("far IS NULL").select(*columns))
        moving = grown.where("far IS NOT NULL")
    nodes = reduce(DataFrame.unionByName, settled)
    if added:
        sizes = saved(reduce(DataFrame.unionByName, added).groupBy("conv_id", "me").agg(F.sum("more").alias("more")), "sizes")
        nodes = nodes.join(sizes, ["conv_id", "me"], "left")
    else:
        nodes = nodes.withColumn("more", F.lit(None).cast("long"))
    nodes = nodes.withColumn("size", 1 + F.coalesce("more", F.lit(0).cast("long")))
    sized = replies.join(nodes, ["conv_id", "me"]).select("conv_id", "me", "up", "top", "depth", "size", "me.turn", "me.th")
    placed = _earlier(sized, ["conv_id", "up"], ["turn", "th"], "size")
    placed = saved(placed.withColumn("step", F.col("before") + F.col("up").isNotNull().cast("long")), "placed")
    at = placed.select("conv_id", "me", F.col("up").alias("far"), F.col("step").alias("position"))
    settled, moving = [at.where("far IS NULL")], at.where("far IS NOT NULL")
    while moving.limit(1).count():
        known = reduce(DataFrame.unionByName, settled, moving)
        above = known.select("conv_id", F.col("me").alias("far"), F.col("far").alias("next"), F.col("position").alias("more"))
        moved = saved(moving.join(above, ["conv_id", "far"]).select("conv_id", "me", F.col("next").alias("far"), (F.col("position") + F.col("more")).alias("position")), "positions")
        settled.append(moved.where("far IS NULL"))
        moving = moved.where("far IS NOT NULL")
    at = reduce(DataFrame.unionByName, settled)
    return placed.select("conv_id", "me", "top", "depth").join(at.select("conv_id", "me", "position"), ["conv_id", "me"])


def link_replies(messages: DataFrame) -> DataFrame:
    """Conversations of messages (conv_id, turn, role, text): one row for each, with what it replies to.

    Adds body, reply_to (a turn or null), by_quote, root (the turn that the thread begins with), depth
    (replies from there), position (in the conversation, from 0, every message after the one it answers)
    and levels (of the deepest quotation). A message answers the one its quotation comes from; of equal
    shares the later. Else it answers the message of the turn before, where there is one: of several the
    one that hashes lowest. Rows that repeat a message are one message, and one row. Messages with a null
    conv_id or turn stand alone, each at position 0. Null texts are empty; other columns aren't kept. An
    empty table gives an empty one.
    """
    rows = saved(parsed(messages.select("conv_id", "turn", "role", "text").distinct()), "messages")
    whole = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = quoted_originals(whole)
    before = saved(whole.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("th").alias("before_th")), "turns")
    parents = whole.select(*KEY).join(quotes, KEY, "left").join(before, ["conv_id", "turn"], "left")
    up = F.coalesce("from", F.when(F.col("before_th").isNotNull(), F.struct((F.col("turn") - 1).alias("turn"), F.col("before_th").alias("th"))))
    replies = saved(parents.select("conv_id", F.struct("turn", "th").alias("me"), F.col("from").isNotNull().alias("by_quote"), up.alias("up")), "replies")
    found = replies.join(_threads(replies), ["conv_id", "me"])
    found = found.select("conv_id", "me.turn", "me.th", "by_quote", F.col("up.turn").alias("reply_to"), F.col("top.turn").alias("root"), "depth", "position")
    levels = F.coalesce(F.array_max(F.transform("lines", lambda x: x.level)), F.lit(0))
    out = rows.select(*KEY, "role", body(F.col("lines")).alias("body"), levels.alias("levels")).join(found, KEY, "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "body", "reply_to", F.coalesce("by_quote", F.lit(False)).alias("by_quote"), F.coalesce("root", "turn").alias("root"), F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"), "levels")


def formatted(role: Column, text: Column) -> Column:
    """One message in the chat format."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n"))


def write_threads(linked: DataFrame) -> DataFrame:
    """conv_id, root, part and text: threads in the order of replies, in parts of PART_TURNS positions each."""
    part = F.floor(F.col("position") / PART_TURNS).alias("part")
    one = F.struct("position", "turn", "role", formatted(F.col("role"), F.col("body")).alias("text"))
    parts = linked.groupBy("conv_id", "root", part).agg(F.array_sort(F.collect_list(one)).alias("m"))
    return parts.select("conv_id", "root", "part", F.array_join(F.transform("m", lambda x: x.text), "").alias("text"))


ORACLE_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS id, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
l AS (SELECT id, conv_id, turn, k, string_split(coalesce(text, ''), chr(10))[k] AS line FROM m, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(k)),
v AS (SELECT *, len(regexp_extract(line, '{MARKS}', 1)) - len(replace(regexp_extract(line, '{MARKS}', 1), '>', '')) AS level FROM l),
n AS (SELECT *, lead(level, 1) OVER w AS l1, lead(level, 2) OVER w AS l2, lead(line, 1) OVER w AS t1 FROM v WINDOW w AS (PARTITION BY id ORDER BY k)),
i AS (SELECT *, level = 0 AND regexp_matches(line, '{INTRODUCTION}') AND coalesce(l1 > 0 OR (l1 = 0 AND trim(t1) = '' AND l2 > 0), false) AS intro,
  lower(trim(regexp_replace(regexp_replace(line, '{MARKS}', ''), '[ \t\r]+', ' ', 'g'))) AS norm FROM n),
b AS (SELECT id, trim(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE level = 0 AND NOT intro), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body, max(level) AS levels FROM i GROUP BY id),
s AS (SELECT *, CASE WHEN intro OR norm = '' THEN NULL ELSE level END AS lv FROM i),
g AS (SELECT *, sum(CASE WHEN lv IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS run FROM (SELECT *, lag(lv) OVER (PARTITION BY id ORDER BY k) AS before FROM s)),
ps AS (SELECT id, conv_id, turn, run, lv, string_agg(norm, ' ' ORDER BY k) AS norm FROM g WHERE lv IS NOT NULL GROUP BY ALL),
f AS (SELECT conv_id, norm, min(turn) AS turn FROM (SELECT conv_id, norm, turn FROM g WHERE lv = 0 UNION ALL SELECT conv_id, norm, turn FROM ps WHERE lv = 0) GROUP BY ALL),
fp AS (SELECT ps.id, ps.run, ps.lv, f.turn, len(ps.norm) AS n FROM ps JOIN f ON f.conv_id = ps.conv_id AND f.norm = ps.norm WHERE ps.lv > 0 AND f.turn < ps.turn),
fl AS (SELECT g.id, g.run, g.lv, f.turn, len(g.norm) AS n FROM g JOIN f ON f.conv_id = g.conv_id AND f.norm = g.norm WHERE g.lv > 0 AND f.turn < g.turn AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.id = g.id AND fp.run = g.run)),
vote AS (SELECT id, lv, turn, sum(n) AS s FROM (SELECT * FROM fp UNION ALL SELECT * FROM fl) GROUP BY ALL),
q AS (SELECT id, max_by(turn, (-lv, s, turn)) AS turn FROM vote GROUP BY id),
p AS (SELECT m.id, m.conv_id, m.turn, coalesce(q.turn, (SELECT max(x.turn) FROM m x WHERE x.conv_id = m.conv_id AND x.turn = m.turn - 1)) AS reply_to, q.turn IS NOT NULL AS by_quote FROM m LEFT JOIN q USING (id)),
r AS (SELECT id, conv_id, reply_to, turn AS root, CAST(0 AS BIGINT) AS depth, turn, [turn] AS path FROM p WHERE reply_to IS NULL
  UNION ALL SELECT p.id, p.conv_id, p.reply_to, r.root, r.depth + 1, p.turn, list_append(r.path, p.turn) FROM p JOIN r ON p.conv_id = r.conv_id AND p.reply_to = r.turn)
SELECT m.conv_id, m.turn, m.role, b.body, p.reply_to, p.by_quote, r.root, r.depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY r.path) - 1 AS position, b.levels FROM m JOIN b USING (id) JOIN p USING (id) JOIN r USING (id)"""
