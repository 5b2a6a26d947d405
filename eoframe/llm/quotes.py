"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes; the number of marks is their level.  Runs
of lines of one level are passages; paragraphs of passages are normalised, hashed
and joined to the message that first wrote the same paragraph unquoted, in the
same conversation before any other, always before the quoting message.  A passage
that is no whole paragraph of that conversation is looked for in parts of its messages: as a run of
unquoted lines between quotes and blank lines, or as lines found in order in one
message; then the same in other conversations.  ``n_linked`` counts whole
paragraphs, ``n_in_part`` parts; both give threads and replies.  Messages become threads: conversations that quote each other are one thread.  A message
replies to the latest original of its outermost quotes, else to the turn before.
Originals are reduced to one row per paragraph hash and conversation before they
are joined, so a paragraph that a third of all messages share costs one row.

Defined results: null text is empty; null conv_id or turn come first; rows equal
in all columns stay apart; a message of quotes alone has an empty body; quotes
without an original are removed and counted; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import NO_ID, components, real_id, table
from eoframe.operators.ranks import number_rows
from eoframe.session import stable

MARKS = r"^(?:[ \t]*>)+"
LEDE = r"(?i)\b(?:wrote|writes|said)[ \t]*:[ \t]*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digest(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def parsed(messages: DataFrame) -> DataFrame:
    """(conv, turn, mk, role, lines, own, body): lines are (level, content); body has no quotes and no lines that introduce one, own has blank lines for them."""
    m = messages.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_ID)).alias("turn"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("mk", F.xxhash64("role", "text"))
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("content"))
    m = m.select("conv", "turn", "mk", "role", F.transform(F.split("text", "\r?\n"), line).alias("lines"))
    after = lambda i: F.coalesce(F.get("lines", i + 1).level, F.lit(0))
    written = lambda x, i: (x.level == 0) & ~((after(i) > 0) & x.content.rlike(LEDE))
    kept = F.filter("lines", written)
    own = F.array_join(F.transform("lines", lambda x, i: F.when(written(x, i), x.content).otherwise("")), "\n")
    return m.withColumn("own", own).withColumn("body", F.trim(F.array_join(F.transform(kept, lambda x: x.content), "\n"), F.lit(" \t\r\n")))


def passages(p: DataFrame) -> DataFrame:
    """(conv, turn, mk, level, hash, ls, lk): quoted paragraphs of messages, hashes of their lines and of these together."""
    rows = p.where(F.exists("lines", lambda x: x.level > 0)).select("conv", "turn", "mk", F.posexplode("lines").alias("at", "x")).select("conv", "turn", "mk", "at", "x.*")
    # within a message: a new passage where the level changes or a line is blank
    one = Window.partitionBy("conv", "turn", "mk").orderBy("at")
    new = F.coalesce((F.lag("level").over(one) != F.col("level")) | (F.trim("content") == ""), F.lit(True))
    runs = rows.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(one)).where("level > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x.content), "\n")
    texts = runs.groupBy("conv", "turn", "mk", "run", "level").agg(text.alias("text")).where(normal(F.col("text")) != "")
    return texts.select("conv", "turn", "mk", "level", digest(F.col("text")).alias("hash"), line_hashes("text").alias("ls"), F.sha2(F.array_join(filled("text"), "\n"), 256).alias("lk"))


def filled(text: str) -> Column:
    """Normalised lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")


def line_hashes(text: str) -> Column:
    return F.transform(filled(text), lambda x: F.xxhash64(x))


def in_order(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lk, conv, turn): messages in which the lines ``ls`` of ``wanted`` (lk, ls) are found in order.

    Messages are looked up by the line of a passage that the fewest messages have.
    """
    some = wanted.select("lk", F.size(F.array_distinct("ls")).alias("k"), F.explode(F.array_distinct("ls")).alias("x"))
    m = p.select("conv", "turn", "mk", line_hashes("own").alias("hs")).where(F.size("hs") > 1)
    has = m.select("conv", "turn", "mk", F.explode(F.array_distinct("hs")).alias("y"))
    has = stable(has.join(some.select(F.col("x").alias("wx")).distinct(), F.col("y") == F.col("wx"), "left_semi").distinct())
    often = has.groupBy(F.col("y").alias("oy")).agg(F.count("*").alias("n"))
    rare = some.join(often, F.col("x") == F.col("oy")).groupBy("lk", "k").agg(F.count("*").alias("known"), F.min(F.struct("n", "x")).alias("r"))
    rare = rare.where("known = k").select(F.col("lk").alias("rk"), F.col("r.x").alias("rx"))
    at = has.join(rare, F.col("y") == F.col("rx")).select("rk", F.col("conv").alias("ac"), F.col("turn").alias("at"), F.col("mk").alias("am"))
    both = at.join(m, (F.col("ac") == F.col("conv")) & (F.col("at") == F.col("turn")) & (F.col("am") == F.col("mk"))).join(wanted, F.col("rk") == F.col("lk"))
    met = F.aggregate("hs", F.lit(0), lambda i, x: F.when(F.get("ls", i) == x, i + 1).otherwise(i))
    return both.where(met == F.size("ls")).select("lk", "conv", "turn")


def originals(quoted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``quoted`` with ``<key>_here`` and ``<key>_there``: (c, t) of the first row of ``found`` (k, conv, turn) in the same and in an earlier conversation."""
    inside = stable(found.groupBy(F.col("k").alias("h"), F.col("conv").alias("c")).agg(F.min("turn").alias("t")))
    first = inside.groupBy(F.col("h").alias("fh")).agg(F.min(F.struct("c", "t")).alias("f"))
    q = quoted.join(inside, (F.col(key) == F.col("h")) & (F.col("conv") == F.col("c")) & (F.col("t") < F.col("turn")), "left").drop("h")
    q = q.join(first, F.col(key) == F.col("fh"), "left")
    earlier = F.struct(F.col("f.c").alias("c"), F.col("f.t").alias("t")) < F.struct(F.col("conv").alias("c"), F.col("turn").alias("t"))
    here, there = F.when(F.col("c").isNotNull(), F.struct("c", "t")), F.when(earlier & (F.col("f.c") != F.col("conv")), F.col("f"))
    return q.select(*quoted.columns, here.alias(f"{key}_here"), there.alias(f"{key}_there"))


def links(p: DataFrame) -> DataFrame:
    """(conv, turn, mk, level, oc, ot, part): each quoted paragraph with its original, or nulls; ``part`` if that is part of a paragraph."""
    quoted = stable(passages(p))
    wanted = quoted.select(F.col("hash").alias("wh"), "lk", "ls").dropDuplicates(["wh", "lk"])

    def units(text: list[Column]) -> DataFrame:
        u = p.select("conv", "turn", F.explode(F.array_distinct(F.concat(*text))).alias("unit")).where(normal(F.col("unit")) != "")
        return u.select(digest(F.col("unit")).alias("k"), "conv", "turn")

    whole = units([F.split("body", r"\n\s*\n"), F.array("body")])
    whole = whole.join(wanted.select("wh").distinct(), F.col("k") == F.col("wh"), "left_semi")
    # a passage of one line has the hash of that line
    runs = units([F.split("own", r"\n\s*\n"), F.split("own", "\n")])
    runs = runs.join(wanted.select("wh", "lk"), F.col("k") == F.col("wh")).select("lk", "conv", "turn")
    parts = runs.unionByName(in_order(p, wanted.where(F.size("ls") > 1).select("lk", "ls").dropDuplicates(["lk"])))
    q = originals(originals(quoted, whole, "hash"), parts.withColumnRenamed("lk", "k"), "lk")
    o = F.coalesce("hash_here", "lk_here", "hash_there", "lk_there")
    part = F.col("hash_here").isNull() & (F.col("lk_here").isNotNull() | F.col("hash_there").isNull())
    return q.select("conv", "turn", "mk", "level", o.alias("o"), part.alias("part")).select("conv", "turn", "mk", "level", F.col("o.c").alias("oc"), F.col("o.t").alias("ot"), "part")


def conversations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, thread_id, position, parent_conv, parent_turn, n_quotes, n_linked, body, n_in_part."""
    p = parsed(messages)
    found = stable(links(p))
    roots = components(found.where("oc IS NOT NULL").select(F.col("conv").alias("a"), F.col("oc").alias("b")))
    outer = F.max(F.when((F.col("level") == 1) & F.col("oc").isNotNull(), F.struct("oc", "ot")))
    by = found.groupBy(F.col("conv").alias("qc"), F.col("turn").alias("qt"), F.col("mk").alias("qm")).agg(
        F.count("*").alias("n_quotes"), F.count(F.when(~F.col("part"), F.col("oc"))).alias("n_linked"), F.count(F.when(F.col("part"), F.col("oc"))).alias("n_in_part"), outer.alias("o"))
    m = p.drop("lines", "own").join(by, (F.col("conv") == F.col("qc")) & (F.col("turn") == F.col("qt")) & (F.col("mk") == F.col("qm")), "left")
    m = m.join(roots, F.col("conv") == F.col("node"), "left").select(
        "conv", "turn", "mk", "role", "body", F.coalesce("root", "conv").alias("thread"), "n_quotes", "n_linked", "n_in_part", "o")
    # numbering by pieces: one conversation may hold a third of all messages
    turns = p.select("conv", "turn").distinct()
    order = number_rows(turns, ["conv"], [F.col("turn")], "no")
    before = order.select(F.col("conv").alias("pc"), F.col("turn").alias("pt"), (F.col("no") + 1).alias("pn"))
    prior = stable(order.join(before, (F.col("conv") == F.col("pc")) & (F.col("no") == F.col("pn")), "left").select(F.col("conv").alias("tc"), F.col("turn").alias("tt"), "pt"))
    m = m.join(prior, (F.col("conv") == F.col("tc")) & (F.col("turn") == F.col("tt")))
    placed = number_rows(m.drop("tc", "tt"), ["thread"], [F.col("conv"), F.col("turn"), F.col("mk")], "position")
    parent_conv = F.when(F.col("o").isNotNull(), F.col("o.oc")).when(F.col("pt").isNotNull(), F.col("conv"))
    return placed.select(
        real_id("conv").alias("conv_id"), real_id("turn").alias("turn"), "role", real_id("thread").alias("thread_id"), "position",
        real_id(parent_conv).alias("parent_conv"), real_id(F.coalesce("o.ot", "pt")).alias("parent_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "body",
        F.coalesce("n_in_part", F.lit(0)).cast("bigint").alias("n_in_part"),
    )


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
