"""Document fingerprints: chains of content words that follow common-word anchors.

A signature is a common word (anchor) and the next ``CHAIN`` content words; a
word with no such anchor among the ``REACH`` words up to it starts a chain of its
own, so stretches with few anchors have signatures too and an edit changes only
those near it.  The fingerprint is the sorted set of their hashes.  Likeness is the Jaccard share of
two sets; two sets whose lengths alone keep it below a threshold are never
compared.  Everything is column expressions.

Defined results: words are runs of letters and digits, in lower case; of
successive anchors the last starts a chain; a text without words is fingerprinted
by its whole content; so every text, empty ones too, has a signature, and
equal texts have equal fingerprints.  A null text counts as empty.  The document
after the last is the first; rows equal in doc_id follow each other by content;
a null doc_id comes first; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import components, real_id, table, with_key
from eoframe.session import stable

CHAIN = 2
REACH = 8
#: Common words of four languages.
ANCHORS = (
    "the of and to in is that it for was with as by on be at this from are or a he an "
    "le la les un une et de des du en que qui pour dans par sur est pas ou au aux il elle "
    "der die das und zu den von mit sich ist im nicht ein eine auf dem für als auch "
    "el los las y del se lo por con para es su al como más una"
).split()


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, anchors=ANCHORS) -> DataFrame:
    """``df`` with the array column ``out``: the sorted set of signatures of the column ``text``."""
    keep = [c for c in df.columns]
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    d = df.withColumn("_words", words)
    d = d.select(*keep, "_words", F.transform("_words", lambda w: w.isin(*anchors)).alias("_common"))
    ahead = lambda c, i, k: F.get(F.col(c), i + k)
    starts = F.transform("_common", lambda c, i: c & ~F.coalesce(ahead("_common", i, 1), F.lit(True)))
    d = d.select(*keep, "_words", "_common", starts.alias("_starts"))
    marked = F.transform("_words", lambda w, i: F.struct(F.when(ahead("_starts", i, -1), ahead("_words", i, -1)).alias("a"), w.alias("w"), ahead("_common", i, 0).alias("c")))
    d = d.select(*keep, "_words", "_starts", F.filter(marked, lambda x: ~x.c).alias("_content"))
    spots = F.transform("_content", lambda x, i: F.when(x.a.isNotNull(), F.xxhash64(x.a, x.w, *[ahead("_content", i, k).w for k in range(1, chain)])))
    from_ = lambda i: F.greatest(F.lit(1), i + 2 - REACH)
    # the second look at _starts keeps the planner from working it out anew for each word
    near = lambda i: ahead("_starts", i, 0) | F.array_contains(F.slice("_starts", from_(i), i + 2 - from_(i)), True)
    alone = F.transform("_words", lambda w, i: F.when(~near(i), F.xxhash64(w, *[ahead("_words", i, k) for k in range(1, chain + 1)])))
    d = d.select(*keep, F.filter(F.concat(spots, alone), lambda h: h.isNotNull()).alias("_spots"))
    chosen = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(F.array(F.xxhash64(text)))
    return d.select(*keep, F.array_sort(F.array_distinct(chosen)).alias(out))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard share of two signature sets; 0 where their lengths show it lies below ``least``."""
    shared = F.size(F.array_intersect(a, b))
    share = shared / (F.size(a) + F.size(b) - shared)
    if least <= 0:
        return share
    return F.when(F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(share)


def classes(signed: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, links): documents of ``signed`` (doc_id, signatures) linked by a likeness of ``least`` or more.

    Equal sets are one node.  Sets are split by length, one class per factor
    1 / ``least``, and meet only within a class or with the next.  Of a set, only
    the rarest signatures that a partner must share are looked up.
    """
    nodes = stable(signed.groupBy(F.xxhash64("signatures").alias("h"), "signatures").agg(F.min("doc_id").alias("node")))
    size = F.size("signatures")
    sig = nodes.select("node", F.explode("signatures").alias("s"))
    # rarest first; ties by hash
    often = sig.groupBy(F.col("s").alias("fs")).agg(F.count("*").alias("df"))
    ranked = sig.join(often, F.col("s") == F.col("fs")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    prefix = F.size("o") - F.ceil(F.lit(least) * F.size("o")).cast("int") + 1
    keys = ranked.select("node", F.size("o").alias("n"), F.floor(F.log(F.size("o")) / -math.log(least)).alias("band"), F.explode(F.slice("o", 1, prefix)).alias("p")).select(
        "node", "n", "band", F.col("p.s").alias("s"))
    left = keys.select(F.col("node").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    pairs = left.join(keys.select(F.col("node").alias("b"), F.col("n").alias("nb"), "s", "band"), ["s", "band"]).where(
        "a <> b AND (na < nb OR (na = nb AND a < b))").where(F.col("na") >= F.lit(least) * F.col("nb")).select("a", "b").distinct()
    sets = nodes.select("node", "signatures")
    compared = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("signatures").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("signatures").alias("sb")), "b")
        .where(likeness(F.col("sa"), F.col("sb"), least) >= least).select("a", "b")
    )
    edges = stable(compared)
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("links"))
    named = nodes.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left")
    named = named.join(degree, F.col("node") == F.col("v"), "left").select("h", F.col("signatures").alias("sg"), F.coalesce("root", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    own = signed.withColumn("h", F.xxhash64("signatures"))
    return own.join(named.withColumnRenamed("h", "nh"), (F.col("h") == F.col("nh")) & (F.col("signatures") == F.col("sg"))).select("doc_id", "class_id", "links")


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(docs)`` (doc_id, tk, ...) with ``next_<c>`` of the row after it in order of doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id; the few rows that end a range find the
    first row of the next range by a join.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    bin_ = F.lit(0)
    if bounds:
        listed = F.array(*[F.lit(int(b)) for b in bounds])
        bin_ = F.size(F.filter(listed, lambda b: b <= F.col("doc_id")))
    binned = docs.withColumn("bin", bin_)
    d = derive(binned)
    order = Window.partitionBy("bin").orderBy("doc_id", "tk")
    seen = d.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns], F.lead(F.lit(1)).over(order).alias("has"))
    inner = seen.where("has IS NOT NULL").drop("bin", "has")
    # a row of a few numbers per range, at most four times the shuffle partitions
    firsts = binned.select("bin", "doc_id", "tk").groupBy("bin").agg(F.min(F.struct("doc_id", "tk")).alias("f"))
    around = Window.orderBy("bin")
    after = stable(firsts.select(
        F.col("bin").alias("eb"), F.coalesce(F.lead("f").over(around), F.first("f").over(around.rowsBetween(Window.unboundedPreceding, 0))).alias("f")
    ).select("eb", F.col("f.doc_id").alias("fd"), F.col("f.tk").alias("ft")))
    few = docs.join(F.broadcast(after), (F.col("doc_id") == F.col("fd")) & (F.col("tk") == F.col("ft")))
    heads = derive(few).select(
        "eb", *[F.col(c).alias(f"next_{c}") for c in columns]).dropDuplicates(["eb"])
    last = seen.where("has IS NULL").drop("has", *[f"next_{c}" for c in columns]).join(heads, F.col("bin") == F.col("eb")).drop("bin", "eb")
    return inner.unionByName(last)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    d = with_next(with_key(docs), ["text", "fingerprint"], lambda t: with_signatures(t, "text", "fingerprint"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "fingerprint", likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
    )
    d = with_signatures(d, "edited", "edited_fingerprint")
    return d.select(
        real_id("doc_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "near_next",
    )


def op6_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
