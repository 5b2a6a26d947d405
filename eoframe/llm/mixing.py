"""Mixing sources to target weights by entropy balancing.

Each source has a token target.  Among all document rates between 0 and 2 whose
tokens meet the target, entropy balancing takes the one nearest to rate one.  It
tilts rates exponentially: r / (2 - r) = exp(lambda * size / scale).  lambda is
the root of the source's convex dual; Newton steps, held inside a bracket, run
for all sources at once over a histogram of (source, size).  Rates become whole
copies by one threshold per source on the rate plus a hash of the document, the
threshold found by narrowing a histogram, and last, in up to eight rounds, the one
or two documents of a source are added or dropped that bring its tokens nearest
to the target.

Defined results: a null text has size 0; a null source is a source, last in
order; a source without words has target 0; rows equal in doc_id and text are
counted apart; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import NO_ID, packed, real_id, table
from eoframe.session import stable, stable_row_each

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
STEPS = 60
BINS = 4096
PASSES = 4
SALTS = 32
ROUNDS = 8


def size_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(no, source, source_size, target) for one row per source with its size.

    The level at which sources hit ``cap`` is found in order of cap per weight;
    windows without a partition hold one short row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    named = sizes.withColumn("no", F.row_number().over(order)).withColumn(
        "weight", F.get(w, F.pmod(F.col("no") - 1, F.lit(len(weights))))
    ).withColumn("most", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("most") / F.col("weight"), "no")
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = named.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("open"),
    )
    # a source is at its cap when the level that would serve it and all later ones lies above
    capped = level.withColumn("full", F.col("rest") / F.col("open") * F.col("weight") >= F.col("most"))
    free = capped.withColumn("x", F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "no", (F.col("rest") / F.col("open")).alias("x")))).over(every))
    return free.select(
        "no", "source", "source_size",
        F.when(F.col("full") | F.col("x").isNull(), F.col("most")).otherwise(F.col("x.x") * F.col("weight")).alias("target"),
    )


def balance(histogram: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(no, lam, scale): the dual's solution per source; ``histogram`` has (no, size, n)."""
    state = stable_row_each(
        targets.join(histogram.groupBy(F.col("no").alias("hn")).agg(F.max("size").cast("double").alias("scale")), F.col("no") == F.col("hn"))
        .select("no", "target", "scale", F.lit(0.0).alias("lam"), (F.col("scale") * -40).alias("low"), (F.col("scale") * 40).alias("high"), F.lit(False).alias("done"))
        .where("target > 0 AND target < 2 * source_size")
    )
    z = F.col("size") / F.col("scale")
    for _ in range(steps):
        rate = F.lit(cap) / (1 + F.exp(-F.least(F.greatest(F.col("lam") * z, F.lit(-700.0)), F.lit(700.0))))
        each = histogram.join(state.where("NOT done").withColumnRenamed("no", "sn"), F.col("no") == F.col("sn"))
        sums = each.groupBy("no").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * z * rate * (1 - rate / cap)).alias("slope"),
        ).withColumnRenamed("no", "gn")
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") + F.try_divide(gap, F.col("slope"))
        inside = (newton > low) & (newton < high)
        step = F.when(inside, newton).otherwise((low + high) / 2)
        ended = F.col("gn").isNull() | (F.abs(gap) <= 1e-9 * F.col("target"))
        state = stable_row_each(
            state.join(sums, F.col("no") == F.col("gn"), "left").select(
                "no", "target", "scale",
                F.when(ended, F.col("lam")).otherwise(step).alias("lam"),
                F.when(ended, F.col("low")).otherwise(low).alias("low"),
                F.when(ended, F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | ended).alias("done"),
            )
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("no", "lam", "scale")


def unit(*columns: str) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def every_salt(per_source: DataFrame) -> DataFrame:
    """A small table with one row per source, once for every salt ``cs``: a hot source is joined in ``SALTS`` parts."""
    return per_source.withColumn("cs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def copies_for(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, size, source_size, target, ordinal, copies): a row per document row.

    ``docs`` has (doc_id, tk, source, size, n): n rows that are alike.  Every event
    "one more copy of this row" has a threshold; a source takes all events up to
    a threshold of its own.
    """
    sizes = stable(docs.groupBy("source", "size").agg(F.sum("n").alias("n")))
    targets = stable_row_each(source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    named = targets.withColumnRenamed("source", "ts").drop("source_size", "target")
    histogram = stable(sizes.join(named, F.col("source").eqNullSafe(F.col("ts"))).where("size > 0").select("no", "size", "n"))
    duals = stable_row_each(
        targets.join(balance(histogram, targets).withColumnRenamed("no", "dn"), F.col("no") == F.col("dn"), "left")
        .select(F.col("source").alias("ts"), "no", "source_size", "target", "lam", "scale")
    )
    rate = (
        F.when(F.col("target") >= CAP * F.col("source_size"), F.lit(CAP)).when(F.col("target") <= 0, F.lit(0.0))
        .otherwise(F.lit(CAP) / (1 + F.exp(-F.least(F.greatest(F.col("lam") * F.col("size") / F.col("scale"), F.lit(-700.0)), F.lit(700.0)))))
    )
    rows = (
        docs.withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
        .withColumn("s", salt("doc_id", "tk", "ordinal"))
        .join(every_salt(duals), F.col("source").eqNullSafe(F.col("ts")) & (F.col("s") == F.col("cs")))
        .select("doc_id", "tk", "source", "ordinal", "s", "size", "no", "source_size", "target", (rate + unit("doc_id", "tk", "ordinal")).alias("y"))
    )
    rows = stable(rows)
    events = rows.where("size > 0").select("no", "s", "size", F.explode(F.array(1 - F.col("y"), 2 - F.col("y"))).alias("at"))
    # narrow [low, low + width) per source; taken: tokens of all events below low
    cut = stable_row_each(targets.select(F.col("no").alias("cn"), F.col("target").alias("goal"), F.lit(-2.0).alias("low"), F.lit(4.0).alias("width"), F.lit(0).cast("bigint").alias("taken")))
    for _ in range(PASSES):
        bin_ = F.floor((F.col("at") - F.col("low")) / F.col("width") * BINS)
        inside = events.join(every_salt(cut), (F.col("no") == F.col("cn")) & (F.col("s") == F.col("cs"))).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("width")))
        bins = inside.groupBy("cn", bin_.alias("bin")).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("cn").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        before = bins.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
        hit = before.join(cut.select(F.col("cn").alias("c2"), "goal", "taken"), F.col("cn") == F.col("c2")).where("taken + before < goal")
        last = hit.groupBy(F.col("cn").alias("hn")).agg(F.max(F.struct("bin", "before")).alias("h"))
        cut = stable_row_each(
            cut.join(last, F.col("cn") == F.col("hn"), "left").select(
                "cn", "goal",
                F.when(F.col("h").isNull(), F.col("low")).otherwise(F.col("low") + F.col("h.bin") * F.col("width") / BINS).alias("low"),
                F.when(F.col("h").isNull(), F.col("width")).otherwise(F.col("width") / BINS).alias("width"),
                (F.col("taken") + F.coalesce("h.before", F.lit(0))).alias("taken"),
            )
        )
    at = cut.select("cn", F.col("low").alias("theta"), "goal")
    first = rows.join(every_salt(at), (F.col("no") == F.col("cn")) & (F.col("s") == F.col("cs"))).withColumn(
        "copies", ((F.col("theta") > 1 - F.col("y")).cast("int") + (F.col("theta") > 2 - F.col("y")).cast("int"))
    )
    first = stable(first.select("doc_id", "tk", "source", "ordinal", "s", "size", "source_size", "target", "no", "copies"))
    moves = closing_moves(first.where("size > 0").groupBy("no", "size", "copies").agg(F.count("*").alias("n")), cut.select(F.col("cn").alias("no"), F.col("goal").cast("double").alias("goal")))
    # each class names how many of its rows move; a row's place in its class is asked for only there
    wanted = every_salt(moves).select(F.col("no").alias("mn"), F.col("size").alias("ms"), F.col("copies").alias("mc"), "steps", "cs")
    classes = first.join(wanted, (F.col("no") == F.col("mn")) & (F.col("size") == F.col("ms")) & (F.col("copies") == F.col("mc")) & (F.col("s") == F.col("cs")))
    by_hash = [unit("doc_id", "tk", "ordinal"), F.col("doc_id"), F.col("tk"), F.col("ordinal")]
    each = classes.withColumn("i", F.row_number().over(Window.partitionBy("no", "size", "copies", "s").orderBy(*by_hash))).where(F.col("i") <= 2 * ROUNDS)
    place = Window.partitionBy("no", "size", "copies").orderBy(*by_hash)
    moved = stable(
        each.withColumn("i", F.row_number().over(place)).where(F.col("i") <= F.size("steps"))
        .select(F.col("doc_id").alias("bd"), F.col("tk").alias("bt"), F.col("ordinal").alias("bo"), F.col("source").alias("bs"), F.get("steps", F.col("i") - 1).alias("move"))
    )
    same = (F.col("doc_id") == F.col("bd")) & (F.col("tk") == F.col("bt")) & (F.col("ordinal") == F.col("bo")) & F.col("source").eqNullSafe(F.col("bs"))
    return first.join(moved, same, "left").select(
        "doc_id", "tk", "source", "ordinal", "size", "source_size", "target", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")
    )


def closing_moves(classes: DataFrame, goals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(no, size, copies, steps): what some rows of a class take more or less so that sources meet their goals.

    ``classes`` has (no, size, copies, n), ``goals`` (no, goal).  In each round
    every source makes the move of one or two rows that brings it nearest to its
    goal; partners are neighbours in order of tokens, so no pairs are formed.  It
    ends when no source gains.  A row moves once: its class keeps the others.
    A window holds one row per move of a source, and the sizes of its documents
    are fewer than the root of twice its words.
    """
    state = stable(classes)
    taken = classes.groupBy(F.col("no").alias("tn")).agg(F.sum(F.col("n") * F.col("size") * F.col("copies")).alias("t"))
    gaps = stable_row_each(goals.join(taken, F.col("no") == F.col("tn")).select("no", (F.col("goal") - F.col("t")).alias("gap")))
    done = state.where("false").select("no", "size", "copies", F.lit(0).alias("step"))
    for _ in range(rounds):
        moves = state.where("n > 0").select(
            "no", "size", "copies", "n", F.explode(F.filter(F.array(*[F.lit(x) for x in (-2, -1, 1, 2)]), lambda x: (F.col("copies") + x).between(0, 2))).alias("step")
        )
        still = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("copies"), F.lit(2).cast("bigint").alias("n"), F.lit(0).alias("step"))
        every = moves.select("no", F.struct("size", "copies", "n", "step").alias("m")).unionByName(gaps.select("no", still.alias("m")))
        worth = F.col("m.size") * F.col("m.step")
        asks = every.join(gaps, "no").where("abs(gap) > 0.5")
        line = asks.select("no", "gap", worth.cast("double").alias("at"), "m", F.lit(None).cast(asks.schema["m"].dataType).alias("ask")).unionByName(
            asks.select("no", "gap", (F.col("gap") - worth).alias("at"), F.lit(None).cast(asks.schema["m"].dataType).alias("m"), F.col("m").alias("ask"))
        )
        below = Window.partitionBy("no").orderBy("at", "m.size", "m.copies", "m.step", "ask.size", "ask.copies", "ask.step")
        above = Window.partitionBy("no").orderBy(*[F.desc(c) for c in ("at", "m.size", "m.copies", "m.step", "ask.size", "ask.copies", "ask.step")])
        met = line.withColumn("lower", F.last("m", ignorenulls=True).over(below)).withColumn("upper", F.last("m", ignorenulls=True).over(above)).where("ask IS NOT NULL")
        pair = met.select("no", "gap", "ask", F.explode(F.array("lower", "upper")).alias("b")).where("b IS NOT NULL")
        # two rows of one class need two rows there
        pair = pair.where("ask.size <> b.size OR ask.copies <> b.copies OR ask.n > 1")
        left = F.abs(F.col("gap") - F.col("ask.size") * F.col("ask.step") - F.col("b.size") * F.col("b.step"))
        best = stable_row_each(pair.groupBy("no").agg(F.min(F.struct(left.alias("left"), F.least("ask", "b").alias("a"), F.greatest("ask", "b").alias("b"))).alias("p"), F.first("gap").alias("gap")).where("p.left < abs(gap)"))
        steps = best.select("no", F.explode(F.array("p.a", "p.b")).alias("m")).where("m.step <> 0").select("no", "m.size", "m.copies", "m.step")
        if best.isEmpty():
            break
        done = done.unionByName(steps)
        used = steps.groupBy(*[F.col(c).alias(f"u_{c}") for c in ("no", "size", "copies")]).agg(F.count("*").alias("u"))
        state = stable(
            state.join(used, (F.col("no") == F.col("u_no")) & (F.col("size") == F.col("u_size")) & (F.col("copies") == F.col("u_copies")), "left")
            .select("no", "size", "copies", (F.col("n") - F.coalesce("u", F.lit(0))).alias("n"))
        )
        gained = best.select(F.col("no").alias("bn"), (F.col("gap") - F.col("p.a.size") * F.col("p.a.step") - F.col("p.b.size") * F.col("p.b.step")).alias("now"))
        gaps = gaps.join(gained, F.col("no") == F.col("bn"), "left").select("no", F.coalesce("now", "gap").alias("gap"))
    return stable(done.groupBy("no", "size", "copies").agg(F.sort_array(F.collect_list("step")).alias("steps")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, source, size, n) of ``docs``."""
    t = packed(docs).select("doc_id", F.xxhash64("_text").alias("tk"), F.col("row.source").alias("source"), size_of(F.col("_text")).alias("size"))
    return stable(t.groupBy("doc_id", "tk", "source", "size").agg(F.count("*").alias("n")))


def mix(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    return copies_for(sized(docs)).select(
        real_id("doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    c = stable(copies_for(sized(docs)).where("copies > 0").select(
        F.col("doc_id").alias("k"), F.col("tk").alias("kt"), F.col("source").alias("ks"), F.col("ordinal").alias("ko"), "copies"))
    d = packed(docs).withColumn("tk", F.xxhash64("_text")).drop("_text").withColumn("source", F.col("row.source"))
    alike = Window.partitionBy("doc_id", "tk", "source").orderBy(F.to_json("row"))
    numbered = d.withColumn("ordinal", F.row_number().over(alike).cast("bigint"))
    on = (F.col("doc_id") == F.col("k")) & (F.col("tk") == F.col("kt")) & F.col("source").eqNullSafe(F.col("ks")) & (F.col("ordinal") == F.col("ko"))
    return numbered.join(c, on).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
