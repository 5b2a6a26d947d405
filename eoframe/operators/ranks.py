"""Order statistics that hold when one group has a third of all rows.

``percentile`` and a window over the group keep a whole group in one task.
That is right for a pixel's dates, wrong for a scene or a product.  The
operators here split a group by value range first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe.functions.radiometry import finite
from eoframe.session import stable

# Buckets per factor e of the value; one bucket spans 1.6 % of its value.  Finer
# ones make the histograms grow like the rows, coarser ones keep more rows in the second read.
_STEPS = 64
# Larger than |ln| of the smallest double times the steps, so buckets keep their sign.
_SHIFT = 800_000

# A wanted-bucket row is some 80 bytes, so a broadcast list stays below 50 MB.
BROADCAST_ROWS = 500_000

# Rows of a wanted bucket above which it is cut again, and into how many parts.
SPLIT_ROWS = 5_000_000
PARTS = 4096

# Hash buckets in which the rows of keys are counted first.
KEY_BUCKETS = 8192

HOT_FLOOR = 1_000_000
# a hot key gives at most four wanted buckets (two seasons, two ranks of a median)
HOT_SHARE = 4.0 / BROADCAST_ROWS


def value_bucket(v: Column) -> Column:
    """A bucket number that never decreases with the value, at any scale.

    It needs no statistics of the data, so no pass over it and no join.
    """
    up = F.floor(F.log(F.abs(v)) * F.lit(_STEPS)) + F.lit(_SHIFT)
    return F.when(v > 0, up).when(v < 0, -up).otherwise(F.when(v.isNotNull(), F.lit(0)))


def halfway(lower: Column, upper: Column) -> Column:
    """The middle of two values, the one formula of every median."""
    return lower * 0.5 + upper * 0.5


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], prefix: str = "q", few_groups: bool = False,
    split: int = SPLIT_ROWS, halves: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, for groups of any size.

    Result: ``by``, ``n_total``, ``n_valid``, ``v_min``, ``v_max`` and one
    column ``<prefix>0``, ``<prefix>1``, … per probability; NULL values count
    only in ``n_total``.  With ``halves`` a value halfway between two ranks is
    the mean of the two, as a median is; else it lies on the line between them,
    which may differ in the last bit.

    A histogram per group, combined before its shuffle, tells which buckets
    hold the wanted ranks.  A second read keeps only the rows of those
    buckets; no group meets in one task.  Meant for large groups.  A wanted
    bucket of different values with more than ``split`` rows (a group whose
    values lie close together) is cut by value until its parts are smaller; each
    cut is one more read, and none is made where buckets are small.

    The list of wanted buckets is broadcast only when it is small: it is
    checkpointed and counted, unless the caller vouches for ``few_groups``.
    Then the data is not shuffled at all.  Beyond the bound equal values
    collapse first and the list is joined by a shuffle.
    """
    by = list(by)
    facts = ["n_total", "n_valid", "v_min", "v_max"]
    rows = df.select(*by, finite(F.col(value)).alias("_v")).withColumn("_b", value_bucket(F.col("_v")))
    hist = rows.groupBy(*by, "_b").agg(
        F.count(F.lit(1)).alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    group = Window.partitionBy(*by)
    running = group.orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.when(F.col("_b").isNotNull(), F.col("_bc")), F.lit(0))
    hist = hist.select(
        *by,
        "_b",
        (F.sum(known).over(running) - known).alias("_before"),
        "_bc",
        "_lo",
        "_hi",
        F.sum("_bc").over(group).alias("n_total"),
        F.sum(known).over(group).alias("n_valid"),
        F.min("_lo").over(group).alias("v_min"),
        F.max("_hi").over(group).alias("v_max"),
    )

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n_valid") - 1)

    ranks = F.array(*[side(at(p)) for p in probs for side in (F.floor, F.ceil)])
    holds = F.exists(
        ranks, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_bc"))
    )
    hist = hist.where(F.col("_b").isNull() | holds)
    inside = [*[F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by], F.col("t._b") == F.col("h._b"), F.col("t._v").between(F.col("h._lo"), F.col("h._hi"))]

    def cut_up(wide: DataFrame, small: bool) -> DataFrame:
        """``wide`` intervals in parts of equal width, as intervals of their own; those with a wanted rank."""
        place = F.floor((F.col("t._v") - F.col("h._lo")) / (F.col("h._hi") - F.col("h._lo")) * PARTS)
        parts = rows.alias("t").join((F.broadcast(wide) if small else wide).alias("h"), inside).groupBy(
            *[F.col(f"h.{c}").alias(c) for c in (*by, "_b", *facts, "_before")], place.alias("_part")
        ).agg(F.count(F.lit(1)).alias("_bc"), F.min("t._v").alias("_lo"), F.max("t._v").alias("_hi"))
        upto = Window.partitionBy(*by, "_before").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        return parts.withColumn("_done", F.sum("_bc").over(upto)).withColumn("_before", F.col("_before") + F.col("_done") - F.col("_bc")).where(holds).select(*hist.columns)

    small = True
    if not few_groups:
        # a bucket of one value is one row later on, whatever its size
        wide = F.coalesce((F.col("_bc") > split) & (F.col("_lo") < F.col("_hi")), F.lit(False))
        hist = stable(hist)
        while True:
            listed, some = hist.agg(F.count(F.lit(1)), F.max(wide)).first()
            small = listed <= BROADCAST_ROWS
            if not some:
                break
            hist = stable(hist.where(~wide).unionByName(cut_up(hist.where(wide), small)))
    wanted = hist.where(F.col("_b").isNotNull()).drop("_bc")
    if small:
        found, wanted = rows.withColumn("_c", F.lit(1)), F.broadcast(wanted)
    else:
        found = rows.groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ties = (
        found.alias("t")
        .join(wanted.alias("h"), inside)
        .groupBy(*[F.col(f"t.{c}").alias(c) for c in by], "_before", "_v")
        .agg(F.sum("_c").alias("_c"), *[F.max(c).alias(c) for c in facts])
    )
    in_bucket = Window.partitionBy(*by, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = ties.withColumn("_end", F.col("_before") + F.sum("_c").over(in_bucket)).select(
        *by, *facts, "_v", (F.col("_end") - F.col("_c")).alias("_start"), "_end"
    )
    void = hist.where(F.col("_b").isNull()).select(
        *by,
        *facts,
        F.lit(None).cast("double").alias("_v"),
        F.lit(None).cast("bigint").alias("_start"),
        F.lit(None).cast("bigint").alias("_end"),
    )
    ends = []
    for i, p in enumerate(probs):
        for side, rank in (("lo", F.floor(at(p))), ("hi", F.ceil(at(p)))):
            hit = (rank >= F.col("_start")) & (rank < F.col("_end"))
            ends.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    out = picked.unionByName(void).groupBy(*by).agg(*[F.max(c).alias(c) for c in facts], *ends)
    quantiles = []
    for i, p in enumerate(probs):
        part = at(p) - F.floor(at(p))
        between = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part
        if halves:
            between = F.when(part == 0.5, halfway(F.col(f"_lo{i}"), F.col(f"_hi{i}"))).otherwise(between)
        quantiles.append(between.alias(f"{prefix}{i}"))
    return out.select(*by, *facts, *quantiles)


def hot_keys(
    counts: DataFrame, keys: Sequence[str], rows: Column, floor: int = HOT_FLOOR, share: float = HOT_SHARE
) -> DataFrame:
    """Keys of a count table with more than ``max(floor, share * all rows)`` rows.

    There are at most ``1 / share`` of them whatever the data, which is the
    proof that the result may be broadcast.
    """
    limit = counts.agg(F.greatest(F.lit(float(floor)), F.sum(rows) * F.lit(float(share))).alias("_limit"))
    return counts.where(rows > limit.scalar()).select(*keys)


def bucket_of(keys: Sequence[str], buckets: int = KEY_BUCKETS) -> Column:
    """A hash bucket of the keys; NULLs have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def find_hot(
    df: DataFrame, keys: Sequence[str], sizes: DataFrame, floor: int = HOT_FLOOR, share: float = HOT_SHARE
) -> tuple[int, DataFrame | None]:
    """(number of rows, the keys of :func:`hot_keys`, or None when there are none).

    ``sizes`` has the rows ``_n`` of ``df`` per bucket ``_h`` of the keys.  A hot
    key makes its bucket hot, so keys are counted in hot buckets only.
    """
    rows, most = sizes.groupBy("_h").agg(F.sum("_n").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    limit = max(float(floor), (rows or 0) * float(share))
    if not rows or most <= limit:
        return rows or 0, None
    big = sizes.groupBy("_h").agg(F.sum("_n").alias("_n")).where(F.col("_n") > limit).select("_h")
    counts = df.withColumn("_h", bucket_of(keys)).join(F.broadcast(big), "_h", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = stable(counts.where(F.col("_n") > limit).select(*keys))
    return rows, None if hot.isEmpty() else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys); together all rows of ``df``.

    Neither side shuffles ``df``: the hot keys are few by construction and are
    broadcast.  When there are none, adaptive execution drops the hot side.
    """
    few = F.broadcast(hot)
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    cold = df.alias("d").join(few.alias("k"), on, "left_anti")
    warm = df.alias("d").join(few.alias("k"), on, "left_semi")
    return cold, warm


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, descending: Sequence[bool] | None = None
) -> DataFrame:
    """``row_number`` per group where a group may be of any size.

    Range partitioning splits a group by its order columns; each piece is
    numbered on its own and shifted by the rows of the group in earlier
    pieces.  ``order`` must identify a row inside its group; ``descending``
    says per order column which way it runs.
    """
    by = list(by)
    names = [f"_o{i}" for i in range(len(order))]
    down = list(descending or [False] * len(order))
    sorting = [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(names, down)]
    keyed = df.select("*", *[o.alias(n) for o, n in zip(order, names)])
    pieces = stable(
        keyed.repartitionByRange(*[F.col(c) for c in by], *sorting).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    # at most (groups + pieces) rows, since a group is contiguous in range order
    sizes = pieces.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_piece").alias("_k_piece"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
    )
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_piece") == F.col("_k_piece")]
    local = Window.partitionBy(*by, "_piece").orderBy(*sorting)
    return (
        pieces.withColumn("_local", F.row_number().over(local))
        .join(offsets, on)
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, out)
    )
