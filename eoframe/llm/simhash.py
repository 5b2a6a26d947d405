"""Near-duplicates by SimHash, linked through Gray-order hierarchical indexes.

Two fingerprints that differ in at most ``distance`` bits agree wholly in some
choice of bit blocks, so each fingerprint goes to one bucket per choice; the
number of blocks follows the number of fingerprints.  A bucket above ``ROWS``
is split again by the bits it has not used, until it is small or its free bits
bound it.  In a bucket fingerprints are sorted by Gray rank; runs of neighbours
share a masked bit pattern in an upper node, and the differences between a query
and a node's own bits add up on the way down, so whole runs are pruned at once.
A bucket gives a forest of its links, never all pairs.

With a least similarity near copies are defined by exact shares instead: a link
is a Jaccard share of shingles of at least that, or fingerprints linked as above
whose counted shingles have that cosine.  Fingerprints alone miss most pairs at
0.8, so rows also meet in ``BANDS`` buckets of pairs of least shingle hashes.  A
bucket is put in order of length and a row is compared with its ``REACH``
neighbours; what is connected then meets ``WIDER`` neighbours as one row, in up
to ``ROUNDS`` more rounds.  Buckets of more rows that are not connected by then
are solved exactly: all their rows are joined by prefixes.  With shingles in
order of how many of these rows have them, two texts alike by the least share
one of the first few, which are the rare ones, so a common passage makes no
pairs.  Rows of one prefix shingle are dealt into squares of ``SIDE`` by
``SIDE`` rows, rows already connected are not compared, and a pair whose
lengths and places forbid the share is left out.  In the same way all
fingerprints of a cluster are compared if it is not connected.

Defined results: empty or null texts have fingerprint zero and link like any
other; equal fingerprints are one node; null doc_ids count as the smallest only
where a component has no other; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import LOWER, NO_ID, UPPER, components, few, kept_rows, packed, real_id, stored, table, with_key
from eoframe.session import stable

WORDS = 4
DISTANCE = 4
ROWS = 4096  # fingerprints of a bucket that one task takes without splitting
LEVELS = 4
FAN = 8
BANDS = 12  # two rows alike by 0.8 share a band's key with 0.64, so they share none of these with 0.36^12, 5 in a million
REACH = 2  # neighbours of a bucket that are compared at first
WIDER = 12  # and later, when what is connected counts as one row
ROUNDS = 1
SIDE = 1000  # rows of a key that meet as many others in one join key
BITMAP = 16  # longs of a text's bitmap; it tells texts of up to some 1 500 shingles apart
_ORDERS = np.random.default_rng(11).integers(1, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words; fewer words: of all of them; none: nothing."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(words) > width else np.zeros(1, dtype=np.int64)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as an unsigned 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, tk, fp): one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(shingle_hashes(x, width)) for x in pdf.text], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "tk": pdf.tk, "fp": fp.view(np.int64)})

    return with_key(docs).mapInPandas(run, "doc_id bigint, tk bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in Gray order, as an unsigned number in a long."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def cut(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(bits, parts)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(rows: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which any two fingerprints within ``distance`` agree on at least one."""
    for extra in range(1, 5):
        blocks = cut(list(range(64)), distance + extra)
        if rows >> (extra * len(blocks[-1])) <= 64:
            break
    return [sum(1 << b for block in chosen for b in block) for chosen in combinations(blocks, extra)]


def finer(mask: int, distance: int = DISTANCE) -> list[int]:
    """The same promise for fingerprints that agree on ``mask``: its free bits in ``distance + 1`` parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part) for part in cut(free, distance + 1)]


def _nodes(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from leaves up: (pattern, mask) of the bits all points below share; points are in Gray order."""
    levels = [(points, np.full(len(points), ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        some = np.bitwise_and.reduceat(mask, at)
        differs = np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern | ~mask, at)
        shared = some & ~differs
        levels.append((np.bitwise_and.reduceat(pattern | ~mask, at) & shared, shared))
    return levels


def near(points: np.ndarray, distance: int = DISTANCE, pairs: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, point) within ``distance``, in pieces; points are sorted by Gray rank."""
    levels = _nodes(points)
    top = len(levels) - 1
    chunk = max(8, min(512, pairs // max(1, len(points))))
    for start in range(0, len(points), chunk):
        q = np.repeat(np.arange(start, min(start + chunk, len(points))), len(levels[top][0]))
        node = np.tile(np.arange(len(levels[top][0])), min(start + chunk, len(points)) - start)
        had = np.zeros(len(q), dtype=np.uint8)
        upper = np.zeros(len(q), dtype=np.uint64)
        for level in range(top, -1, -1):
            pattern, mask = levels[level]
            own = mask[node] & ~upper  # bits the node adds to those of its parent
            had = had + np.bitwise_count((points[q] ^ pattern[node]) & own)
            ok = had <= distance
            q, node, had, upper = q[ok], node[ok], had[ok], mask[node[ok]]
            if level:
                below = len(levels[level - 1][0])
                kids = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, had, upper = (np.repeat(x, FAN) for x in (q, had, upper))
                real = kids < below
                q, node, had, upper = q[real], kids[real], had[real], upper[real]
        yield q, node


def forest(points: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Per point the index of the first point it is linked to through the bucket."""
    root = np.arange(len(points))
    for a, b in near(points, distance):
        a, b = root[a], root[b]
        while len(a := a[k := a != b]):
            b = b[k]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
            a, b = root[a], root[b]
    return root


def _whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, sorted by ``keys``, in pieces that never cut a key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        last = np.logical_and.reduce([pdf[k].to_numpy() == pdf[k].iloc[-1] for k in keys]) if len(pdf) else np.empty(0, dtype=bool)
        if not len(pdf) or last.all() and (not held or all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)):
            held += [pdf] if len(pdf) else []
            continue
        yield pd.concat([*held, pdf[~last]])
        held = [pdf[last]]
    if held:
        yield pd.concat(held)


def _bounds(*columns: np.ndarray) -> list[int]:
    edge = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [0, *(np.flatnonzero(edge) + 1).tolist(), len(columns[0])]


def _solve(pdf: pd.DataFrame, distance: int) -> Iterator[pd.DataFrame]:
    mask, value, fp = (pdf[c].to_numpy() for c in ("mask", "value", "fp"))
    bounds = _bounds(mask, value)
    a, b = [], []
    for s, e in zip(bounds, bounds[1:]):
        if e - s > 1:
            points = fp[s:e].view(np.uint64)
            root = forest(points, distance)
            own = root != np.arange(e - s)
            if own.any():
                a.append(fp[s:e][own])
                b.append(fp[s:e][root[own]])
    if a:
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that keep every connection within the distance."""
    # few distinct masks: they depend on the distance and the number of fingerprints only
    buckets = fps.select(F.explode(F.array(*[F.lit(signed(m)) for m in block_masks(fps.count(), distance)])).alias("mask"), "fp")
    small = None
    for level in range(LEVELS):
        keyed = buckets.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if level == LEVELS - 1:
            ready = keyed
        else:
            big = stable(keyed.groupBy(F.col("mask").alias("bm"), F.col("value").alias("bv")).count().where(F.col("count") > ROWS))
            masks = [r.bm for r in big.select("bm").distinct().collect()]  # at most as many as there are masks
            on = (F.col("mask") == F.col("bm")) & (F.col("value") == F.col("bv"))
            ready = keyed.join(big, on, "left_anti") if masks else keyed
        small = ready if small is None else small.unionByName(ready)
        if level == LEVELS - 1 or not masks:
            break
        which = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(signed(f)) for f in finer(m % (1 << 64), distance)]))])
        buckets = stable(keyed.join(big, on, "left_semi").select(F.explode(which[F.col("mask")]).alias("mask"), "fp"))
    sorted_ = (
        small.withColumn("gray", gray_rank(F.col("fp"))).repartition("mask", "value")
        .sortWithinPartitions("mask", "value", F.col("gray") < 0, "gray")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, ["mask", "value"]):
            yield from _solve(pdf, distance)

    return sorted_.select("mask", "value", "fp").mapInPandas(run, "a bigint, b bigint")


def minima(hashes: np.ndarray) -> np.ndarray:
    """A key per band: the least of the shingle hashes under each of the band's two orders, put together."""
    least = np.full(2 * BANDS, ~np.uint64(0))
    for i in range(0, len(hashes), 1 << 14):
        mixed = hashes[i : i + (1 << 14), None] * _ORDERS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    least = least.reshape(BANDS, 2)
    keys = (least[:, 0] ^ (least[:, 1] * _ORDERS[0])) * _ORDERS[1]
    return (keys ^ (keys >> np.uint64(29)) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tk, fp, n, keys): fingerprint, number of different shingles and band keys per document, in one reading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, tk, text in zip(pdf.doc_id.tolist(), pdf.tk.tolist(), pdf.text):
                h = shingle_hashes(text, width)
                own = np.unique(h)
                out.append((doc, tk, int(np.uint64(fingerprint(h)).view(np.int64)), len(own), minima(own) if len(own) else []))
            yield pd.DataFrame(out, columns=["doc_id", "tk", "fp", "n", "keys"])

    return with_key(docs).mapInPandas(run, "doc_id bigint, tk bigint, fp bigint, n bigint, keys array<bigint>")


def neighbours(rows: DataFrame, reach: int = REACH, least: float = 0.0) -> DataFrame:
    """(a, b): different groups of rows (key, n, node, root) that stand at most ``reach`` places apart in their bucket.

    Buckets are in order of ``n`` and range partitions cut large ones, so no
    task holds a bucket; rows at a cut are joined by their places.  Pairs whose
    lengths alone forbid the share ``least`` are left out.
    """
    placed = stable(rows.repartitionByRange(F.col("key"), F.col("n"), F.col("node")).sortWithinPartitions("key", "n", "node").withColumn("piece", F.spark_partition_id()))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs within a piece, and its first and last ``reach`` rows for the cuts (``cut``: -1 first, 1 last)."""
        tail = None
        first = None
        for pdf in batches:
            if not len(pdf):
                continue
            piece = int(pdf.piece.iloc[0])
            whole = pdf if tail is None else pd.concat([tail, pdf])
            yield _pairs(whole, 0 if tail is None else len(tail), reach, least)
            if first is None or len(first) < reach:
                first = (pdf if first is None else pd.concat([first, pdf])).head(reach)
            tail = whole.tail(reach)
        if tail is not None:
            yield pd.concat([_edge(first, piece, -1), _edge(tail, piece, 1)])

    schema = "a bigint, b bigint, cut int, piece int, place int, key bigint, n bigint, node bigint, root bigint"
    found = stable(placed.mapInPandas(pairs, schema))
    ends = found.where("cut <> 0")  # at most 2 * reach rows a partition
    order = Window.orderBy("piece")
    after = ends.select("piece").distinct().select("piece", F.lead("piece").over(order).alias("next"))
    last = ends.where("cut = 1").join(after, "piece").select("next", F.col("place").alias("back"), *[F.col(c).alias(f"l{c}") for c in ("key", "n", "node", "root")])
    first = ends.where("cut = -1")
    near_ = (
        (F.col("next") == F.col("piece")) & (F.col("lkey") == F.col("key")) & (F.col("back") + F.col("place") < reach)
        & (F.col("lroot") != F.col("root")) & (F.col("ln") >= least * F.col("n") - 1e-9)
    )
    over = last.join(first, near_).select(F.col("lnode").alias("a"), F.col("node").alias("b"))
    return found.where("cut = 0").select("a", "b").unionByName(over).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _edge(pdf: pd.DataFrame, piece: int, which: int) -> pd.DataFrame:
    place = np.arange(len(pdf)) if which < 0 else np.arange(len(pdf))[::-1]
    return pd.DataFrame({
        "a": 0, "b": 0, "cut": which, "piece": piece, "place": place, **{c: pdf[c].to_numpy() for c in ("key", "n", "node", "root")}
    })


def _pairs(pdf: pd.DataFrame, old: int, reach: int, least: float) -> pd.DataFrame:
    """Pairs of rows up to ``reach`` places apart of which the later one is none of the first ``old`` rows."""
    key, n, node, root = (pdf[c].to_numpy() for c in ("key", "n", "node", "root"))
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for d in range(1, reach + 1):
        at = np.arange(max(d, old), len(pdf))
        at = at[(key[at] == key[at - d]) & (root[at] != root[at - d]) & (n[at - d] >= least * n[at] - 1e-9)]
        a.append(node[at - d])
        b.append(node[at])
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": a, "b": b, "cut": 0, "piece": 0, "place": 0, "key": 0, "n": 0, "node": 0, "root": 0})


def alike(a: np.ndarray, b: np.ndarray, least: float, counted: bool) -> bool:
    """Jaccard share of two lists of shingle hashes, or if ``counted`` the cosine of their counts, is ``least`` or more."""
    (x, p), (y, q) = (np.unique(h, return_counts=True) for h in (a, b))
    if not len(x) or not len(y):
        return len(x) == len(y)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) >= least * (len(x) + len(y) - len(i)) - 1e-9:
        return True
    p, q = p.astype(float), q.astype(float)
    return counted and p[i] @ q[j] >= least * np.sqrt((p @ p) * (q @ q))


def bitmap(own: np.ndarray) -> np.ndarray:
    """Per place whether an odd number of the different hashes ``own`` falls there, as ``BITMAP`` longs."""
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def checked(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Of ``pairs`` (a, b, counted) of texts of ``docs`` (one row per text) those that are alike by ``least``."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"v": pdf.tk, "hs": [np.sort(shingle_hashes(x, width)).tobytes() for x in pdf.text]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [alike(*(np.frombuffer(x, dtype=np.uint64) for x in two), least, c) for *two, c in zip(pdf.ha, pdf.hb, pdf.counted)]
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    wanted = stable(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct())
    lists, remove = stored(with_key(docs).join(few(wanted), F.col("tk") == F.col("v"), "left_semi").mapInPandas(hashes, "v bigint, hs binary").dropDuplicates(["v"]))
    both = pairs.join(lists.select(F.col("v").alias("va"), F.col("hs").alias("ha")), F.col("a") == F.col("va"))
    both = both.join(lists.select(F.col("v").alias("vb"), F.col("hs").alias("hb")), F.col("b") == F.col("vb"))
    out = stable(both.select("a", "b", "ha", "hb", "counted").mapInPandas(run, "a bigint, b bigint"))
    remove()
    return out


def across(rows: DataFrame, fits: Callable[[str, str], Column]) -> DataFrame:
    """(a, b): every two nodes of ``rows`` (key, node, root, ...) that share a key, differ in root and meet ``fits``.

    Rows of a key's largest root meet the others only, and no join key holds
    more than about ``SIDE`` rows of either side.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("k"))
    sizes = sizes.agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all")).where("all > top.c")
    sizes = stable(sizes)  # with ``rows`` a checkpoint, so that the plans below stay short
    dealt = rows.join(sizes, F.col("key") == F.col("k")).withColumns({
        "heavy": F.col("root") == F.col("top.root"),
        "nh": F.ceil(F.col("top.c") / SIDE), "nl": F.ceil((F.col("all") - F.col("top.c")) / SIDE),
    }).withColumn("slot", F.pmod(F.xxhash64("node"), F.when(F.col("heavy"), F.col("nh")).otherwise(F.col("nl"))))
    # squares (i, j): i is a part of the others, j one of them too, or below zero a part of the largest root
    light = "concat(transform(sequence(slot, nl - 1), c -> struct(slot AS i, c AS j)), transform(sequence(0L, nh - 1), c -> struct(slot AS i, -1 - c AS j)))"
    right = "CASE WHEN heavy THEN transform(sequence(0L, nl - 1), c -> struct(c AS i, -1 - slot AS j)) ELSE transform(sequence(0L, slot), c -> struct(c AS i, slot AS j)) END"
    plain = rows.columns
    x = dealt.where("NOT heavy").select(*plain, F.explode(F.expr(light)).alias("at")).select("*", "at.i", "at.j").alias("x")
    y = dealt.select(*plain, F.explode(F.expr(right)).alias("at")).select("*", "at.i", "at.j").alias("y")
    once = F.expr("x.key = y.key AND x.i = y.i AND x.j = y.j AND x.root <> y.root AND (x.i <> x.j OR x.node < y.node)")
    met = x.join(y, once & fits("x", "y"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def prefix_pairs(docs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): pairs of texts ``rows`` (node, root) of different roots, among them all that share ``least`` of their shingles."""

    longs = [f"b{k}" for k in range(BITMAP)]

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.unique(shingle_hashes(x, width)) for x in pdf.text]
            bits = np.array([bitmap(h) for h in own], dtype=np.int64).reshape(len(own), BITMAP)
            yield pd.DataFrame({"v": pdf.tk.to_numpy(), "hs": [h.view(np.int64) for h in own], **dict(zip(longs, bits.T))})

    schema = "v bigint, hs array<bigint>, " + ", ".join(f"{b} bigint" for b in longs)
    some = with_key(docs).join(few(rows), F.col("tk") == F.col("node"), "left_semi").mapInPandas(shingles, schema)
    lists, remove = stored(some.dropDuplicates(["v"]))
    tokens = lists.select("v", F.size("hs").cast("bigint").alias("n"), F.explode("hs").alias("token"))
    shared = tokens.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("v")  # the shingles of one text
    # those that no other row has come first
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "token")) - 1
    first = tokens.join(shared, F.col("token") == F.col("t")).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9))
    mapped = rows.join(lists.select(F.col("v").alias("bv"), *longs), F.col("node") == F.col("bv"))
    first = stable(first.join(mapped, F.col("v") == F.col("node")).select(F.col("token").alias("key"), "node", "root", "n", "place", *longs))
    remove()

    def fits(x: str, y: str) -> Column:
        n, m, i, j = (F.col(f"{t}.{c}") for c in ("n", "place") for t in (x, y))
        # at the first shingle two texts share, no more than what follows can be shared
        follows = F.least(n - i, m - j) * (1 + least) >= least * (n + m) - 1e-6
        # texts differ in as many shingles as their bitmaps do in bits, or in more
        bits = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in longs), F.lit(0))
        return follows & (bits * (1 + least) <= (1 - least) * (n + m) + 1e-6)

    return across(first, fits)


def similar_roots(docs: DataFrame, nodes: DataFrame, width: int, distance: int, least: float) -> DataFrame:
    """(node, root) of the texts of ``nodes`` (tk, fp, n, keys) that are linked to any other by ``least``."""
    heads = nodes.groupBy("fp").agg(F.min("tk").alias("head"))
    by = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"n{c}"))
    near_ = links(heads.select("fp"), distance).distinct().join(by("a"), "a").join(by("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = nodes.join(by("f"), F.col("fp") == F.col("f")).where("tk <> nf").select(F.col("tk").alias("a"), F.col("nf").alias("b"))
    close = stable(near_.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("counted")))
    rows = nodes.select(F.explode("keys").alias("key"), "n", F.col("tk").alias("node"))
    first = neighbours(rows.withColumn("root", F.col("node")), least=least).withColumn("counted", F.lit(False))
    pairs = stable(close.unionByName(first).groupBy("a", "b").agg(F.max("counted").alias("counted")))
    roots = stable(components(checked(pairs, docs, width, least)))
    # in buckets of two rows all is compared by now
    full = rows.groupBy(F.col("key").alias("k")).count().where(F.col("count") > min(REACH, 2))
    rows = stable(rows.join(full, F.col("key") == F.col("k"), "left_semi"))

    def rooted(some: DataFrame) -> DataFrame:
        r = some.join(roots.select(F.col("node").alias("rn"), "root"), F.col("node") == F.col("rn"), "left")
        return r.withColumn("root", F.coalesce("root", "node")).drop("rn")

    def stars(some: DataFrame) -> DataFrame:
        """What is known to be connected as links, which new links are added to."""
        return some.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    for _ in range(ROUNDS):
        # what is connected meets others as one row of its shortest text
        one = rooted(rows).groupBy("key", "root").agg(F.min(F.struct("n", "node")).alias("m"))
        met = neighbours(one.select("key", "m.n", "m.node", "root"), WIDER, least)
        more = stable(met.join(pairs.select("a", "b"), ["a", "b"], "left_anti").withColumn("counted", F.lit(False)))
        if more.isEmpty():
            break
        pairs = pairs.unionByName(more)
        new = checked(more, docs, width, least)
        if new.isEmpty():
            break
        roots = stable(components(stars(roots).unionByName(new)))
    # the rest exactly: texts of buckets, and of clusters of fingerprints, that are not connected
    r = stable(rooted(rows))
    apart = r.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    texts_ = stable(r.join(apart, F.col("key") == F.col("k"), "left_semi").select("node", "root").distinct())
    linked = stars(roots)
    rest = []
    if not texts_.isEmpty():
        rest.append(prefix_pairs(docs, texts_, width, least).withColumn("counted", F.lit(False)))
    ends = rooted(rooted(close.withColumnRenamed("a", "node")).withColumnsRenamed({"node": "a", "root": "ra", "b": "node"}))
    if not ends.where("ra <> root").isEmpty():
        cluster = components(close).select(F.col("node").alias("cn"), F.col("root").alias("key"))
        members = stable(rooted(nodes.select(F.col("tk").alias("node"), "fp").join(cluster, F.col("node") == F.col("cn")).drop("cn")))
        rest.append(across(members, lambda x, y: F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= distance).withColumn("counted", F.lit(True)))
    for some in rest:
        more = stable(some.join(pairs, ["a", "b", "counted"], "left_anti"))
        if not more.isEmpty():
            linked = linked.unionByName(checked(more, docs, width, least))
            roots = None
    return roots if roots is not None else components(linked)


def near_groups(docs: DataFrame, width: int = WORDS, distance: int = DISTANCE, least: float | None = None) -> DataFrame:
    """(doc_id, tk, fp, component_id, kept_tk) per document; doc_ids with NO_ID for null.

    Linked by fingerprints of ``width`` words within ``distance``, or if ``least``
    is given by that similarity.
    """
    first = F.struct(F.col("doc_id") == NO_ID, "doc_id", "tk")
    if least is not None:
        d, _ = stored(sketches(docs, width))
        nodes, _ = stored(d.groupBy("tk").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(first).alias("first")))
        roots = similar_roots(docs, nodes.select("tk", "fp", "n", "keys"), width, distance, least)
        named = stable(nodes.join(roots, F.col("tk") == F.col("node"), "left").select(F.col("tk").alias("k"), "first", F.coalesce("root", "tk").alias("root")))
        least_ = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("f"))
        ids = named.join(least_, F.col("root") == F.col("r")).select("k", F.col("f.doc_id").alias("component_id"), F.col("f.tk").alias("kept_tk"))
        return d.join(ids, F.col("tk") == F.col("k")).select("doc_id", "tk", "fp", "component_id", "kept_tk")
    d = stable(fingerprints(docs, width))
    fps = stable(d.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(links(fps.select("fp"), distance))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    ids = stable(
        named.join(least, F.col("root") == F.col("r"))
        .select(F.col("fp").alias("f"), F.col("least.doc_id").alias("component_id"), F.col("least.tk").alias("kept_tk"))
    )
    return d.join(ids, F.col("fp") == F.col("f")).select("doc_id", "tk", "fp", "component_id", "kept_tk")


def drop_near(docs: DataFrame, width: int = WORDS, distance: int = DISTANCE, least: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (a null only if there is no other)."""
    counted = near_groups(docs, width, distance, least).groupBy("doc_id", "tk", "component_id", "kept_tk").agg(F.count("*").alias("rows"))
    counted = stable(counted.withColumn("kept", (F.col("doc_id") == F.col("component_id")) & (F.col("tk") == F.col("kept_tk"))))
    d = packed(docs).withColumn("tk", F.xxhash64("_text")).drop("_text")
    return kept_rows(d, counted.where("NOT kept").select("doc_id", "tk"), counted.where("kept AND rows > 1").select("doc_id", "tk"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select(
        real_id("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real_id("component_id").alias("component_id"),
    )
