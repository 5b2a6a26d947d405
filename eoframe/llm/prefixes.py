"""Prefix trie of conversations from sorted neighbours.

A turn is a token of 16 bytes (a digest of role and text) and the code points
of its text; a conversation is its tokens in one byte string.  Equal
conversations become one item with a weight.  Items are sorted over all
partitions, and two neighbours share ``lcp`` turns.  In a partition the edges
between neighbours are taken by descending lcp and joined by union-find: every
merge of components is a branching node at that depth, so the branching nodes of
the trie come out bottom up, each a run of sorted items.  The sums a node needs
are sums over its items and edges:

* members: weights; smallest member: least id;
* children: 1 + edges with lcp equal to its depth - items that end there;
* childless nodes below: items that are no prefix of the next one;
* saved tokens: an edge counts the code points that its lcp turns hold (a
  further copy of an item, all of its own), less those above the node for each
  member but one.

A node whose depth is at most the lcp across a partition's border goes on in
the next partition.  Those open nodes lie on the two outer spines; the rest of
the forest is contracted, and for each depth of a spine one fragment with its
sums leaves the partition.  Fragments of one node meet by the digest of its
turns and are added up, the edge across a border counting for the partition
right of it; the answers go back to the partitions for the nodes below.

Defined results: rows with a null conv_id belong to no conversation; turns equal
in number are ordered by token; an empty table gives no rows; a null role or
text is empty; other columns are ignored.  A conversation's tokens are one row:
24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import stored, table
from eoframe.session import stable

TOKEN = 16
LENT = 5
FAMILY = 100
NONE_SHA = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def rebuilt(talks: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): every conversation after its family's first turns took the place of its own."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = talks.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), token(role, text).alias("token"), F.char_length(text).cast("bigint").alias("size")).alias("t"),
    )
    # nulls sort first
    own, _ = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")))
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, LENT).alias("lent"))
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LENT + 1)).cast("int")
    whole = own.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("lent", F.slice("own", 1, 0)), F.lit(1), lent),
            F.slice("own", lent + 1, F.greatest(F.size("own") - lent, F.lit(0))),
        ).alias("whole"),
    )
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.transform("whole", lambda t: F.hex(t["token"])), "")).alias("seq"), F.col("whole.size").alias("sizes")
    )


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n, least, ends_sha256) of rows sorted by (key, conv_id); a group streams through, none is held."""
    key, n, least, sha, out = None, 0, 0, None, []
    for pdf in batches:
        keys, ids = pdf.key.tolist(), pdf.conv_id.to_numpy()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if n:
                    out.append((key, n, least, sha.hexdigest()))
                key, n, least, sha = keys[at], 0, int(ids[at]), hashlib.sha256()
            sha.update(((b"," if n else b"") + ",".join(map(str, ids[at:end].tolist())).encode()))
            n += end - at
            at = end
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["key", "n", "least", "ends_sha256"])
            out = []
    if n:
        out.append((key, n, least, sha.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "n", "least", "ends_sha256"])


def items(talks: DataFrame) -> DataFrame:
    """(seq, sizes, n, least, ends_sha256): each different conversation once."""
    convs, _ = stored(rebuilt(talks).withColumn("key", F.unhex(F.md5("seq"))))
    # the digest of a group needs its ids in order; they are short and stream through one task
    ends = (
        convs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
        .mapInPandas(_ends, "key binary, n bigint, least bigint, ends_sha256 string")
    )
    # the least member stands for its copies, so no copy is shuffled with its turns
    return ends.join(convs.select("conv_id", "seq", "sizes"), F.col("least") == F.col("conv_id")).select("seq", "sizes", "n", "least", "ends_sha256")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns ``a`` and ``b`` have in common at the beginning."""
    n = min(len(a), len(b)) // TOKEN
    if a[: n * TOKEN] == b[: n * TOKEN]:
        return n
    if n <= 16:
        for i in range(n):
            if a[i * TOKEN : i * TOKEN + TOKEN] != b[i * TOKEN : i * TOKEN + TOKEN]:
                return i
    x = np.frombuffer(a, dtype=np.uint8, count=n * TOKEN) != np.frombuffer(b, dtype=np.uint8, count=n * TOKEN)
    return int(np.argmax(x)) // TOKEN


class Forest:
    """The branching nodes of sorted different items, by union-find over neighbour edges of descending lcp.

    ``lcp[i]`` joins items i - 1 and i.  A node has its depth, its run of items
    (low, high) and its parent node; node i < number of items is where item i ends.
    """

    def __init__(self, depths: list[int], lcp: list[int]):
        n = len(depths)
        self.depth, self.low, self.high = list(depths), list(range(n)), list(range(n))
        self.parent = [-1] * n
        self._into = list(range(n))
        self._up = list(range(n))
        top = list(range(n))  # node on top of a component
        for e in sorted(range(1, n), key=lambda i: -lcp[i]):
            a, b = self._find(e - 1), self._find(e)
            node = self._merged(top[a], top[b], lcp[e])
            self._up[b] = a
            top[a] = node

    def _find(self, i: int) -> int:
        while self._up[i] != i:
            self._up[i] = self._up[self._up[i]]
            i = self._up[i]
        return i

    def _merged(self, a: int, b: int, depth: int) -> int:
        """The node above neighbours ``a`` and ``b``; one that has this depth already takes the other in."""
        low, high = self.low[a], self.high[b]
        if self.depth[a] == depth:
            node = a
            if self.depth[b] == depth:
                self._into[b] = a
            else:
                self.parent[b] = a
        elif self.depth[b] == depth:
            node = b
            self.parent[a] = b
        else:
            node = len(self.depth)
            self.depth.append(depth)
            self.low.append(low)
            self.high.append(high)
            self.parent.append(-1)
            self._into.append(node)
            self.parent[a] = self.parent[b] = node
        self.low[node], self.high[node] = low, high
        return node

    def node(self, i: int) -> int:
        while self._into[i] != i:
            i = self._into[i]
        return i

    def alive(self) -> list[int]:
        return [i for i in range(len(self.depth)) if self._into[i] == i]


OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: rows of a piece: closed nodes (``open`` false; ``side`` and ``up`` name the open parent, side -1: none) and fragments of
#: open ones, whose ``saved_tokens`` are code points on edges and whose ``n_children`` are splits less ends
PART = f"open boolean, piece int, side int, up bigint, name binary, up_name binary, above bigint, {OUT}"
TURNS_A_PIECE = 500_000


class Piece:
    """The sorted items of one partition, with the last item before and the first one after it (None: there is none)."""

    def __init__(self, no: int, rows: pd.DataFrame, before: bytes | None, after: bytes | None):
        self.no, self.m = no, len(rows)
        self.seqs = [bytes(s) for s in rows.seq]
        self.least, self.ends = rows.least.tolist(), rows.ends_sha256.tolist()
        self.sums = [np.concatenate(([0], np.cumsum(np.asarray(s, dtype=np.int64)))).astype(np.int64) for s in rows.sizes]
        self.depths = [len(s) // TOKEN for s in self.seqs]
        self.left = -1 if before is None else shared_turns(before, self.seqs[0])
        self.right = -1 if after is None else shared_turns(self.seqs[-1], after)
        self.lcp = [self.left] + [shared_turns(self.seqs[i - 1], self.seqs[i]) for i in range(1, self.m)]
        childless = [after < d for after, d in zip(self.lcp[1:] + [self.right], self.depths)]
        copies = [(w - 1) * int(s[-1]) for w, s in zip(rows.n.tolist(), self.sums)]
        edges = [int(s[max(c, 0)]) for s, c in zip(self.sums, self.lcp)]
        # running sums, so that any run of items is a difference
        self.members, self.childless, self.copied, self.edges = (
            np.concatenate(([0], np.cumsum(np.asarray(x, dtype=np.int64)))) for x in (rows.n, childless, copies, edges)
        )

    def totals(self, low: int, high: int, joined: bool = False) -> tuple[int, int, int]:
        """(members, childless nodes, code points on edges) of a run of items; ``joined``: with the edge before it."""
        on_edges = self.edges[high + 1] - self.edges[low if joined else low + 1]
        return (
            int(self.members[high + 1] - self.members[low]),
            int(self.childless[high + 1] - self.childless[low]),
            int(self.copied[high + 1] - self.copied[low] + on_edges),
        )

    def open_to(self, low: int, high: int) -> int:
        """The greatest depth at which the node over a run of items goes on beyond the piece."""
        return max(self.left if low == 0 else -1, self.right if high == self.m - 1 else -1)

    def closed(self) -> Iterator[tuple]:
        """Nodes that lie in this piece alone, one row for each depth of a branch."""
        forest = Forest(self.depths, self.lcp)
        nodes = forest.alive()
        least = dict(enumerate(self.least))
        children: dict[int, int] = {}
        over: dict[int, int] = {}
        for i in sorted(nodes, key=lambda i: -forest.depth[i]):
            p = forest.parent[i]
            over[i] = p = forest.node(p) if p >= 0 else -1
            if p >= 0:
                children[p] = children.get(p, 0) + 1
                least[p] = min(least.get(p, least[i]), least[i])
        for i in nodes:
            d, low, high, p = forest.depth[i], forest.low[i], forest.high[i], over[i]
            start = forest.depth[p] + 1 if p >= 0 else 0
            n, leaves, copied = self.totals(low, high)
            for depth in range(max(start, self.open_to(low, high) + 1), d + 1):
                above = i if depth > start else p
                side, parent = -1, None
                if depth > 0:
                    if depth - 1 > self.open_to(forest.low[above], forest.high[above]):
                        parent = least[above]
                    else:
                        side = 0 if forest.low[above] == 0 and depth - 1 <= self.left else 1
                yield (
                    False, self.no, side, depth - 1, None, None, None, least[i], depth, parent, n,
                    children.get(i, 0) if depth == d else 1, leaves, copied - (n - 1) * int(self.sums[low][depth - 1] if depth else 0),
                    self.ends[low] if depth == d == self.depths[low] else NONE_SHA,
                )

    def fragments(self) -> Iterator[tuple]:
        """What this piece adds to each open node: per depth the run of items at the left and at the right border."""
        m = self.m
        with_first = -np.minimum.accumulate(np.array([self.depths[0], *self.lcp[1:]]))
        with_last = -np.minimum.accumulate(np.array([self.depths[-1], *self.lcp[:0:-1]]))
        least_left = np.minimum.accumulate(np.array(self.least))
        least_right = np.minimum.accumulate(np.array(self.least[::-1]))
        split: dict[int, list[int]] = {}
        for i in range(1, m):
            split.setdefault(self.lcp[i], []).append(i)
        name = [hashlib.md5(), hashlib.md5()]
        up_name: list[bytes | None] = [None, None]
        for depth in range(max(self.left, self.right) + 1):
            end = int(np.searchsorted(with_first, -depth, side="right")) - 1
            start = m - int(np.searchsorted(with_last, -depth, side="right"))
            runs = []
            if depth <= self.left:
                runs.append((0, 0, end, int(least_left[end])))
            if depth <= self.right and not (depth <= self.left and end == m - 1):
                runs.append((1, start, m - 1, int(least_right[m - 1 - start])))
            own = [x.digest() for x in name]
            for side, low, high, least in runs:
                n, leaves, copied = self.totals(low, high, joined=side == 0)
                edges = split.get(depth, [])
                splits = int(np.searchsorted(edges, high, side="right") - np.searchsorted(edges, low + 1)) + (side == 0 and self.left == depth)
                ended = self.depths[low] == depth  # only the first of a run can end here
                yield (
                    True, self.no, side, depth, own[side], up_name[side], int(self.sums[low][depth - 1]) if depth else 0, least, depth,
                    None, n, splits - ended, leaves, copied, self.ends[low] if ended else None,
                )
            for side, seq in enumerate((self.seqs[0], self.seqs[-1])):
                up_name[side] = own[side]
                name[side].update(seq[depth * TOKEN : (depth + 1) * TOKEN])


def _piece(rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq", key=lambda c: c.map(bytes))
    before, after = (None if v is None else bytes(v) for v in (beside.before.iloc[0], beside.after.iloc[0]))
    piece = Piece(int(rows.piece.iloc[0]), rows, before, after)
    columns = [c.split()[0] for c in PART.split(", ")]
    out = pd.DataFrame([*piece.closed(), *piece.fragments()], columns=columns)
    return out.astype({"parent_conv_id": "Int64", "above": "Int64"})


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of ``rows`` (seq, sizes, n, least, ends_sha256), different ``seq`` each."""
    kept, remove = stored(rows)
    turns = kept.agg(F.sum(F.octet_length("seq") / TOKEN)).first()[0] or 0
    pieces = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(turns // TURNS_A_PIECE))
    placed = stable(kept.repartitionByRange(pieces, "seq").withColumn("piece", F.spark_partition_id()))
    remove()
    # one row per partition
    order = Window.orderBy("piece")
    ends = placed.groupBy("piece").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    beside = ends.select("piece", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    parts, _ = stored(placed.groupBy("piece").cogroup(beside.groupBy("piece")).applyInPandas(_piece, PART))
    closed, fragments = parts.where("NOT open"), parts.where("open")
    whole = stable(
        fragments.groupBy("depth", "name").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("splits"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("edges"), F.max("above").alias("above"), F.max("ends_sha256").alias("ends"), F.max("up_name").alias("up_name"),
        )
    )
    ids = whole.select(F.col("depth").alias("d"), F.col("name").alias("k"), F.col("conv_id").alias("id"))
    opened = whole.join(ids, (F.col("depth") - 1 == F.col("d")) & (F.col("up_name") == F.col("k")), "left").select(
        "conv_id", "depth", F.col("id").alias("parent_conv_id"), "n_convs", (1 + F.col("splits")).alias("n_children"), "n_leaves",
        (F.col("edges") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"),
    )
    spine = fragments.select(F.col("piece").alias("p"), F.col("side").alias("s"), "depth", "name").join(ids, (F.col("depth") == F.col("d")) & (F.col("name") == F.col("k")))
    below = closed.where("side >= 0").drop("parent_conv_id").join(
        spine.select("p", "s", "d", F.col("id").alias("parent_conv_id")), (F.col("piece") == F.col("p")) & (F.col("side") == F.col("s")) & (F.col("up") == F.col("d"))
    )
    return closed.where("side < 0").select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(opened.select(*COLUMNS))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(items(table(spark, sf_dir, "conversations")))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM own),
whole AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
members AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ended FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(prefix[d].text), 0) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY prefix, d),
kids AS (SELECT p.prefix, count(c.depth) AS n_children FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.prefix[1:p.depth] = p.prefix GROUP BY p.prefix),
below AS (
  SELECT a.prefix, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes n ON n.depth >= a.depth AND n.prefix[1:a.depth] = a.prefix JOIN kids k ON k.prefix = n.prefix GROUP BY a.prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON k.prefix = n.prefix JOIN below b ON b.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
