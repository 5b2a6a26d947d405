"""Merkle manifest of a dataset with octopus multiproofs.

Rows of a source, ascending by doc_id, are the leaves of a tree with runs of
three; the roots of the sources, by name, are the leaves of a top tree.  A node
is named by (tree, level, position); ``tree`` is '0' for a null source, '1' and
the name for others and '' for the top tree, so names sort as sources do.

Trees grow in blocks: ``BLOCK`` = 3^7 neighbouring nodes of one level are one
group, which a task hashes up seven levels, so that a tree of any size takes
few shuffles and a hot source spreads over its blocks.

Proofs are made for whole leaf partitions (a block of leaves).  A partition
knows its leaves; walking up, it lists the siblings that it neither holds nor
can derive: the minimal union of missing coordinates of all its proofs.  These
few are joined with the stored nodes in one fetch, the partition derives the
shared interior nodes and expands every leaf's proof by itself.  A node near a
root is fetched by very many partitions, so nodes of high levels are laid out
once for every ``SHARED`` partitions that may ask for them, which multiplies a
level by less than it is smaller than the leaves.

Defined results: nulls in any column enter a leaf as ``-``; a null doc_id comes
first and is never tampered with; equal rows of a source have equal leaves and
adjacent positions; rows equal in source and doc_id are ordered by their leaf;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import stored, table
from eoframe.operators.ranks import number_rows

FAN = 3
HEIGHT = 7
BLOCK = FAN**HEIGHT
SHARED = FAN**5
TOP = ""
NODE = "tree string, level int, pos bigint, digest string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[sized(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], sized(text)).cast("binary"), 256)


def tampered_text() -> Column:
    """The text as an intruder leaves it: without line feeds where 2 divides the id's checksum."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))


def tree_of(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, pos, leaf, tampered): the place of every row in its source's tree; texts stay behind."""
    rows = docs.select(
        tree_of(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(F.col("text")).alias("leaf"),
        leaf(tampered_text()).alias("tampered"),
    )
    # equal (tree, doc_id, leaf) are equal rows, whose order cannot be seen; a number tells them apart
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    hashed, _ = stored(rows)  # range bounds are sampled, and texts should be hashed once
    return number_rows(hashed, ["tree"], [F.col(c) for c in ("doc_id", "leaf", "copy")], "no").select(
        "tree", "doc_id", (F.col("no") - 1).alias("pos"), "leaf", "tampered"
    )


def _grow(level: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The levels above one block of neighbouring nodes, as far as the tree goes."""
        pdf = pdf.sort_values("pos")
        tree, first, n = pdf.tree.iloc[0], int(pdf.pos.iloc[0]), int(pdf.n.iloc[0])
        nodes, out = pdf.digest.tolist(), []
        for up in range(1, HEIGHT + 1):
            if n <= 1:
                break
            nodes = [h(*nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
            first, n = first // FAN, -(-n // FAN)
            out += [(tree, level + up, first + i, d, n) for i, d in enumerate(nodes)]
        return pd.DataFrame(out, columns=["tree", "level", "pos", "digest", "n"])

    return grow


def interiors(leaves: DataFrame) -> tuple[DataFrame, list]:
    """(tree, level, pos, digest, n) of all nodes above ``leaves`` (tree, pos, digest, n); ``n`` nodes stand on that level.

    One shuffle every ``HEIGHT`` levels, each of 3^HEIGHT fewer rows, written as tables whose removers come second.
    """
    level, base, parts, removers = 0, leaves.where("n > 1"), [], []
    while True:
        grown, remove = stored(
            base.groupBy("tree", F.expr(f"pos div {BLOCK}")).applyInPandas(_grow(level), f"{NODE}, n bigint")
        )
        parts.append(grown)
        removers.append(remove)
        level += HEIGHT
        base = grown.where((F.col("level") == level) & (F.col("n") > 1)).drop("level")
        if base.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, removers


def missing(held: list[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, position) that prove the leaves ``held`` of a tree of ``n`` leaves.

    A sibling that is held, or derived from held ones, isn't asked for.
    """
    out, level, known = [], 0, sorted(set(held))
    while n > 1:
        have = set(known)
        parents = sorted({p // FAN for p in known})
        out += [(level, s) for p in parents for s in range(p * FAN, min(p * FAN + FAN, n)) if s not in have]
        known, n, level = parents, -(-n // FAN), level + 1
    return out


def expanded(held: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> tuple[dict[int, list], str]:
    """(proof per held leaf, root); a proof is for every level the digests left and right of the path in its run.

    The nodes above held leaves are derived once and shared by all proofs.
    """
    levels, now, size = [], dict(held), n
    while size > 1:
        level = len(levels)
        runs = {}
        for p in {x // FAN for x in now}:
            runs[p] = [now[s] if s in now else fetched[level, s] for s in range(p * FAN, min(p * FAN + FAN, size))]
        levels.append(runs)
        now, size = {p: h(*run) for p, run in runs.items()}, -(-size // FAN)
    out = {}
    for start in held:
        pos, proof = start, []
        for runs in levels:
            run, at = runs[pos // FAN], pos % FAN
            proof.append((run[:at], run[at + 1 :]))
            pos //= FAN
        out[start] = proof
    return out, now[0]


def folded(digest: str, proof: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in proof:
        digest = h(*left, digest, *right)
    return digest


def lists(proof: list[tuple[list[str], list[str]]]) -> tuple[list[str], list[int]]:
    """A proof as plain columns: siblings left to right, level by level, and per level 4 * siblings left + siblings right."""
    return [d for left, right in proof for d in left + right], [4 * len(left) + len(right) for left, right in proof]


def unlisted(siblings: list[str], shape: list[int]) -> list[tuple[list[str], list[str]]]:
    out, at = [], 0
    for s in shape:
        a, b = divmod(int(s), 4)
        out.append((list(siblings[at : at + a]), list(siblings[at + a : at + a + b])))
        at += a + b
    return out


def _fetched(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, block, level, pos, digest): what every leaf partition (block) of ``leaves`` lacks, from ``nodes``."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tree, no = int(pdf.n.iloc[0]), pdf.tree.iloc[0], int(pdf.block.iloc[0])
        return pd.DataFrame(
            [(tree, no, lv, p, no // SHARED if lv > HEIGHT else -1) for lv, p in missing(pdf.pos.tolist(), n)],
            columns=["tree", "block", "level", "pos", "copy"],
        )

    asked = leaves.select("tree", "block", "pos", "n").groupBy("tree", "block").applyInPandas(
        ask, "tree string, block bigint, level int, pos bigint, copy bigint"
    )
    # the blocks that may ask for a node stand below its parent
    width = F.pow(F.lit(float(FAN)), F.col("level") + 1 - HEIGHT)
    first = F.floor(F.col("pos") / FAN) * width
    copies = F.sequence(F.floor(first / SHARED).cast("bigint"), F.floor((first + width - 1) / SHARED).cast("bigint"))
    laid = nodes.withColumn("copy", F.explode(F.when(F.col("level") > HEIGHT, copies).otherwise(F.array(F.lit(-1).cast("bigint")))))
    key = ["tree", "level", "pos", "copy"]
    laid = laid.select(*[F.col(c).alias(f"n_{c}") for c in key], "digest")
    return asked.join(laid, [F.col(c) == F.col(f"n_{c}") for c in key]).select("tree", "block", "level", "pos", "digest")


def _blocks(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("block", F.expr(f"pos div {BLOCK}"))


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, pos, siblings, shape, root) of ``leaves`` (tree, pos, digest, n), any subset of the leaves below ``nodes``.

    ``nodes`` (tree, level, pos, digest) holds every node that may be missing, leaves as level 0.
    """

    def expand(held: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return pd.DataFrame({c: [] for c in ("tree", "pos", "siblings", "shape", "root")})
        fetch = {(lv, p): d for lv, p, d in zip(got.level.tolist(), got.pos.tolist(), got.digest)}
        proof, root = expanded(dict(zip(held.pos.tolist(), held.digest)), fetch, int(held.n.iloc[0]))
        rows = [(held.tree.iloc[0], p, *lists(x), root) for p, x in proof.items()]
        return pd.DataFrame(rows, columns=["tree", "pos", "siblings", "shape", "root"])

    asked = _blocks(leaves.select("tree", "pos", "digest", "n"))
    schema = "tree string, pos bigint, siblings array<string>, shape array<int>, root string"
    return asked.groupBy("tree", "block").cogroup(_fetched(asked, nodes).groupBy("tree", "block")).applyInPandas(expand, schema)


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(leaves with n, nodes of all source trees, top, removers) for ``leaves`` (tree, pos, leaf, ...).

    ``top`` (tree, subroot, siblings, shape, root) has a row per source: its root and the proof that leads on to the root.
    """
    # sizes reach the leaves by block, so that no task gets a whole source
    leaves = _blocks(leaves)
    blocks = leaves.groupBy("tree", "block").agg(F.count("*").alias("n"))
    trees = blocks.groupBy(F.col("tree").alias("t")).agg(F.sum("n").alias("n"))
    sizes = blocks.drop("n").join(trees, F.col("tree") == F.col("t")).select("t", F.col("block").alias("b"), "n")
    known = leaves.join(sizes, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b", "block")
    nodes, removers = interiors(known.select("tree", "pos", F.col("leaf").alias("digest"), "n"))
    alone = known.where("n = 1").select("tree", F.col("leaf").alias("digest"))
    subroots = nodes.where("n = 1").select("tree", "digest").unionByName(alone)  # level ends where one node is left
    subroots, remove = stored(
        number_rows(subroots, [], [F.col("tree")], "no").select(F.col("tree").alias("of"), "digest", (F.col("no") - 1).alias("pos"))
    )
    ordered = subroots.select("of", F.lit(TOP).alias("tree"), "pos", "digest", F.lit(subroots.count()).cast("bigint").alias("n"))
    above, more = interiors(ordered)
    every = above.select("tree", "level", "pos", "digest").unionByName(ordered.select("tree", F.lit(0).alias("level"), "pos", "digest"))
    top, last = stored(
        proofs(ordered, every).select(F.col("pos").alias("at"), "siblings", "shape", "root")
        .join(subroots, F.col("at") == F.col("pos")).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "siblings", "shape", "root")
    )
    return known, nodes, top, [*removers, remove, *more, last]


def verified(docs: DataFrame) -> DataFrame:
    """Per row its leaf, roots, proof digest and whether the tampered row still folds to the root."""
    rows, _ = stored(leaves_of(docs))  # the answer is read from the stored tables, which stay in the shared folder
    known, nodes, top, _ = manifest(rows)
    held = _blocks(known)
    # a whole block asks for nothing below its own height
    fetched = _fetched(held, nodes.where(F.col("level") >= HEIGHT).select("tree", "level", "pos", "digest"))
    on = top.select(
        F.col("tree").alias("t"), F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("pos"), F.to_json(F.struct("siblings", "shape", "root")).alias("digest")
    )
    tails = held.select("tree", "block").distinct().join(on, F.col("tree") == F.col("t")).select("tree", "block", "level", "pos", "digest")

    def expand(held: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        fetch = {(lv, p): d for lv, p, d in zip(got.level.tolist(), got.pos.tolist(), got.digest)}
        tail = json.loads(fetch.pop((-1, 0)))
        ahead, root = unlisted(tail["siblings"], tail["shape"]), tail["root"]
        proof, subroot = expanded(dict(zip(held.pos.tolist(), held.leaf)), fetch, int(held.n.iloc[0]))
        out = []
        for doc, pos, own, bad in zip(held.doc_id, held.pos.tolist(), held.leaf, held.tampered):
            whole = proof[pos] + ahead
            got_root = folded(bad, whole)
            out.append((doc, own, subroot, root, h(*lists(whole)[0]), got_root, got_root == root))
        columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return held.groupBy("tree", "block").cogroup(fetched.unionByName(tails).groupBy("tree", "block")).applyInPandas(
        expand, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM d),
nodes(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree AS of, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
above(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (
  SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
  UNION ALL
  SELECT '', level, pos // 3, list(digest ORDER BY pos) FROM above WHERE n > 1 GROUP BY level, pos // 3),
tops AS (SELECT tree, max(level) AS up FROM nodes GROUP BY tree),
path(doc_id, tree, leaf, low, here, level, digest, proof, subroot) AS (
  SELECT doc_id, tree, leaf, tree, pos, 0, tampered, '', NULL::VARCHAR FROM leaves
  UNION ALL
  SELECT p.doc_id, p.tree, p.leaf, CASE WHEN r.tree IS NULL THEN '' ELSE p.low END,
    CASE WHEN r.tree IS NULL THEN s.pos ELSE p.here // 3 END, CASE WHEN r.tree IS NULL THEN 0 ELSE p.level + 1 END,
    CASE WHEN r.tree IS NULL THEN p.digest
      ELSE sha256(array_to_string(r.ds[1:p.here % 3], '') || p.digest || array_to_string(r.ds[p.here % 3 + 2:], '')) END,
    CASE WHEN r.tree IS NULL THEN p.proof ELSE p.proof || array_to_string(r.ds[1:p.here % 3], '') || array_to_string(r.ds[p.here % 3 + 2:], '') END,
    CASE WHEN r.tree IS NULL THEN s.digest ELSE p.subroot END
  FROM path p LEFT JOIN runs r ON r.tree = p.low AND r.level = p.level AND r.run = p.here // 3 JOIN subroots s ON s.of = p.tree
  WHERE r.tree IS NOT NULL OR p.low <> ''),
root AS (SELECT digest FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, path.digest AS folded_root, path.digest = root.digest AS verified
FROM path, root WHERE low = '' AND level = (SELECT max(level) FROM above)
"""
