import hashlib
import random
import zlib
from collections import defaultdict

import fixtures
from eoframe.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc, _, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def tree(digests):
    """All levels of a plain tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 3]) for i in range(0, len(low), 3)])
    return levels


def path(levels, pos):
    out = []
    for low in levels[:-1]:
        first = pos // 3 * 3
        out.append((low[first:pos], low[pos + 1 : first + 3]))
        pos //= 3
    return out


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r[1]
        bad = text.replace("\n", "") if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else text
        groups["0" if r[3] is None else "1" + r[3]].append((r[0] is not None, r[0] or 0, leaf(r, text), leaf(r, bad), r[0]))
    trees = {t: tree([x[2] for x in sorted(g, key=lambda x: x[:3])]) for t, g in groups.items()}
    names = sorted(trees, key=str.encode)
    top = tree([trees[t][-1][0] for t in names])
    out = []
    for t, g in groups.items():
        for pos, (_, _, own, bad, doc) in enumerate(sorted(g, key=lambda x: x[:3])):
            proof = path(trees[t], pos) + path(top, names.index(t))
            digest = bad
            for left, right in proof:
                digest = h(*left, digest, *right)
            root = top[-1][0]
            out.append((doc, own, trees[t][-1][0], root, h(*[d for a, b in proof for d in a + b]), digest, digest == root))
    return fixtures.table(out)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(spark, rows):
    got = merkle.verified(fixtures.docs(spark, rows, extra=True)).select(*COLUMNS).collect()
    assert fixtures.table(got) == plain(rows)


def low(monkeypatch):
    """Blocks of three, so that small tables have many blocks, levels and shared nodes."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    monkeypatch.setattr(merkle, "SHARED", 3)


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS)


def test_many_blocks_and_a_hot_source(spark, monkeypatch):
    low(monkeypatch)
    sources = ["hot"] * 8 + ["a", "B", "é", "", None, "z"]
    rows = [(i, f"text\n{i % 50}", "en", sources[i % len(sources)], i) for i in range(260)]
    rows += [(7, "text\n7", "en", "hot", 7)] * 3 + [(None, "x\ny", None, "only", None)]
    check(spark, rows)


def test_many_sources(spark, monkeypatch):
    low(monkeypatch)
    check(spark, [(i, "a\nb", "en", f"s{i % 61}", 1) for i in range(90)])


def test_empty(spark):
    assert merkle.verified(fixtures.empty(spark)).count() == 0


def test_missing_is_least():
    """Each asked node is needed, and nothing asked can be derived from what is held."""
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 10, 28, 82):
        levels = tree([h(str(i)) for i in range(n)])
        for _ in range(10):
            held = rng.sample(range(n), rng.randrange(1, n + 1))
            asked = merkle.missing(held, n)
            want = set()
            for p in held:
                for level in range(len(levels) - 1):
                    first = p // 3**level // 3 * 3
                    for s in range(first, min(first + 3, len(levels[level]))):
                        if not any(q // 3**level == s for q in held):
                            want.add((level, s))
            assert len(asked) == len(set(asked)) and set(asked) == want
            proof, root = merkle.expanded({p: levels[0][p] for p in held}, {k: levels[k[0]][k[1]] for k in asked}, n)
            assert root == levels[-1][0]
            for p in held:
                assert proof[p] == path(levels, p) == merkle.unlisted(*merkle.lists(proof[p]))
                assert merkle.folded(levels[0][p], proof[p]) == root


def test_proofs_of_some_leaves(spark, monkeypatch):
    low(monkeypatch)
    digests = {t: [h(t, str(i)) for i in range(n)] for t, n in (("1a", 100), ("1b", 1), ("1c", 31))}
    leaves = spark.createDataFrame([(t, i, d, len(ds)) for t, ds in digests.items() for i, d in enumerate(ds)], "tree string, pos long, digest string, n long")
    nodes, removers = merkle.interiors(leaves)
    every = nodes.select("tree", "level", "pos", "digest").unionByName(leaves.select("tree", F.lit(0).alias("level"), "pos", "digest"))
    got = merkle.proofs(leaves.where("pos % 7 IN (0, 3)"), every).collect()
    assert {(r.tree, r.pos) for r in got} == {(t, i) for t, ds in digests.items() for i in range(len(ds)) if i % 7 in (0, 3)}
    for r in got:
        levels = tree(digests[r.tree])
        assert merkle.unlisted(r.siblings, r["shape"]) == path(levels, r.pos) and r.root == levels[-1][0]
    for remove in removers:
        remove()
