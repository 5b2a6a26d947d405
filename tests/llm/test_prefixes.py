import hashlib
import random
import zlib
from collections import defaultdict

import fixtures
import pytest
from eoframe.llm import prefixes
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def token(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, token(role, text), len(text)))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs):
    """All nodes from a dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * (p[-1][1] if p else 0)
    return fixtures.table(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, cs in members.items()
    )


def got(df):
    return fixtures.table(df.select(*prefixes.COLUMNS).collect())


def check(spark, rows):
    talks = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("token", F.lit(1)).withColumn("seq", F.lit(2))
    assert got(prefixes.trie(prefixes.items(talks))) == plain(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [
        (5, 0, "user", "a"), (5, 1, None, None), (5, None, "user", "first"), (6, 1, "user", "x"), (6, 1, "user", "b"), (6, 1, "user", "b"),
        (None, 0, "user", "nobody's"), (107, 0, "user", "own"), (100, 0, "s", "one"), (100, 1, "s", "two"), (-3, 0, "u", "é漢\U0001F600"),
        (8, 0, "user", "L" * 200_000), (9, 0, "user", "L" * 200_000),
    ]
    check(spark, rows)


def test_empty_and_one(spark):
    assert prefixes.trie(prefixes.items(spark.createDataFrame([], SCHEMA))).count() == 0
    check(spark, [(7, 0, "user", "a")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(330):
        rows += [(c, i, "u", rng.choice("ab") * rng.randrange(1, 3)) for i in range(rng.randrange(1, 9))]
    check(spark, rows)


def test_a_hot_conversation_and_long_ones(spark):
    rows = [(c, i, "u", f"t{i}") for c in range(1000, 1200) for i in range(7)]  # many copies of one
    rows += [(c, i, "u", f"l{i}") for c in (1, 2) for i in range(300 + c)]
    rows += [(3, i, "u", f"l{i}" if i < 200 else "z") for i in range(260)]
    check(spark, rows)


def plain_rows(spark, convs):
    """``items`` of given token lists."""
    rows, seen = [], defaultdict(list)
    for c, turns in convs.items():
        seen[tuple(turns)].append(c)
    for turns, cs in seen.items():
        sha = hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
        rows.append((bytearray(b"".join(t for t, _ in turns)), [n for _, n in turns], len(cs), min(cs), sha))
    return spark.createDataFrame(rows, "seq binary, sizes array<bigint>, n bigint, least bigint, ends_sha256 string")


def test_borders_everywhere(spark):
    """Few items over many pieces, so that nodes go on over several borders, turnless and prefix conversations included."""
    rng = random.Random(5)
    t = [(hashlib.md5(bytes([i])).digest(), i + 1) for i in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 13, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            convs = {c: [rng.choice(t) for _ in range(rng.randrange(7))] for c in range(60)}
            convs[60] = [t[0]] * 30
            convs[61] = [t[0]] * 29 + [t[1]]
            assert got(prefixes.trie(plain_rows(spark, convs))) == plain(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_forest():
    """Four neighbours that share one turn meet in one node, in whatever order their edges come."""
    f = prefixes.Forest([1, 3, 3, 2, 2], [-1, 1, 2, 1, 1])
    top = [i for i in f.alive() if f.parent[i] < 0]
    assert top == [0] and (f.low[0], f.high[0], f.depth[0]) == (0, 4, 1)
    assert sorted((f.depth[i], f.low[i], f.high[i]) for i in f.alive()) == [(1, 0, 4), (2, 1, 2), (2, 3, 3), (2, 4, 4), (3, 1, 1), (3, 2, 2)]
