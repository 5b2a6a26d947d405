import hashlib
import random

import fixtures
from eoframe.llm import spots
from pyspark.sql import functions as F


def test_awkward_rows(spark):
    rows = [r for r in fixtures.ROWS if r[0] is not None and r[0] != 6] + [(6, fixtures.LONG, "en", "a", 1)]
    got = {r.doc_id: r for r in spots.fingerprints(fixtures.docs(spark, rows, extra=True)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        k = len(t) // 4
        assert got[r[0]].n_chars == len(t)
        assert got[r[0]].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        assert 0 <= got[r[0]].near_edited <= 1 and 0 <= got[r[0]].near_next <= 1
    assert got[4].fingerprint == got[5].fingerprint
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0


def test_repeated_and_null_ids(spark):
    assert spots.fingerprints(fixtures.docs(spark)).count() == len(fixtures.ROWS)
    assert spots.fingerprints(fixtures.empty(spark)).count() == 0


def test_signatures(spark):
    d = spark.createDataFrame([("The cat of Rome is a big dog",)], "t string")
    got = spots.with_signatures(d, "t", "s").first().s
    want = d.select(F.array(F.xxhash64(F.lit("the"), F.lit("cat"), F.lit("rome")), F.xxhash64(F.lit("of"), F.lit("rome"), F.lit("big")), F.xxhash64(F.lit("a"), F.lit("big"), F.lit("dog")))).first()[0]
    assert got == sorted(want)


def test_classes_equal_all_pairs(spark):
    rng = random.Random(6)
    sets = []
    for g in range(15):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(3, 40))]
        for _ in range(rng.randrange(1, 6)):
            s = set(base)
            for _ in range(rng.randrange(3)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(10**6))
            sets.append(sorted(s))
    rows = [(i, s) for i, s in enumerate(sets)]
    got = {r.doc_id: r.class_id for r in spots.classes(spark.createDataFrame(rows, "doc_id long, signatures array<long>")).collect()}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(sets))}


def test_stray_anchor_keeps_the_rest(spark):
    words = [f"w{i}" for i in range(120)]
    for at in (5, 60, 115):
        text = words[:at] + ["the"] + words[at:]
        edited = text[:90] + [f"x{i}" for i in range(31)]
        d = spark.createDataFrame([(" ".join(text), " ".join(edited))], "t string, e string")
        r = spots.with_signatures(spots.with_signatures(d, "t", "a"), "e", "b").select("a", "b", spots.likeness(F.col("a"), F.col("b")).alias("like")).first()
        assert len(r.a) > 100 and 0.4 < r.like < 0.8
