import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
import fixtures
from eoframe.llm import simhash


def plain_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_roots(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(spark, rows):
    got = simhash.near_groups(fixtures.docs(spark, rows, extra=True)).collect()
    fps = [plain_fp(r[1]) for r in rows]
    comp = {}
    for i, r in enumerate(plain_roots(fps)):
        if rows[i][0] is not None:
            comp[r] = min(comp.get(r, 1 << 70), rows[i][0])
    want = [(r[0], f, comp.get(k)) for r, f, k in zip(rows, fps, plain_roots(fps))]
    none = lambda x: None if x == simhash.NO_ID else x
    assert fixtures.table((none(r.doc_id), r.fp % (1 << 64), none(r.component_id)) for r in got) == fixtures.table(want)


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS)


def test_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for k in range(rng.randrange(1, 8)):
            words[rng.randrange(150)] = "changed"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    check(spark, rows)


@pytest.mark.parametrize("rows,flips", [(300, 6), (3000, 5)])
def test_forest_equals_all_pairs(rows, flips):
    rng = random.Random(rows)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(flips))) & (1 << 64) - 1 for _ in range(rows // 2)}
    fps |= {rng.getrandbits(64) for _ in range(rows // 4)}

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    fps = sorted((f % (1 << 64) for f in fps), key=rank)
    got = simhash.forest(np.array(fps, dtype=np.uint64)).tolist()
    want = plain_roots(fps) if rows < 1000 else None
    if want:
        assert got == want
    pairs = sum(len(a) for a, _ in simhash.near(np.array(fps, dtype=np.uint64)))
    a = np.array(fps, dtype=np.uint64)
    assert pairs == sum(int((np.bitwise_count(a ^ x) <= 4).sum()) for x in a)


def test_masks_promise():
    rng = random.Random(1)
    for rows in (10, 10**5, 10**8, 10**11):
        masks = simhash.block_masks(rows)
        for _ in range(50):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)
            m = next(m for m in masks if not d & m)
            assert any(not d & f for f in simhash.finer(m))


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 20)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for _ in range(400)})
    signed = [simhash.signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    at = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(at[e.a]), find(at[e.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == plain_roots(fps)


def test_stage(spark):
    d = fixtures.docs(spark, extra=True)
    out = simhash.drop_near(d)
    assert out.columns == d.columns
    kept = [r.doc_id for r in out.collect()]
    groups = simhash.near_groups(d).select("component_id").distinct().count()
    assert len(kept) == groups
    assert simhash.drop_near(fixtures.empty(spark)).count() == 0


def test_similarity_equals_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for g in range(10):
        base = [f"g{g}w{rng.randrange(90)}" for _ in range(80)]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    sets = [{tuple(r[1].split()[i : i + 5]) for i in range(76)} for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(rows))}
    docs = fixtures.docs(spark, rows, extra=True)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, 5, least=0.8).collect()}
    assert got == want
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()} != want
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == sorted(set(want.values()))
    awkward = simhash.drop_near(fixtures.docs(spark, extra=True), 5, least=0.8)
    assert 0 < awkward.count() <= len(fixtures.ROWS)
    assert simhash.drop_near(fixtures.empty(spark), 5, least=0.8).count() == 0
