import random
import zlib

import fixtures
import numpy as np
from eoframe.llm import quality
from pyspark.sql import functions as F


def plain_measures(t):
    """Some of the measures of one text, said plainly."""
    words = t.split()
    n = max(1, len(words))
    letters = [c for c in t if c.isalpha()]
    return {
        "upper": sum(c.isupper() for c in letters) / max(1, len(letters)),
        "digits": sum(c.isdigit() for c in t) / max(1, len(t)),
        "spaces": sum(c.isspace() for c in t) / max(1, len(t)),
        "marks": t.count("!") / max(1, len(t)),
        "words": np.log1p(len(words)),
        "word_length": sum(map(len, words)) / n,
        "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / n,
        "different": len(set(words)) / n,
        "most_frequent": max(map(words.count, set(words)), default=0) / n,
        "long_words": sum(len(w) > 20 for w in words) / n,
        "longest_line": np.log1p(max(map(len, t.split("\n")))),
    }


def test_measures():
    some = ["", " \t\n ", "One one ONE!", "a a a b\na a a b\n\nc", "x" * 30 + " 12 é", "漢字 \U0001F600 fin", "ab\n" * 300 + "Z" * 5000]
    got = quality.measures(some)
    for t, row in zip(some, got):
        have = dict(zip(quality.MEASURES, row.tolist()))
        for k, v in plain_measures(t).items():
            assert abs(have[k] - v) < 1e-4, (t[:20], k)
    one_by_one = np.concatenate([quality.measures([t]) for t in some])
    assert np.array_equal(got, one_by_one)


def risk(w, tp, tu, prior):
    zp, zu = tp @ w, tu @ w
    return prior * np.mean((1 - zp) ** 2) + max(0, np.mean((1 + zu) ** 2) - prior * np.mean((1 + zp) ** 2)) + w @ quality.ridge(len(w)) @ w


def test_least_risk_against_descent():
    """The closed form reaches the risk that plain subgradient steps and random moves can't go below."""
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.9):
        tp = np.hstack([np.ones((60, 1)), rng.random((60, 12)) < 0.7]).astype(float)
        tu = np.hstack([np.ones((80, 1)), rng.random((80, 12)) < 0.4]).astype(float)
        w = quality.least_risk(tp.T @ tp, tu.T @ tu, prior)
        least = risk(w, tp, tu, prior)
        for size in (1, 0.1, 0.01, 0.001):
            for _ in range(500):
                assert risk(w + size * rng.standard_normal(len(w)), tp, tu, prior) >= least - 1e-6
        v = np.zeros_like(w)
        for step in range(20_000):
            zp, zu = tp @ v, tu @ v
            g = -2 * prior * tp.T @ (1 - zp) / 60 + 2 * quality.ridge(len(v)) @ v
            if np.mean((1 + zu) ** 2) > prior * np.mean((1 + zp) ** 2):
                g += 2 * tu.T @ (1 + zu) / 80 - 2 * prior * tp.T @ (1 + zp) / 60
            v -= 0.02 / (1 + step / 2000) * g
        assert least <= risk(v, tp, tu, prior) + 1e-6


def test_pair_counts_and_bins(spark):
    rng = random.Random(1)
    some = [" ".join(rng.choice(["aa", "Bb", "c1", "!!"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = quality.measured(fixtures.docs(spark, [(i, t, None, None, None) for i, t in enumerate(some)]))
    kinds = rows.select((F.col("doc_id") % 4).cast("int").alias("kind"), "x").repartition(7)
    x = quality.measures(some)
    cuts = [np.unique(np.quantile(x[:, i], (0.2, 0.5, 0.9))) for i in range(x.shape[1])]
    t = quality.steps(x, cuts).astype(np.int64)
    sums = quality.summed(kinds, cuts)
    for k in range(4):
        assert np.array_equal(sums[k], t[k::4].T @ t[k::4])
    w = [rng.random() * np.ones(t.shape[1]) / 20 - 0.5, np.linspace(-0.4, 0.4, t.shape[1])]
    p, u = quality.counted_scores(kinds, cuts, w)
    for kind, got in ((1, p), (0, u)):
        want = np.zeros(quality.BINS)
        for i in range(300):
            if i % 2 == kind:
                want[int(np.clip((t[i] @ w[i % 4 // 2] + 2) / 4 * quality.BINS, 0, quality.BINS - 1))] += 1
        assert np.array_equal(got, want)


def test_prior():
    p = np.array([10.0, 30, 60, 100, 100, 100])
    assert abs(quality.prior_of(p * 1000, (0.8 * p + np.array([80, 0, 0, 0, 0, 0])) * 1000) - 0.8) < 0.01


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abdefghlnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        good = i % 5 != 0
        if not good:
            text = [w + rng.choice(["***", "$$$"]) for w in text] if i % 2 else [w for w in text[:20] for _ in range(4)]
        rows.append((100 + i, " ".join(text), "en", "s", 1))
        if i % 2 or i % 3 == 0:
            labels.append((100 + i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    # a repeated row, one labelled both ways, labels without a document, id or mark
    docs = fixtures.docs(spark, [*rows, rows[0], *fixtures.ROWS], extra=True)
    more = [(None, 1), (99_999, 1), (4, None), (7, 1), (7, 0)]
    marks = spark.createDataFrame([(i, q, 0) for i, q in labels + more], "doc_id long, quality int, score int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows) + 1 + len(fixtures.ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(by_id[i].predicted, q) for i, q in labels if by_id[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert 0.7 < got[0].class_prior < 0.95
    # marks of 0 and held-out marks are never learnt from
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels if q or zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.classify(fixtures.docs(spark, rows), flipped).collect()}
    base = {r.doc_id: r.score for r in quality.classify(fixtures.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert again == base


def test_nothing_to_learn_from(spark):
    docs = fixtures.docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted, r.class_prior) for r in quality.classify(docs, none).collect()} == {(0.5, 1, None)}
    assert quality.classify(fixtures.empty(spark), none).count() == 0
    one = spark.createDataFrame([(5, 1), (6, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(docs, one).count() == len(fixtures.ROWS)
