import hashlib
import random
from collections import Counter

import fixtures
import numpy as np
import pytest
from eoframe.llm import repeats


def plain(rows, width):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + width] for b in raws for i in range(len(b) - width + 1))
    out = []
    for r, b in zip(rows, raws):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, rows, width=200):
    got = repeats.without_repeats(fixtures.docs(spark, rows, extra=True), width).drop("kept").collect()
    assert fixtures.table(got) == fixtures.table(plain(rows, width))


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS)


def pieces(rng, n):
    shared = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(150, 500))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(shared)[rng.randrange(90) :] if rng.random() < 0.5 else "".join(rng.choice("ghijk ") for _ in range(rng.randrange(300)))
        rows.append((i, text, "en", "s", 1))
    return rows


def test_shared_pieces(spark):
    check(spark, pieces(random.Random(4), 80))


def test_large_groups_take_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    check(spark, pieces(random.Random(5), 60))


def test_empty(spark):
    assert repeats.without_repeats(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))]
    strings += rng.choices(strings, k=2)
    index = repeats.RunIndex(strings)
    got = index.matching_statistics(12).tolist()
    suffixes = [s[i:] for s in strings for i in range(len(s))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [min(12, max((common(a, b) for j, b in enumerate(suffixes) if j != i), default=0)) for i, a in enumerate(suffixes)]
    assert got == want
    assert index.run_length.sum() == len(suffixes)
