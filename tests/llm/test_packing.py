import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import fixtures
from eoframe.llm import packing


def check(spark, rows, parts=3):
    import public_tokenizers as vocabularies
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    got = packing.pack(fixtures.docs(spark, rows, extra=True).repartition(parts)).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(coder.encode(r[1] or "", add_special_tokens=False).ids + [1])
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(ids)
    for doc, versions in ids.items():
        assert sum(p.length for p in pieces[doc]) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p.start):
                part = versions[0][at : at + p.length]
                assert p.start == at and p.doc_tokens == len(versions[0])
                assert p.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
                at += p.length
    windows = defaultdict(list)
    for p in got:
        windows[p.sequence_id].append((p.offset, p.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    return got


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS)


def test_many(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"word{rng.randrange(9)}" for _ in range(rng.choice([1, 30, 500, 900, 3000]))), "en", "s", 1) for i in range(400)]
    check(spark, rows)


def test_special_string(spark):
    check(spark, [(1, "a <|endoftext|> b", "en", "s", 1)], 1)


def test_empty(spark):
    assert packing.pack(fixtures.empty(spark)).count() == 0


def test_open_windows_are_bounded_and_best_fit():
    p = packing.Packer(0, window=10, limit=2)
    ids = lambda n: np.arange(n, dtype="<u4")
    p.add(("a",), ids(6))
    p.add(("b",), ids(5))
    p.add(("c",), ids(4))  # fits best with a
    assert p.emitted == 1 and len(p.open) == 1
    p.add(("d",), ids(7))
    p.add(("e",), ids(6))  # fits nowhere: its head fills d, its tail opens a window or fits
    assert p.emitted == 2 and all(u < 10 for u, _ in p.open) and len(p.open) <= 2
    assert sum(len(x[2]) for x in p.finish()) < 10


@pytest.mark.parametrize("total", [1, 5, 2047, 2048, 2049, 5000])
def test_tail_is_cut_at_powers_of_two(total):
    seen = {packing.sequence_at(i, total) for i in range(total)}
    assert sum(e - s for _, s, e in seen) == total
    assert all((e - s) & (e - s - 1) == 0 for _, s, e in seen)
    assert len({n for n, _, _ in seen}) == len(seen)
