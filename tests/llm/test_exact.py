import hashlib
import random
from collections import defaultdict

import fixtures
from eoframe.llm import exact


def plain(rows):
    """(doc_id, keep, size, digest) of each row and how many rows stay, by dictionaries."""
    groups = defaultdict(list)
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        groups[hashlib.sha256(low.encode()).hexdigest()].append(r[0])
    out = []
    for d, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), d) for i in ids]
    return out, len(groups)


def check(spark, rows):
    got = exact.exact_groups(fixtures.docs(spark, rows, extra=True)).collect()
    want, kept = plain(rows)
    assert fixtures.table((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == fixtures.table(want)
    assert sum(r.kept for r in got) == kept
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS)


def test_one_large_group(spark):
    rows = [(i, "Same Text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(600)]
    check(spark, rows)


def test_empty(spark):
    assert exact.exact_groups(fixtures.empty(spark)).count() == 0
    assert exact.drop_exact(fixtures.empty(spark)).count() == 0


def test_stage_keeps_columns_and_one_row_per_text(spark):
    d = fixtures.docs(spark, extra=True)
    out = exact.drop_exact(d)
    assert out.columns == d.columns
    want, kept = plain(fixtures.ROWS)
    assert out.count() == kept
    assert {r.doc_id for r in out.collect()} >= {2, 3, 6, 7, 8, 9, 10}


def test_index_inserts_deletes_and_grows():
    index, live, rng = exact.LiveIndex(4), {}, random.Random(5)
    for step in range(4000):
        digest = hashlib.sha256(str(rng.randrange(900)).encode()).digest()
        assert index.get(digest) == live.get(digest)
        if digest in live and rng.random() < 0.4:
            assert index.delete(digest)
            del live[digest]
        elif digest not in live:
            index.insert(digest, step)
            live[digest] = step
    assert dict(index.items()) == live and index.size == len(live) and index.resized > 3
    assert not index.delete(b"x" * 32)
