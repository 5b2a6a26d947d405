import math

import fixtures
from eoframe.llm import mixing

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_targets(sizes):
    """Shares stopped at twice the source's size, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: 2.0 * sizes[s] for s in above}


def check(spark, rows, near):
    got = mixing.mix(fixtures.docs(spark, rows, extra=True)).collect()
    again = mixing.mix(fixtures.docs(spark, rows, extra=True).repartition(5)).collect()
    assert fixtures.table(got) == fixtures.table(again)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    targets = plain_targets(sizes)
    assert fixtures.table((r.doc_id, r.size) for r in got) == fixtures.table((r[0], words(r[1])) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    by = {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
            by[s] = by.get(s, 0) + r.taken
    for s, taken in by.items():
        if near is not None:
            assert abs(taken - targets[s]) <= max(near * targets[s], 0.5), (s, taken, targets[s])


def test_awkward_rows(spark):
    check(spark, fixtures.ROWS, None)


def test_sources_meet_targets(spark):
    rows = [(i, "word " * (1 + i * 37 % 400), "en", f"s{i % 7}" if i % 3 else "hot", 1) for i in range(900)]
    check(spark, rows, 0.01)


def test_empty(spark):
    assert mixing.mix(fixtures.empty(spark)).count() == 0
    assert mixing.mixed(fixtures.empty(spark)).count() == 0


def test_rates_solve_the_dual(spark):
    h = spark.createDataFrame([(1, s, n) for s, n in ((1, 50), (10, 20), (500, 3))], "no int, size long, n long")
    total = 1750
    for share in (0.01, 0.4, 1.0, 1.7, 1.99):
        t = spark.createDataFrame([(1, "s", total, share * total)], "no int, source string, source_size long, target double")
        r = mixing.balance(h, t).first()
        got = sum(n * s * 2 / (1 + math.exp(min(700, -r.lam * s / r.scale))) for s, n in ((1, 50), (10, 20), (500, 3)))
        assert math.isclose(got, share * total, rel_tol=1e-6)


def test_stage_repeats_rows(spark):
    rows = [(i, "word " * (1 + i * 37 % 400), "en", f"s{i % 4}", 1) for i in range(200)]
    d = fixtures.docs(spark, rows, extra=True)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(d).collect()}
    have = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v}


def test_sources_of_few_documents(spark):
    """Ten documents of very different sizes: one threshold alone misses by much more."""
    rows = [(i, "w " * (3 + (i * i * 7919 + i * 104729) % (3000 if i % 10 == 0 else 400)), "en", f"s{i % 8}", 1) for i in range(80)]
    check(spark, rows, 0.01)


def test_closing_moves(spark):
    """The nearest sum that one or two rows reach, again and again; a row moves once."""
    classes = [(1, 100, 1, 2), (1, 7, 0, 3), (2, 10, 2, 1), (3, 5, 1, 4)]
    goals = [(1, 314.0), (2, 20.0), (3, 0.0)]
    c = spark.createDataFrame(classes, "no int, size long, copies int, n long")
    got = {(r["no"], r["size"], r["copies"]): r.steps for r in mixing.closing_moves(c, spark.createDataFrame(goals, "no int, goal double")).collect()}
    assert got == {(1, 100, 1): [1], (1, 7, 0): [2], (3, 5, 1): [-1, -1, -1, -1]}
    one = spark.createDataFrame([(1, 100, 0, 1)], "no int, size long, copies int, n long")
    assert [r.steps for r in mixing.closing_moves(one, spark.createDataFrame([(1, 300.0)], "no int, goal double")).collect()] == [[2]]
