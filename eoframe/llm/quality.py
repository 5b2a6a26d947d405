"""Quality classifier learnt from trusted positives and unlabelled web text.

Texts become measures of their form (shares of letters, capitals, symbols,
repeated words and lines, lengths ...), and each measure becomes steps, one for
every cut it exceeds.  A linear machine on these steps is the minimiser of the
non-negative unbiased risk with the squared loss

    prior * P[(1 - z)^2] + max(0, U[(1 + z)^2] - prior * P[(1 + z)^2])

where P is the mean over trusted positives and U over unlabelled texts.  The
risk needs nothing but counts of steps and of pairs of steps, so both means
cover all rows in one pass, whose sums are whole numbers and don't depend on
their order.  The largest value of ``mu * negative part`` over ``mu`` in [0, 1]
is the part cut at zero, and for each ``mu`` the risk is a convex quadratic form:
``mu`` is 1 where the negative part stays above zero, else it is bisected.

The class prior is the least ratio of unlabelled to positive texts above a
score, over the scores of a machine that tells positives from unlabelled texts.
Rows are dealt into two halves by a hash, and either half is scored by the
machine of the other, since a machine finds the positives it has seen too easily.
A score is the logistic of the distance to the emptiest place of the unlabelled
texts' values near the estimated share of negatives.

Labels with quality 0 are not used.  The cuts are quantiles of at most
``SAMPLE`` positives (first by a hash of their id); all else covers every row.

Defined results: null texts count as empty; labels without a document, with a
null id or a null mark are left out, an id labelled both ways counts as 0;
labelled rows repeat as often as their documents do; without positives, or
where every document is a positive, all scores are 0.5; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import stored, table, texts

SAMPLE = 20_000
PARTS = (0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8, 0.92, 0.97, 0.99, 0.998)
MERGERS = 4
RIDGE = 1e-3
BINS = 400
THRESHOLD = 0.5
SLOPE = 4.0

LOW, UP, DIGIT, SPACE, LINE, POINT, MARK, SYMBOL, OTHER = range(9)
MEASURES = (
    "upper", "digits", "spaces", "points", "marks", "symbols", "others", "words", "word_length", "length_spread",
    "long_words", "same_as_last", "different", "most_frequent", "all_caps", "ends_in_symbol", "without_letter",
    "with_digit", "first_upper", "sentence", "lines", "repeated_lines", "longest_line",
)


def _classes() -> np.ndarray:
    out = np.full(0x3000, OTHER, dtype=np.int8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isupper():
            out[c] = UP
        elif ch.isalpha():
            out[c] = LOW
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch == "\n":
            out[c] = LINE
        elif ch.isspace():
            out[c] = SPACE
        elif ch in ".,;:?'\"()-":
            out[c] = POINT
        elif ch == "!":
            out[c] = MARK
        elif c < 0x250:
            out[c] = SYMBOL
    return out


CLASSES = _classes()
#: odd multipliers by place in a word or line
_PLACES = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the maximal runs of positions that are not ``cut``."""
    inside = np.concatenate(([False], ~cut, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def _names(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of characters."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    size = end - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    chars = codes[np.repeat(first, size) + at].astype(np.uint64) + np.uint64(0x9E3779B9)
    mixed = chars * _PLACES[at % len(_PLACES)]
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), np.cumsum(size) - size)


def _kinds(owner: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different names, rows of the most frequent name) per owner."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((names, owner))
    o, v = owner[order], names[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    starts = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, o[starts], np.diff(np.append(starts, len(o))))
    return np.bincount(o[starts], minlength=n).astype(float), most


def _some_measures(some: list[str]) -> np.ndarray:
    n = len(some)
    flat = np.frombuffer("\n".join([*some, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in some])
    owner = np.repeat(np.arange(n), sizes + 1)
    cls = np.where(flat < 0x3000, CLASSES[np.minimum(flat, 0x2FFF)], LOW)
    last = np.cumsum(sizes + 1) - 1
    each = np.bincount(owner * 9 + cls, minlength=9 * n).reshape(n, 9).astype(float)
    each[:, LINE] -= 1
    chars = np.maximum(sizes, 1)
    letters = np.maximum(each[:, LOW] + each[:, UP], 1)

    first, end = _runs((cls == SPACE) | (cls == LINE))
    who = owner[first]
    count = np.bincount(who, minlength=n).astype(float)
    some_words = np.maximum(count, 1)
    size = (end - first).astype(float)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[end] - total[first]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(who, weights=mask, minlength=n) / some_words

    ups, lows = per_word(cls == UP), per_word(cls == LOW)
    names = _names(flat, first, end)
    same = np.concatenate(([False], (names[1:] == names[:-1]) & (who[1:] == who[:-1]))) if len(names) else names > 0
    kinds, most = _kinds(who, names, n)
    mean = np.bincount(who, weights=size, minlength=n) / some_words
    ends = np.isin(cls[end - 1], (MARK, SYMBOL, OTHER)) if len(end) else end > 0

    starts, stops = _runs(flat == 10)
    line_of = owner[starts]
    lines = np.maximum(np.bincount(line_of, minlength=n), 1).astype(float)
    different, _ = _kinds(line_of, _names(flat, starts, stops), n)
    longest = np.zeros(n)
    np.maximum.at(longest, line_of, stops - starts)
    stop_marks = np.bincount(owner[np.isin(flat, (33, 46, 63))], minlength=n)
    columns = [
        each[:, UP] / letters, each[:, DIGIT] / chars, (each[:, SPACE] + each[:, LINE]) / chars, each[:, POINT] / chars,
        each[:, MARK] / chars, each[:, SYMBOL] / chars, each[:, OTHER] / chars, np.log1p(count), mean,
        np.sqrt(np.maximum(np.bincount(who, weights=size * size, minlength=n) / some_words - mean * mean, 0)),
        share(size > 20), share(same), kinds / some_words, most / some_words, share((ups > 1) & (lows == 0)), share(ends),
        share(ups + lows == 0), share(per_word(cls == DIGIT) > 0), share(cls[first] == UP), count / (1.0 + stop_marks),
        lines / some_words, np.where(lines > 0, 1 - np.maximum(different, 1) / lines, 0), np.log1p(longest),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def measures(some: list[str]) -> np.ndarray:
    """A row of ``MEASURES`` per text, whole texts of any length."""
    out, at, size = [np.zeros((0, len(MEASURES)), dtype=np.float32)], 0, 0
    for i, t in enumerate(some, 1):
        size += len(t)
        if size >= 2_000_000 or i == len(some):
            out.append(_some_measures(some[at:i]))
            at, size = i, 0
    return np.concatenate(out)


def steps(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """1 and, for every cut, whether the measure lies above it."""
    return np.concatenate([np.ones((len(x), 1), dtype=np.float32), *[(x[:, [i]] > c).astype(np.float32) for i, c in enumerate(cuts)]], axis=1)


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf.x), dtype=np.float32).reshape(-1, len(MEASURES))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the measures of every text as packed floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "x": [r.tobytes() for r in measures(pdf.text.tolist())]})

    return texts(docs).mapInPandas(run, "doc_id bigint, x binary")


def summed(rows: DataFrame, cuts: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Counts of pairs of steps per ``kind`` of ``rows`` (kind, x); entry [0, 0] is the number of rows.

    Tasks return a matrix per kind and ``MERGERS`` tasks add them, so the driver
    gets at most that many matrices of fixed size per kind.
    """
    width = 1 + sum(len(c) for c in cuts)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for kind, some in pdf.groupby("kind"):
                for i in range(0, len(some), 1 << 14):
                    t = steps(matrix(some.iloc[i : i + (1 << 14)]), cuts)
                    total[kind] = total.get(kind, 0) + (t.T @ t).astype(np.int64)
        yield pd.DataFrame([(k, m.tobytes()) for k, m in total.items()], columns=["kind", "m"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for kind, m in zip(pdf.kind, pdf.m):
                total[kind] = total.get(kind, 0) + np.frombuffer(m, dtype=np.int64)
        yield pd.DataFrame([(k, m.tobytes()) for k, m in total.items()], columns=["kind", "m"])

    schema = "kind int, m binary"
    got = rows.mapInPandas(add, schema).repartition(MERGERS).mapInPandas(merge, schema).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        out[r.kind] = out.get(r.kind, 0) + np.frombuffer(r.m, dtype=np.int64).reshape(width, width)
    return out


def ridge(width: int) -> np.ndarray:
    return np.diag(np.append(1e-9, np.full(width - 1, RIDGE)))


def against_unlabelled(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Least squares of positives (1) against unlabelled texts (-1), both sides of equal weight."""
    mp, mu = p / p[0, 0], u / u[0, 0]
    return np.linalg.solve(mp + mu + ridge(len(p)), mp[0] - mu[0])


def negative_part(w: np.ndarray, mp: np.ndarray, mu: np.ndarray, prior: float) -> float:
    """U[(1 + z)^2] - prior * P[(1 + z)^2] with z = steps . w, from the pair means."""
    v = w.copy()
    v[0] += 1
    return float(v @ mu @ v - prior * (v @ mp @ v))


def least_risk(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk; ``p`` and ``u`` are pair counts of positives and unlabelled texts."""
    mp, mu = p / p[0, 0], u / u[0, 0]

    def best(m: float) -> np.ndarray:
        # prior * P[(1 - z)^2] + m * (U[(1 + z)^2] - prior * P[(1 + z)^2])
        return np.linalg.solve(prior * (1 - m) * mp + m * mu + ridge(len(p)), prior * (1 + m) * mp[0] - m * mu[0])

    w = best(1.0)
    if negative_part(w, mp, mu, prior) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if negative_part(best(mid), mp, mu, prior) >= 0 else (low, mid)
    return best(low)


def prior_of(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of unlabelled to positive rows in the best scores; ``p`` and ``u`` count rows per score bin.

    Only scores that half of the positives reach count, since few rows stand above higher ones.
    """
    sp, su = np.cumsum(p[::-1]) / p.sum(), np.cumsum(u[::-1]) / u.sum()
    ok = sp >= 0.5
    return float(np.clip((su[ok] / sp[ok]).min(), 0.02, 0.98))


def cut_of(u: np.ndarray, prior: float) -> float:
    """The score where the classes part: the emptiest place of the unlabelled scores (rows per bin)
    that leaves between half and twice the estimated share of negatives below; middle of equal places."""
    below = np.cumsum(u) / u.sum()
    near = np.convolve(u, np.hanning(2 * BINS // 20 + 3), mode="same")
    wanted = np.flatnonzero((below >= (1 - prior) / 2) & (below <= 2 * (1 - prior)))
    if not len(wanted):
        wanted = np.array([np.searchsorted(below, 1 - prior)])
    ties = wanted[near[wanted] <= near[wanted].min() * (1 + 1e-9)]
    return float((ties[len(ties) // 2] + 1) * 4 / BINS - 2)


def counted_scores(rows: DataFrame, cuts: list[np.ndarray], w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows per score bin: (positives, unlabelled); a row of kind + 2 * half is scored by ``w[half]``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            half = pdf.kind.to_numpy() // 2
            z = (steps(matrix(pdf), cuts).astype(float) @ np.stack(w, axis=1))[np.arange(len(pdf)), half]
            at = np.clip((z + 2) / 4 * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"kind": pdf.kind % 2, "at": at}).groupby(["kind", "at"]).size().rename("n").reset_index()

    out = np.zeros((2, BINS))
    for r in rows.mapInPandas(run, "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r.kind, r["at"]] = r.n
    return out[1], out[0]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def trusted(labels: DataFrame) -> DataFrame:
    """(k, good) per labelled document that is not held out; ``good`` is 1 where all its marks are 1."""
    return (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("k")).agg(F.min("quality").cast("int").alias("good"))
    )


def fit(rows: DataFrame, labels: DataFrame):
    """(cuts, weights, prior) learnt from ``rows`` (doc_id, x) and ``labels`` (doc_id, quality), or None.

    A row is a trusted positive (kind 1), unlabelled (kind 0: without a label that may be learnt from), or left out.
    """
    joined = rows.join(trusted(labels), F.col("doc_id") == F.col("k"), "left")
    half = F.pmod(F.xxhash64(F.lit("half"), "x"), F.lit(2)) * 2
    known = F.coalesce("good", F.lit(0))
    kinds, remove = stored(joined.where("k IS NULL OR good = 1").select((known + half).cast("int").alias("kind"), "doc_id", "x"))
    try:
        some = kinds.where("kind % 2 = 1").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(SAMPLE).toPandas()
        if some.empty or kinds.where("kind % 2 = 0").isEmpty():
            return None
        x = matrix(some)
        cuts = [np.unique(np.quantile(x[:, i], PARTS, method="inverted_cdf")) for i in range(x.shape[1])]
        sums = summed(kinds.select("kind", "x"), cuts)
        p, u = (sums.get(k, 0) + sums.get(k + 2, 0) for k in (1, 0))
        other = [against_unlabelled(sums.get(3 - 2 * h, p), sums.get(2 - 2 * h, u)) for h in (0, 1)]
        prior = prior_of(*counted_scores(kinds.select("kind", "x"), cuts, other))
        w = least_risk(p, u, prior)
        w[0] -= cut_of(counted_scores(kinds.select("kind", "x"), cuts, [w, w])[1], prior)
        return cuts, w, prior
    finally:
        remove()


def scores(rows: DataFrame, model) -> DataFrame:
    """(doc_id, score) per row of ``rows`` (doc_id, x)."""
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    cuts, w, _ = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = steps(matrix(pdf), cuts).astype(float) @ w
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": 1 / (1 + np.exp(-np.clip(SLOPE * z, -30, 30)))})

    return rows.mapInPandas(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the estimated ``class_prior`` per document."""
    rows, _ = stored(measured(docs))  # stays in the shared folder: the answer is read from it
    model = fit(rows, labels)
    return scores(rows, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.lit(model[2] if model else None).cast("double").alias("class_prior"),
    )


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
