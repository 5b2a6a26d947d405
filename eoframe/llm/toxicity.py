"""Toxicity by a subsequence string kernel machine with Nystroem landmarks.

Two words are alike in the subsequences of four characters they share, gaps of
up to two characters allowed and discounted; word ends count as characters.  So
an insult with a character put in, or spelt with dots or blanks, stays near the
plain one.  A support vector machine (squared hinge) is trained on the words of
labelled sentences in the space that the landmark words span; as the kernel is a
sum over subsequences, the trained machine is a table of subsequence weights,
and scoring a text is looking up its words' subsequences.  A logistic step on a
text's word scores gives the score of the text.

Training sees at most ``SAMPLE`` labelled texts (those first by a hash of their
id) and all of their words; landmarks are chosen among ``WORDS`` of them, ties by
hash.  Word counts over that sample, the sums of each Newton step and all scores
are computed on executors.

Defined results: null or empty texts get the score of a text without words;
labels whose document is missing or whose mark is null are left out; with labels
of one kind only, or labelled texts without a word of two letters, every score is
the share of toxic labels; empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import few, packed, real_id, table, with_key
from eoframe.session import stable

SAMPLE = 20_000
WORDS = 16_000
LANDMARKS = 240
TRAINERS = 24  # tasks of a training step, each of which makes one matrix of sums, whatever the partitions of the words
MERGERS = 4
GAP = 2
DECAY = 0.7
THRESHOLD = 0.3
LENGTH = 4
ENDS = 1
#: (offsets of the later characters, weight)
PATTERNS = [(o, DECAY ** (o[-1] - LENGTH + 1)) for o in combinations(range(1, LENGTH + GAP), LENGTH - 1)]
SPELT = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][\s.\-*]){3,}[^\W_](?=\W|$)")
START = 4.0  # weight of a subsequence that begins with its word, so that a rare beginning counts before a common ending
DIGITS = dict(zip("013457", "oieast"))


def _classes() -> np.ndarray:
    """Class of every code point below 0x3000: 0 is left out, 1 a word end, 2-27 letters, 28-63 the rest."""
    out = np.zeros(0x3000, dtype=np.int64)
    for c in range(0x3000):
        ch = DIGITS.get(chr(c), chr(c))
        if "a" <= ch <= "z":
            out[c] = 2 + ord(ch) - 97
        elif ch.isdigit():
            out[c] = 28
        elif ch.isalpha():
            out[c] = 29 + c % 35
    return out


CLASSES = _classes()


def words_of(text: str) -> list[str]:
    low = text.lower()
    spelt = [re.sub(r"[\s.\-*]", "", m) for m in SPELT.findall(low)]
    return low.split() + spelt


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?]\s|\n", text) if s.strip()]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class, word number) of all kept characters of the words, with an end before and after each word."""
    flat = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    cut = flat == 10
    owner = np.cumsum(cut)
    cls = np.where(flat < 0x3000, CLASSES[np.minimum(flat, 0x2FFF)], 29 + flat % 35)
    keep = (cls > 0) & ~cut
    cls, owner = cls[keep], owner[keep]
    n = len(words)
    ends = np.arange(n)
    who = np.concatenate((ends, owner, ends))
    order = np.argsort(who, kind="stable")
    return np.concatenate((np.full(n, ENDS), cls, np.full(n, ENDS)))[order], who[order]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number, subsequence, weight) per pattern."""
    cls, who = letters(words)
    for offsets, weight in PATTERNS:
        last = len(cls) - offsets[-1]
        if last <= 0:
            continue
        ok = np.flatnonzero(who[:last] == who[offsets[-1] :])
        code = cls[ok]
        for o in offsets:
            code = code * 64 + cls[ok + o]
        yield who[ok], code, np.where(cls[ok] == ENDS, START * weight, weight)


def norms(words: list[str]) -> np.ndarray:
    total = np.zeros(len(words))
    for who, _, weight in subsequences(words):
        total += np.bincount(who, weights=weight * weight, minlength=len(words))
    return np.sqrt(np.maximum(total, 1e-12))


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of ``words`` against ``marks``."""
    found = list(subsequences(marks))
    code, who, weight = (np.concatenate([x[i] for x in found]) for i in (1, 0, 2))
    # one entry for a subsequence and a mark, by subsequence; most subsequences have few marks
    cells, place = np.unique(code * len(marks) + who, return_inverse=True)
    value = np.bincount(place, weights=weight) / norms(marks)[cells % len(marks)]
    mark = cells % len(marks)
    codes, starts, sizes = np.unique(cells // len(marks), return_index=True, return_counts=True)
    out = np.zeros(len(words) * len(marks))
    squares = np.zeros(len(words))
    for who, code, weight in subsequences(words):
        squares += np.bincount(who, weights=weight * weight, minlength=len(words))
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = np.flatnonzero(codes[at] == code)
        if len(hit):
            n = sizes[at[hit]]
            entry = np.arange(n.sum()) + np.repeat(starts[at[hit]] - np.cumsum(n) + n, n)
            cell = np.repeat(who[hit] * len(marks), n) + mark[entry]
            out += np.bincount(cell, weights=np.repeat(weight[hit], n) * value[entry], minlength=len(out))
    lengths = np.sqrt(np.maximum(squares, 1e-12))
    return (out.reshape(len(words), len(marks)) / lengths[:, None]).astype(np.float32)


def moments(words: list[str], p: np.ndarray, q: np.ndarray, marks: list[str], root: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of one Newton step over ``words``: a row per weight, the second derivatives and last the first."""
    out = np.zeros((len(w), len(w) + 1))
    for i in range(0, len(words), 1 << 12):
        some = words[i : i + (1 << 12)]
        x = np.hstack([kernel(some, marks) @ root.astype(np.float32), np.ones((len(some), 1), dtype=np.float32)]).astype(np.float64)
        ok = norms(some) > 1e-5  # words too short for a subsequence have nothing to learn from
        f = x @ w
        a, b = p[i : i + (1 << 12)] * (ok & (f < 1)), q[i : i + (1 << 12)] * (ok & (f > -1))
        out[:, :-1] += (x.T * (a + b)) @ x
        out[:, -1] += x.T @ (a * (f - 1) + b * (f + 1))
    return out


def svm(size: int, sums: Callable[[np.ndarray], np.ndarray], cost: float = 30.0, steps: int = 25) -> np.ndarray:
    """Squared hinge by Newton steps with ``sums(w)`` over all words; last entry is the bias."""
    w = np.zeros(size + 1)
    ridge = np.ones(size + 1)
    ridge[-1] = 1e-3
    for _ in range(steps):
        m = sums(w)
        step = np.linalg.solve(np.diag(ridge) + 2 * cost * m[:, :-1], ridge * w + 2 * cost * m[:, -1])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def spread(words: list[str], weight: np.ndarray, n: int) -> list[str]:
    """``n`` of ``words``: the heaviest, then always the one of most weight that the chosen leave unexplained in kernel space."""
    left = np.asarray(weight, dtype=float) + 1e-9
    rest = np.ones(len(words))
    basis = np.zeros((len(words), 0))
    chosen: list[int] = []
    while len(chosen) < min(n, len(words)):
        i = int(np.argmax(left * rest))
        if rest[i] < 1e-3:
            break
        k = kernel(words, [words[i]])[:, 0].astype(float)
        new = (k - basis @ basis[i]) / np.sqrt(max(rest[i], 1e-6))
        basis = np.column_stack([basis, new])
        rest = np.maximum(rest - new**2, 0)
        chosen.append(i)
    return [words[i] for i in chosen]


def landmarks(words: list[str], p: np.ndarray, q: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(landmark words, the map from kernel values to the space they span)."""
    lean = np.argsort(q - p, kind="stable")
    first = lean[: 16 * LANDMARKS]
    toxic = spread([words[i] for i in first], np.maximum(p - q, 0)[first] ** 2, LANDMARKS // 2)
    plain = lean[::-1][: LANDMARKS // 4]
    rest = lean[LANDMARKS // 2 : -LANDMARKS // 4][:: max(1, len(lean) // (LANDMARKS // 4))]
    marks = list(dict.fromkeys([*toxic, *[words[i] for i in [*plain, *rest]]]))
    kmm = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    good = values > 1e-4 * values.max()
    return marks, vectors[:, good] / np.sqrt(values[good])


def folded(marks: list[str], root: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(subsequence codes, their weights, bias) of the machine with weights ``w``."""
    beta = root @ w[:-1] / norms(marks)
    codes = np.unique(np.concatenate([c for _, c, _ in subsequences(marks)]))
    weights = np.zeros(len(codes))
    for who, code, weight in subsequences(marks):
        np.add.at(weights, np.searchsorted(codes, code), weight * beta[who])
    return codes.astype(np.int32), weights.astype(np.float32), float(w[-1])


def train_words(words: list[str], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The machine of a plain list of words."""
    marks, root = landmarks(words, p, q)
    return folded(marks, root, svm(root.shape[1], lambda w: moments(words, p, q, marks, root, w)))


def train_table(words: DataFrame, marks: list[str], root: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The machine of all rows of ``words`` (word, p, q); at most ``TRAINERS`` tasks return one matrix of sums each."""
    words = words.coalesce(TRAINERS)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, least = 0.0, None
            for pdf in batches:
                if len(pdf):
                    total = total + moments(pdf.word.tolist(), pdf.p.to_numpy(), pdf.q.to_numpy(), marks, root, w)
                    least = pdf.word.iloc[0] if least is None else least
            if least is not None:
                yield pd.DataFrame({"least": [least], "m": [total.tobytes()]})

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = sorted((least, m) for pdf in batches for least, m in zip(pdf.least, pdf.m))
            if rows:
                yield pd.DataFrame({"least": [rows[0][0]], "m": [sum(np.frombuffer(m) for _, m in rows).tobytes()]})

        # a matrix per task, added in a fixed order by MERGERS tasks, so disk and driver get as many whatever the partitions
        some = words.mapInPandas(run, "least string, m binary").repartition(MERGERS).mapInPandas(merge, "least string, m binary")
        rows = sorted(some.collect(), key=lambda r: r.least)
        return sum(np.frombuffer(r.m).reshape(len(w), len(w) + 1) for r in rows)

    return folded(marks, root, svm(root.shape[1], sums))


_TABLES: dict[int, np.ndarray] = {}


def _table(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    key = hash((codes.tobytes(), weights.tobytes()))
    if key not in _TABLES:
        _TABLES.clear()
        dense = np.zeros(64**LENGTH, dtype=np.float32)
        dense[codes] = weights
        _TABLES[key] = dense
    return _TABLES[key]


RARE = 0.02  # of a word's shares, so that a rare word leans less
FEATURES = 6


def text_features(texts: list[str], machine: tuple) -> np.ndarray:
    """Per text: how many of its words score above 0.2 and 0.5 (logs and shares), the highest score, and its length."""
    codes, weights, bias = machine
    dense = _table(codes, weights)
    out = np.zeros((len(texts), FEATURES))
    out[:, 4] = -1
    at, size = 0, 0
    for end in range(1, len(texts) + 1):
        size += len(texts[end - 1])
        if size < 1_500_000 and end < len(texts):
            continue
        lists = [words_of(t) for t in texts[at:end]]
        counts = np.array([len(x) for x in lists])
        every = [w for x in lists for w in x]
        if every:
            number, kinds = pd.factorize(np.array(every, dtype=object))
            kinds = list(kinds)
            f, squares = np.zeros(len(kinds)), np.zeros(len(kinds))
            for who, code, weight in subsequences(kinds):
                f += np.bincount(who, weights=weight * dense[code], minlength=len(kinds))
                squares += np.bincount(who, weights=weight * weight, minlength=len(kinds))
            f = (f / np.sqrt(np.maximum(squares, 1e-12)) + bias)[number]
            have = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[have]
            low, high = np.add.reduceat(f > 0.2, starts, dtype=np.int64), np.add.reduceat(f > 0.5, starts, dtype=np.int64)
            n = counts[have]
            out[at + have] = np.stack(
                [np.log1p(low), np.log1p(high), low / n, high / n, np.clip(np.maximum.reduceat(f, starts), -1, 2), np.log1p(n)], axis=1
            )
        at, size = end, 0
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights on standardised features, folded back; last entry is the bias."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread < 1e-3, 1.0, spread)  # a feature that never varies must not weigh on other texts
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (s - y) + ridge * w
        step = np.linalg.solve((z.T * (s * (1 - s) + 1e-9)) @ z + np.diag(ridge), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _sentence_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, toxic, n): sentences with the word; the word '' counts all sentences."""
    from collections import Counter

    for pdf in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(pdf.text, pdf.toxic.tolist()):
            for s in sentences_of(text):
                # punctuation is no part of a trained word, and a word is counted once a sentence
                seen[toxic].update({"".join(c for c in w if c.isalnum()) for w in words_of(s)} - {""})
                seen[toxic][""] += 1
        yield pd.DataFrame([(w, t, n) for t in seen for w, n in seen[t].items()], columns=["word", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame):
    """(machine, logistic weights), or a constant score, from the labelled rows of ``docs`` among ``labels`` (doc_id, toxic)."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("li")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = marked.join(docs.select(F.col("doc_id").alias("di")).distinct(), F.col("li") == F.col("di")).select("li", "toxic")
    chosen = stable(known.orderBy(F.xxhash64("li"), "li").limit(SAMPLE))  # SAMPLE short rows
    sample = stable(
        # by id too, or all copies of a text meet in one task
        with_key(docs).join(chosen, F.col("doc_id") == F.col("li")).repartition(24, F.xxhash64("li", "text")).select("text", "toxic")
    )
    share = sample.agg(F.avg("toxic")).first()[0]
    if share is None or share in (0.0, 1.0):
        return None, float(share or 0.0)
    counts = stable(
        sample.mapInPandas(_sentence_words, "word string, toxic int, n bigint")
        .groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    )
    total = counts.where("word = ''").first()
    if total is None:
        return None, float(share)
    p, q = F.col("p") * 100 / max(1, total.p), F.col("q") * 100 / max(1, total.q)
    damp = F.sqrt(p + q + RARE)  # a word weighs by the root of how often it is seen, so that rare insults count
    words = counts.where("word <> ''").select("word", (p / damp).alias("p"), (q / damp).alias("q"))
    words = stable(words.repartition(24, F.xxhash64("word")).sortWithinPartitions("word"))
    picked = [
        words.orderBy((F.col("q") - F.col("p")), F.xxhash64("word"), "word").limit(WORDS // 2),
        words.orderBy((F.col("p") - F.col("q")), F.xxhash64("word"), "word").limit(WORDS // 4),
        words.orderBy(F.xxhash64("word"), "word").limit(WORDS // 4),
    ]
    got = picked[0].unionByName(picked[1]).unionByName(picked[2]).distinct().orderBy(F.xxhash64("word"), "word").toPandas()  # at most WORDS rows
    got = got[norms(got.word.tolist()) > 1e-5]  # words too short for a subsequence have nothing to learn from
    if got.empty:
        return None, float(share)
    machine = train_table(words, *landmarks(got.word.tolist(), got.p.to_numpy(), got.q.to_numpy()))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pd.DataFrame(text_features(pdf.text.tolist(), machine), columns=[f"f{i}" for i in range(FEATURES)])
            yield x.assign(toxic=pdf.toxic.to_numpy())
        _TABLES.clear()

    schema = ", ".join(f"f{i} double" for i in range(FEATURES)) + ", toxic int"
    rows = sample.mapInPandas(features, schema).toPandas().sort_values([f"f{i}" for i in range(FEATURES)])  # about SAMPLE rows
    return machine, logistic(rows[[f"f{i}" for i in range(FEATURES)]].to_numpy(), rows.toxic.to_numpy().astype(float))


def scores(docs: DataFrame, model) -> DataFrame:
    """(doc_id, tk, score) per document; doc_id with NO_ID for null."""
    machine, weights = model
    keyed = with_key(docs)
    if machine is None:
        return keyed.select("doc_id", "tk", F.lit(weights).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = text_features(pdf.text.tolist(), machine)
            s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "tk": pdf.tk, "score": s})
        _TABLES.clear()  # a worker outlives its task, and its 67 MB would stay through later stages

    return keyed.mapInPandas(run, "doc_id bigint, tk bigint, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per document; learns from rows of ``labels`` that are not held out."""
    out = scores(docs, fit(docs, training_labels(labels)))
    i = real_id("doc_id")
    return out.select(
        i.alias("doc_id"), F.coalesce(held_out(i), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; the classifier learns from ``labelled`` and ``labels``."""
    bad = stable(
        scores(docs, fit(labelled, training_labels(labels))).where(F.col("score") >= THRESHOLD)
        .select(F.col("doc_id").alias("k"), F.col("tk").alias("kt")).distinct()
    )
    d = packed(docs).withColumn("tk", F.xxhash64("_text")).drop("_text")
    return d.join(few(bad), (F.col("doc_id") == F.col("k")) & (F.col("tk") == F.col("kt")), "left_anti").select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
