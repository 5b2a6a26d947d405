"""Removal of long repeated byte strings through run-length BWT indexes.

A byte goes when it lies in a ``width``-byte string that also starts anywhere
else, in the same document or another.  Texts are cut into segments: runs of
window starts that share the window's least ``gram``-byte hash (leftmost on
ties).  Equal windows share that anchor and their place around it, so only
segments with the same anchor can hold equal windows.

* Equal segments are counted by digest before anything else; a segment that
  occurs twice is repeated whole, an anchor with one segment is not.
* What is left (segments that share an anchor but differ) is indexed in blocks of
  whole anchor groups.  A block's run-compressed Burrows-Wheeler transform keeps
  suffix positions at run starts and ends only.  Longest common prefixes there
  give, streamed in text order, the matching statistics of every position against
  all other positions: inside a run they fall by one per byte.  Statistics of
  ``width`` or more mark a window.
* An anchor with more than ``GROUP`` different segments is dealt into parts, each
  indexed as a block; the different windows of its parts then meet by digest, so
  no group is ever too large for a block.

Defined results: null texts are empty; texts shorter than ``width`` lose nothing;
rows equal in doc_id and text repeat each other; a null doc_id stays null; empty
tables give none.  Segments are equal when anchor and digest, 128
bits together, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import real_id, stored, table, with_key
from eoframe.session import stable

WIDTH = 200
GRAM = 32
GROUP = 2000  # different segments of an anchor that one block takes, about
BLOCK = 400_000  # bytes of segments after which a block is closed
PIECE = 1 << 19  # bytes hashed at once

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        ups = np.full(n, BASE, dtype=np.uint64)
        downs = np.full(n, INVERSE, dtype=np.uint64)
        ups[0] = downs[0] = 1
        _POWERS[n] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return _POWERS[n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes."""
    n = len(data)
    size = max(PIECE + 2 * WIDTH, 1 << max(0, n - 1).bit_length()) if n > PIECE + 2 * WIDTH else PIECE + 2 * WIDTH
    up, down = _powers(size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours."""
    out, have = h, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def segments(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash): runs of window starts with the same anchor."""
    starts, counts, anchors = [], [], []
    total = len(data) - width + 1
    for at in range(0, max(total, 0), PIECE):
        n = min(PIECE, total - at)
        h = gram_hashes(data[at : at + n + width - 1], gram)
        # the hash's upper bits with the place below them: the least is leftmost on ties
        place = np.arange(len(h), dtype=np.uint64)
        key = (h & ~np.uint64((1 << 20) - 1)) | place
        best = (_least(key, width - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        starts.append(new + at)
        counts.append(np.diff(np.append(new, n)))
        anchors.append(h[best[new]])
    if not starts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors).view(np.int64)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _segment_rows(width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for doc, tk, text in zip(pdf.doc_id.tolist(), pdf.tk.tolist(), pdf.text):
                raw = _bytes(text)
                start, n, anchor = segments(np.frombuffer(raw, dtype=np.uint8), width, gram)
                if len(start):
                    whole = np.array([digest(raw[s:e]) for s, e in zip(start.tolist(), (start + n + width - 1).tolist())], dtype=np.uint64)
                    yield pd.DataFrame({"doc_id": doc, "tk": tk, "start": start, "n": n, "anchor": anchor, "digest": whole.view(np.int64)})

    return run


def _joined(run):
    """Hand on the many small frames of ``run`` as few larger ones."""

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in run(batches):
            held.append(pdf)
            rows += len(pdf)
            if rows >= 20_000:
                yield pd.concat(held)
                held, rows = [], 0
        if held:
            yield pd.concat(held)

    return out


def suffix_order(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of the strings laid end to end in ``text``, sorted; each ends with its own string.

    ``rest`` is the number of bytes from a position to its string's end.  Equal
    suffixes are in order of place, as if every string had a sentinel of its own.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(8, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    span = 6
    for k in range(span):  # six bytes and ends, base 257
        key = key * 257 + np.where(rest > k, padded[k : n + k], 0)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)  # places of ``order`` that are not yet settled
    key = key[order]
    done = rest[order] < 0
    while True:
        # a suffix ranks by the first slot of its group
        new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[order[slots]] = np.repeat(slots[first], size)
        # groups of one, and of suffixes that have ended, are settled
        slots = slots[np.repeat(size > 1, size) & ~done]
        if not len(slots):
            return np.argsort(rank, kind="stable")
        at = order[slots]
        later = np.zeros(len(at), dtype=np.int64)
        inside = rest[at] > span
        later[inside] = rank[at[inside] + span] + 1
        key = rank[at] * (n + 1) + later
        by = np.argsort(key)
        order[slots], key, done = at[by], key[by], later[by] == 0
        span *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with suffix positions at run starts and ends."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(strings), dtype=np.uint8)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.rest = np.repeat(self.first + lengths, lengths) - np.arange(len(self.text))
        order = suffix_order(self.text, self.rest)
        head = np.zeros(len(self.text), dtype=bool)
        head[self.first[lengths > 0]] = True
        # the byte before a suffix; before a string stands a sentinel of its own
        bwt = np.where(head[order], -1 - order, self.text[order - 1].astype(np.int64))
        new = np.concatenate(([True], bwt[1:] != bwt[:-1])) if len(bwt) else np.empty(0, dtype=bool)
        at = np.flatnonzero(new)
        self.run_byte = bwt[at]
        self.run_length = np.diff(np.append(at, len(bwt)))
        tails = at + self.run_length - 1
        # sampled at run starts: the suffix there and the one above it; at run ends: and the one below
        self.starts = order[at[1:]], order[at[1:] - 1]
        self.ends = order[tails[:-1]], order[tails[:-1] + 1]
        self.edges = order[[0, -1]] if len(order) else order

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, up to ``most``."""
        limit = np.minimum(np.minimum(self.rest[a], self.rest[b]), most)
        out = np.zeros(len(a), dtype=np.int64)
        going = np.flatnonzero(limit > 0)
        step = np.arange(16)
        last = len(self.text) - 1
        while len(going):
            off = out[going, None] + step
            same = self.text[np.minimum(a[going, None] + off, last)] == self.text[np.minimum(b[going, None] + off, last)]
            same &= off < limit[going, None]
            run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            out[going] += run
            going = going[run == 16]
        return out

    def matching_statistics(self, most: int) -> np.ndarray:
        """Per position the length, up to ``most``, of its longest match that starts at any other position."""
        n = len(self.text)
        best = np.zeros(n, dtype=np.int64)
        place = np.arange(n)
        # cut at ``most`` only where compared: a value may count from up to one string length before
        far = int(self.rest.max()) if n else 0
        for a, b in (self.starts, self.ends):
            known = np.full(n, -1, dtype=np.int64)
            known[a] = self._common(a, b, far)
            known[self.edges[0] if a is self.starts[0] else self.edges[1]] = 0
            source = np.maximum.accumulate(np.where(known >= 0, place, -1))
            value = np.where(source >= 0, known[source] - (place - source), 0)
            best = np.maximum(best, value)
        return np.minimum(np.maximum(best, 0), most)


def _solve(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, tk, start, end) of the repeated stretches of the segments of one block."""
    index = RunIndex([r[3] for r in rows])
    hit = index.matching_statistics(width) >= width
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    owner = np.searchsorted(index.first, edge[::2], side="right") - 1
    for s, e, o in zip(edge[::2].tolist(), edge[1::2].tolist(), owner.tolist()):
        doc, tk, start, raw = rows[o]
        at = start + s - int(index.first[o])
        out.append((doc, tk, at, at + (e - s) + width - 1))
    return out


FOUND = "doc_id bigint, tk bigint, start bigint, end bigint, d1 bigint, d2 bigint, single boolean"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _windows(rows: list[tuple], width: int) -> pd.DataFrame:
    """A row per different window of one block: its digest, a place, and whether the block has it once."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    counts = np.array([len(r[3]) - width + 1 for r in rows])
    two = np.frombuffer(b"".join([digest(raw[i : i + width]) for _, _, _, raw in rows for i in range(len(raw) - width + 1)]), dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((two[:, 1], two[:, 0]))
    ranked = two[order]
    first = np.flatnonzero(np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1))))
    kept = order[first]
    owner = np.repeat(np.arange(len(rows)), counts)[kept]
    inside = kept - (np.cumsum(counts) - counts)[owner]
    doc, tk, start = (np.array([r[i] for r in rows], dtype=np.int64)[owner] for i in range(3))
    at = start + inside
    single = np.diff(np.append(first, len(ranked))) == 1
    return pd.DataFrame({"doc_id": doc, "tk": tk, "start": at, "end": at + width, "d1": two[kept, 0], "d2": two[kept, 1], "single": single})


def _blocks(width: int):
    """Rows come sorted by anchor and part; blocks are closed between parts and give stretches (null digests).

    A part of a larger anchor group (``parts`` above one) is a block of its own and
    also gives its different windows with digests, which meet those of other parts.
    """

    def stretches(rows: list[tuple], split: bool) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*x, None, None, None) for x in _solve(rows, width)], columns=_NAMES)
        if rows and split:
            yield _windows(rows, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, last = [], 0, (None, 0, False)
        for pdf in batches:
            for anchor, part, parts, doc, tk, start, raw in zip(
                pdf.anchor.tolist(), pdf.part.tolist(), pdf.parts.tolist(), pdf.doc_id.tolist(), pdf.tk.tolist(), pdf.start.tolist(), pdf.raw
            ):
                here = anchor, part, parts > 1
                if here != last and (size >= BLOCK or here[2] or last[2]):
                    yield from stretches(rows, last[2])
                    rows, size = [], 0
                raw = bytes(raw)
                rows.append((doc, tk, start, raw))
                size += len(raw)
                last = here
        yield from stretches(rows, last[2])

    return run


def _cut_out(width: int):
    """Bytes of the wanted segments of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, tk, text, wanted in zip(pdf.doc_id.tolist(), pdf.tk.tolist(), pdf.text, pdf.wanted):
                raw = _bytes(text)
                yield pd.DataFrame(
                    [(w["anchor"], w["parts"], doc, tk, w["start"], raw[w["start"] : w["start"] + w["n"] + width - 1]) for w in wanted],
                    columns=["anchor", "parts", "doc_id", "tk", "start", "raw"],
                )

    return run


KEY = ["doc_id", "tk"]
SEGMENT = "doc_id bigint, tk bigint, start bigint, n bigint, anchor bigint, digest bigint"


def repeated_stretches(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tk, start, end): byte stretches of ``keyed`` (doc_id, tk, text) covered by repeated strings; they may overlap."""
    rows, remove = stored(keyed.mapInPandas(_joined(_segment_rows(width, gram)), SEGMENT))
    end = (F.col("start") + F.col("n") + (width - 1)).alias("end")
    # most anchors occur once: only the others go on
    anchors = stable(
        rows.groupBy(F.col("anchor").alias("ka"))
        .agg(F.count("*").alias("c"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        .where("c > 1").select("ka", F.expr("least <> most").alias("mixed"))
    )
    again, _ = stored(rows.join(anchors, F.col("anchor") == F.col("ka")).drop("ka"))
    remove()
    # one row per different segment of a mixed anchor; any of its places stands for it
    mixed = again.where("mixed")
    kinds, _ = stored(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (*KEY, "start", "n")]))
    often = kinds.where("copies > 1").select(F.col("anchor").alias("ka"), F.col("digest").alias("kd"))
    whole = again.where("NOT mixed").select(*KEY, "start", end).unionByName(
        mixed.join(often, (F.col("anchor") == F.col("ka")) & (F.col("digest") == F.col("kd"))).select(*KEY, "start", end)
    )
    per_anchor = kinds.groupBy(F.col("anchor").alias("ka")).agg(F.count("*").alias("kinds"), F.min("copies").alias("least"))
    # a larger group is dealt into parts of about GROUP segments
    open_ = stable(per_anchor.where("least = 1").select("ka", F.ceil(F.col("kinds") / GROUP).cast("int").alias("parts")))
    unsure = kinds.join(open_, F.col("anchor") == F.col("ka"))
    # segments of one document, as many as its length allows
    lists = unsure.groupBy(*[F.col(c).alias(f"w_{c}") for c in KEY]).agg(F.collect_list(F.struct("anchor", "parts", "start", "n")).alias("wanted"))
    with_text = keyed.join(lists, (F.col("doc_id") == F.col("w_doc_id")) & (F.col("tk") == F.col("w_tk"))).select(*KEY, "text", "wanted")
    raw = with_text.mapInPandas(_joined(_cut_out(width)), "anchor bigint, parts int, doc_id bigint, tk bigint, start bigint, raw binary")
    raw = raw.withColumn("part", F.pmod(F.xxhash64(*KEY, "start"), "parts"))
    found = stable(
        raw.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInPandas(_joined(_blocks(width)), FOUND)
    )
    # of a window only one place per part goes on, so one that most segments hold is no large group
    windows = found.where("d1 IS NOT NULL")
    twice = windows.groupBy(F.col("d1").alias("k1"), F.col("d2").alias("k2")).agg(F.count("*").alias("c")).where("c > 1")
    single = windows.where("single").join(twice, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select(*KEY, "start", "end")
    return whole.unionByName(found.where("d1 IS NULL").select(*KEY, "start", "end")).unionByName(single)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, tk, text, runs in zip(pdf.doc_id.tolist(), pdf.tk.tolist(), pdf.text, pdf.runs):
            raw = _bytes(text)
            kept, at, spans = [], 0, 0
            if runs is not None:
                end = -1
                for s, e in sorted((r["start"], r["end"]) for r in runs):
                    if s > end:
                        spans += 1
                        kept.append(raw[at:s])
                    end = at = max(end, e)
            kept.append(raw[max(at, 0):])
            left = b"".join(kept)
            out.append((doc, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    keyed = with_key(docs)
    runs = (
        repeated_stretches(keyed, width)
        .groupBy(*[F.col(c).alias(f"r_{c}") for c in KEY]).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    )
    both = keyed.join(runs, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("tk") == F.col("r_tk")), "left").select(*KEY, "text", "runs")
    out = both.mapInPandas(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", real_id("doc_id"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
