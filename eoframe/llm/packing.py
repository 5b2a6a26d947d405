"""Bounded-space online packing of token sequences.

Each partition tokenises its documents and keeps a fixed number of open windows.
Whole windows of a long document leave at once.  The rest goes where it fits
best; when it fits nowhere and all windows are open, its head fills the fullest
window, which is emitted, and its tail is placed again.  At the end a partition
fills its fullest windows from its emptiest, so less than one window is left
over; leftovers of all partitions are laid end to end and cut at the window
size, and what remains in the end at powers of two.  So no sequence is padded.

Defined results: a null or empty text is its end token alone; rows equal in
doc_id are packed one by one; a null doc_id stays null; empty tables give none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import table, texts
from eoframe.session import stable

WINDOW = 2048
OPEN = 64
END = 1
LEFT = 1 << 62  # sequence ids of merged leftovers start here

PIECE = "has_id boolean, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
COLUMNS = [x.split()[0] for x in PIECE.split(", ")] + ["part", "ids"]

_CODERS: dict[str, object] = {}


def coder(path: str | None = None):
    """The vocabulary of ``byte_bpe_50k`` as ranks; same ids as the JSON file, at several times its speed."""
    import public_tokenizers as vocabularies
    import tiktoken

    path = path or vocabularies.path("byte_bpe_50k.tiktoken")
    if path not in _CODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        _CODERS[path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256}
        )
    return _CODERS[path]


def token_ids(encoding, text: str) -> np.ndarray:
    ids = encoding.encode_to_numpy(text, allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END)).astype("<u4")


class Packer:
    """Open windows of one partition; ``out`` collects pieces of emitted windows."""

    def __init__(self, part: int, window: int = WINDOW, limit: int = OPEN):
        self.part, self.window, self.limit = part, window, limit
        self.open: list[tuple[int, list]] = []  # (tokens used, [(doc, start, ids, doc tokens)])
        self.emitted = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for s in range(0, whole, self.window):
            self._emit([(doc, s, ids[s : s + self.window], len(ids))])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:].copy(), len(ids)))

    def _place(self, piece: tuple) -> None:
        while True:
            doc, start, ids, n = piece
            used = [u for u, _ in self.open]
            fits = [i for i, u in enumerate(used) if u + len(ids) <= self.window]
            if fits:
                best = max(fits, key=used.__getitem__)
                self._put(best, piece)
                return
            if len(self.open) < self.limit:
                self.open.append((len(ids), [piece]))
                return
            full = max(range(len(used)), key=used.__getitem__)
            gap = self.window - used[full]
            self._put(full, (doc, start, ids[:gap], n))
            piece = (doc, start + gap, ids[gap:], n)

    def _put(self, at: int, piece: tuple) -> None:
        used, pieces = self.open[at]
        pieces.append(piece)
        used += len(piece[2])
        if used == self.window:
            del self.open[at]
            self._emit(pieces)
        else:
            self.open[at] = (used, pieces)

    def finish(self) -> list[tuple]:
        """Fill the fullest windows from the emptiest; the pieces of the last open window."""
        self.open.sort(key=lambda w: -w[0])
        while len(self.open) > 1:
            _, pieces = self.open.pop()
            for piece in pieces:
                while piece is not None:
                    if not self.open:
                        self.open.append((0, []))
                    doc, start, ids, n = piece
                    gap = self.window - self.open[0][0]
                    piece = (doc, start + gap, ids[gap:], n) if len(ids) > gap else None
                    self._put(0, (doc, start, ids[:gap], n))
        return self.open[0][1] if self.open else []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.out.append((*doc, start, len(ids), zlib.crc32(ids.tobytes()), n, (self.part << 32) + self.emitted, offset, self.part, None))
            offset += len(ids)
        self.emitted += 1


def _pack(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(TaskContext.get().partitionId())
        encoding = coder(path)
        for pdf in batches:
            for has, doc, text in zip(pdf.has_id.tolist(), pdf.doc_id.tolist(), pdf.text):
                packer.add((has, doc), token_ids(encoding, text))
            yield pd.DataFrame(packer.out, columns=COLUMNS)
            packer.out.clear()
        offset, left = 0, packer.finish()
        for (has, doc), start, ids, n in left:
            packer.out.append((has, doc, start, len(ids), 0, n, 0, offset, packer.part, ids.tobytes()))
            offset += len(ids)
        yield pd.DataFrame(packer.out, columns=COLUMNS)

    return run


def sequence_at(position: int, total: int, window: int = WINDOW) -> tuple[int, int, int]:
    """(number, start, end) of the sequence that holds ``position`` of ``total`` tokens laid end to end."""
    whole = total // window
    number = position // window
    if number < whole:
        return number, number * window, (number + 1) * window
    number = start = whole
    start *= window
    for bit in range(window.bit_length() - 1, -1, -1):
        if (total - whole * window) >> bit & 1:
            if position < start + (1 << bit):
                return number, start, start + (1 << bit)
            start += 1 << bit
            number += 1
    raise ValueError("position lies beyond the tokens")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            ids = np.frombuffer(r.ids, dtype="<u4")
            at, done = r.base + r.offset, 0
            while done < len(ids):
                number, start, end = sequence_at(at + done, r.total)
                n = min(len(ids) - done, end - at - done)
                out.append((r.has_id, r.doc_id, r.start + done, n, zlib.crc32(ids[done : done + n].tobytes()), r.doc_tokens, LEFT + number, at + done - start))
                done += n
        yield pd.DataFrame(out, columns=COLUMNS[:8])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names another vocabulary file of ranks.
    """
    t = texts(docs).select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    placed = stable(t.mapInPandas(_pack(path), PIECE + ", part bigint, ids binary"))
    left = placed.where("ids IS NOT NULL")
    # one row per partition that has a leftover, of a few bytes
    sizes = left.groupBy("part").agg(F.sum("length").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    merged = left.join(bases, F.col("part") == F.col("p")).drop("p").mapInPandas(_merge, PIECE)
    every = placed.where("ids IS NULL").drop("part", "ids").unionByName(merged)
    return every.select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
