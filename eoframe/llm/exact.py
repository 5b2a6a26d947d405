"""Exact dedup: shards of live digests behind cuckoo filters.

A digest is the SHA-256 of the normalised text.  Rows meet in shards by digest
and a salt of the doc_id, so the copies of one text spread over many tasks.  In
a shard a cuckoo filter answers whether a digest may be live; a hit is verified
against the keys stored in the bucket.  When a row with a larger doc_id comes,
the live entry is deleted and the new one inserted.  A filter that overflows is
built anew, twice as large, from the stored keys.  One row per digest and salt
leaves a shard; these few rows settle the group.

Defined results: a null text counts as empty; a null doc_id comes before every
other; among rows equal in doc_id and text one stays; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import NO_ID, ascii_lower, kept_rows, packed, real_id, table, texts
from eoframe.session import stable

SALTS = 32
SLOTS = 4
KICKS = 200


class LiveIndex:
    """Digests (32 bytes) with a value, behind a cuckoo filter of 16-bit marks.

    ``keys`` are the stored keys per bucket: a filter hit is only believed when
    the whole digest stands in one of the two buckets it names.
    """

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self.resized = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.keys: list[list] = [[None] * SLOTS for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        word = xxhash.xxh64_intdigest(digest)  # of all bytes: keys of one digest and many salts must spread
        mark = (word >> 48) or 1
        first = word & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        mark, *places = self._places(digest)
        for b in places:
            for s in range(SLOTS):
                if self.marks[b, s] == mark and self.keys[b][s][0] == digest:
                    return b, s
        return None

    def get(self, digest: bytes):
        at = self._find(digest)
        return None if at is None else self.keys[at[0]][at[1]][1]

    def delete(self, digest: bytes) -> bool:
        at = self._find(digest)
        if at is None:
            return False
        self.marks[at] = 0
        self.keys[at[0]][at[1]] = None
        self.size -= 1
        return True

    def insert(self, digest: bytes, value) -> None:
        """Insert a digest that is not live."""
        entry = (digest, value)
        while (entry := self._place(entry)) is not None:
            self._grow()
        self.size += 1

    def _place(self, entry):
        """None when placed, else the entry left over."""
        mark, a, b = self._places(entry[0])
        for at in (a, b):
            for s in range(SLOTS):
                if not self.marks[at, s]:
                    self.marks[at, s], self.keys[at][s] = mark, entry
                    return None
        at = a
        for k in range(KICKS):
            s = k % SLOTS
            out = self.keys[at][s]
            old = int(self.marks[at, s])
            self.marks[at, s], self.keys[at][s] = mark, entry
            entry, mark, at = out, old, self._other(at, old)
            for s in range(SLOTS):
                if not self.marks[at, s]:
                    self.marks[at, s], self.keys[at][s] = mark, entry
                    return None
        return entry

    def _grow(self) -> None:
        stored = list(self.items())
        size = self.buckets * 2
        while True:
            self._clear(size)
            self.resized += 1
            if all(self._place(e) is None for e in stored):
                return
            size *= 2

    def items(self) -> Iterator[tuple]:
        for row in self.keys:
            for e in row:
                if e is not None:
                    yield e


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    live = LiveIndex()
    for pdf in batches:
        for digest, salt, doc, n in zip(pdf.digest, pdf.salt.tolist(), pdf.doc_id.tolist(), pdf.n.tolist()):
            digest = bytes(digest)
            old = live.get(digest)
            if old is None:
                live.insert(digest, (salt, doc, n))
            elif doc > old[1]:
                live.delete(digest)
                live.insert(digest, (salt, doc, old[2] + n))
            else:
                old = (old[0], old[1], old[2] + n)
                live.delete(digest)
                live.insert(digest, old)
    rows = [(d, *v) for d, v in live.items()]
    for i in range(0, len(rows), 20_000):
        yield pd.DataFrame(rows[i : i + 20_000], columns=["digest", "salt", "keep", "n"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n): rows of ``docs`` with the same text and doc_id are counted."""
    t = texts(docs)
    return t.select(
        F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")
    ).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))


def groups(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n, keep, size): a row per different (text, doc_id), with the group's kept id and rows."""
    rows = stable(digest_rows(docs)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # a salt is part of the key here, so no digest of one shard meets the same digest of another salt
    placed = rows.withColumn("digest", F.concat("digest", F.unhex(F.lpad(F.hex("salt"), 2, "0"))))
    some = stable(
        placed.repartition("digest").mapInPandas(_shard, "digest binary, salt int, keep bigint, n bigint")
        .withColumn("digest", F.substring("digest", 1, 32))
    )
    whole = some.groupBy(F.col("digest").alias("d")).agg(F.max("keep").alias("keep_id"), F.sum("n").alias("size"))
    back = some.join(whole, F.col("digest") == F.col("d")).select(
        F.col("digest").alias("bd"), F.col("salt").alias("bs"), "keep_id", "size"
    )
    return rows.join(back, (F.col("digest") == F.col("bd")) & (F.col("salt") == F.col("bs"))).select(
        "digest", "doc_id", "n", F.col("keep_id").alias("keep"), "size"
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    g = groups(docs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return g.select(
        real_id("doc_id").alias("doc_id"),
        real_id("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("doc_id") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest doc_id."""
    g = groups(docs)
    d = packed(docs).withColumn("digest", F.unhex(F.sha2(ascii_lower(F.col("_text")), 256))).drop("_text")
    return kept_rows(d, g.where("doc_id <> keep").select("digest", "doc_id"), g.where("doc_id = keep AND n > 1").select("digest", "doc_id"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
