"""Exact de-duplication with a sharded cuckoo-filter index of live digests.

Every text is normalised (each run of `[\\x20\\x09-\\x0D]` becomes one space) and summed up on the JVM by a key: SHA-256,
length and a second, independent hash. A cuckoo filter of 16-bit fingerprints answers most look-ups; each of its slots
points at the bucketed content, the whole key, and a hit counts only if all of that is equal. Every input task inserts
its rows into an index of its own, where a hit adds its row to the group found; the entries of these indexes are dealt by
digest and inserted into the shards' indexes, where hits put groups together. So a group that holds a third of all rows
costs one entry a task. A filter that overflows is rebuilt at twice the size from the stored keys; keys that no size
separates are kept beside it.

Cases: a null text counts as empty; empty texts are equal to each other. Rows that repeat a doc_id and a text are counted
one by one in group_size and stand or fall together in `exact_dedup`; `drop_exact_copies` keeps one of them. Rows that share
a doc_id with different texts are judged each by its text. Null ids never win over other ids; of rows without id one stays.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import drop_rows, materialize, read_table, text_key, tidy

SPACES = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """A cuckoo filter over keys of 32 digest bytes and more, whose slots point at stored keys and their values.

    insert() returns the value already stored for the key, or None after storing the new one; delete() removes a live
    key. Memory is about 150 bytes a live key. `hits`, `misses` (fingerprints that the stored key refuted) and `resizes`
    count what happened.
    """

    SLOTS = 4
    KICKS = 200
    #: A filter this much larger than its keys need isn't doubled again: what still has no slot goes to `beside`.
    SPARSE = 16

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.beside: dict[bytes, int] = {}
        self.live = self.resizes = self.hits = self.misses = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros(buckets * self.SLOTS, np.uint16).tolist()
        self.slots = [0] * (buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        # the first bytes of the digest choose the shard, so the filter uses its last ones
        fp = int.from_bytes(key[30:32], "little") or 1
        first = int.from_bytes(key[22:30], "little") & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def _find(self, key: bytes) -> int:
        """The row of a live key, or -1."""
        fp, a, b = self._places(key)
        for bucket in (a, b) if a != b else (a,):
            for at in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[at] == fp:
                    if self.keys[self.slots[at]] == key:
                        return self.slots[at]
                    self.misses += 1
        return self.beside.get(key, -1)

    def _place(self, key: bytes, row: int) -> int:
        """Give the row a slot, moving others on; returns the row that is left without one, or -1."""
        fp, bucket, other = self._places(key)
        for b in (bucket, other):
            for at in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.slots[at] = fp, row
                    return -1
        bucket = other
        for kick in range(self.KICKS):
            at = bucket * self.SLOTS + kick % self.SLOTS
            self.prints[at], fp = fp, self.prints[at]
            self.slots[at], row = row, self.slots[at]
            bucket = self._other(bucket, fp)
            for at in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.slots[at] = fp, row
                    return -1
        return row

    def _resize(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self.resizes += 1
            self._clear(buckets)
            self.beside = {}
            last = buckets * self.SLOTS > self.SPARSE * max(self.live, 64)
            for row, key in enumerate(self.keys):
                if key is not None and (left := self._place(key, row)) >= 0:
                    if not last:
                        break
                    self.beside[self.keys[left]] = left
            else:
                return
            buckets *= 2

    def get(self, key: bytes):
        row = self._find(key)
        return None if row < 0 else self.values[row]

    def put(self, key: bytes, value) -> None:
        """Replace the value of a live key."""
        self.values[self._find(key)] = value

    def insert(self, key: bytes, value):
        row = self._find(key)
        if row >= 0:
            self.hits += 1
            return self.values[row]
        if self.free:
            row = self.free.pop()
            self.keys[row], self.values[row] = key, value
        else:
            row = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        self.live += 1
        if self.live > 0.95 * len(self.prints):
            self._resize()
        elif (left := self._place(key, row)) >= 0:
            if len(self.prints) > self.SPARSE * max(self.live, 64):
                self.beside[self.keys[left]] = left
            else:
                self._resize()
        return None

    def delete(self, key: bytes) -> bool:
        row = self._find(key)
        if row < 0:
            return False
        if self.beside.pop(key, -1) < 0:
            fp, a, b = self._places(key)
            for bucket in (a, b):
                for at in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                    if self.prints[at] == fp and self.slots[at] == row:
                        self.prints[at] = 0
        self.keys[row] = self.values[row] = None
        self.free.append(row)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8; null counts as empty."""
    return F.sha2(normalised(text), 256)


def content_key(text: Column) -> Column:
    """What is bucketed of a normalised text: its SHA-256, its length and a second hash, 48 bytes."""
    wide = lambda x: F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(F.sha2(text, 256), wide(F.octet_length(text)), wide(F.xxhash64(text))))


INDEX_SCHEMA = "digest binary, keep_id long, group_size long"
#: Live digests of a map task's index before its entries are passed on, and rows that a shard of the index is meant for.
TASK_DIGESTS, SHARD_ROWS = 200_000, 500_000


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _join(index: CuckooIndex, digest: bytes, keep, size: int) -> None:
    """Insert a group of rows; a verified hit adds it to the group found."""
    stored = index.insert(digest, (keep, size))
    if stored is not None:
        index.put(digest, (_least(stored[0], keep), stored[1] + size))


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        yield pa.RecordBatch.from_pydict(
            {
                "digest": pa.array([k for k, _ in part], pa.binary()),
                "keep_id": pa.array([v[0] for _, v in part], pa.int64()),
                "group_size": pa.array([v[1] for _, v in part], pa.int64()),
            }
        )


@tidy
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, digest) of a task as groups, by an index of its own."""
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist()):
            _join(index, digest, doc_id, 1)
        if index.live > TASK_DIGESTS:
            yield from _entries(index)
            index = CuckooIndex()
    yield from _entries(index)


@tidy
def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the rows of one shard in order (op 0: stored keys, 1: deletions, 2: insertions) and give its live digests."""
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, size, op in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "op"))):
            if op == 1:
                index.delete(digest)
            else:
                _join(index, digest, keep, size)
    yield from _entries(index)


def _shards(rows: int) -> int:
    return 1 + rows // SHARD_ROWS


def build_index(digests: DataFrame) -> DataFrame:
    """Live digests of (doc_id, digest): keep_id is the smallest id, group_size the number of rows."""
    groups = materialize(digests.select("doc_id", "digest").mapInArrow(_gather, INDEX_SCHEMA), "groups")
    return groups.withColumn("op", F.lit(2)).repartition(_shards(groups.count()), "digest").mapInArrow(_shard, INDEX_SCHEMA)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index after deleting the digests of `deletes` (digest), then inserting `inserts` (doc_id, digest)."""
    added = materialize(inserts.select("doc_id", "digest").mapInArrow(_gather, INDEX_SCHEMA), "groups")
    gone = deletes.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).distinct()
    rows = index.withColumn("op", F.lit(0)).unionByName(gone.withColumn("op", F.lit(1))).unionByName(added.withColumn("op", F.lit(2)))
    return rows.repartition(_shards(index.count() + added.count()), "digest").sortWithinPartitions("op").mapInArrow(_shard, INDEX_SCHEMA)


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, digest, keep_id, group_size of every row.

    Texts are read once; what moves is ids and digests. The index is written out, so that the join that brings its
    decisions back can split a hot digest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), normalised(F.col(text_col)).alias("text"))
    digests = materialize(rows.select("doc_id", "text_key", content_key(F.col("text")).alias("digest")), "digests")
    return digests.join(materialize(build_index(digests), "index"), "digest", "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, id_col, text_col).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with its columns as they came: of those with the smallest doc_id any one."""
    rows = materialize(_decided(docs, "doc_id", "text").filter("group_size > 1"), "decided")
    # of rows that share the id that stays, those with the smallest text_key stay (their texts may differ in blanks)
    stays = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text_key").alias("stay_key"))
    told = rows.join(stays, "digest").groupBy("doc_id", "text_key").agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("stay_key"))).alias("stays"), F.count(F.lit(1)).alias("n")
    )
    told = materialize(told, "told")
    return drop_rows(docs, told.filter("not stays"), told.filter("stays and n > 1"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
