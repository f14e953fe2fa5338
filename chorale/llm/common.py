"""Session, storage and text-scanning helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import chorale

# Functions of this package travel inside the task, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(chorale)

CHUNK_BYTES = 1 << 20


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process, whatever way the calling function was shipped."""
    return sys.modules.setdefault("_chorale_process_cache", types.ModuleType("_chorale_process_cache")).__dict__


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a qualified path: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster executors could not read what
    others wrote there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "chorale-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(hadoop_path).toString().rstrip("/")
    # Hadoop writes file:/x where pyarrow wants file:///x
    return re.sub(r"^file:/(?!/)", "file:///", path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/chorale/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids or row keys that a join may broadcast, after they were counted: at 16 bytes each some 32 MB on an executor.
BROADCAST_IDS = 1 << 20


def counted(ids: DataFrame, name: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids or row keys (long columns) that joins broadcast if it has at most `limit` rows, and shuffle beyond."""
    ids = materialize(ids, name)
    return F.broadcast(ids) if ids.count() <= limit else ids


def text_key(text: Column) -> Column:
    """A 64-bit key of a text (null: empty), which tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def drop_rows(docs: DataFrame, gone: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` whose (doc_id, text_key) isn't in `gone`, with their columns as they came.

    Of rows that share a (doc_id, text_key) of `single` one stays, any one: their other columns don't count. Ids are
    compared null-safe. Both tables are distinct row keys; texts move for the repeated rows only.
    """
    i, k = fresh_names(docs, "row_id", "row_key")
    gi, gk = fresh_names(docs, "gone_id", "gone_key")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), k: text_key(F.col("text"))})
    same = F.col(i).eqNullSafe(F.col(gi)) & (F.col(k) == F.col(gk))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def keys(rows: DataFrame, name: str) -> DataFrame:
        return counted(rows.select(F.col("doc_id").alias(gi), F.col("text_key").alias(gk)), name)

    if single is not None:
        single = keys(single, "single")
        if single.isEmpty():
            single = None
    if single is None:
        return keyed.join(keys(gone, "gone"), same, "left_anti").select(*own)
    rows = keyed.join(keys(gone, "gone"), same, "left_anti")
    once = rows.join(single, same, "left_semi").dropDuplicates([i, k])
    return rows.join(single, same, "left_anti").unionByName(once).select(*own)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised scanning of UTF-8 text -------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`: every byte but these six ends up inside a word; bytes of multi-byte characters are >= 0x80.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offset of each, without a copy per text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first row, row after the last, bytes, offsets within them."""
    data, offsets = text_buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def scan_words(low: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in lower-cased bytes, and per text the index of its first word (and the total)."""
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[low]
    edge = offsets[:-1][offsets[:-1] < len(low)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, then mixed with its length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    powers = np.full(int(lens.max()), STEP, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    codes = BYTE_CODE[low[pos + np.repeat(starts, lens)]]
    codes *= powers[pos]
    return mix64(np.add.reduceat(codes, first) + lens.astype(np.uint64))


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n consecutive word hashes; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m] + np.uint64(n)
    for i in range(1, n):
        out = out * STEP + words[i : i + m]
    return mix64(out)
