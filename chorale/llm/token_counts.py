"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of little-endian unsigned 16-bit identifiers in which an end-of-document identifier closes each
document; nothing else says where documents are. The scan cuts files into blocks of fixed size. Each block is searched
for separators with one vectorised comparison and gives the counts between its own separators, what stands before the
first and what stands after the last. Blocks of a file are stitched with a prefix scan over these summaries: the running
number of separators gives the ordinal of a block's first document, the running maximum of separator places gives where
that document began, however many blocks it spans.

`write_token_files` makes such files from documents with a public vocabulary and keeps, apart from them, which document
has which ordinal. Names of files are unique to an attempt of a task and are listed in what Spark commits, so that a
task that runs twice leaves nothing that is read.

Cases: a null or empty text has 0 tokens and is a separator of its own. Text that spells a special token is ordinary text.
Tokens after the last separator of a file are a document that isn't complete. An empty file has no documents. Repeated
rows are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.llm.common import fresh_path, materialize, process_cache, read_table, tidy

END_ID = 50256
BLOCK_BYTES = 4 << 20


def _encoding(ranks: str, pattern: str):
    cache = process_cache()
    key = ("tiktoken", hash(ranks))
    if key not in cache:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines())
        cache[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return cache[key]


_MANIFEST = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])


def _writer(folder: str, held, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(held.value, pattern)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n, size = f"{base}/{uuid.uuid4().hex}.bin", 0, 0
        end = np.array([end_id], "<u2").tobytes()
        with fs.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for text in batch.column("text"):
                    raw = np.array(encoding.encode_ordinary(text.as_py() or ""), "<u2").tobytes() + end
                    out.write(raw)
                    size += len(raw)
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * k, pa.string()), pa.array(np.arange(n, n + k)), batch.column("doc_id"), pa.nulls(k, pa.int64())], schema=_MANIFEST
                )
                n += k
        yield pa.RecordBatch.from_pydict({"file": [name], "ordinal": [None], "doc_id": [None], "bytes": [size]}, schema=_MANIFEST)

    return tidy(run)


def write_token_files(docs: DataFrame, folder: str, ranks_path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(file, bytes) of the files written to `folder`, and (file, ordinal, doc_id) of the documents in them."""
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary; its size doesn't depend on the data
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "file string, ordinal long, doc_id long, bytes long"
    manifest = materialize(rows.mapInArrow(_writer(folder, held, public_tokenizers.PATTERN, end_id), schema), "token-manifest")
    return manifest.filter("bytes is not null").select("file", "bytes"), manifest.filter("bytes is null").select("file", "ordinal", "doc_id")


def scan_block(ids: np.ndarray, end_id: int) -> tuple[int, int, list[int], int]:
    """Separators, tokens before the first (all, if there is none), tokens between neighbours, place of the last or -1."""
    at = np.flatnonzero(ids == end_id)
    if not len(at):
        return 0, len(ids), [], -1
    return len(at), int(at[0]), (np.diff(at) - 1).tolist(), int(at[-1])


_BLOCK = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("ends", pa.int64()), ("head", pa.int64()), ("between", pa.list_(pa.int64())), ("last", pa.int64())]
)


def _scanner(folder: str, end_id: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with fs.open_input_file(name) as f:
                    f.seek(block * block_bytes)
                    raw = f.read(block_bytes)
                start = block * block_bytes // 2
                ends, head, between, last = scan_block(np.frombuffer(raw, "<u2"), end_id)
                row = [name, block, start, len(raw) // 2, ends, head, between, start + last if last >= 0 else None]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

    return tidy(run)


def count_tokens(files: DataFrame, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, complete) of the documents in the files (file, bytes); block_bytes is even."""
    last = F.ceil(F.col("bytes") / block_bytes) - 1
    blocks = files.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file", "block")
    schema = "file string, block long, start long, size long, ends long, head long, between array<long>, last long"
    scanned = materialize(blocks.mapInArrow(_scanner(folder, end_id, block_bytes), schema), "blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = scanned.select(
        "file",
        "block",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("began"),
    )
    whole = scanned.filter("ends > 0").join(stitched, ["file", "block"])
    counts = F.concat(F.array(F.col("start") + F.col("head") - F.col("began")), F.col("between"))
    whole = whole.select("file", "first", F.posexplode(counts).alias("i", "n_tokens"))
    whole = whole.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    rest = scanned.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.sum("size") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    return whole.unionByName(rest.filter("n_tokens > 0").withColumn("complete", F.lit(False)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in the flat files that all documents were written to."""
    folder = fresh_path(spark, "tokens")
    files, placed = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return placed.join(count_tokens(files, folder), ["file", "ordinal"]).select("doc_id", "n_tokens")
