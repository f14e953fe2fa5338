"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is eight consecutive words of an item, or a shorter item as a whole. The set of a window is its word shingles
(three words, or all of a shorter window); shingles are ordered by rarity, that is by how often they occur in all
documents. For exact containment a window has to share its one rarest shingle, the necessary prefix, with a document.
A document position that carries such a prefix shingle gives a candidate: the window would start so many words before
it. Positional and length bounds (start within the document, end within the document) reject some; the rest is verified
word by word. Every word of a verified window is hit.

There are two plans with the same result. A benchmark of at most INDEX_BYTES of text is broadcast as plain arrays (some 25
bytes a byte of text) and joined in place. A larger one stays in tables: documents are scanned once for the counts and once
for candidates, both behind a bitmap of the shingles asked for (MAP_BITS bits, whatever the benchmark's size), and
candidates, which carry the words around them, are shuffled to the prefix shingles. Nothing about documents is collected
but counts of a broadcast benchmark's shingles.

Cases: null, empty and wordless texts have no words. Items without words have no windows. Rows of the benchmark without
item_id are left out; rows that share an item_id are one item. Repeated document rows give repeated rows, and rows that
share a doc_id are judged each by its text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import (
    ALNUM_WORDS,
    LOWER,
    drop_rows,
    materialize,
    read_table,
    scan_words,
    sequence_hash,
    text_chunks,
    text_key,
    tidy,
    word_hashes,
)

WINDOW, SHINGLE = 8, 3
#: Benchmark text that is broadcast at most, in bytes, and bits of the bitmap that stands for a larger one.
INDEX_BYTES, MAP_BITS = 1 << 20, 1 << 26


def scan(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunk by chunk: lower-cased bytes, starts and ends of words, the first word of each text (and the total), word hashes."""
    for _, _, data, offsets in text_chunks(texts):
        low = LOWER[data]
        starts, ends, first = scan_words(low, offsets, ALNUM_WORDS)
        yield low, starts, ends, first, word_hashes(low, starts, ends)


# --- windows of the benchmark ----------------------------------------------------------------------------------------


@tidy
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items: item_id, their words joined by blanks, their number, and the key of each shingle in order."""
    for batch in batches:
        item = 0
        for low, starts, ends, first, hashes in scan(batch.column("text")):
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            by_width = {w: sequence_hash(hashes, w).view(np.int64).tolist() for w in range(1, SHINGLE + 1)}
            rows = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                n = min(b - a, WINDOW)
                width = min(n, SHINGLE)
                for at in range(a, b - n + 1) if n else ():
                    rows.append((batch.column("item_id")[item].as_py(), b" ".join(words[at : at + n]), n, by_width[width][at : at + n - width + 1]))
                item += 1
            types = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["item_id", "words", "n", "keys"])


# --- a broadcast index -----------------------------------------------------------------------------------------------


def _csr(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *map(len, groups)]), np.array([x for g in groups for x in g], np.int64)


def index_of(windows: pa.Table) -> dict:
    """Plain arrays of the distinct windows: words, lengths, items, and all their shingle keys."""
    items = sorted(set(windows.column("item_id").to_pylist()))
    number = {x: k for k, x in enumerate(items)}
    owners: dict[bytes, set[int]] = {}
    keys: dict[bytes, list[int]] = {}
    for item, words, own in zip(*(windows.column(c).to_pylist() for c in ("item_id", "words", "keys"))):
        owners.setdefault(words, set()).add(number[item])
        keys[words] = own
    texts = sorted(owners)
    of, owner = _csr([sorted(owners[t]) for t in texts])
    entry, key = _csr([keys[t] for t in texts])
    lengths = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    return {
        "items": items, "blob": b"".join(texts), "at": np.cumsum([0, *map(len, texts)]), "n": lengths,
        "of": of, "owner": owner, "entry": entry, "keys": key.view(np.uint64),
        "vocabulary": np.unique(key.view(np.uint64)), "widths": sorted({min(int(n), SHINGLE) for n in np.unique(lengths)}),
    }


def order_by_rarity(index: dict, counts: np.ndarray) -> dict:
    """The index with the rarest shingle of each window that can occur: keys in order, the windows and places of each."""
    slot = np.searchsorted(index["vocabulary"], index["keys"])
    window = np.repeat(np.arange(len(index["n"])), np.diff(index["entry"]))
    place = np.arange(len(slot)) - index["entry"][window]
    order = np.lexsort((place, index["keys"], counts[slot], window))
    rarest = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
    rarest = rarest[counts[slot[rarest]] > 0]
    rarest = rarest[np.argsort(index["keys"][rarest], kind="stable")]
    keys, first = np.unique(index["keys"][rarest], return_index=True)
    held = {k: index[k] for k in ("items", "blob", "at", "n", "of", "owner", "widths")}
    return held | {"prefix": keys, "first": np.append(first, len(rarest)), "window": window[rarest], "place": place[rarest]}


def _member(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are in the sorted keys, and which key each is."""
    if not len(keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[keys & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(seen[values & np.uint64(0xFFFF)])
    slot = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    good = keys[slot] == values[at]
    return at[good], slot[good]


def _inside(at: np.ndarray, width: int, first: np.ndarray) -> np.ndarray:
    """Whether the shingles at these words lie within one text."""
    return first[np.searchsorted(first, at, side="right")] >= at + width


def _counter(held):
    """Occurrences of the vocabulary in the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, widths = held.value
        counts = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, _, first, hashes in scan(batch.column("text")):
                for width in widths:
                    at, slot = _member(sequence_hash(hashes, width), keys)
                    counts += np.bincount(slot[_inside(at, width, first)], minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "n": pa.array(counts[some])})

    return tidy(run)


def _finish(spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, str]:
    hit = end = 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


FOUND = "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string"


def _finder(held):
    """The result of each document under a broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for low, starts, ends, first, hashes in scan(batch.column("text")):
                base = len(n_words)
                n_words += np.diff(first).tolist()
                spans += [[] for _ in range(len(first) - 1)]
                items += [set() for _ in range(len(first) - 1)]
                for width in ix["widths"]:
                    at, slot = _member(sequence_hash(hashes, width), ix["prefix"])
                    if not len(at):
                        continue
                    many = ix["first"][slot + 1] - ix["first"][slot]
                    rows = np.repeat(ix["first"][slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    begin, which = np.repeat(at, many) - ix["place"][rows], ix["window"][rows]
                    doc = np.searchsorted(first, np.repeat(at, many), side="right") - 1
                    good = (begin >= first[doc]) & (begin + ix["n"][which] <= first[doc + 1])
                    for b, w, d in zip(begin[good].tolist(), which[good].tolist(), doc[good].tolist()):
                        n = int(ix["n"][w])
                        if b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(b, b + n)) == ix["blob"][ix["at"][w] : ix["at"][w + 1]]:
                            spans[base + d].append((b - int(first[d]), b - int(first[d]) + n))
                            items[base + d].update(ix["items"][o] for o in ix["owner"][ix["of"][w] : ix["of"][w + 1]].tolist())
            done = [_finish(*x) for x in zip(spans, items)]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), *columns],
                names=["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    return tidy(run)


def _broadcast_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    index = index_of(windows.toArrow())
    vocabulary = sc.broadcast((index["vocabulary"], index["widths"]))
    counted = rows.select("text").mapInArrow(_counter(vocabulary), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(index["vocabulary"]), np.int64)
    for r in counted.collect():
        counts[r.slot] = r.n
    return rows.mapInArrow(_finder(sc.broadcast(order_by_rarity(index, counts))), FOUND)


# --- a benchmark in tables -------------------------------------------------------------------------------------------


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of keys in the bitmap."""
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys % np.uint64(MAP_BITS)).astype(np.int64))], names=["bit"])


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of a column of keys, MAP_BITS / 8 bytes."""
    held = np.zeros(MAP_BITS, bool)
    held[keys.select("key").mapInArrow(tidy(_bits), "bit long").distinct().toArrow().column("bit").to_numpy()] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(held))


def _asked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (hashes % np.uint64(MAP_BITS)).astype(np.int64)
    return np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)


def _shingle_counter(held):
    """Counts of the shingles behind the bitmap, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, first, hashes in scan(batch.column("text")):
                for width in range(1, SHINGLE + 1):
                    keys = sequence_hash(hashes, width)
                    at = _asked(keys, held.value)
                    found, n = np.unique(keys[at[_inside(at, width, first)]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return tidy(run)


CANDIDATES = "doc_id long, text_key long, n_words long, key long, pos long, lead int, near binary"


def _candidates(held):
    """A row for each document (key null) and for each of its words that a prefix shingle may begin at, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = 0
            for low, starts, ends, first, hashes in scan(batch.column("text")):
                k = len(first) - 1
                own = [batch.column(c).slice(doc, k) for c in ("doc_id", "text_key")]
                n_words = np.diff(first)
                none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                names = [c.split()[0] for c in CANDIDATES.split(", ")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), *none], names=names)
                for width in range(1, SHINGLE + 1):
                    keys = sequence_hash(hashes, width)
                    at = _asked(keys, held.value)
                    at = at[_inside(at, width, first)]
                    d = np.searchsorted(first, at, side="right") - 1
                    begin, end = np.maximum(first[d], at - WINDOW + 1), np.minimum(first[d + 1], at + WINDOW)
                    near = [b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(x, y)) for x, y in zip(begin.tolist(), end.tolist())]
                    columns = [pa.array(keys[at].view(np.int64)), pa.array(at - first[d]), pa.array((at - begin).astype(np.int32)), pa.array(near, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(d)) for c in own), pa.array(n_words[d]), *columns], names=names)
                doc += k

    return tidy(run)


def _table_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    windows = materialize(windows, "windows")
    distinct = materialize(windows.groupBy("words", "n").agg(F.first("keys").alias("keys")), "distinct-windows")
    shingles = distinct.select("words", "n", F.posexplode("keys").alias("place", "key"))
    vocabulary = materialize(shingles.select("key").distinct(), "vocabulary")
    counts = rows.select("text").mapInArrow(_shingle_counter(_bitmap(vocabulary)), "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))
    rarest = shingles.join(materialize(counts, "shingle-counts"), "key").groupBy("words", "n").agg(F.min(F.struct("df", "key", "place")).alias("r"))
    # (a window with a shingle that no document has can't occur)
    rarest = rarest.join(distinct.select("words", F.size("keys").alias("size")), "words")
    known = shingles.join(counts, "key", "left_semi").groupBy("words").agg(F.count(F.lit(1)).alias("known"))
    prefix = materialize(rarest.join(known, "words").filter("known = size").select("words", "n", "r.key", "r.place"), "prefix")
    found = materialize(rows.mapInArrow(_candidates(_bitmap(prefix)), CANDIDATES), "candidates")
    docs = found.filter("key is null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    near = F.split(F.col("near").cast("string"), " ")
    own = F.array_join(F.slice(near, F.col("lead") - F.col("place") + 1, F.col("n")), " ").cast("binary")
    spans = found.filter("key is not null").drop("n_words").distinct().join(prefix, "key")
    spans = spans.filter((F.col("place") <= F.col("lead")) & (F.col("lead") - F.col("place") + F.col("n") <= F.size(near))).filter(own == F.col("words"))
    spans = materialize(spans.select("doc_id", "text_key", "words", (F.col("pos") - F.col("place")).alias("a"), "n"), "spans")
    hit = spans.select("doc_id", "text_key", F.explode(F.sequence("a", F.col("a") + F.col("n") - 1)).alias("w")).distinct()
    hit = hit.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.select("doc_id", "text_key", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    items = items.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = docs
    for i, part in enumerate((hit, items)):
        part = part.select(F.col("doc_id").alias(f"d{i}"), F.col("text_key").alias(f"k{i}"), part.columns[2])
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col(f"d{i}")) & (F.col("text_key") == F.col(f"k{i}")), "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("items", F.coalesce("items", none)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    n = [F.col("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items")]
    return out.select("doc_id", "text_key", *n, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items), text_key."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0)).alias("b")).first().b
    windows = items.mapInArrow(_windows, "item_id string, words binary, n int, keys array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    join = _broadcast_join if size <= index_bytes else _table_join
    out = join(rows, windows).withColumn("contaminated", F.col("n_items") >= min_items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_hit: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a passage of the benchmark, with their columns as they came.

    A passage is at least one window of one item with min_hit words hit in all, so that a single item of a few words,
    which prose may hold by chance, drops nothing.
    """
    found = contamination(docs, benchmark, min_items=1)
    return drop_rows(docs, found.filter(F.col("contaminated") & (F.col("n_hit") >= min_hit)).select("doc_id", "text_key").distinct())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
