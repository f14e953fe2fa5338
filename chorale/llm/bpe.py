"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Encoding gives the ids that the tokenizers library gives for a byte-level BPE file with add_special_tokens=False: the
strings of added tokens in a text become their ids, the rest is split by the usual pattern, and each distinct piece is
merged once. The symbols of many pieces lie in one flat array. A round looks up every neighbouring pair by binary search
among the sorted pair keys, takes the lowest rank of each piece with one segmented minimum, and merges that pair wherever
it stands in the piece, from left to right without overlap. Pieces without a pair left leave the array. A piece of more than
LONG_PIECE bytes is worked on by itself: its rounds go by rank and look only at the pairs beside the merges before, so that
time grows little more than its length.

A process keeps a dictionary of pieces, cleared when it exceeds CACHE_PIECES; that changes speed only.

Cases: a null text counts as empty; an empty text has no ids and decodes to an empty text. Bytes that are not UTF-8
after decoding become U+FFFD, as in the library. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import process_cache, read_table, tidy

#: The pattern of byte-level BPE (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 200_000
LONG_PIECE = 512
NONE = np.int64(2**62)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the usual rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """One vocabulary in memory, from the JSON text of its file."""

    def __init__(self, source: str, specials: bool = True):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = np.zeros(256, np.int64)
        for char, b in alphabet.items():
            self.byte_ids[b] = vocab[char]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), new[order]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        for t in spec["added_tokens"]:
            tokens[t["id"]] = t["content"].encode()
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.pieces = regex.compile(PIECES)
        added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]} if specials else {}
        self.added = added
        self.split = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NONE: no pair) and its place among the keys."""
        keys = (left << 32) | right
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[slot] == keys, self.ranks[slot], NONE), slot

    def merge_long(self, piece: bytes) -> bytes:
        """The ids of one piece, as of `merge`."""
        symbols = np.append(self.byte_ids[np.frombuffer(piece, np.uint8)], 0)
        n = len(piece)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, slot = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
        at: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        fresh = np.arange(n - 1)
        while True:
            if len(fresh):
                rank[fresh], slot[fresh] = self._look_up(symbols[fresh], symbols[after[fresh]])
                fresh = fresh[rank[fresh] < NONE]
                fresh = fresh[np.argsort(rank[fresh], kind="stable")]
                edges = np.flatnonzero(np.diff(rank[fresh], prepend=-1)).tolist()
                for a, b in zip(edges, [*edges[1:], len(fresh)]):
                    r = int(rank[fresh[a]])
                    if r not in at:
                        at[r] = []
                        heapq.heappush(ranks, r)
                    at[r].append(fresh[a:b])
            if not ranks:
                break
            r = heapq.heappop(ranks)
            places = np.concatenate(at.pop(r))
            places = np.unique(places[rank[places] == r])
            if len(places) > 1 and (chained := after[places[:-1]] == places[1:]).any():
                # of overlapping places every second one merges
                index = np.arange(len(places))
                start = np.maximum.accumulate(np.where(np.append(True, ~chained), index, 0))
                places = places[(index - start) % 2 == 0]
            gone = after[places]
            symbols[places] = self.merged[slot[places]]
            after[places], rank[gone] = after[gone], NONE
            before[after[places]] = places
            fresh = np.unique(np.concatenate([places, before[places]]))
            fresh = fresh[fresh >= 0]
            rank[fresh] = NONE
            fresh = fresh[after[fresh] < n]
        keep = np.zeros(n, bool)
        place = 0
        steps = after.tolist()
        while place < n:
            keep[place] = True
            place = steps[place]
        return symbols[:n][keep].astype("<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Per piece its ids as little-endian unsigned 32-bit integers."""
        if any(len(p) > LONG_PIECE for p in pieces):
            short = iter(self.merge([p for p in pieces if len(p) <= LONG_PIECE]))
            return [next(short) if len(p) <= LONG_PIECE else self.merge_long(p) for p in pieces]
        if not pieces:
            return []
        count = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), count)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank, slot = self._look_up(symbols[:-1], symbols[1:])
            rank = np.where(owner[:-1] == owner[1:], rank, NONE)
            rank, slot = np.append(rank, NONE), np.append(slot, 0)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            runs = np.diff(np.append(first, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, first), runs)
            open_ = least != NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
            at = (rank == least) & open_
            if at[1:].any():
                # in a run of overlapping places every second one merges
                index = np.arange(len(at))
                begins = at & ~np.append(False, at[:-1])
                start = np.maximum.accumulate(np.where(begins, index, 0))
                at &= (index - start) % 2 == 0
            symbols = np.where(at, self.merged[slot], symbols)
            keep = open_ & ~np.append(False, at[:-1])
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        raw = symbols[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            if self.split is not None and self.split.search(text):
                parts = self.split.split(text)
                split.append([p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pieces.findall(part))])
            else:
                split.append(self.pieces.findall(text))
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        known = self.known
        known.update(self.added)
        new = list({p for pieces in split for p in pieces if p not in known})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, self.merge([p.encode() for p in part])))
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lengths = self.lengths[flat]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.blob[np.repeat(self.places[flat] - (ends - lengths), lengths) + np.arange(total)].tobytes()
        bounds = np.append(0, ends)[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def model_of(held, specials: bool = True) -> ByteBPE:
    """The model of a broadcast vocabulary, built once in a process."""
    cache = process_cache()
    key = ("bpe", hash(held.value), specials)
    if key not in cache:
        cache[key] = ByteBPE(held.value, specials)
    return cache[key]


def _runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, one row at least, so that few texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, last
        first = last


def encoder(held, specials: bool = True):
    """mapInArrow function: replaces column `text` by `ids`, keeping the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(held, specials)
        for batch in batches:
            rest, column = batch.drop_columns(["text"]), batch.column("text")
            for a, b in _runs(column):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                yield rest.slice(a, b - a).append_column("ids", pa.array(model.encode_batch(texts), pa.binary()))

    return tidy(run)


def decoder(held):
    """mapInArrow function: replaces column `ids` by `decoded`, keeping the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(held)
        for batch in batches:
            rest, column = batch.drop_columns(["ids"]), batch.column("ids")
            for a, b in _runs(column):
                ids = [i or b"" for i in column.slice(a, b - a).to_pylist()]
                yield rest.slice(a, b - a).append_column("decoded", pa.array(model.decode_batch(ids), pa.string()))

    return tidy(run)


def coder(held):
    """mapInArrow function: replaces column `text` by `ids` and by `decoded`, what the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(held)
        for batch in batches:
            rest, column = batch.drop_columns(["text"]), batch.column("text")
            for a, b in _runs(column):
                ids = model.encode_batch([t or "" for t in column.slice(a, b - a).to_pylist()])
                out = rest.slice(a, b - a).append_column("ids", pa.array(ids, pa.binary()))
                yield out.append_column("decoded", pa.array(model.decode_batch(ids), pa.string()))

    return tidy(run)


def hold_vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast the file of a vocabulary (about 1.5 MB; its size doesn't depend on the data)."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, specials: bool = True) -> DataFrame:
    """(doc_id, ids): ids as a binary of little-endian unsigned 32-bit integers."""
    held = hold_vocabulary(docs.sparkSession, path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoder(held, specials), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Replace column ids of `encoded` by the text they stand for, in column decoded."""
    held = hold_vocabulary(encoded.sparkSession, path)
    rest = [f for f in encoded.schema if f.name != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "decoded string"])
    return encoded.select(*(f.name for f in rest), "ids").mapInArrow(decoder(held), schema)


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, through the ids and back in one Python process a task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = rows.mapInArrow(coder(hold_vocabulary(docs.sparkSession, path)), "doc_id long, ids binary, decoded string")
    n = F.expr("octet_length(ids) div 4").cast("long")
    return both.select("doc_id", n.alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
