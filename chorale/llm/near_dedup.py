"""Near-duplicate detection: b-bit MinHash signatures, a multi-index Hamming join, confirmation on full shingle sets.

A signature has 64 lanes of 16 bits. Lanes of a pair with Jaccard similarity s differ with probability 1 - s, so at the
threshold of 0.75 a pair differs in 16 of 64 lanes on average (standard deviation 3.5). The join finds every pair that
differs in at most 29 lanes: the lanes are split into 15 chunks, and by the pigeonhole principle one chunk of such a
pair has at most 29 // 15 = 1 error. Enumerating the allowed error means leaving out each lane of a chunk in turn, which
gives 64 keys a text; two texts within the distance share one of them at least. A pair at the threshold lies beyond the
distance once in about 8,000 times. Whatever shares a key is confirmed on the full shingle sets.

Texts with equal sets are one class with one representative, so copies are never paired. A key that few representatives
share gives all their pairs. A key that many share gives the pairs with its smallest id first (a star). Once those are
confirmed, only keys whose members still fall into several components matter, and the members go through an exact
prefix-filtered join with bounds on size and place (`_prefix_pairs`), which every link passes. No partner or candidate is
dropped on the way.

Cases: a null or empty text has an empty set, is kept and is linked with nothing. With fewer than five words the whole
sequence is the only shingle. Rows that repeat a doc_id are judged each by its text: a vertex is a class of equal sets, not
an id. A component of rows without id has no component_id, and its rows count as kept; `drop_near_copies` keeps one row of
every component, whether its id is null or repeated. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import (
    LOWER,
    SPACE_WORDS,
    counted,
    drop_rows,
    materialize,
    mix64,
    read_table,
    scan_words,
    sequence_hash,
    text_chunks,
    text_key,
    tidy,
    word_hashes,
)
from chorale.llm.components import connected_components

WORDS = 5
LANES, CHUNKS, DISTANCE = 64, 15, 29
#: A key that so many representatives share at most gives all their pairs at once.
SMALL_BUCKET = 24

_seeds = np.random.default_rng(7)
LANE_FACTORS = (_seeds.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
CHUNK_LANES = [[int(i) for i in part] for part in np.array_split(np.arange(LANES), CHUNKS)]


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in text_chunks(texts):
        low = LOWER[data]
        starts, ends, first = scan_words(low, offsets, SPACE_WORDS)
        words = word_hashes(low, starts, ends)
        shingles = sequence_hash(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            else:
                yield sequence_hash(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 lanes of 16 bits: the minimum of each multiplicative hash, mixed and cut to 16 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (low[i : i + 2048, None] * LANE_FACTORS[None, :]).min(axis=0), out=least)
    return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, his, los, sigs = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            ns.append(len(s))
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            his.append((h >> 64) - 2**63)
            los.append((h & (2**64 - 1)) - 2**63)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text_key")), *(pa.array(x, pa.int64()) for x in (ns, his, los)), pa.array(sigs, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "hi", "lo", "sig"],
        )


def chunk_keys(lanes: np.ndarray) -> np.ndarray:
    """Per row of signatures the 64 keys: each chunk with each of its lanes left out, tagged with both."""
    keys = np.empty((len(lanes), LANES), np.uint64)
    wide = lanes.astype(np.uint64)
    for chunk in CHUNK_LANES:
        for left_out in chunk:
            h = np.full(len(lanes), left_out + 1, np.uint64)
            for lane in chunk:
                if lane != left_out:
                    h = mix64(h) + wide[:, lane]
            keys[:, left_out] = mix64(h)
    return keys


@tidy
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lanes = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, LANES)
            keys = chunk_keys(lanes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("id").to_numpy(), LANES))], names=["key", "id"]
            )


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(part.column("text")))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "shingles"]
            )


@tidy
def _near_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most DISTANCE lanes."""
    for batch in batches:
        lanes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, LANES) for c in ("sig_a", "sig_b")]
        near = (lanes[0] != lanes[1]).sum(axis=1) <= DISTANCE
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))


class NearDuplicates:
    """One run over (doc_id, text). `members` maps every row to its representative, `components` those to components."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        text = F.col(text_col)
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
        schema = "doc_id long, text_key long, n_shingles long, hi long, lo long, sig binary"
        self.rows = materialize(self.texts.mapInArrow(_signatures, schema), "signatures")
        classes = self.rows.filter("n_shingles > 0").groupBy("hi", "lo")
        # any one row of a class stands for its set
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f")
        reps = materialize(classes.agg(first, F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
        reps = reps.select("hi", "lo", "n", "sig", "f.doc_id", "f.text_key")
        # a class is called by its smallest doc_id; where that is null or stands for several classes, by a negative hash
        several = counted(reps.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("several")), "several")
        named = reps.join(several, F.col("doc_id").eqNullSafe(F.col("several")), "left_semi")
        named = named.withColumn("id", -1 - F.shiftrightunsigned(F.xxhash64("hi", "lo"), 1))
        plain = reps.join(several, F.col("doc_id").eqNullSafe(F.col("several")), "left_anti").withColumn("id", F.col("doc_id"))
        self.reps = materialize(plain.unionByName(named), "representatives")

    def _buckets(self) -> DataFrame:
        """(key, id, size, lead) of every key that several representatives share. Sets below three link with equals only."""
        keys = self.reps.filter("n >= 3").select("id", "sig").mapInArrow(_keys, "key long, id long")
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lead")).filter("size > 1")
        return materialize(keys.join(materialize(shared, "shared"), "key"), "buckets")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets fulfil 100 * intersection >= 75 * union, after the tests on size and signature."""
        small = self.reps.select("id", "n", "sig")
        a, b = (small.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "sig"))) for x in "ab")
        near = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
        near = near.filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
        return self._confirmed_on_sets(materialize(near.mapInArrow(_near_signatures, "a long, b long"), "near"))

    def _shingles_of(self, ids: DataFrame) -> DataFrame:
        wanted = self.reps.join(ids.select("id").distinct(), "id").select("id", F.col("doc_id").alias("wanted_id"), F.col("text_key").alias("wanted_key"))
        wanted = counted(wanted, "wanted")
        texts = self.texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_key") == F.col("wanted_key")))
        return texts.select("id", "text").mapInArrow(_sets, "id long, shingles array<long>")

    def _confirmed_on_sets(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        sets = materialize(self._shingles_of(ends), "sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return materialize(both.filter("100 * common >= 75 * (total - common)").select("a", "b"), "links")

    def _prefix_pairs(self, ids: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs of different components among `ids` that the bounds of a prefix-filtered join leave, as they leave any link.

        The shingles of a set are ranked by how many sets of `ids` hold them; those of one set only can't be common and
        are left out, but count in its size n. A link needs 3/7 (n_x + n_y) common shingles. With m ranked shingles, at
        most m - place of them are common if the first common one has this place; so that one stands in the prefix of
        both, and a set links only with sets whose size its own bound allows. Sizes are compared in steps of 5 %.
        """
        sets = materialize(self._shingles_of(ids), "sets")
        tokens = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
        # (a repeated row only raises counts, which weakens the bounds)
        counts = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "counts")
        common = tokens.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        common = common.withColumn("m", F.size("ranked").cast("long"))
        length = F.greatest(F.lit(0), F.expr("m - ceil(n * 75 / 100) + 1")).cast("int")
        prefix = common.select("id", "n", "m", F.posexplode(F.slice("ranked", 1, length)).alias("place", "t"))
        prefix = prefix.select("id", "n", (F.col("m") - F.col("place")).alias("left"), "t.token")
        prefix = prefix.join(comps.select("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        prefix = materialize(prefix, "prefix")
        per = prefix.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        major = per.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        major = materialize(major.select("token", F.col("top.comp").alias("major")), "major")
        step = lambda n: F.floor(F.log(n) / F.log(F.lit(1.05)))
        rows = materialize(prefix.join(major, "token").withColumn("step", step(F.col("n"))), "rows")
        # members of a token's largest component are paired with the others only
        names = ("id", "n", "left", "comp")
        least, most = F.ceil(F.col("n") * 3 / 4), F.floor(F.col("left") * 7 / 3) - F.col("n")
        x = rows.filter("comp <> major").filter(least <= most).withColumn("step", F.explode(F.sequence(step(least), step(most))))
        x = x.select("token", "step", *(F.col(c).alias(f"{c}_x") for c in names))
        y = rows.select("token", "step", "major", *(F.col(c).alias(f"{c}_y") for c in names))
        pairs = x.join(y, ["token", "step"]).filter("comp_x <> comp_y and 7 * least(left_x, left_y) >= 3 * (n_x + n_y)")
        pairs = pairs.filter("100 * least(n_x, n_y) >= 75 * greatest(n_x, n_y)")
        return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links, components): confirmed pairs (a, b) of representatives, enough to connect all that belong together."""
        buckets = self._buckets()
        few = buckets.filter(F.col("size") <= SMALL_BUCKET)
        pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").filter("a < b")
        stars = buckets.filter((F.col("size") > SMALL_BUCKET) & (F.col("id") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("id").alias("b"))
        links = self._confirmed(pairs.select("a", "b").union(stars).distinct())
        comps = connected_components(links)
        large = buckets.filter(F.col("size") > SMALL_BUCKET)
        if large.isEmpty():
            return links, comps
        known = large.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        split = materialize(known.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l <> h"), "split")
        rest = materialize(large.join(split.select("key"), "key").select("id").distinct(), "rest")
        if rest.isEmpty():
            return links, comps
        links = links.union(self._confirmed_on_sets(materialize(self._prefix_pairs(rest, comps), "pairs")))
        return links, connected_components(links)

    def components(self) -> DataFrame:
        """doc_id, text_key, n_shingles, label of every row; rows share a label if they are connected, null for empty sets."""
        _, comps = self.links()
        reps = self.reps.select("hi", "lo", "id").join(comps, "id", "left").select("hi", "lo", F.coalesce("comp", "id").alias("label"))
        rows = self.rows.select("doc_id", "text_key", "n_shingles", "hi", "lo").join(materialize(reps, "components"), ["hi", "lo"], "left")
        return materialize(rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).alias("label")), "labelled")

    def result(self) -> DataFrame:
        """One row per input row: doc_id, n_shingles, component_id, kept."""
        rows = self.components()
        least = materialize(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
        out = rows.join(least, "label", "left")
        component = F.when(F.col("label").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return NearDuplicates(docs, id_col, text_col).result()


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with an empty set and one row of each component, that with the smallest doc_id, with their columns as they came."""
    rows = NearDuplicates(docs).components().filter("label is not null")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    stays = rows.groupBy("label").agg(F.min(row).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    told = rows.join(materialize(stays.drop("n"), "stays"), "label").withColumn("row", row)
    told = materialize(told.groupBy("doc_id", "text_key").agg(F.max(F.col("row") == F.col("stays")).alias("stay"), F.count(F.lit(1)).alias("n")), "told")
    return drop_rows(docs, told.filter("not stay"), told.filter("stay and n > 1"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, then reachability; doc_id is taken to be unique.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
