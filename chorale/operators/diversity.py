"""Diversity: variance between groups, distinct-n, self-BLEU, spread of outcomes, clusters of trajectories."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

import chorale
from chorale.functions import text as T
from chorale.operators.cells import CELL, SET

# Functions of this package travel inside the task, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(chorale)


def plausible(utterances: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The utterances whose diversity counts: all, or with labels those grounded and not fabricated."""
    if labels is None:
        return utterances
    good = labels.filter("grounded and not coalesce(fabricated, false)").select("utterance_id")
    return utterances.join(good, "utterance_id", "left_semi")


def group_variance(cells: DataFrame, keys: list[str] = SET) -> DataFrame:
    """Per set: mean over cells of the variance of mean z-scores between role types, and how many cells took part.

    A cell needs three values that differ and two role types.
    """
    w = W.partitionBy(*keys, *CELL)
    rows = cells.select(*keys, *CELL, T.role_type(F.col("kg_role")).alias("role"), F.col("revised").cast("double").alias("x"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean", F.avg("x").over(w)).withColumn("sd", F.stddev_pop("x").over(w))
    z = rows.filter("n >= 3 and sd > 0").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))
    groups = z.groupBy(*keys, *CELL, "role").agg(F.avg("z").alias("m"))
    per = groups.groupBy(*keys, *CELL).agg(F.var_pop("m").alias("v"), F.count(F.lit(1)).alias("g")).filter("g >= 2")
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("v").alias("between_group_variance"))


def distinct_n(utterances: DataFrame, n: int, keys: list[str] = SET) -> DataFrame:
    """Per set: n-grams within utterances, distinct ones, their ratio. Counts by n-gram come first, so one set may be large."""
    grams = utterances.select(*keys, F.explode(T.ngrams(T.plain_tokens(F.col("text")), n)).alias("g"))
    per = grams.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(*keys).agg(F.sum("c").alias("n_total"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("distinct_ratio", F.try_divide(F.col("n_distinct").cast("double"), F.col("n_total").cast("double")))


def self_bleu(utterances: DataFrame, keys: list[str] = SET, max_groups: int | None = 200, group_order: str = "group_id") -> DataFrame:
    """Per set: mean sentence BLEU (1- and 2-grams, evenly weighted) of each text against the others of its group.

    Columns: keys, group_id, member, text. Only the first max_groups groups of a set by `group_order` count. A matched
    n-gram counts at most as often as the reference that has it most: that is the largest count in the group, or the
    second largest for the text that holds the largest alone. So two numbers an n-gram replace all pairs of texts.
    A text without a shared word scores 0; without a shared pair its pairs count 0.1. High values mean little diversity.
    """
    rows = utterances.select(*keys, "group_id", "member", T.plain_tokens(F.col("text")).alias("words"))
    if max_groups is not None:
        groups = rows.select(*keys, "group_id").distinct()
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(group_order)) if keys else F.row_number().over(W.orderBy(group_order))
        rows = rows.join(groups.withColumn("rank", rank).filter(F.col("rank") <= max_groups).drop("rank"), [*keys, "group_id"])
    by = [*keys, "group_id"]
    size = rows.select(*by, "member", F.size("words").cast("long").alias("len"))
    counts = None
    for n in (1, 2):
        c = rows.select(*by, "member", F.explode(T.ngrams(F.col("words"), n)).alias("g")).groupBy(*by, "member", "g").agg(F.count(F.lit(1)).alias("c"))
        c = c.withColumn("n", F.lit(n))
        counts = c if counts is None else counts.unionByName(c)
    top = counts.groupBy(*by, "n", "g").agg(F.slice(F.sort_array(F.collect_list("c"), False), 1, 2).alias("top"))
    both = counts.join(top, [*by, "n", "g"])
    largest, second = F.get("top", F.lit(0)), F.coalesce(F.get("top", F.lit(1)), F.lit(0).cast("long"))
    clip = F.least("c", F.when(F.col("c") == largest, second).otherwise(largest))
    matched = both.groupBy(*by, "member").agg(
        *(F.sum(F.when(F.col("n") == n, clip).otherwise(0)).alias(f"m{n}") for n in (1, 2)), *(F.sum(F.when(F.col("n") == n, F.col("c")).otherwise(0)).alias(f"t{n}") for n in (1, 2))
    )
    lengths = size.groupBy(*by).agg(F.sort_array(F.collect_list("len")).alias("lens"))
    hyp = size.filter("len > 0").join(matched, [*by, "member"]).join(lengths, by).filter(F.size("lens") > 1)
    # the others' lengths: one value equal to the text's own is left out
    own = F.array_position("lens", F.col("len")).cast("int")
    others = F.concat(F.slice("lens", F.lit(1), own - 1), F.slice("lens", own + 1, F.size("lens")))
    near = F.array_min(F.transform(others, lambda x: F.struct(F.abs(x - F.col("len")).alias("d"), x.alias("x"))))["x"]
    hyp = hyp.withColumn("ref", near)
    p1 = F.col("m1") / F.greatest(F.lit(1), F.col("t1"))
    p2 = F.when(F.col("m2") > 0, F.col("m2").cast("double")).otherwise(F.lit(0.1)) / F.greatest(F.lit(1), F.col("t2"))
    penalty = F.when(F.col("len") > F.col("ref"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref") / F.col("len")))
    score = F.when(F.col("m1") == 0, F.lit(0.0)).otherwise(penalty * F.sqrt(p1 * p2))
    return hyp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hypotheses"), F.avg(score).alias("self_bleu"))


def outcome_range(estimates: DataFrame, keys: list[str] = SET, bins: int = 5) -> DataFrame:
    """Per set, phase and target with two estimates: n, min, max, quartiles, share of bins used, normalised entropy.

    Bins are of equal width between min and max; a value's bin is the number of inner edges not above it. A constant
    series uses one bin and has entropy 0.
    """
    by = [*keys, "phase", "target"]
    w = W.partitionBy(*by)
    rows = estimates.select(*by, F.col("estimate").alias("x")).withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins
    bin_ = sum(((F.col("x") >= edge(i)).cast("int") for i in range(1, bins)), F.lit(0))
    rows = rows.filter("n >= 2").withColumn("bin", F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(bin_))
    share = F.col("k") / F.col("n")
    entropy = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).groupBy(*by)
    entropy = entropy.agg((F.count(F.lit(1)) / bins).alias("bin_coverage"), (F.sum(-share * F.ln(share)) / F.ln(F.lit(float(bins)))).alias("entropy"))
    spread = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.percentile("x", 0.25).alias("q1"), F.percentile("x", 0.75).alias("q3")
    )
    return spread.join(entropy, by)


def trajectory_clusters(estimates: DataFrame, ks: range = range(2, 6), starts: int = 10, keys: list[str] | None = None, block: int = 2048) -> DataFrame:
    """Per set: k and silhouette of the best clustering of scenarios by their estimates, and how many scenarios; ties take the first k.

    keys: by default the columns of SET that the estimates have. Within a set columns are standardised (a constant one by
    1), missing values take the column's mean. KMeans runs `starts` times for each k, see `_kmeans`. The silhouette is
    Euclidean and compares all pairs of scenarios of a set, in blocks. A set without a clustering has null for both. Runs
    when called; all sets, ks and starts share the passes over the scenarios.
    """
    keys = [c for c in SET if c in estimates.columns] if keys is None else keys
    spark = estimates.sparkSession
    z = estimates.select(*keys, "scenario_uid", "phase", "target", "estimate").cache()
    stats = z.groupBy(*keys, "phase", "target").agg(F.avg("estimate").alias("mean"), F.stddev_pop("estimate").alias("sd"))
    people = z.select(*keys, "scenario_uid").distinct()
    grid = people.join(F.broadcast(stats), keys) if keys else people.crossJoin(F.broadcast(stats))
    grid = grid.join(z, [*keys, "scenario_uid", "phase", "target"], "left")
    value = F.coalesce((F.col("estimate") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), F.lit(0.0))
    vectors = grid.groupBy(*keys, "scenario_uid").agg(F.sort_array(F.collect_list(F.struct("phase", "target", value.alias("z")))).alias("v"))
    vectors = vectors.select(*keys, F.xxhash64("scenario_uid").alias("h"), F.transform("v", lambda x: x["z"]).alias("x")).cache()
    sets = [tuple(r) for r in vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect()]
    fields = [vectors.schema[c] for c in keys]
    index = StructType([*(StructField(f.name + "_", f.dataType) for f in fields), StructField("s", IntegerType()), StructField("blocks", IntegerType())])
    table = spark.createDataFrame([(*r[:-2], i, -(-r[-2] // block)) for i, r in enumerate(sets)], index)
    same = functools.reduce(lambda a, b: a & b, (vectors[c].eqNullSafe(table[c + "_"]) for c in keys), F.lit(True))
    rows = vectors.join(F.broadcast(table), same).groupBy("s", "blocks", F.pmod("h", F.col("blocks")).cast("int").alias("b"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("h", "x"))).alias("r"))
    rows = rows.select("s", "blocks", "b", F.col("r.h").alias("h"), F.flatten("r.x").alias("x")).cache()
    centers, labelled = _kmeans(rows, {i: (r[-2], r[-1]) for i, r in enumerate(sets)}, list(ks), starts)
    scores = _silhouettes(rows, centers, labelled)
    out = []
    for i, r in enumerate(sets):
        best = max(((k, scores[i, k]) for k in ks if (i, k) in scores), key=lambda f: (f[1], -f[0]), default=(None, None))
        if keys or best[0] is not None:
            out.append((*r[:-2], *best, r[-2]))
    for df in (rows, vectors, z):
        df.unpersist()
    types = dict(estimates.dtypes)
    return spark.createDataFrame(out, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "best_k int, silhouette double, n_scenarios long"]))


def _points(batches) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    """(set, other numbers, hashes, matrix of points) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("h", "x")}
            h = batch.column("h")[i].values.to_numpy().view(np.uint64)
            yield row["s"], row, h, batch.column("x")[i].values.to_numpy().reshape(len(h), -1)


def _uniform(h: np.ndarray, start: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash, start and turn: splitmix64."""
    x = h + np.uint64((start * 64 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, from differences."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        step = x[:, j, None] - y[None, :, j]
        step *= step
        out += step
    return out


def _sent(rows: DataFrame, run: Callable, schema: str) -> list:
    """What run(batches) yields on each part of the blocks, at the driver."""
    return rows.mapInArrow(run, schema).collect()


def _kmeans(rows: DataFrame, sets: dict[int, tuple[int, int]], ks: list[int], starts: int, turns: int = 300, near: float = 1e-4) -> tuple[dict, dict]:
    """Of each set and k below its size the centers with the least cost of all starts, and the sizes of their clusters.

    A start draws its first centers one by one, each point with a chance in proportion to its squared distance to the
    centers before (k-means++), and shares them between the ks. A draw is the least of -log(uniform of a hash) / chance, so
    it doesn't depend on how rows are dealt. Then Lloyd's turns, until no center moves by more than `near`. A turn is one
    pass over the scenarios for all sets, ks and starts that still move; what goes to the driver are sums by center.
    """
    live = {i: [k for k in ks if k < n] for i, (n, _) in sets.items()}
    most = {i: max(k) for i, k in live.items() if k}
    seeds: dict[tuple[int, int], np.ndarray] = {}
    for turn in range(max(most.values(), default=0)):
        known = dict(seeds)

        def draw(batches):
            out = {}
            for s, _, h, x in _points(batches):
                for start in range(starts) if most.get(s, 0) > turn else ():
                    chance = _apart(x, known[s, start]).min(1) if turn else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        key = -np.log(_uniform(h, start, turn)) / chance
                    at = int(key.argmin())
                    if (s, start) not in out or key[at] < out[s, start][0]:
                        out[s, start] = (float(key[at]), x[at].tolist())
            for (s, start), (key, x) in out.items():
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "start": pa.array([start], pa.int32()), "key": [key], "x": [x]})

        found = {}
        for r in _sent(rows, draw, "s int, start int, key double, x array<double>"):
            found[r.s, r.start] = min(found.get((r.s, r.start), (np.inf, [])), (r.key, r.x))
        for at, (key, x) in found.items():
            # all points lie on a center: one more is a copy, which stays empty
            new = np.array([x]) if key < np.inf else seeds[at][:1]
            seeds[at] = np.concatenate([seeds[at], new]) if at in seeds else new
    centers = {(s, k, start): seeds[s, start][:k] for s in most for k in live[s] for start in range(starts)}
    moving, total = set(centers), {}
    for turn in range(turns + 1):
        # the last pass gives the costs and sizes of the centers as they are
        last = not moving or turn == turns
        of: dict[int, list] = {}
        for at in sorted(centers if last else moving):
            of.setdefault(at[0], []).append((at, centers[at]))

        def assign(batches):
            out = {}
            for s, _, _, x in _points(batches):
                with_one = np.concatenate([x, np.ones((len(x), 1))], 1)
                for at, c in of.get(s, ()):
                    d = _apart(x, c)
                    own = d.argmin(1)
                    sums = np.zeros((len(c), x.shape[1] + 2))
                    sums[:, :-1] = (own == np.arange(len(c))[:, None]).astype(float) @ with_one
                    sums[0, -1] = d[np.arange(len(x)), own].sum()
                    out[at] = out[at] + sums if at in out else sums
            for (s, k, start), sums in out.items():
                yield pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int32()) for n, v in (("s", s), ("k", k), ("start", start))}, "sums": [sums.ravel().tolist()]})

        total = {}
        for r in _sent(rows, assign, "s int, k int, start int, sums array<double>"):
            at, sums = (r.s, r.k, r.start), np.array(r.sums).reshape(r.k, -1)
            total[at] = total[at] + sums if at in total else sums
        if last:
            break
        for at, sums in total.items():
            size = sums[:, -2:-1]
            moved = np.where(size > 0, sums[:, :-2] / np.maximum(size, 1), centers[at])
            if not ((moved - centers[at]) ** 2).sum(1).max() > near**2:  # NaN ends too
                moving.discard(at)
            centers[at] = moved
    best = {(s, k): min(range(starts), key=lambda start: total[s, k, start][0, -1]) for s in most for k in live[s]}
    return {at: centers[*at, start] for at, start in best.items()}, {at: total[*at, start][:, -2] for at, start in best.items()}


def _silhouettes(rows: DataFrame, centers: dict, sizes: dict) -> dict[tuple[int, int], float]:
    """Mean Euclidean silhouette of each set and k with two clusters at least. Each block meets all blocks of its set.

    The blocks that one meets come to its task one after the other, itself first; distances serve all ks.
    """
    of: dict[int, list] = {}
    for (s, k), c in sorted(centers.items()):
        if (sizes[s, k] > 0).sum() > 1:
            of.setdefault(s, []).append((k, c, sizes[s, k]))
    if not of:
        return {}

    def scored(s, x, sums):
        at = 0
        for k, c, n in of[s]:
            own, total = _apart(x, c).argmin(1), sums[:, at : at + k]
            at += k
            i = np.arange(len(x))
            alone = n[own] < 2
            inner = total[i, own] / np.maximum(n[own] - 1, 1)
            means = np.where(n > 0, total / np.maximum(n, 1), np.inf)
            means[i, own] = np.inf
            outer = means.min(1)
            top = np.maximum(inner, outer)
            score = np.where(alone | (top == 0), 0.0, (outer - inner) / np.where(top == 0, 1.0, top))
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "k": pa.array([k], pa.int32()), "sum": [float(score.sum())], "n": pa.array([len(x)], pa.int64())})

    def run(batches):
        met = x = sums = None
        for s, row, _, y in _points(batches):
            if s not in of:
                continue
            if met != (s, row["to"]):
                if met is not None:
                    yield from scored(met[0], x, sums)
                met, x = (s, row["to"]), y
                sums = np.zeros((len(x), sum(k for k, _, _ in of[s])))
            own = [_apart(y, c).argmin(1) for _, c, _ in of[s]]
            which = np.concatenate([(o[:, None] == np.arange(k)).astype(float) for o, (k, _, _) in zip(own, of[s])], 1)
            for at in range(0, len(x), 256):
                sums[at : at + 256] += np.sqrt(_apart(x[at : at + 256], y)) @ which
        if met is not None:
            yield from scored(met[0], x, sums)

    held = rows.groupBy("s").agg(F.collect_list("b").alias("all"))
    sent = rows.join(F.broadcast(held), "s").select("s", F.explode("all").alias("to"), "b", "h", "x")
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(parts, "s", "to").sortWithinPartitions("s", "to", F.col("b") != F.col("to"), "b")
    out: dict[tuple[int, int], tuple[float, int]] = {}
    for r in _sent(sent, run, "s int, k int, sum double, n long"):
        a, n = out.get((r.s, r.k), (0.0, 0))
        out[r.s, r.k] = (a + r.sum, n + r.n)
    return {at: a / n for at, (a, n) in out.items()}
