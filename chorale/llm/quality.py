"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted trees of small depth are fitted to labelled rows; every path from a root to a node is a rule, a conjunction of
comparisons of statistics with thresholds. A lasso logistic regression over the rules keeps few of them, its penalty
chosen on a part of the labelled rows. The rules that stay are compiled into one Spark column expression.

Statistics come from the text alone. Labels, language, source and id are never inputs of a score. The model learns from
at most SAMPLE_ROWS labelled rows, taken in the order of a hash of their id, of those with crc32(doc_id as text) mod 5
not 0. Every row is scored by the same expression.

Cases: a null text counts as empty; an empty text has statistics of 0 and is scored like any other. A row without id is
never learned from. Labels that repeat an id count by their mean; null labels are left out. Without labels of both
kinds every row gets the smoothed share of label 1. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import LOWER, SPACE_WORDS, fresh_names, read_table, release_memory, scan_words, sequence_hash, text_chunks, word_hashes

SAMPLE_ROWS = 12_000
KEEP_FROM = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "blank": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "quote": b"\"'()-",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "wide": range(0x80, 0x100),
}
CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    CLASS_OF[list(_bytes)] = _k
LINES = np.ones(256, dtype=bool)
LINES[0x0A] = False

STATISTICS = [
    *(f"share_{c}" for c in [*_CLASSES, "other"]),
    "log_bytes",
    "log_words",
    "word_bytes",
    "longest_word",
    "short_words",
    "distinct_words",
    "top_word",
    "distinct_pairs",
    "distinct_triples",
    "log_lines",
    "line_bytes",
    "distinct_lines",
    "capital_words",
    "stop_words",
    "sign_words",
]


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    kinds = len(_CLASSES) + 1
    classes = CLASS_OF[data]
    counts = np.bincount(np.repeat(np.arange(n), sizes) * kinds + classes, minlength=n * kinds).reshape(n, kinds)
    low = LOWER[data]
    starts, ends, first = scan_words(low, offsets, SPACE_WORDS)
    hashes, lens, words = word_hashes(low, starts, ends), ends - starts, np.diff(first)
    owner = np.repeat(np.arange(n), words)
    capital = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    last = classes[ends - 1] if len(ends) else np.empty(0, np.int64)
    names = list(_CLASSES)
    line_start, line_end, line_first = scan_words(data, offsets, LINES)
    line_hash = word_hashes(data, line_start, line_end)
    per = lambda w: np.bincount(owner, weights=w, minlength=n) / np.maximum(words, 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, :kinds] = counts / np.maximum(sizes, 1)[:, None]
    col = {s: i for i, s in enumerate(STATISTICS)}
    out[:, col["log_bytes"]] = np.log1p(sizes)
    out[:, col["log_words"]] = np.log1p(words)
    out[:, col["word_bytes"]] = per(lens)
    out[:, col["short_words"]] = per(lens <= 3)
    out[:, col["capital_words"]] = per(capital)
    out[:, col["stop_words"]] = per(last == names.index("stop"))
    out[:, col["sign_words"]] = per(last >= names.index("shout"))
    lines = np.diff(line_first)
    out[:, col["log_lines"]] = np.log1p(lines)
    out[:, col["line_bytes"]] = np.log1p(sizes / np.maximum(lines, 1))
    pairs, triples = sequence_hash(hashes, 2), sequence_hash(hashes, 3)
    for i, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_first[:-1].tolist(), line_first[1:].tolist())):
        if b > a:
            ordered = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            out[i, col["distinct_words"]] = len(edges) / (b - a)
            out[i, col["top_word"]] = np.diff(np.append(edges, b - a)).max() / (b - a)
            out[i, col["longest_word"]] = np.log1p(lens[a:b].max())
            for name, grams, width in (("distinct_pairs", pairs, 2), ("distinct_triples", triples, 3)):
                out[i, col[name]] = len(np.unique(grams[a : b - width + 1])) / (b - a - width + 1) if b - a >= width else 1.0
        if d > c:
            out[i, col["distinct_lines"]] = len(np.unique(line_hash[c:d])) / (d - c)
    return out


def _statistics_column(text):
    rows = [_statistics(data, offsets) for _, _, data, offsets in text_chunks(text)]
    table = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
    release_memory()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(STATISTICS))], names=STATISTICS)


def statistics(text: Column) -> Column:
    """The struct of STATISTICS of a text column, computed a batch at a time."""
    run = F.arrow_udf(_statistics_column, "struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    return run(text)


# --- fitting, on a bounded sample on the driver ------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float):
    """A regression tree by Newton gain over binned statistics: (node of each row, leaf values, the path of each node)."""
    at = np.zeros(len(g), np.int64)
    paths: dict[int, Rule] = {0: ()}
    value = {0: 0.0}
    for _ in range(depth):
        for node in [k for k in paths if len(paths[k]) == _ and k in value]:
            rows = np.flatnonzero(at == node)
            gs, hs, best = g[rows].sum(), h[rows].sum(), (1e-3, None)
            for f in range(x.shape[1]):
                bins = x[rows, f]
                gl = np.cumsum(np.bincount(bins, weights=g[rows], minlength=len(edges[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins, weights=h[rows], minlength=len(edges[f]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < least) | (hs - hl < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
            if best[1] is None:
                continue
            f, cut = best[1]
            left, right = max(paths) + 1, max(paths) + 2
            paths[left], paths[right] = (*paths[node], (f, True, float(edges[f][cut]))), (*paths[node], (f, False, float(edges[f][cut])))
            low = x[rows, f] <= cut
            at[rows[low]], at[rows[~low]] = left, right
            del value[node]
            for k in (left, right):
                own = at == k
                value[k] = -g[own].sum() / (h[own].sum() + 1)
    return at, value, [p for p in paths.values() if p]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] <= cut) == below
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], rounds: int = 250):
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    w, b = start
    v, c, t = w.copy(), b, 1.0
    step = 4 / (np.linalg.norm(r.T @ r, 2) / len(y) + 1)
    for _ in range(rounds):
        e = _sigmoid(r @ v + c) - y
        nw = v - step * (r.T @ e) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb, nt = c - step * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The score of a statistics struct as one column expression, from 0 to 1."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            test = F.lit(True)
            for f, below, cut in rule:
                value = stats[STATISTICS[f]]
                test = test & ((value <= cut) if below else (value > cut))
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * _holds(rule, x)
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, shrink: float = 0.3) -> RuleModel:
    """Rules from boosted trees, weighted by lasso; every fifth row chooses the penalty."""
    share = (y.sum() + 1) / (len(y) + 2)
    if min(y.sum(), len(y) - y.sum()) < 3:
        return RuleModel([], [], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), np.log(share / (1 - share)))
    found: dict[bytes, Rule] = {}
    for k in range(trees):
        p = _sigmoid(z)
        # each tree sees the rows but a changing third
        use = np.arange(len(y)) % 3 != k % 3 if len(y) >= 300 else np.ones(len(y), bool)
        at, value, paths = _tree(binned[use], edges, (p - y)[use], (p * (1 - p))[use], depth, 2.0 if len(y) >= 300 else 0.5)
        if not paths:
            break
        leaves = {k: v for k, v in value.items()}
        for rule in paths:
            holds = _holds(rule, x)
            if 0 < holds.sum() < len(y):
                found.setdefault(np.packbits(holds).tobytes(), rule)
        for rule, v in zip(_leaf_rules(paths), leaves.values()):
            z += shrink * v * _holds(rule, x)
    rules = list(found.values())
    if not rules:
        return RuleModel([], [], float(np.log(share / (1 - share))))
    r = np.stack([_holds(rule, x) for rule in rules], axis=1).astype(np.float64)
    scale = np.maximum(r.std(axis=0), 0.02)
    r = r / scale
    check = np.arange(len(y)) % 5 == 0
    state, best = (np.zeros(len(rules)), 0.0), (np.inf, 0.0)
    for penalty in (0.03, 0.01, 0.004, 0.002, 0.001):
        state = _lasso(r[~check], y[~check], penalty, state)
        p = np.clip(_sigmoid(r[check] @ state[0] + state[1]), 1e-4, 1 - 1e-4)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = _lasso(r, y, best[1], state, 500)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in kept], [float(w[i] / scale[i]) for i in kept], float(b))


def _leaf_rules(paths: list[Rule]) -> list[Rule]:
    inner = {p[:-1] for p in paths}
    return [p for p in paths if p not in inner]


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most sample_rows labelled rows of `docs`; their statistics are all that reaches the driver."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label")).filter(bucket(F.col("label_id"), 5) != 0)
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("label_id"))
    rows = rows.select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "log_bytes").limit(sample_rows).toArrow()
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("s"))
    out = rows.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), model.score(F.col("s")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns as they came."""
    model = train(docs, labels)
    (stats,) = fresh_names(docs, "statistics")
    scored = docs.withColumn(stats, statistics(F.col("text")))
    return scored.filter(model.score(F.col(stats)) >= KEEP_FROM).select(*(F.col(f"`{n}`") for n in docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
