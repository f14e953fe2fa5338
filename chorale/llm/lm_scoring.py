"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are words of the lower-cased text, then one end a document; a token's context is the token before it. The model has
one restaurant for every context of the training documents, however rare, and a root restaurant that is the parent of all.
A context that training never saw passes on what the root says. The root's base is uniform over the words seen and one
place for words never seen. Discounts come from the numbers of dishes seen once and twice.

Seating is sampled by Gibbs sweeps, all restaurants at once, which auxiliary variables make exact:

* given the root's distribution G over words and a Gamma variable g of the context (shape THETA / d + its tables), the tables
  of each dish are independent of all other dishes: t tables for c customers have weight S(c, t) * (d * g * G(dish)) ** t,
  S being the number of seatings (generalised Stirling numbers). Up to FEW customers t is drawn from these weights. Beyond,
  a Chinese restaurant whose strength fits the weights is seated customer by customer, and the outcome is accepted or refused by Metropolis and Hastings' rule;
* the tables of all contexts are the customers of the root, whose tables are drawn likewise, and G is drawn from the Dirichlet
  distribution that its seating gives (for the rest of its mass the mean, the base, stands).

After BURN_IN sweeps each of SAMPLES seatings gives predictive probabilities; their average is the probability of a token,
and `perplexity` follows from it. Random numbers are hashes of the word, or of the pair, and the sweep, and what is summed
over parts are integers, so scores don't depend on how rows are dealt.

One scan turns documents into windows of tokens. Each window sends, once, its distinct (context, token) pairs to parts by
context, with the places of their documents; contexts that hold SPREAD_SHARE of the tokens are dealt by pair, and their few
numbers are added up by the driver. A part joins its pairs and keeps them as files in the shared folder. Words are dealt to
parts of their own: in a sweep each pair part sends the tables of its words there and gets their share of G back, in the
order of its words. At the end a part scores its own tokens and returns sums by document to the windows. So what is gathered
grows with the input, and nothing that is broadcast or collected does.

Cases: a null or empty text is one end token. A document without id is never learned from and counts as held out.
Repeated rows give repeated rows; in training they count each. Without training documents the base is uniform over one
place. Other columns are not read. A task that runs twice has to give the same windows; if it doesn't, documents with missing
tokens raise an error.
"""

from __future__ import annotations

import gc
import pickle
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import LOWER, SPACE_WORDS, STEP, fresh_path, materialize, mix64, read_table, scan_words, text_chunks, tidy, word_hashes

SPREAD_SHARE = 1 / 1000
PART_TOKENS, WINDOW_TOKENS = 4 << 20, 3 << 20
THETA = 1.0
BURN_IN, SAMPLES = 2, 3
FEW = 32
BLOCK = 1 << 18
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BE6546B64)


# --- tokens and parts --------------------------------------------------------------------------------------------------


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk of texts with their ends, the token before each, and where each text begins (and the total)."""
    low = LOWER[data]
    starts, ends, first = scan_words(low, offsets, SPACE_WORDS)
    n = len(offsets) - 1
    begin = first + np.arange(n + 1)
    tokens = np.empty(begin[-1], np.uint64)
    is_end = np.zeros(begin[-1], bool)
    is_end[begin[1:] - 1] = True
    tokens[~is_end], tokens[is_end] = word_hashes(low, starts, ends), END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begin[:-1]] = BEGIN
    return tokens, before, begin


def _place(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + the index of each value in the sorted keys, 0 if it isn't there."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[keys & np.uint64(0xFFFF)] = True
    out = np.zeros(len(values), np.int64)
    at = np.flatnonzero(seen[values & np.uint64(0xFFFF)])
    slot = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    out[at] = np.where(keys[slot] == values[at], slot + 1, 0)
    return out


def pair_key(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(tokens + before * STEP)


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash; parts are ranges of hashes, in order."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _part(tokens: np.ndarray, before: np.ndarray, spread: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of (token, context) and the parts in it: by token, of frequent tokens by both."""
    h = np.where(_place(tokens, spread) > 0, pair_key(tokens, before), mix64(tokens))
    order = np.argsort(h)
    return order, _range(h[order], parts)


# --- sampling ----------------------------------------------------------------------------------------------------------


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key, fixed by key and salt."""
    seed = xxhash.xxh3_64_intdigest(struct.pack(f"<{len(salt)}q", *salt))
    return ((mix64(keys * STEP + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, *salt: int) -> np.ndarray:
    """Gamma variables by Marsaglia and Tsang's rejection, fixed by key and salt."""
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, open_, turn = np.empty(len(a)), np.arange(len(a)), 0
    while len(open_):
        u, angle, test = (uniform(keys[open_], *salt, 3 * turn + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * angle)
        d = a[open_]
        v = (1 + x / np.sqrt(9 * d)) ** 3
        good = (v > 0) & (np.log(test) < x * x / 2 + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[open_[good]] = (d * v)[good]
        open_, turn = open_[~good], turn + 1
    small = np.flatnonzero(shape < 1)
    out[small] *= uniform(keys[small], *salt, -1) ** (1 / shape[small])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers."""
    y, shift = np.array(x, np.float64), 0.0
    while len(y) and y.min() < 7:
        small = y < 7
        shift = shift + np.where(small, np.log(y), 0.0)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def log_seatings(d: float, most: int = FEW) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the seatings of c customers at t tables with discount d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - t * d, 0)))
    return out


def _few_tables(c: np.ndarray, log_a: np.ndarray, u: np.ndarray, seatings: np.ndarray) -> np.ndarray:
    t = np.minimum(c, 1)
    for k in range(2, FEW + 1):
        rows = np.flatnonzero(c == k)
        if len(rows):
            weight = seatings[k, 1 : k + 1] + log_a[rows, None] * np.arange(1, k + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (weight[:, :-1] < (u[rows] * weight[:, -1])[:, None]).sum(axis=1)
    return t


def _crowd(c: np.ndarray, strength: np.ndarray, d: float, keys: np.ndarray, *salt: int) -> np.ndarray:
    """Tables of Chinese restaurants after c customers, seated in blocks of them.

    Customer i opens a table if its draw lies below (strength + d * tables) / (strength + i). In a block this is solved from
    no new table upwards: tables only add openings, and each customer depends on earlier ones alone, so the rounds end at the
    one seating that fits. A block at most doubles a restaurant, which takes few rounds.
    """
    t, n = np.ones(len(c), np.int64), np.ones(len(c), np.int64)
    open_ = np.flatnonzero(n < c)
    while len(open_):
        size = np.minimum(np.minimum(np.maximum(n, 2 * FEW), c - n)[open_], BLOCK)
        now = open_[: max(np.searchsorted(np.cumsum(size), BLOCK, side="right"), 1)]
        size = size[: len(now)]
        first = np.cumsum(size) - size
        at = np.repeat(np.arange(len(now)), size)
        i = np.arange(len(at)) + (n[now] - first)[at]
        s = strength[now][at]
        needed = (uniform(keys[now][at] ^ mix64(i.astype(np.uint64)), *salt) * (s + i) - s) / d - t[now][at]
        new = needed < 0
        while True:
            before = np.cumsum(new) - new
            more = needed < before - before[first][at]
            if (more == new).all():
                break
            new = more
        t[now] += np.add.reduceat(new.astype(np.int64), first)
        n[now] += size
        open_ = open_[n[open_] < c[open_]]
    return t


def _fitting_strength(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """The strength of a restaurant whose expected strength + d * tables after c customers is about a."""
    low, high = np.full(len(c), np.log(1e-6)), np.log(np.maximum(a, 1e-5))
    for _ in range(14):
        middle = (low + high) / 2
        s = np.exp(middle) - d
        above = log_gamma(s + 1) - log_gamma(s + d) + log_gamma(s + d + c) - log_gamma(s + c) > np.log(a)
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return np.exp((low + high) / 2) - d


def tables(c: np.ndarray, log_a: np.ndarray, before: np.ndarray, d: float, seatings: np.ndarray, keys: np.ndarray, *salt: int) -> np.ndarray:
    """New numbers of tables for dishes of c customers, with weight S(c, t) * a ** t; `before` holds the present ones."""
    t = _few_tables(np.where(c > FEW, 0, c), log_a, uniform(keys, *salt, 0), seatings)
    many = np.flatnonzero(c > FEW)
    if len(many):
        k, log_a, old, keys = c[many], log_a[many], before[many], keys[many]
        s = _fitting_strength(k, np.exp(log_a), d)
        new = _crowd(k, s, d, keys, *salt, 1)
        weight = lambda t: t * (log_a - np.log(d)) - log_gamma(s / d + t)
        t[many] = np.where(np.log(uniform(keys, *salt, 2)) < weight(new) - weight(old), new, old)
    return t


def sweep_contexts(c, at, t, sizes, g_root, discount, seatings, keys, contexts, sweep: int) -> np.ndarray:
    """New tables of the dishes (c customers, t tables now, in restaurant `at`) of restaurants with so many tables in all."""
    g = gamma(THETA / discount + sizes, contexts, sweep, 0)
    return tables(c, np.log(discount * g[at] * g_root), t, discount, seatings, keys, sweep, 1)


def sweep_root(c, t, total: int, words: int, discount, seatings, keys, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """New tables of the root's dishes, and its Gamma variables in units of 2 ** -16; `total` is the number of tables now."""
    g = gamma(np.array([THETA / discount + total]), np.zeros(1, np.uint64), sweep, 2)[0]
    seen = c > 0
    log_a = np.full(len(c), np.log(discount * g / (words + 1)))
    t = np.where(seen, tables(c, log_a, np.clip(t, 1, np.maximum(c, 1)), discount, seatings, keys, sweep, 3), 0)
    mass = np.zeros(len(c))
    mass[seen] = gamma((c - discount * t)[seen], keys[seen], sweep, 4)
    return t, np.round(mass * 65536).astype(np.int64)


def rest_of_root(total: int, discount: float, sweep: int) -> float:
    """The Gamma variable of the root's mass beyond its dishes."""
    return float(gamma(np.array([THETA + discount * total]), np.zeros(1, np.uint64), sweep, 5)[0])


# --- messages between parts ----------------------------------------------------------------------------------------------

MESSAGE = "p int, kind int, source long, x long, data binary"
STAT = 9


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same natural numbers in as few bytes as they need."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted natural numbers by their differences, then byte by byte of all numbers, compressed."""
    codec, out = pa.Codec("zstd", 1), []
    for a in arrays:
        sorted_ = a.dtype.kind == "u" and bool((a[1:] >= a[:-1]).all())
        if sorted_:
            a = np.diff(a, prepend=a.dtype.type(0))
        body = codec.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes(), asbytes=True)
        out += [struct.pack("<2s?qq", a.dtype.str[1:].encode(), sorted_, len(a), len(body)), body]
    return b"".join(out)


def _load(raw: bytes) -> list[np.ndarray]:
    """What _dump made bytes of."""
    codec, out, at, header = pa.Codec("zstd"), [], 0, struct.calcsize("<2s?qq")
    while at < len(raw):
        kind, sorted_, n, size = struct.unpack_from("<2s?qq", raw, at)
        kind, at = np.dtype(kind.decode()), at + header
        body = codec.decompress(raw[at : at + size], n * kind.itemsize, asbytes=True)
        a = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=kind) if sorted_ else a)
        at += size
    return out


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (p, kind, source, x, data)."""
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["p", "kind", "source", "x", "data"])


def _counts(**named: int) -> list[tuple]:
    """Numbers that are summed over all parts, by name."""
    return [(-1, STAT, 0, int(x), name.encode()) for name, x in named.items()]


def _totals(sent: DataFrame) -> dict[str, int]:
    rows = sent.filter(F.col("kind") == STAT).groupBy(F.col("data").cast("string").alias("name")).agg(F.sum("x").alias("x"))
    return {r.name: r.x for r in rows.collect()}


def _dealt(sent: DataFrame, parts: int) -> DataFrame:
    return sent.filter(F.col("kind") != STAT).repartition(parts, "p").sortWithinPartitions("p", "kind", "source", "x")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each part with its messages (kind, source, x, data), sorted."""
    p, held = None, []
    for batch in batches:
        for part, *message in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "source", "x", "data"))):
            if part != p and held:
                yield p, held
                held = []
            p = part
            held.append(tuple(message))
    if held:
        yield p, held


def _put(folder: str, name: str, value: dict) -> None:
    """Write a part's state; a repeated task puts the same in its place."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    own = f"{base}/{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        pickle.dump({k: (isinstance(v, np.ndarray), _dump(v) if isinstance(v, np.ndarray) else v) for k, v in value.items()}, out, protocol=5)
    fs.move(own, f"{base}/{name}")


def _get(folder: str, name: str, missing: dict | None = None) -> dict:
    """What was put there; `missing` for parts that had nothing to keep."""
    fs, base = pafs.FileSystem.from_uri(folder)
    if missing is not None and fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
        return missing
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        return {k: _load(v)[0] if packed else v for k, (packed, v) in pickle.load(f).items()}


# --- the stages ----------------------------------------------------------------------------------------------------------


def _frequent(share: float):
    """Contexts that hold a tenth of the share in a window, and (null) the window's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= share / 10 * n
            return pa.RecordBatch.from_arrays(
                [pa.array([*found[many].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[many].tolist(), n], pa.int64())], names=["h", "c"]
            )

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                held.append(tokens_of(data, offsets)[1])
                n += len(held[-1])
                if n >= WINDOW_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return tidy(run)


def _window(tokens, before, lengths, learned, ids, null, seed: int, parts: int, spread: np.ndarray) -> list[tuple]:
    """Messages of one window: its pairs and the places (2 * document + learned) of their tokens, and its documents."""
    key = pair_key(tokens, before)
    found, at, pair, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    window = xxhash.xxh3_64_intdigest(found.tobytes() + ids.tobytes() + lengths.tobytes(), seed=seed) - 2**63
    w, v = tokens[at], before[at]
    order, p = _part(v, w, spread, parts)
    w, v, n = w[order], v[order], n[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = _narrow(np.repeat(2 * np.arange(len(lengths)) + learned, lengths))[np.argsort(rank[pair], kind="stable")]
    ends = np.append(0, np.cumsum(n))
    bounds = np.append(np.flatnonzero(np.diff(p, prepend=-1)), len(p)).tolist()
    home = int(_range(mix64(np.array([window]).view(np.uint64)), parts)[0])
    out = [(home, 1, window, 0, _dump(ids, null, _narrow(lengths)))]
    for i, j in zip(bounds[:-1], bounds[1:]):
        words, w_at = np.unique(w[i:j], return_inverse=True)
        contexts, v_at = np.unique(v[i:j], return_inverse=True)
        out.append((int(p[i]), 0, window, 0, _dump(words, _narrow(w_at), contexts, _narrow(v_at), _narrow(n[i:j]), places[ends[i] : ends[j]])))
    return out


def _send(parts: int, spread: np.ndarray):
    """Windows of (doc_id, text, learned), as messages to the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        task = TaskContext.get().partitionId()

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return _messages(_window(*columns, (task << 24) + n, parts, spread))

        for batch in batches:
            ids, learned = batch.column("doc_id"), batch.column("learned").to_numpy(zero_copy_only=False)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                tokens, before, begin = tokens_of(data, offsets)
                held.append((tokens, before, np.diff(begin), learned[a:b], ids[a:b], null[a:b].astype(np.uint8)))
                size += len(tokens)
                if size >= WINDOW_TOKENS:
                    yield flush()
                    size, n = 0, n + 1
        if held:
            yield flush()

    return tidy(run)


def _to_words(p: int, words: np.ndarray, parts: int, columns: list[np.ndarray]) -> list[tuple]:
    """Messages of a pair part to the parts of its (sorted) words."""
    q = _range(words, parts)
    bounds = np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q)).tolist()
    return [(int(q[i]), 0, p, 0, _dump(*(c[i:j] for c in columns))) for i, j in zip(bounds[:-1], bounds[1:])]


def _spread_counts(name: str, contexts: np.ndarray, spread: np.ndarray, x: np.ndarray) -> list[tuple]:
    place = _place(contexts, spread)
    return _counts(**{f"{name}{place[i]}": x[i] for i in np.flatnonzero(place)})


def _join(folder: str, parts: int, spread: np.ndarray):
    """Joins the pairs of a part from all windows and keeps them; tells the word parts its words, with customers and first tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, messages in _by_part(batches):
            _put(folder, f"documents-{p}", {"windows": [(source, data) for kind, source, _, data in messages if kind == 1]})
            held, windows = [], []
            for kind, source, _, data in messages:
                if kind == 0:
                    words, w_at, contexts, v_at, n, places = _load(data)
                    held.append((words[w_at], contexts[v_at], n.astype(np.int64), places.astype(np.uint32), np.full(len(places), len(windows), np.uint32)))
                    windows.append(source)
            del messages
            if not held:
                continue
            w, v, n, places, window = (np.concatenate(x) for x in zip(*held))
            del held
            order = np.lexsort((w, v))
            starts = (np.cumsum(n) - n)[order]
            w, v, n = w[order], v[order], n[order]
            token = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places, window = places[token], window[token]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
            begin = (np.cumsum(n) - n)[first]
            n = np.add.reduceat(n, first)
            c = np.add.reduceat((places & 1).astype(np.int64), begin)
            words, w_at = np.unique(w[first], return_inverse=True)
            contexts, v_at = np.unique(v[first], return_inverse=True)
            del w, v, order, token
            per = lambda at, x, size: np.bincount(at, weights=x, minlength=size).astype(np.int64)
            _put(folder, f"pairs-{p}", {"w_at": _narrow(w_at), "v_at": _narrow(v_at), "c": _narrow(c), "n": _narrow(n)})
            _put(folder, f"tokens-{p}", {"windows": windows, "window": _narrow(window), "place": _narrow(places >> 1)})
            many, one = np.flatnonzero(c > 1), c == 1
            customers = per(v_at, c, len(contexts))
            _put(folder, f"many-{p}", {
                "words": words, "contexts": contexts, "customers": customers, "w_at": _narrow(w_at[many]), "v_at": _narrow(v_at[many]), "c": c[many],
                "w_ones": per(w_at, one, len(words)), "v_ones": per(v_at, one, len(contexts)),
            })
            dishes = per(v_at, c > 0, len(contexts))
            rows = _to_words(p, words, parts, [words, _narrow(per(w_at, c, len(words))), _narrow(per(w_at, c > 0, len(words)))])
            rows += _counts(once=one.sum(), twice=(c == 2).sum(), tokens=c.sum())
            yield _messages(rows + _spread_counts("customers", contexts, spread, customers) + _spread_counts("tables", contexts, spread, dishes))

    return tidy(run)


def _enrol(folder: str):
    """Keeps the words of a word part, their counts, and which of them each pair part has, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, messages in _by_part(batches):
            asked = [_load(data) for *_, data in messages]
            words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            add = lambda i: np.bincount(at, weights=np.concatenate([a[i] for a in asked]), minlength=len(words)).astype(np.int64)  # noqa: B023, E731
            count, contexts = add(1), add(2)
            _put(folder, f"words-{q}", {"words": words, "count": count, "at": _narrow(at), "sources": [(m[1], len(a[0])) for m, a in zip(messages, asked)]})
            yield _messages(_counts(words=(count > 0).sum(), root_once=(contexts == 1).sum(), root_twice=(contexts == 2).sum()))

    return tidy(run)


def _root(folder: str, m: dict, sweep: int, samples: list[int] | None):
    """A sweep of the root over a word part, given the tables of all contexts; answers with its Gamma variables.

    If samples are given, this is the last one, and the answers are the words' counts and their customers less discounts in
    each sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seatings = log_seatings(m["d"][1])
        for q, messages in _by_part(batches):
            held = _get(folder, f"words-{q}")
            at, n = held["at"], len(held["words"])
            c = np.bincount(at, weights=np.concatenate([_load(data)[-1] for *_, data in messages]), minlength=n).astype(np.int64)
            t = _get(folder, f"root-{q}-{sweep - 1}")["t"].astype(np.int64) if sweep else np.ones(n, np.int64)
            t, mass = sweep_root(c, t, m["root_tables"], m["words"], m["d"][1], seatings, held["words"], sweep)
            _put(folder, f"root-{q}-{sweep}", {"t": _narrow(t), "r": (c - m["d"][1] * t).astype(np.float32)})
            if samples is None:
                columns = [(mass / 65536).astype(np.float32)]
            else:
                columns = [_narrow(held["count"]), *(_get(folder, f"root-{q}-{k}")["r"] for k in samples)]
            rows, begin = _counts(mass=mass.sum(), customers=c.sum(), tables=t.sum()), 0
            for p, size in held["sources"]:
                own = at[begin : begin + size]
                rows.append((p, 0, q, 0, _dump(*(x[own] for x in columns))))
                begin += size
            yield _messages(rows)

    return tidy(run)


def _answers(messages: list[tuple]) -> list[np.ndarray]:
    """The columns of a pair part's words, from the answers of the word parts in order."""
    return [np.concatenate(x) for x in zip(*(_load(data) for *_, data in messages))]


def _override(contexts: np.ndarray, spread: np.ndarray, own: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Numbers of a part's contexts, those of spread contexts over all parts."""
    place = _place(contexts, spread)
    return np.where(place > 0, np.append(0, totals)[place], own)


def _contexts(folder: str, parts: int, m: dict, sweep: int):
    """A sweep over the contexts of a pair part, given the root's distribution; tells the word parts the new tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seatings = log_seatings(m["d"][0])
        for p, messages in _by_part(batches):
            (mass,) = _answers(messages)
            held = _get(folder, f"many-{p}")
            words, contexts, w_at, v_at, c = (held[k] for k in ("words", "contexts", "w_at", "v_at", "c"))
            g_root = (mass + m["rest"] / (m["words"] + 1)) / (m["mass"] + m["rest"])
            t = _get(folder, f"tables-{p}-{sweep - 1}")["t"].astype(np.int64) if sweep else np.ones(len(c), np.int64)
            per = lambda at, x, ones: ones + np.bincount(at, weights=x, minlength=len(ones)).astype(np.int64)
            sizes = _override(contexts, m["spread"], per(v_at, t, held["v_ones"]), m["spread_tables"])
            t = sweep_contexts(c, v_at, t, sizes, g_root[w_at], m["d"][0], seatings, pair_key(words[w_at], contexts[v_at]), contexts, sweep)
            _put(folder, f"tables-{p}-{sweep}", {"t": _narrow(t)})
            sizes = per(v_at, t, held["v_ones"])
            yield _messages(_to_words(p, words, parts, [_narrow(per(w_at, t, held["w_ones"]))]) + _spread_counts("tables", contexts, m["spread"], sizes))

    return tidy(run)


def _score(folder: str, parts: int, m: dict):
    """The averaged predictive probabilities of a part's tokens, as sums by document to the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = m["d"][0]
        for p, messages in _by_part(batches):
            count, *roots = _answers(messages)
            many, pairs = _get(folder, f"many-{p}"), _get(folder, f"pairs-{p}")
            contexts, w_at, v_at, c = many["contexts"], pairs["w_at"], pairs["v_at"], pairs["c"].astype(np.float64)
            strength = THETA + _override(contexts, m["spread"], many["customers"], m["spread_customers"])
            t, passed_on = np.minimum(c, 1), np.zeros(len(c))
            several = np.flatnonzero(c > 1)
            t[several] = 0
            for sample, r, spread_tables, root, base in zip(m["samples"], roots, m["sampled_tables"], m["sampled_root"], m["sampled_base"]):
                own = _get(folder, f"tables-{p}-{sample}")["t"].astype(np.int64)
                t[several] += own / len(roots)
                sizes = many["v_ones"] + np.bincount(many["v_at"], weights=own, minlength=len(contexts))
                weight = (THETA + d * _override(contexts, m["spread"], sizes, spread_tables)) / strength
                passed_on += weight[v_at] * (r.astype(np.float64) / root + base)[w_at] / len(roots)
            score = np.log10((c - d * t) / strength[v_at] + passed_on)
            del t, passed_on, c, strength, several
            held = _get(folder, f"tokens-{p}")
            pair = np.repeat(np.arange(len(score)), pairs["n"])
            docs, at = np.unique((held["window"].astype(np.int64) << 32) | held["place"], return_inverse=True)
            sums = [np.bincount(at, minlength=len(docs))]
            for x in (count > 0, np.log10(count + 0.1)):
                sums.append(np.bincount(at, weights=x[w_at][pair], minlength=len(docs)))
            sums.append(np.bincount(at, weights=score[pair], minlength=len(docs)))
            bounds = np.searchsorted(docs >> 32, np.arange(len(held["windows"]) + 1)).tolist()
            homes = _range(mix64(np.array(held["windows"], np.int64).view(np.uint64)), parts).tolist()
            rows = []
            for home, window, i, j in zip(homes, held["windows"], bounds[:-1], bounds[1:]):
                rows.append((home, 1, window, p, _dump((docs[i:j] & 0xFFFFFFFF), _narrow(sums[0][i:j]), _narrow(sums[1][i:j].astype(np.int64)), sums[2][i:j], sums[3][i:j])))
            yield _messages(rows)

    return tidy(run)


def _documents(folder: str):
    """The documents that the parts (p) keep for windows, as messages to these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield _messages([(p, 0, window, 0, data) for window, data in _get(folder, f"documents-{p}", {"windows": []})["windows"]])

    return tidy(run)


SUMS = "doc_id long, n_tokens long, n_known long, base double, score double"


@tidy
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: its sums over all parts."""
    for _, messages in _by_part(batches):
        held = {}
        for kind, window, _, data in messages:
            if kind == 0:
                ids, null, lengths = _load(data)
                held[window] = (ids, null, lengths, np.zeros((4, len(ids))))
            else:
                docs, *sums = _load(data)
                held[window][3][:, docs] += sums
        for ids, null, lengths, (n, known, base, score) in held.values():
            if (n != lengths).any():
                raise ValueError("tokens are missing: a task that ran twice gave other windows")
            columns = [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "score"])


def _forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that are written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pitman_yor(rows: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, share: float = SPREAD_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row (doc_id, text, learned).

    The model learns from the rows that `learned` marks.
    """
    spark = rows.sparkSession
    seen = materialize(rows.select("text").mapInArrow(_frequent(share), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    every = seen.filter("h is null").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    frequent = seen.filter(F.col("h").isNotNull() & (F.col("c") >= 0.9 * share * every)).select("h").collect()
    spread = np.sort(np.array([r.h for r in frequent], np.int64).view(np.uint64))
    parts, folder = 4 + every // PART_TOKENS, fresh_path(spark, "model")

    def stage(messages: DataFrame, run, name: str) -> tuple[DataFrame, dict[str, int]]:
        out = materialize(_dealt(messages, parts).mapInArrow(run, MESSAGE), name)
        del messages  # callers hold no other reference
        _forget(spark)
        return out, _totals(out)

    def of_spread(totals: dict, name: str) -> np.ndarray:
        return np.array([totals.get(f"{name}{i + 1}", 0) for i in range(len(spread))], np.int64)

    asked, totals = stage(rows.select("doc_id", "text", "learned").mapInArrow(_send(parts, spread), MESSAGE), _join(folder, parts, spread), "asked")
    _, of_words = stage(asked, _enrol(folder), "enrolled")
    tokens, words = totals.get("tokens", 0), of_words.get("words", 0)
    discount = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95))
    d = (discount(totals.get("once", 0), totals.get("twice", 0)), discount(of_words.get("root_once", 0), of_words.get("root_twice", 0)))
    m = {"d": d, "words": words, "spread": spread, "spread_customers": of_spread(totals, "customers"), "root_tables": words}
    tables_of_spread, roots = [of_spread(totals, "tables")], []
    sampled = list(range(burn_in, burn_in + samples))
    for sweep in range(burn_in + samples + 1):
        last = sweep == burn_in + samples
        answers, root = stage(asked, _root(folder, m, sweep, [k + 1 for k in sampled] if last else None), "answers")
        roots.append((root.get("customers", 0), root.get("tables", 0)))
        m["root_tables"] = roots[-1][1]
        if not last:
            m |= {"mass": root.get("mass", 0) / 65536, "rest": rest_of_root(roots[-1][1], d[1], sweep), "spread_tables": tables_of_spread[-1]}
            asked, totals = stage(answers, _contexts(folder, parts, dict(m), sweep), "asked")
            tables_of_spread.append(of_spread(totals, "tables"))
    m |= {
        "samples": sampled,
        "sampled_tables": [tables_of_spread[k + 1] for k in sampled],
        "sampled_root": [THETA + roots[k + 1][0] for k in sampled],
        "sampled_base": [(THETA + d[1] * roots[k + 1][1]) / (THETA + roots[k + 1][0]) / (words + 1) for k in sampled],
    }
    scored = _dealt(answers, parts).mapInArrow(_score(folder, parts, m), MESSAGE)
    kept = spark.range(parts).select(F.col("id").cast("int").alias("p")).mapInArrow(_documents(folder), MESSAGE)
    sums = _dealt(scored.unionByName(kept), parts).mapInArrow(_gather, SUMS)
    share_ = float(np.log10(tokens + 0.1 * (words + 1)))
    return sums.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * share_).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(True))


def score_corpus(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("learned", ~held_out(F.col("doc_id")))
    out = pitman_yor(rows, **options)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])


def held_out_perplexity(scored: DataFrame) -> float | None:
    """The perplexity of all held-out documents together."""
    held = scored.filter("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-held.s / held.n) if held.n else None


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(read_table(spark, sf_dir, "documents"))
