"""Secret scans with a randomness test battery, in DataFrame expressions only.

Base kinds are patterns: assignments of a value to a secret-like name, access keys, and long runs of hex digits. The
battery adds spans of kind `random`: runs of at least MIN_RUN characters of the base64 alphabets. The encoding of a run is
inferred (hex, base32, base64), and three tests ask whether its characters look drawn uniformly from that alphabet:

* chi-squared: how evenly the characters of the alphabet are used (mean and variance of the statistic are exact for the
  length, so short runs are judged fairly);
* runs: how often the lower and the upper half of the alphabet alternate (Wald and Wolfowitz);
* serial correlation of the characters' values at lag 1.

Fisher's method makes one p-value of the three. It is uniform on random strings and close to 0 on structured ones. What is
controlled is the share of structured strings among the reported ones, within each class of length, since short strings
give weak tests: runs with p >= 0.5 tell how many random strings there are, hence how many of those above a lower bound
are in excess. The lowest bound with an excess of at most FALSE_SHARE holds. To the counts of each class, whatever its size, come
those of PRIOR_RUNS random runs and of as many structured ones as make PRIOR_BOUND the bound of a class without runs; the
more runs a class has, the less they weigh. The counts come from all documents; they are a small table of fixed size.

Texts are read once: spans and p-values are written out, bounds are taken from them and applied to them. Texts aren't
shuffled. Cases: a null text counts as empty; an empty text has no
spans. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.text import let, matches
from chorale.llm.common import materialize, read_table

#: Patterns of the base kinds (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

KINDS = ["assign", "access", "hex", "random"]
ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
MIN_RUN = 20
LENGTH_CLASSES = [32, 48, 96]
BOUNDS = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5]
FALSE_SHARE, PRIOR_BOUND, PRIOR_RUNS = 0.05, 0.05, 30

SPAN = "struct<start:bigint,rank:int,stop:bigint>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def _span(m: Column, end: Column, rank: int) -> Column:
    return F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("stop"))


def base_spans(text: Column) -> list[Column]:
    """Per base kind an array of spans, in order."""

    def assign(m: Column, ends: Column) -> Column:
        spans = F.transform(m, lambda x, i: F.when(F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6, _span(x, F.get(ends, i), 0)))
        return F.filter(spans, lambda s: s.isNotNull())

    def long_enough(rank: int, least: int) -> Callable[[Column, Column], Column]:
        def body(m: Column, ends: Column) -> Column:
            spans = F.transform(m, lambda x, i: F.when(F.length(x) >= least, _span(x, F.get(ends, i), rank)))
            return F.filter(spans, lambda s: s.isNotNull())

        return body

    return [
        matches(text, ASSIGN, assign, NO_SPANS),
        matches(text, ACCESS, long_enough(1, 20), NO_SPANS),
        matches(text, HEX, long_enough(2, 24), NO_SPANS),
    ]


# --- the battery -----------------------------------------------------------------------------------------------------


def upper_tail(z: Column) -> Column:
    """The normal upper tail to about 1e-4, not below 1e-12."""
    return F.greatest(F.lit(1e-12), 1 / (1 + F.exp(F.least(F.lit(40.0), 0.07056 * z * z * z + 1.5976 * z))))


def _tests(s: Column, k: int) -> Column:
    """Fisher's combination of the three tests for a string over the alphabet of size k."""
    alphabet = ALPHABETS[k]
    n = F.length(s).cast("double")
    square = F.aggregate(
        F.array(*(F.lit(c) for c in alphabet)), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0))
    )
    chi = (k * square / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    half = F.translate(s, alphabet, "0" * (k // 2) + "1" * (k // 2))
    count = lambda b, part: (F.length(b) - F.length(F.replace(b, F.lit(part), F.lit("")))).cast("double") / len(part)

    def runs(b: Column) -> Column:
        product = 2 * count(b, "0") * count(b, "1")
        variance = product * (product - n) / (n * n * (n - 1))
        z = (count(b, "01") + count(b, "10") - product / n) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
        return F.when(variance > 0, F.abs(z)).otherwise(F.lit(9.0))

    def serial(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

        def around(mean: Column) -> Column:
            spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            near = F.aggregate(
                F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)),
                F.lit(0.0),
                lambda a, v: a + v,
            )
            return F.when(spread > 0, F.abs((near / F.when(spread > 0, spread) + 1 / n) * F.sqrt(n))).otherwise(F.lit(9.0))

        return let(total / n, around)

    values = F.transform(F.split(s, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
    y = -(F.ln(upper_tail(chi)) + F.ln(F.least(F.lit(1.0), 2 * upper_tail(let(half, runs)))) + F.ln(F.least(F.lit(1.0), 2 * upper_tail(let(values, serial)))))
    # the upper tail of chi-squared with 6 degrees of freedom at 2 y
    return let(y, lambda v: F.exp(-v) * (1 + v + v * v / 2))


def p_random(run: Column) -> Column:
    """The p-value of a run under its inferred encoding; separators and padding of base64 are normalised first."""
    hexed, plain = F.lower(run), F.translate(run, "-_=", "+/")
    test = lambda s, k: F.when(F.length(s) >= 8, let(s, lambda v: _tests(v, k))).otherwise(F.lit(0.0))
    return (
        F.when(run.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), test(hexed, 16))
        .when(run.rlike("^[A-Z2-7]+=*$"), test(F.replace(run, F.lit("="), F.lit("")), 32))
        .otherwise(test(plain, 64))
    )


def candidates(text: Column) -> Column:
    """array<struct<span, klass, p>> of all runs."""

    def body(m: Column, ends: Column) -> Column:
        return F.transform(
            m,
            lambda x, i: F.struct(
                _span(x, F.get(ends, i), 3).alias("span"),
                sum(((F.length(x) >= cut).cast("int") for cut in LENGTH_CLASSES), F.lit(0)).alias("klass"),
                p_random(x).alias("p"),
            ),
        )

    return matches(text, RUN, body, f"cast(array() as array<struct<span:{SPAN},klass:int,p:double>>)")


def _estimates(b, upper, above):
    """The estimated numbers of structured runs with p >= b and of all runs with p >= b, both with the prior's."""
    prior = PRIOR_RUNS * FALSE_SHARE * PRIOR_BOUND / b
    return above - 2 * upper * (1 - b) + prior, above + PRIOR_RUNS * (1 - b) + prior


def bounds_of(runs: DataFrame) -> list[float]:
    """Per class of length the least p that is reported, from all runs (klass, p)."""
    above = [F.count_if(F.col("p") >= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    counts = {row.klass: [row[f"b{i}"] for i in range(len(BOUNDS))] for row in runs.groupBy("klass").agg(*above).collect()}
    out = []
    for klass in range(len(LENGTH_CLASSES) + 1):
        n = counts.get(klass, [0] * len(BOUNDS))
        shares = [_estimates(b, n[-1], k) for b, k in zip(BOUNDS, n)]
        # (at 0.5 the estimate is the prior's alone, so there is always one)
        out.append(next(b for b, (structured, every) in zip(BOUNDS, shares) if structured <= FALSE_SHARE * every + 1e-9))
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for c, k in zip(base_spans(text), KINDS)), candidates(text).alias("runs")
    )
    found = materialize(found, "secret-spans")
    least = F.array(*map(F.lit, bounds_of(found.select(F.explode("runs").alias("c")).select("c.klass", "c.p"))))
    kept = F.filter("runs", lambda x: x["p"] >= F.get(least, x["klass"]))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.transform(kept, lambda x: x["span"]))).alias("spans"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def _located_sql(name: str, pattern: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""{name}_m AS (SELECT rid, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS k, parts FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS parts FROM t)),
{name} AS (SELECT rid, m, CAST(sum(length(parts[k]) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS stop FROM {name}_m)"""


def _tail_sql(z: str) -> str:
    return f"greatest(1e-12, 1 / (1 + exp(least(40.0, 0.07056 * {z} * {z} * {z} + 1.5976 * {z}))))"


_KLASS_SQL = " + ".join(f"CAST(length(m) >= {c} AS INT)" for c in LENGTH_CLASSES)
_ALPHABET_SQL = "CASE k " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in ALPHABETS.items()) + " END"
_HALVES_SQL = "CASE k " + " ".join(f"WHEN {k} THEN '{'0' * (k // 2)}{'1' * (k // 2)}'" for k in ALPHABETS) + " END"
_BOUNDS_SQL = ", ".join(map(str, BOUNDS))
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_located_sql("a", ASSIGN)}, {_located_sql("b", ACCESS)}, {_located_sql("h", "[0-9a-f]{24,}")}, {_located_sql("r", "[A-Za-z0-9+/_=-]{20,}")},
base AS (SELECT rid, stop - length(m) AS start, 0 AS rank, stop FROM a WHERE length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= 6
  UNION ALL SELECT rid, stop - length(m), 1, stop FROM b WHERE length(m) >= 20 UNION ALL SELECT rid, stop - length(m), 2, stop FROM h WHERE length(m) >= 24),
enc AS (SELECT *, {_KLASS_SQL} AS klass, CASE WHEN regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') THEN 16 WHEN regexp_full_match(m, '[A-Z2-7]+=*') THEN 32 ELSE 64 END AS k FROM r),
nor AS (SELECT *, CASE k WHEN 16 THEN lower(m) WHEN 32 THEN replace(m, '=', '') ELSE replace(translate(m, '-_', '+/'), '=', '') END AS s, {_ALPHABET_SQL} AS al FROM enc),
one AS (SELECT *, CAST(length(s) AS DOUBLE) AS n, list_sum([pow(length(s) - length(replace(s, c, '')), 2) FOR c IN string_split(al, '')]) AS sq, translate(s, al, {_HALVES_SQL}) AS half,
  [CAST(strpos(al, c) - 1 AS DOUBLE) FOR c IN string_split(s, '')] AS x FROM nor WHERE length(s) >= 8),
two AS (SELECT *, (k * sq / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, 2 * (n - length(replace(half, '0', ''))) * (n - length(replace(half, '1', ''))) AS pr,
  (n - length(replace(half, '01', ''))) / 2 + (n - length(replace(half, '10', ''))) / 2 AS turns, list_sum(x) / n AS mean FROM one),
thr AS (SELECT *, pr * (pr - n) / (n * n * (n - 1)) AS var, list_sum([(v - mean) * (v - mean) FOR v IN x]) AS spread, list_sum([(x[i] - mean) * (x[i + 1] - mean) FOR i IN range(1, len(x))]) AS near FROM two),
fou AS (SELECT *, CASE WHEN var > 0 THEN abs((turns - pr / n) / sqrt(greatest(var, 1e-9))) ELSE 9.0 END AS runs, CASE WHEN spread > 0 THEN abs((near / nullif(spread, 0) + 1 / n) * sqrt(n)) ELSE 9.0 END AS serial FROM thr),
fiv AS (SELECT *, -(ln({_tail_sql("chi")}) + ln(least(1.0, 2 * {_tail_sql("runs")})) + ln(least(1.0, 2 * {_tail_sql("serial")}))) AS y FROM fou),
cand AS (SELECT rid, stop - length(m) AS start, stop, klass, exp(-y) * (1 + y + y * y / 2) AS p FROM fiv UNION ALL SELECT rid, stop - length(m), stop, klass, 0.0 FROM nor WHERE length(s) < 8),
up AS (SELECT klass, count(*) FILTER (p >= 0.5) AS u FROM cand GROUP BY klass),
ok AS (SELECT c.klass, b.b, any_value(u) AS u, count(*) FILTER (p >= b.b) AS n FROM cand c JOIN up USING (klass), (SELECT CAST(unnest([{_BOUNDS_SQL}]) AS DOUBLE) AS b) b GROUP BY c.klass, b.b),
bo AS (SELECT klass, min(b) FILTER (n - 2 * u * (1 - b) + {PRIOR_RUNS * FALSE_SHARE * PRIOR_BOUND} / b <= {FALSE_SHARE} * (n + {PRIOR_RUNS} * (1 - b) + {PRIOR_RUNS * FALSE_SHARE * PRIOR_BOUND} / b) + 1e-9) AS bound FROM ok GROUP BY klass),
alls AS (SELECT * FROM base UNION ALL SELECT rid, start, 3, stop FROM cand JOIN bo USING (klass) WHERE p >= bound),
per AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg((['assign', 'access', 'hex', 'random'])[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3), '') AS bs,
  string_agg((['assign', 'access', 'hex', 'random'])[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM alls GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN per USING (rid)
"""
