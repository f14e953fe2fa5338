"""Text functions as column expressions: no Python runs for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions import cues


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body or a lambda in it uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def running_sum(numbers: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array of long, by sums of blocks, so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def with_blocks(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(
            before,
            lambda base: F.transform(
                numbers,
                lambda _, i: F.get(base, F.floor(i / block).cast("int")) + total(F.slice(numbers, (i - i % block) + 1, i % block + 1)),
            ),
        )

    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(numbers, b * block + 1, F.lit(block))))
    return let(sums, with_blocks)


def matches(text: Column, pattern: str, body: Callable[[Column, Column], Column], empty: str) -> Column:
    """body(matched strings, ends in code points) of the leftmost non-overlapping matches, or `empty` where none is."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def located(m: Column) -> Column:
        steps = let(between, lambda parts: F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(parts, i))).cast("long")))
        return let(let(steps, running_sum), lambda ends: body(m, ends))

    return F.when(text.rlike(pattern), let(found, located)).otherwise(F.expr(empty))


def windows(text: Column, pattern: str, around: int) -> Column:
    """array<string>: the text from `around` characters before each match to as many after it, cut at the text's ends."""

    def body(m: Column, ends: Column) -> Column:
        begin = lambda x, i: F.greatest(F.lit(0).cast("long"), F.get(ends, i) - F.length(x) - around)
        return F.transform(m, lambda x, i: F.substring(text, (begin(x, i) + 1).cast("int"), (F.get(ends, i) + around - begin(x, i)).cast("int")))

    return matches(text, pattern, body, "cast(array() as array<string>)")


def tokens(text: Column) -> Column:
    """Words of two characters at least, lower-cased, in any script, repeated ones kept (for TF-IDF)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Runs of two Latin or Hangul letters at least, lower-cased, repeated ones kept (for distinct-n and BLEU)."""
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z가-힣]{2,}"), F.lit(0)), lambda w: F.lower(w))


def letters(text: Column, least: int) -> Column:
    """Distinct lower-cased runs of `least` ASCII letters at least."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-zA-Z]{{{least},}}"), F.lit(0)))


def significant_words(text: Column) -> Column:
    return F.array_except(letters(text, 4), F.array(*(F.lit(w) for w in cues.STOPWORDS)))


def ngrams(words: Column, n: int) -> Column:
    """array<array<string>> of n neighbouring words; empty if there are fewer."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
    grams = let(words, lambda w: F.transform(places, lambda i: F.slice(w, i, F.lit(n))))
    return F.filter(grams, lambda g: F.size(g) == n)


def after_deontic(fact: Column) -> Column:
    """What follows the first must, can or cannot; the whole text if none does."""
    rest = F.regexp_extract(fact, r"(?is)\b(?:must|can|cannot)\b\s+([^\n]*)", 1)
    return F.when(fact.rlike(r"(?is)\b(?:must|can|cannot)\b\s+"), rest).otherwise(fact)


def clauses(text: Column) -> Column:
    """Parts between . ! ? and ; without blanks around them, empty ones left out."""
    return F.filter(F.transform(F.split(text, "[.!?;]"), lambda c: F.trim(c)), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def role_type(role: Column) -> Column:
    return F.substring_index(role, ":", 1)


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(text, p))


CANDIDATES = "array<struct<raw:string,class:string,value:double>>"


def numeric_candidates(text: Column) -> Column:
    """Percentages, amounts, years and counts with commas: array of raw text, class and normalised value.

    Looks at 8 characters before a number and 15 after it. A percent sign comes first, then a scale or a currency, then
    four digits that begin with 19 or 20, then a comma; other numbers are left out.
    """

    def one(m: Column, end: Column) -> Column:
        begin = end - F.length(m)
        left = F.greatest(F.lit(0).cast("long"), begin - 8)
        before = F.lower(F.substring(text, (left + 1).cast("int"), (begin - left).cast("int")))
        after = F.substring(text, (end + 1).cast("int"), F.lit(15))
        number = F.replace(m, F.lit(",")).cast("double")
        scale_text = F.regexp_extract(F.lower(after), r"(?U)^\s?(billion|million|thousand|k(?![a-z])|억|만)", 0)
        scale = F.trim(F.regexp_extract(F.lower(after), r"(?U)^\s?(billion|million|thousand|k(?![a-z])|억|만)", 1))
        currency = contains_any(before, cues.CURRENCIES) | contains_any(F.substring(F.lower(after), 1, 6), cues.CURRENCIES)
        short = F.when(currency & (scale == ""), F.regexp_extract(after, r"^(M|B)(?![a-zA-Z])", 1)).otherwise(F.lit(""))
        percent = F.regexp_extract(after, r"(?U)^\s*%", 0)
        factor = F.lit(1.0)
        for name, times in cues.SCALES.items():
            factor = F.when(scale == name, F.lit(times)).otherwise(factor)
        for name, times in cues.ABBREVIATIONS.items():
            factor = F.when(short == name, F.lit(times)).otherwise(factor)
        kind = (
            F.when(percent != "", F.lit("percent"))
            .when((scale != "") | currency, F.lit("amount"))
            .when(m.rlike(r"^(19|20)\d{2}$"), F.lit("year"))
            .when(F.contains(m, F.lit(",")), F.lit("amount"))
        )
        value = F.when(kind == "amount", number * factor).otherwise(number)
        tail = F.when(percent != "", percent).when(short != "", short).otherwise(scale_text)
        return F.struct(F.trim(F.concat(m, tail)).alias("raw"), kind.alias("class"), value.alias("value"))

    def body(m: Column, ends: Column) -> Column:
        return F.filter(F.transform(m, lambda x, i: one(x, F.get(ends, i))), lambda c: c["class"].isNotNull())

    return matches(text, cues.NUMBER, body, f"cast(array() as {CANDIDATES})")
