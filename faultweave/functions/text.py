"""String and token functions as Column builders; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultweave.functions import rules as R


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise_message(text: Column) -> Column:
    for pattern, by in R.NORMALISE:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def fatal_template(text: Column) -> Column:
    """A normalised fatal report without its place."""
    return F.regexp_replace(normalise_message(text), R.FATAL_HEAD, "UVM_FATAL ")


def test_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z_]+", " ")


def resolve_path(base: str, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def length_bucket(total: Column) -> Column:
    out = F.lit(R.LONGEST)
    for below, name in reversed(R.LENGTHS):
        out = F.when(total < below, F.lit(name)).otherwise(out)
    return out


def retire_bucket(retire: Column) -> Column:
    return F.least(F.floor(retire / 100), F.lit(999)).cast("long")


def bucket_name(label: Column) -> Column:
    return F.concat(F.lit("bucket_"), label.cast("string"))


def clean_tokens(blob: Column) -> Column:
    """Lower-case tokens without the noise ones, equal neighbours once."""
    tokens = F.filter(F.split(F.lower(F.trim(blob)), r"\s+"), lambda t: (t != "") & ~t.isin(R.NOISE_TOKENS) & ~t.rlike(R.NOISE_PATTERN))
    return let(tokens, lambda ts: F.filter(ts, lambda t, i: (i == 0) | (t != F.get(ts, i - 1))))


def clean_blob(blob: Column) -> Column:
    return F.array_join(clean_tokens(blob), " ")


def or_placeholder(text: Column, case: Column) -> Column:
    return F.when(F.length(text) == 0, F.concat(F.lit("empty_case_"), case.cast("string"))).otherwise(text)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z_][A-Za-z0-9_<>]+"), F.lit(0))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of low to high tokens, joined by a space."""

    def of(ts: Column) -> Column:
        def size(n: int) -> Column:
            made = F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.array_join(F.slice(ts, i + 1, F.lit(n)), " "))
            return F.when(F.size(ts) >= n, made).otherwise(F.array().cast("array<string>"))

        return F.concat(*[size(n) for n in range(low, high + 1)])

    return let(tokens, of)


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Substrings of low to high characters of each white-space word with one space at either side; a word that is no longer than n is taken whole once, and then no larger n."""

    def of(word: Column) -> Column:
        length = F.length(word)

        def size(n: int) -> Column:
            made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1)), lambda i: F.substring(word, i, F.lit(n)))
            # n - 1 characters or fewer were taken whole at an earlier n
            return F.when((length >= n) if n > low else F.lit(True), made).otherwise(F.array().cast("array<string>"))

        return F.concat(*[size(n) for n in range(low, high + 1)])

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: let(F.concat(F.lit(" "), w, F.lit(" ")), of)))


def ascii_histogram(text: Column) -> Column:
    """128 counts of the ASCII characters in a text."""
    empty = F.array_repeat(F.lit(0.0), 128)
    marks = F.filter(F.transform(F.split(text, ""), F.ascii), lambda a: (a >= 1) & (a < 128))

    def counted(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda c: F.size(F.filter(found, lambda a: a == c)).cast("double"))

    return F.when((text.isNull()) | (text == ""), empty).otherwise(let(marks, counted))
