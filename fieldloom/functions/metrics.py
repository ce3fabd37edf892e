"""Scores of extracted values as column expressions; Python only where words must be counted in long texts or aligned."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .bags import bag_f1, grams_f1, lcs_f1, word_tokens

MATCH_AT = 0.9
BLANKS = r"(?U)\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), BLANKS), lambda w: w != "")


@pandas_udf(T.DoubleType())
def word_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """bag_f1 as a column."""
    return pd.Series(map(bag_f1, a, b), dtype=float)


@pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words (letters, digits and _ only, lower case)."""
    return pd.Series([lcs_f1(word_tokens(x), word_tokens(y)) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("jac", "r1", "r2", "rl")]))
def text_measures(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """token_jaccard, rouge_n of single words and of pairs, and rouge_l of two texts whose words are taken once; pairs of equal texts once."""

    def one(x, y):
        if x == y:
            return 1.0, 1.0, 1.0, 1.0
        p, q = word_tokens(x), word_tokens(y)
        return len({*p} & {*q}) / len({*p} | {*q}) if p or q else 1.0, grams_f1(p, q, 1), grams_f1(p, q, 2), lcs_f1(p, q)

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["jac", "r1", "r2", "rl"], dtype=float)


def sequence_ratio_within(most_chars: int | None):
    """difflib's ratio of the first most_chars characters, or of whole texts with None."""

    @pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, (x or "")[:most_chars], (y or "")[:most_chars]).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


sequence_ratio = sequence_ratio_within(5000)


@pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of an HTML fragment, all entities decoded."""
    from ..rx import html_to_text

    return s.map(html_to_text)


@pandas_udf(T.BooleanType())
def dates_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether both texts name the same day, read leniently."""
    from dateutil import parser

    def day(s):
        try:
            return parser.parse(s, fuzzy=True).date() if s else None
        except (ValueError, OverflowError, TypeError):
            return None

    return pd.Series([(x := day(p)) is not None and x == day(q) for p, q in zip(a, b, strict=True)], dtype=bool)


def rouge_tokens(text: Column) -> Column:
    return words(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\s]", " "))


def rouge_n(a: Column, b: Column, n: int) -> Column:
    """F1 of bags of word n-grams; both without any: 1."""

    @pandas_udf(T.DoubleType())
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([grams_f1(list(x), list(y), n) for x, y in zip(p, q, strict=True)], dtype=float)

    return run(rouge_tokens(a), rouge_tokens(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(rouge_tokens(a)), F.array_distinct(rouge_tokens(b)))


def without_space(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, BLANKS, ""))


def joined(values: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(values, " "), BLANKS, " "))


def raw_score(gt: Column, pred: Column, metric: Column) -> Column:
    """The unrounded score; null without ground truth, 0 without a prediction."""
    same = F.when(joined(gt) == joined(pred), 1.0).otherwise(0.0)
    # Spark computes this for every row, so rows that don't need it send nulls
    by_words = ~F.coalesce(metric, F.lit("")).isin("jaccard", "exact_match") & (F.size(gt) > 0) & (F.size(pred) > 0)
    words_of = word_f1(F.when(by_words, F.array_join(gt, " ")), F.when(by_words, F.array_join(pred, " ")))
    score = F.when(metric == "jaccard", jaccard(without_space(gt), without_space(pred))).when(metric == "exact_match", same).otherwise(words_of)
    return F.when(F.size(F.coalesce(gt, F.array())) == 0, None).when(F.size(F.coalesce(pred, F.array())) == 0, 0.0).otherwise(score)


def score_label(raw: Column) -> Column:
    return F.when(raw >= MATCH_AT, "MATCH").when(raw > 0, "PARTIAL").otherwise("WRONG")


def label_of(raw: Column, gt: Column, pred: Column) -> Column:
    return F.when(F.size(F.coalesce(gt, F.array())) == 0, "NO_GT").when(F.size(F.coalesce(pred, F.array())) == 0, "MISS").otherwise(score_label(raw))


def pair_agreement(raw: Column, a: Column, b: Column) -> Column:
    """Two predictions against each other: null if both found nothing, 0 if one did, else their score."""
    none = lambda x: F.size(F.coalesce(x, F.array())) == 0
    return F.when(none(a) & none(b), None).when(none(a) | none(b), 0.0).otherwise(raw)


def pair_similarity(raw: Column, a: Column, b: Column) -> Column:
    """Two annotators' values: alike if both found nothing, 0 if one did, else their score."""
    none = lambda x: F.size(F.coalesce(x, F.array())) == 0
    return F.when(none(a) & none(b), 1.0).when(none(a) | none(b), 0.0).otherwise(raw)


def text_label(extracted: Column, gt: Column, is_date: Column, same_day: Column, similarity: Column) -> Column:
    """(score, label) of a single text: dates match by day; others are PARTIAL at best."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    pair = lambda s, label: F.struct(F.lit(s).cast("double").alias("score") if not isinstance(s, Column) else s.alias("score"), F.lit(label).alias("label"))
    return F.when(empty(extracted), pair(0.0, "NULL")).when(empty(gt), pair(-1.0, "NO_GT")).when(is_date & same_day, pair(1.0, "MATCH")).when(similarity > 0, pair(similarity, "PARTIAL")).otherwise(pair(0.0, "WRONG"))


def image_label(extracted: Column, gt: Column) -> Column:
    """(score, label) of sets of image addresses; PARTIAL at best."""
    pair = lambda s, label: F.struct(s.cast("double").alias("score"), F.lit(label).alias("label"))
    score = jaccard(F.array_distinct(extracted), F.array_distinct(gt))
    return F.when(F.size(extracted) == 0, pair(F.lit(0.0), "NULL")).when(F.size(gt) == 0, pair(F.lit(-1.0), "NO_GT")).when(score > 0, pair(score, "PARTIAL")).otherwise(pair(F.lit(0.0), "WRONG"))


def same_texts(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same texts but for white space and order."""
    return F.sort_array(without_space(a)) == F.sort_array(without_space(b))


def char_entropy(text: Column) -> Column:
    """Bits per character of a text by its own character frequencies; 0 for an empty one."""
    chars = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""))
    counts = F.transform(chars, lambda c: F.struct((F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n"), F.length(text).alias("s")))
    return F.when(F.length(text) > 0, -F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["n"] / x["s"] * F.log2(x["n"] / x["s"]))).otherwise(0.0)


def first_sentence(text: Column) -> Column:
    """Up to the first . ! or ?, else the first 80 characters and an ellipsis."""
    found = F.regexp_extract(text, r"(?s)^(.*?[.!?])", 1)
    return F.when(found != "", found).otherwise(F.concat(F.substring(text, 1, 80), F.lit("…")))


def reduction_pct(original: Column, cleaned: Column) -> Column:
    return F.when(original == 0, 0.0).otherwise(F.round((1 - cleaned / original) * 100, 2))


def input_truncated(chars: Column, tokens: Column) -> Column:
    """Whether a model seems to have read a cut input: tokens 2, 3 or 4 above a power of two from 1,024 on, or over six characters a token."""
    power = lambda k: ((tokens - k) >= 1024) & ((tokens - k).bitwiseAND(tokens - k - 1) == 0)
    return F.coalesce((tokens > 0) & (power(2) | power(3) | power(4) | (chars / F.nullif(tokens, F.lit(0)) > 6)), F.lit(False))


def retry_wait(server: Column, attempt: Column) -> Column:
    """Seconds before the next attempt: what the server asks or 10, 20, 40 ..., a minute at most."""
    return F.least(F.greatest(F.coalesce(server.cast("double"), F.lit(0.0)), 10 * F.pow(F.lit(2.0), attempt)), F.lit(60.0))


def field_kind(kind: Column) -> Column:
    return F.when(kind == "image", "image").when(kind == "url", "url").otherwise("text")


def utc(text: Column) -> Column:
    """An ISO time; without an offset it is UTC; null if it can't be read."""
    return F.try_to_timestamp(text)
