"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: its character classes, and its use of the common words of its
language. Reference histograms are sums over all documents of a language that pass the base rules on
length and repetition, so that junk which those catch doesn't shift them. A text fails when the
Jensen-Shannon distance to its reference exceeds a threshold, unless the text is so short that its
histogram says little (the guards).

Counts and histograms can be kept in shared storage, so that texts are read once; where whole rows are carried, that
would write all texts again, and they are counted twice instead. Nothing shuffles but the reference sums, one row per language and task. The references are
broadcast: they have at most one row for each language of ``COMMON_WORDS`` and one for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut, named

SPACES = r"[\x20\x09-\x0D]+"
#: The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "was", "with", "be", "by", "on", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"],
}
REST = "other"
#: The classes of characters, removed one after the other from what lower-case letters and space leave.
CLASSES = [("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("punct", r"[!-/:-@\[-`{-~]+")]
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.29
MIN_CHARS = 200
MIN_WORDS = 80


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, though a lambda in body reads it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column, zero) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; null if either is empty."""
    share = lambda h, s: F.transform(h, lambda x: x / s)
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    both = bound(F.struct(p.alias("p"), q.alias("q"), total(p, 0.0).alias("a"), total(q, 0.0).alias("b")), lambda s: F.when((s["a"] > 0) & (s["b"] > 0), total(F.zip_with(share(s["p"], s["a"]), share(s["q"], s["b"]), lambda x, y: term(x, y) + term(y, x)), 0.0)))
    return F.sqrt(F.abs(both) / 2)


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows found twice or more among the words, the first included."""

    def covered(s: Column) -> Column:
        twin = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        return bound(at, lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), 0))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    numbered = lambda t: F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = bound(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), bound(numbered(t), covered)).otherwise(0))
    return F.when(F.size(words) >= 3, found).otherwise(0)


def counted(docs: DataFrame, carry: list[str], text: str, lang: str, keep: bool) -> DataFrame:
    """The columns to carry as the struct ``row``, language, length, base counts, the base verdict, and both histograms."""
    t, w, r, lg = F.col("t"), F.col("w"), F.col("r"), F.col("lg")
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    code = F.lower(named(lang).cast("string"))
    df = docs.select(F.struct(*map(named, carry)).alias("row"), F.coalesce(named(text), F.lit("")).alias("t"), F.when(code.isin(*COMMON_WORDS), code).otherwise(REST).alias("lg"))
    df = df.withColumns({"w": F.filter(F.split(t, SPACES), lambda x: x != ""), "r": F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", "")})
    df = df.withColumns({"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_r": F.length(r), "c0": r})
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"c{k + 1}", F.regexp_replace(F.col(f"c{k}"), pattern, ""))
    counts = {name: F.length(f"c{k}") - F.length(f"c{k + 1}") for k, (name, _) in enumerate(CLASSES)}
    chars = [F.length(t) - F.col("word_chars"), F.col("word_chars") - F.col("n_r"), *counts.values(), F.length(f"c{len(CLASSES)}")]
    n = len(COMMON_WORDS["en"])
    hits = bound(lists[lg], lambda known: F.filter(F.transform(w, lambda x: F.array_position(known, F.lower(x))), lambda i: i > 0))
    used = bound(hits, lambda h: F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda k: F.when(k <= n, F.size(F.filter(h, lambda i: i == k))).otherwise(F.size(w) - F.size(h)).cast("double")))
    lines = bound(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    df = df.select(
        "row", "lg", F.length(t).alias("length"), "n_words", "word_chars", counts["symbol"].cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"), repeat_words(w).cast("long").alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in chars]).alias("chars"), F.when(lg != REST, used).alias("used"),
    )
    # a generator of one row: filters on what follows stay above it, and don't compute all of this again inside lambdas
    df = cut(df) if keep else df.select("row", F.inline(F.array(F.struct(*[c for c in df.columns if c != "row"]))))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(hist: DataFrame) -> DataFrame:
    """One row per language: both histograms summed over all its documents that pass the base rules."""
    n_chars, n_used = len(CLASSES) + 3, len(COMMON_WORDS["en"]) + 1
    sums = hist.where("not base_failed").groupBy("lg").agg(*[F.sum(F.get("chars", F.lit(i))).alias(f"a{i}") for i in range(n_chars)], *[F.sum(F.get("used", F.lit(i))).alias(f"b{i}") for i in range(n_used)])
    return sums.select("lg", F.array(*[f"a{i}" for i in range(n_chars)]).alias("ref_chars"), F.array(*[f"b{i}" for i in range(n_used)]).alias("ref_used"))


def quality_rules(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per row of docs: the struct ``row`` of the columns to carry (all, if none are named), base counts, both distances and the verdict.

    Where columns are named, they are kept with the counts and texts are read once.

    A null text is empty and fails the base rules. A null or unknown language is compared with all
    other such documents, by character classes only. Distances are null where a guard holds or no document
    of the language passes the base rules, and a null distance fails nothing. Repeated rows are judged alike; an empty table gives no rows.
    Columns of docs are read through ``row``, so their names can't clash.
    """
    hist = counted(docs, docs.columns if carry is None else carry, text, lang, carry is not None)
    df = hist.join(F.broadcast(references(hist)), "lg", "left")
    df = df.withColumns({
        "char_distance": F.when(F.col("length") >= min_chars, js_distance(F.col("chars"), F.col("ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("used"), F.col("ref_used"))),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~far).alias("kept"))
