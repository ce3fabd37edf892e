"""The thin queries over the operators of this subpackage, as the driver registers them, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, jaccard, lines, lm, merkle, mixing, negatives, packing, quality, substring, tokens, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.section_tokens(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: four-word shingles, similarity of 0.85 or more."""
    return jaccard.jaccard_components(documents(spark, sf_dir), words=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the lines that many documents share."""
    df = lines.line_dedup(documents(spark, sf_dir))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 50 words that a smaller document has."""
    df = substring.substring_dedup(documents(spark, sf_dir))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2,048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for each document, texts compared without white space."""
    df = exact.exact_dedup(documents(spark, sf_dir), ["doc_id"])
    return df.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix, sources weighing 5, 2, 1 in turn."""
    df = mixing.mix(documents(spark, sf_dir), ["doc_id"])
    first = F.when(F.size("positions") > 0, F.get("positions", F.lit(0)))
    out = df.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", first.alias("position"))
    # most rows of an oversized source are taken nowhere: by the hash they don't all end in one range
    return out.orderBy("position", F.xxhash64("doc_id", "size")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, divergence from the language's distributions, and the verdict on every document."""
    df = quality.quality_rules(documents(spark, sf_dir), ["doc_id"])
    return df.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, by words and by context-tree weighting."""
    return lm.lm_scores(documents(spark, sf_dir), depth=lm.DEEPEST)


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector and its positives."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; a third of them fold with their letters in lower case."""
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    df = merkle.manifest(documents(spark, sf_dir), tampered=picked, changes={"text": merkle.lowered(F.col("text"))})
    return df.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of test items."""
    df = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

SQL_EXACT = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d"""

SQL_MIXING = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
q AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS c, coalesce(sum(weight) OVER o, 0) AS ws, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_w
      FROM q WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ratio <= (total - c)::DOUBLE / (total_w - ws)::DOUBLE AS capped FROM p),
g AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS cc, coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS cw FROM f),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap::DOUBLE ELSE (total - cc)::DOUBLE * weight / (total_w - cw)::DOUBLE END AS target FROM g),
m AS (SELECT doc_id, size, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, greatest(0, ceil((target - middle) / source_size)))::INT ELSE 0 END AS copies,
             CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS a, least(1.0::DOUBLE, middle::DOUBLE / target) AS x FROM m)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN a = 0 THEN x ELSE (sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * a) END, 6) END AS position
FROM n"""


SQL_LINES = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT no, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d),
m AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS largest FROM m WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT no) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < largest) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (largest IS NULL OR doc_id >= largest), '')) AS kept_sha256
FROM m LEFT JOIN h USING (key) GROUP BY no, doc_id"""

SQL_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
b AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE first < doc_id),
x AS (SELECT u.doc_id, u.k, word, max(b.i) OVER (PARTITION BY u.doc_id ORDER BY u.k) AS last FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) AS u LEFT JOIN b ON u.doc_id = b.doc_id AND u.k = b.i),
r AS (SELECT doc_id, count(*) FILTER (last >= k - 49) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (last IS NULL OR last < k - 49) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def sql_quality() -> str:
    known = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in quality.COMMON_WORDS.items())
    n = len(quality.COMMON_WORDS["en"])
    steps, columns, last = [], [], "c0"
    for k, (name, pattern) in enumerate(quality.CLASSES):
        steps.append(f"e{k + 1} AS (SELECT *, regexp_replace(c{k}, '{pattern}', '', 'g') AS c{k + 1} FROM e{k})")
        columns.append(f"length(c{k}) - length(c{k + 1})")
        last = f"c{k + 1}"
    end, symbol = f"e{len(quality.CLASSES)}", columns[[name for name, _ in quality.CLASSES].index("symbol")]
    js = lambda p, q, a, b: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] / {a} * log2(2 * (z[1] / {a}) / (z[1] / {a} + z[2] / {b})) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] / {b} * log2(2 * (z[2] / {b}) / (z[1] / {a} + z[2] / {b})) ELSE 0 END))) / 2))"
    sums = lambda column, size: "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(size)) + "]"
    return rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lower(lang) IN ({", ".join(f"'{k}'" for k in quality.COMMON_WORDS)}) THEN lower(lang) ELSE 'other' END AS lg FROM documents),
e0 AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS c0 FROM b),
{", ".join(steps)},
h AS (SELECT doc_id, lg, t, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, ({symbol})::BIGINT AS n_symbols,
      [length(t) - coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) - length(c0), {", ".join(columns)}, length({last})]::DOUBLE[] AS chars,
      list_filter(list_transform(w, lambda x: list_position(CASE lg {known} ELSE [] END, lower(x))), lambda i: i > 0) AS hits FROM {end}),
u AS (SELECT *, CASE WHEN lg <> 'other' THEN list_transform(range(1, {n + 2}), lambda k: CASE WHEN k <= {n} THEN len(list_filter(hits, lambda i: i = k)) ELSE len(w) - len(hits) END)::DOUBLE[] END AS used FROM h),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM u WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM u) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM (SELECT u.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))),
refs AS (SELECT lg, {sums("chars", len(quality.CLASSES) + 3)} AS ref_chars, {sums("used", n + 1)} AS ref_used FROM v WHERE NOT base_failed GROUP BY lg),
z AS (SELECT v.*, ref_chars, ref_used, list_sum(chars) AS sc, list_sum(ref_chars) AS sr, list_sum(used) AS su, list_sum(ref_used) AS sv FROM v LEFT JOIN refs USING (lg)),
y AS (SELECT *,
      CASE WHEN length(t) >= {quality.MIN_CHARS} AND sc > 0 AND sr > 0 THEN {js("chars", "ref_chars", "sc", "sr")} END AS char_distance,
      CASE WHEN n_words >= {quality.MIN_WORDS} AND su > 0 AND sv > 0 THEN {js("used", "ref_used", "su", "sv")} END AS word_distance FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept,
       round(char_distance, 4) AS char_distance, round(word_distance, 4) AS word_distance
FROM y"""


SQL_NEGATIVES = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.no AS anchor, a.vec_id AS anchor_id, v.no, v.vec_id, v.label = a.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score FROM v AS a JOIN v ON a.no <> v.no WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, no) <= 5),
n AS (SELECT s.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.no ORDER BY s.score DESC, s.vec_id, s.no) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

SQL_DECONTAMINATION = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM p) ON len(w) >= k)),
m AS MATERIALIZED (SELECT DISTINCT doc_id, k, i, item FROM g JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def sql_merkle(levels: int = 9) -> str:
    """levels: as many as a group or the groups may have; more change nothing."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: f"sha256({' || '.join(field(t if c == 'text' else c) for c in merkle.FIELDS)})"
    lower = f"translate(text, '{merkle.LETTERS}', '{merkle.LETTERS.lower()}')"
    ctes = []

    def tree(name: str, first: str) -> None:
        """Levels of a forest: tables of (key, pos, h, n), and for each node of the first the siblings and the places."""
        ctes.append(f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM ({first}))")
        for k in range(levels):
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT key, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (n + 7) // 8 AS n FROM (SELECT key, pos, h, n FROM {name}{k}) GROUP BY key, pos // 8, n)")

    def fold(name: str, k: int, before: str) -> str:
        """Folds a row's digest through level k of the forest, and adds the siblings to its proof."""
        inner = f"(SELECT string_agg(CASE WHEN s.pos = r.{name}_pos // {8**k} THEN {{}} ELSE s.h END, '' ORDER BY s.pos) FROM {name}{k} AS s WHERE s.key = r.{name}_key AND s.pos // 8 = r.{name}_pos // {8 ** (k + 1)} AND s.n > 1)"
        return f"SELECT * EXCLUDE (proof, folded), proof || coalesce({inner.format(chr(39) * 2)}, '') AS proof, coalesce(sha256({inner.format('r.folded')}), r.folded) AS folded FROM {before} AS r"

    tree("g", f"SELECT {field('lang')} AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS pos, {leaf('text')} AS h, lang, doc_id, {leaf(lower)} AS changed FROM documents")
    tree("r", f"SELECT '' AS key, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, key AS label FROM g{levels} JOIN (SELECT DISTINCT key, lang FROM g0) USING (key)")
    start = f"""SELECT g0.doc_id, g0.key AS g_key, '' AS r_key, g0.h AS leaf, g0.pos AS g_pos, r0.pos AS r_pos, r0.h AS subroot, (SELECT h FROM r{levels}) AS root, '' AS proof, CASE WHEN crc % 3 = 0 THEN g0.changed ELSE g0.h END AS folded
      FROM g0 JOIN r0 ON g0.key = r0.label LEFT JOIN (SELECT DISTINCT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(c >> 8, bytes[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
      FROM documents, (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS bytes)) USING (doc_id)"""
    ctes.append(f"f0 AS MATERIALIZED ({start})")
    for k in range(2 * levels):
        ctes.append(f"f{k + 1} AS MATERIALIZED ({fold('gr'[k // levels], k % levels, f'f{k}')})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{2 * levels}"


SQL: dict[str, str] = {
    "op3_line_dedup": SQL_LINES,
    "op5_exact_dedup": SQL_EXACT,
    "op6_substring_dedup": SQL_SUBSTRING,
    "op8_mixing": SQL_MIXING,
    "op9_quality_rules": sql_quality(),
    "op11_hard_negative_mining": SQL_NEGATIVES,
    "op12_merkle_manifest": sql_merkle(),
    "op13_benchmark_decontamination": SQL_DECONTAMINATION,
}
