"""Readers: pages as files, study documents as JSON, site lists, the audit log, and links on pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import css, dom

SITES = "countries array<struct<country:string,code:string,continent:string,language:string,sites:array<struct<name:string,url:string,language:string,notes:string>>>>"
TEMPLATES = "name string, description string, page_type string, fields map<string,struct<type:string,metric:string,required:boolean,merge:boolean,label:string,description:string>>"
GROUND_TRUTH = "domain string, layouts map<string,struct<name:string,page_type:string,template_id:string,selectors:map<string,string>,compiled:map<string,struct<at:string,by:string>>>>, page_assignments map<string,struct<layout_id:string,skipped:boolean>>"


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """domain, page, html, size_bytes of <folder>/<domain>/<page>.html; bytes that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(folder)
    at = F.split("path", "/")
    return files.select(F.element_at(at, -2).alias("domain"), F.element_at(at, -1).alias("page"), lenient_text(F.col("content")).alias("html"), F.col("length").alias("size_bytes"))


def lenient_text(content: Column) -> Column:
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one document each, with their name as file; documents that can't be read are left out."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def host(url: Column) -> Column:
    """The host of an address, without any www. in it."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def sites(listed: DataFrame, folders: DataFrame) -> DataFrame:
    """Site records for all folders (domain), with empty defaults where the list has none."""
    c = listed.select(F.explode("countries").alias("c")).select("c", F.explode("c.sites").alias("s"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    language = F.coalesce(F.nullif(blank(F.col("s.language")), F.lit("")), F.col("c.language"), F.lit(""))
    known = c.select(host(F.col("s.url")).alias("domain"), F.col("s.name").alias("name"), F.col("s.url").alias("url"), F.col("c.country").alias("country"), blank(F.col("c.code")).alias("code"), blank(F.col("c.continent")).alias("continent"), language.alias("language"), blank(F.col("s.notes")).alias("notes"), F.lit(True).alias("has_meta"))
    df = folders.select("domain").distinct().join(known, "domain", "left")
    return df.select("domain", F.coalesce("name", "domain").alias("name"), F.coalesce("url", F.concat(F.lit("https://"), "domain")).alias("url"), *[blank(F.col(k)).alias(k) for k in ("country", "code", "continent", "language", "notes")], F.coalesce("has_meta", F.lit(False)).alias("has_meta"))


def template_fields(templates: DataFrame) -> DataFrame:
    """A row per field of a document of templates (template_id, and the columns of TEMPLATES)."""
    df = templates.select("template_id", F.explode(F.map_entries("fields")).alias("f"))
    return df.select("template_id", F.col("f.key").alias("field"), "f.value.type", F.coalesce("f.value.metric", F.lit("rouge")).alias("metric"), F.coalesce("f.value.merge", F.lit(False)).alias("merge"), F.coalesce("f.value.required", F.lit(False)).alias("required"))


def long_rules(selectors: DataFrame, keys: list[str]) -> DataFrame:
    """Rules in long form from a map of field to JSON or text: a text is a CSS rule, a list its alternatives, an object has a rule per language."""
    df = selectors.select(*keys, F.explode("selectors").alias("field", "value"))
    as_map, as_list = F.from_json("value", "map<string,string>"), F.from_json("value", "array<string>")
    rules = F.when(F.ltrim("value").startswith("{"), as_map).when(F.ltrim("value").startswith("[") & as_list.isNotNull() & F.exists(as_list, lambda x: x.isNotNull()), F.create_map(F.lit("css"), F.array_join(F.filter(as_list, lambda x: x.isNotNull()), ", "))).otherwise(F.create_map(F.lit("css"), "value"))
    return df.select(*keys, "field", F.explode(rules).alias("lang", "rule")).where("lang in ('css', 'xpath', 'regex') and coalesce(rule, '') <> ''")


def variant_rules(selectors: DataFrame, keys: list[str]) -> DataFrame:
    """Rules in long form from a map of field to JSON or text, read as variants.

    A text is a CSS rule, and so is what isn't JSON; a list's texts are alternatives of one; an object has a rule per language, itself a text or a list.
    Empty rules, nulls and other languages are left out.
    """
    spark = selectors.sparkSession
    text = lambda v: f"""CASE WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN array_join(filter(try_variant_get({v}, '$', 'array<string>'), x -> x IS NOT NULL), ', ')
        WHEN schema_of_variant({v}) NOT LIKE 'OBJECT%' THEN try_variant_get({v}, '$', 'string') END"""  # noqa: E731
    read = selectors.select(F.struct(*keys).alias("k"), F.explode("selectors").alias("field", "value")).withColumn("v", F.try_parse_json("value"))
    read = read.withColumn("form", F.when(F.col("v").isNull(), "text").when(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), "object").when(F.expr("schema_of_variant(v) LIKE 'ARRAY%'"), "list").otherwise("text"))
    one = read.where("form <> 'object'").select("k.*", "field", F.lit("css").alias("lang"), F.when(F.col("form") == "list", F.expr(text("v"))).otherwise(F.col("value")).alias("rule"))
    parts = spark.sql(f"SELECT d.k.*, d.field, e.key AS lang, {text('e.value')} AS rule FROM {{d}} AS d, LATERAL variant_explode(d.v) AS e", d=read.where("form = 'object'"))
    return one.unionByName(parts).where("lang in ('css', 'xpath', 'regex') and coalesce(rule, '') <> ''")


def metrics_cells(documents: DataFrame, keys: list[str], document: str = "metrics") -> DataFrame:
    """keys, page, field, score, label of documents {page: {field: {score, label}}} in JSON; what isn't a cell is left out, and so are documents that aren't JSON."""
    read = documents.select(F.struct(*keys).alias("k"), F.try_parse_json(document).alias("v")).where("v is not null")
    return documents.sparkSession.sql("""SELECT d.k.*, p.key AS page, f.key AS field, try_variant_get(f.value, '$.score', 'double') AS score, try_variant_get(f.value, '$.label', 'string') AS label
        FROM {d} AS d, LATERAL variant_explode(d.v) AS p, LATERAL variant_explode(p.value) AS f WHERE schema_of_variant(f.value) LIKE 'OBJECT%'""", d=read)


def audit_entries(lines: DataFrame) -> DataFrame:
    """line_no, value -> at, action, user, domain, details, newest first; lines of fewer than two parts are left out."""
    parts = F.split(F.trim("value"), r"\s{2,}")
    details = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "  ")
    df = lines.where(F.size(parts) >= 2).select("line_no", F.get(parts, F.lit(0)).alias("at"), F.get(parts, F.lit(1)).alias("action"), details.alias("details"))
    value = lambda k: F.regexp_extract("details", rf"(?:^|\W){k}=(\S*)", 1)
    user = F.when(value("user") != "", value("user")).otherwise(value("by"))
    return df.select("line_no", "at", "action", user.alias("user"), value("domain").alias("domain"), "details").orderBy(F.desc("line_no"))


def last_compilations(entries: DataFrame) -> DataFrame:
    """When each layout was last compiled, by the last COMPILE line."""
    layout = F.regexp_extract("details", r"(?:^|\W)layout=(\S*)", 1)
    df = entries.where("action = 'COMPILE'").select("line_no", "domain", layout.alias("layout_id"), F.try_to_timestamp("at").alias("at")).where("domain <> '' and layout_id <> '' and at is not null")
    return df.groupBy("domain", "layout_id").agg(F.max_by("at", "line_no").alias("compiled_at"))


def page_links(pages: DataFrame, key: str, selector: str = "a[href]") -> DataFrame:
    """Links of each page in order, each address once: key, ord, href, text (80 characters); none that are empty, within the page, or scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ord_, href, text = [], [], [], []
            for i, html in enumerate(batch.column(1)):
                for k, n in enumerate(css.select(dom.parse(html.as_py() or ""), selector)):
                    row.append(i)
                    ord_.append(k)
                    href.append(n.attrs.get("href", "").strip())
                    text.append(dom.visible_text(n)[:80])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(ord_, pa.int32()), pa.array(href, pa.string()), pa.array(text, pa.string())], names=[key, "ord", "href", "text"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, "html").mapInArrow(run, f"`{key}` {kind}, ord int, href string, text string")
    good = found.where("href <> '' and not startswith(href, '#') and not startswith(lower(href), 'javascript')")
    first = good.withColumn("k", F.row_number().over(Window.partitionBy(key, "href").orderBy("ord"))).where("k = 1")
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("ord"), "href", "text")


def accepted_fetch(status: Column, html: Column) -> Column:
    """Whether a response is a page: 200 with 1,000 characters, or a refusal that is a page after all, with 3,000 and links."""
    return ((status == 200) & (F.length(html) >= 1000)) | ((status == 403) & (F.length(html) >= 3000) & F.contains(F.lower(html), F.lit("<a ")))


def robots_decision(enabled: Column, status: Column, allowed: Column) -> Column:
    """allowed by the rules of a robots.txt that was read, allowed without one, refused while it can't be reached."""
    return F.when(~enabled, True).when(status.between(200, 299), allowed).when(status.between(400, 499), True).otherwise(False)
