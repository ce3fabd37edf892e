"""Changes of a study as an ordered log, folded into its tables in one plan.

A log has rows of CHANGES; seq orders them. What a change does follows from the last changes of its key before it, so each table is a
window over its own keys: sites by domain, and pages, assignments and the index by domain and page. Deleting a
site is a tombstone over all keys of its domain: only what comes after the last one counts.

* ``site_put`` writes a site's record: name and notes, the address if one is given, and the country it moves to. A country that is new needs a code
  no other country has; a change without one is refused. Countries without sites are no longer listed; a code stays with its country.
* ``page_add`` writes a page and its index row; ``page_redownload`` does so for a page that exists, clears its assignment and adds a row to the download
  log, as ``page_add`` does; ``page_delete`` takes the page and its assignment and leaves the index; ``assign`` gives a page a layout.
* ``site_delete`` takes a site's pages, assignments, index and log rows and excludes the domain; its record stays.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGES = "seq long, action string, domain string, page string, url string, html string, page_type string, method string, layout_id string, name string, notes string, country string, code string, at string"
OTHER = "Other"
START = -1  # before every change


@dataclass(frozen=True)
class Tables:
    sites: DataFrame  # domain, name, notes, url, country
    countries: DataFrame  # country, code
    pages: DataFrame  # domain, page, html
    assignments: DataFrame  # domain, page, layout_id
    index: DataFrame  # domain, page, url, page_type, method, size, at
    downloads: DataFrame  # seq, domain, url, page_type, method, at
    excluded: DataFrame  # domain


SCHEMAS = {"sites": "domain string, name string, notes string, url string, country string", "countries": "country string, code string", "pages": "domain string, page string, html string", "assignments": "domain string, page string, layout_id string", "index": "domain string, page string, url string, page_type string, method string, size long, at string", "downloads": "seq long, domain string, url string, page_type string, method string, at string", "excluded": "domain string"}


def no_tables(spark: SparkSession) -> Tables:
    return Tables(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})


def claims(countries: DataFrame, puts: DataFrame) -> DataFrame:
    """country, code, seq: when each country got its code. puts: seq, country, code.

    Reads the first change of each country and code: their number is that of countries times codes in use, whatever the log's length.
    """
    first = puts.where(F.col("country") != OTHER).groupBy("country", "code").agg(F.min("seq").alias("seq"))
    known = countries.where(F.col("country") != OTHER).select("country", "code", F.lit(START).cast("long").alias("seq"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        out, used = {}, set()
        for r in rows.sort_values(["seq", "country", "code"]).itertuples(index=False):
            code = (r.code or "").strip().upper()
            if r.country not in out and (r.seq == START or code and code not in used):
                out[r.country] = (r.country, code, r.seq)
                used.add(code)
        return pd.DataFrame(list(out.values()), columns=["country", "code", "seq"])

    return known.unionByName(first).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(greedy, "country string, code string, seq long")


def sites_after(tables: Tables, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites, countries with their number of sites, and the changes that were refused (seq, domain, why)."""
    puts = log.where("action = 'site_put'").withColumn("country", F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit(OTHER)))
    owned = claims(tables.countries, puts.select("seq", "country", "code"))
    judged = puts.alias("p").join(owned.alias("c"), "country", "left").select("p.*", ((F.col("country") == OTHER) | (F.col("c.seq") <= F.col("p.seq"))).alias("ok"))
    given = F.nullif(F.col("url"), F.lit(""))
    old = tables.sites.select(F.lit(START).cast("long").alias("seq"), "domain", "name", "notes", "url", "country")
    done = judged.where("ok").select("seq", "domain", "name", F.coalesce("notes", F.lit("")).alias("notes"), given.alias("url"), "country").unionByName(old)
    last = lambda c: F.max_by(c, "seq").alias(c)
    sites = done.groupBy("domain").agg(last("name"), last("notes"), F.max_by("url", F.when(F.col("url").isNotNull(), F.col("seq"))).alias("url"), last("country"))
    sites = sites.withColumn("url", F.coalesce("url", F.concat(F.lit("https://"), "domain")))
    counted = sites.groupBy("country").agg(F.count(F.lit(1)).alias("sites")).join(owned.select("country", "code"), "country", "left")
    why = F.when(F.coalesce(F.trim("code"), F.lit("")) == "", "a new country needs a code").otherwise("the code is another country's")
    return sites, counted.select("country", "code", "sites"), judged.where("not coalesce(ok, false)").select("seq", "domain", why.alias("why"))


def replay(tables: Tables, log: DataFrame) -> tuple[Tables, DataFrame, DataFrame]:
    """The tables after all changes of log, countries with their number of sites, and the changes that were refused."""
    sites, counted, refused = sites_after(tables, log)
    gone = log.where("action = 'site_delete'").groupBy("domain").agg(F.max("seq").alias("cut"))

    def living(df: DataFrame) -> DataFrame:
        """Rows after their site was last deleted."""
        return df.join(gone, "domain", "left").where("cut is null or seq > cut").drop("cut")

    then = lambda df, action, *more: df.select(F.lit(START).cast("long").alias("seq"), F.lit(action).alias("action"), "domain", "page", *more)
    of_pages = log.where("action in ('page_add', 'page_redownload', 'page_delete', 'assign')").select("seq", "action", "domain", "page", "url", "html", "page_type", "method", "layout_id", "at")
    old = then(tables.pages, "was_page", "html").unionByName(then(tables.assignments, "was_assigned", "layout_id"), True).unionByName(then(tables.index, "was_indexed", "url", "page_type", "method", "size", "at"), True)
    events = living(of_pages.unionByName(old, True))
    key = Window.partitionBy("domain", "page").orderBy("seq", "action")
    # whether the page exists when a change comes: what the last one that made or deleted it has left
    there = F.last(F.when(F.col("action").isin("page_add", "was_page"), True).when(F.col("action") == "page_delete", False), ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("there", F.coalesce(there, F.lit(False)))
    events = events.where("action <> 'page_redownload' or there")
    order = F.struct("seq", "action")
    last_of = lambda c, *actions: F.max_by(c, F.when(F.col("action").isin(*actions), order))
    wrote = F.col("action").isin("page_add", "page_redownload")
    fetched, any_page, any_index = ("page_add", "page_redownload"), ("page_add", "page_redownload", "was_page"), ("page_add", "page_redownload", "was_indexed")
    events = events.withColumn("size", F.when(wrote, F.length("html").cast("long")).otherwise(F.col("size")))
    state = events.groupBy("domain", "page").agg(
        last_of("action", "page_add", "was_page", "page_delete").alias("life"), last_of("html", *any_page).alias("html"),
        last_of("action", "assign", "was_assigned", "page_delete", "page_redownload").alias("placed"), last_of("layout_id", "assign", "was_assigned").alias("layout_id"),
        last_of("url", *any_index).alias("url"), last_of("method", *any_index).alias("method"), last_of("size", *any_index).alias("size"), last_of("at", *any_index).alias("at"),
        last_of("action", *any_index).alias("indexed"), last_of("page_type", "page_add", "was_indexed").alias("page_type"),
    )
    kind = F.coalesce("page_type", F.lit("article"))
    logged = events.where(F.col("action").isin(*fetched)).select("seq", "domain", "url", F.coalesce("page_type", F.lit("article")).alias("page_type"), "method", "at")
    out = replace(
        tables, sites=sites.select("domain", "name", "notes", "url", "country"), countries=counted.select("country", "code"),
        pages=state.where("life in ('page_add', 'was_page')").select("domain", "page", "html"),
        assignments=state.where("placed in ('assign', 'was_assigned')").select("domain", "page", "layout_id"),
        index=state.where("indexed is not null").select("domain", "page", "url", kind.alias("page_type"), "method", "size", "at"),
        downloads=living(tables.downloads.withColumn("was", F.lit(True)).withColumn("order", F.col("seq")).withColumn("seq", F.lit(START).cast("long"))).select(F.col("order").alias("seq"), "domain", "url", "page_type", "method", "at").unionByName(logged),
        excluded=tables.excluded.select("domain").union(gone.select("domain")).distinct(),
    )
    return out, counted, refused
