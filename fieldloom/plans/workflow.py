"""From pages to scored rules: sample, clean, skeleton, prompt, answer, repair, rules, cells, with a status per layout.

The model is any callable ``(call: dict) -> dict``: call has model, domain, layout_id, lang, system, prompt and fields; the answer has raw,
and if known finish, tokens_in, tokens_out. It runs where the sample pages are, one call per layout (``mapInPandas``), and an exception
of its or of any step is that layout's error and nobody else's; a backend that is busy is asked again (``calls``). ``replayed`` makes one
from recorded answers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import responses
from ..clean import clean
from ..extract import Page
from ..regexgen import generate
from ..skeleton import skeleton
from ..sinks import atomic
from . import calls, experiment
from .experiment import Config

Model = Callable[[dict], dict]
QUICK_PAGES = 5
RUNS = "domain string, layout_id string, sample_page string, rules map<string,string>, verified map<string,boolean>, status string, error string, raw string, finish string, truncated boolean, shown_chars long, tokens_in long, tokens_out long, ms double, attempts array<struct<attempt:int,status:int,error:string,wait:double>>"


def replayed(recorded: list[dict]) -> Model:
    """A model that answers from records (model, domain, match, lang, rules): those whose match occurs in the prompt first, then those that know most fields, then the first."""

    def answer(call: dict) -> dict:
        fits = [r for r in recorded if r["model"] == call["model"] and r["domain"] == call["domain"] and (r.get("match") or "") in call["prompt"]]
        known = lambda r: r["rules"] if r["lang"] == call["lang"] else {}
        if not fits:
            raise LookupError(f"no recorded answer of {call['model']} for {call['domain']}")
        best = max(enumerate(fits), key=lambda x: (bool(x[1].get("match")), len(set(known(x[1])) & set(call["fields"])), -x[0]))[1]
        return {"raw": json.dumps({f: known(best).get(f) for f in call["fields"]}), "finish": "stop"}

    return answer


def truncated(chars: int, tokens: int | None) -> bool:
    """Whether a model has read a cut input, by the rule of ``metrics.input_truncated``."""
    near_power = any(tokens - k >= 1024 and (tokens - k) & (tokens - k - 1) == 0 for k in (2, 3, 4)) if tokens else False
    return bool(tokens) and (near_power or chars / tokens > 6)


def one_layout(row, config: Config, model: Model, name: str, repair: bool, kept_chars: int | None = None) -> dict:
    """What a model makes of a layout's sample page. kept_chars: how much of the answer is kept, all of it if None."""
    fields = [dict(f.asDict() if hasattr(f, "asDict") else f) for f in row.fields]
    names = [f["name"] for f in fields]
    lang = "css" if config.lang == "regexn" else config.lang
    shown = clean(row.html or "", config.cleaning)
    if config.skeleton:
        shown = skeleton(shown, config.skeleton).text
    system = responses.system_prompt(row.template, row.description or "", fields, lang, bool(config.skeleton))
    prompt = responses.user_prompt(row.domain, shown, lang, bool(config.skeleton))
    began = time.monotonic()
    answer = model({"model": name, "domain": row.domain, "layout_id": row.layout_id, "lang": lang, "system": system, "prompt": prompt, "fields": names})
    rules, error = responses.parse_response(answer.get("raw"), names)
    if error and answer.get("finish") in responses.LIMIT_REASONS:
        error += " (output limit reached)"
    if repair and lang == "css":
        known = responses.class_names(shown)
        rules = {f: responses.repair_selector(r, f, known) for f, r in rules.items()}
        if "body" in rules:
            rules["body"] = responses.body_from_skeleton(rules["body"], shown)
    verified = {}
    if config.lang == "regexn":
        page = Page(row.html)
        for f in fields:
            kind = f["kind"]
            made = generate(rules.get(f["name"]) or "", [page.html], [page.values(rules.get(f["name"]), "css", kind, bool(f["merge"]))], kind)
            rules[f["name"]], verified[f["name"]] = (made["regex"], made["passed"] == made["total"]) if made else ("", False)
    cut = truncated(len(system) + len(prompt), answer.get("tokens_in"))
    error = error or ("input truncated" if cut else "")
    return {"rules": rules, "verified": verified, "status": "error" if error else "done", "error": error, "raw": (answer.get("raw") or "")[:kept_chars], "finish": answer.get("finish"), "truncated": cut, "shown_chars": len(shown), "tokens_in": answer.get("tokens_in"), "tokens_out": answer.get("tokens_out"), "ms": round((time.monotonic() - began) * 1000, 1), "attempts": answer.get("attempts") or []}


def detect_rules(samples: DataFrame, fields: DataFrame, config: Config, model: Model, name: str = "model", repair: bool = False, kept_chars: int | None = None, retries: int = calls.RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row per layout (RUNS): the rules a model writes from its sample page, with status and error.

    samples: domain, layout_id, sample_page, html, template, description. fields: layout_id, field, type, merge, required, ord, and
    description if there is one. Used alone this suggests rules for a page.
    """
    about = F.col("description") if "description" in fields.columns else F.lit(None).cast("string")
    kind = F.when(F.col("type").isin("image", "url"), F.col("type")).otherwise("text")
    listed = fields.groupBy("layout_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("field").alias("name"), about.alias("description"), "required", kind.alias("kind"), "merge"))).alias("fields"))
    names, asked = [x.split(" ")[0] for x in RUNS.split(", ")], calls.patient(model, retries, sleep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                made = {n: None for n in names} | {"domain": row.domain, "layout_id": row.layout_id, "sample_page": row.sample_page, "rules": {}, "verified": {}, "truncated": False, "attempts": []}
                try:
                    made |= one_layout(row, config, asked, name, repair, kept_chars)
                except Exception as e:  # the layout's own failure, kept as its result
                    made |= {"status": "error", "error": f"{type(e).__name__}: {e}", "attempts": getattr(e, "attempts", [])}
                out.append(made)
            yield pd.DataFrame(out, columns=names).astype({"tokens_in": "Int64", "tokens_out": "Int64", "shown_chars": "Int64"})

    cores = samples.sparkSession.sparkContext.defaultParallelism
    return samples.select("domain", "layout_id", "sample_page", "html", "template", "description").join(listed, "layout_id").repartition(cores, "domain", "layout_id").mapInPandas(run, RUNS)


def samples_of(pages: DataFrame, config: Config, template: str, description: str = "") -> DataFrame:
    """Sample pages with their html; pages: domain, layout_id, page, html."""
    drawn = experiment.sample_pages(pages.select("domain", "layout_id", "page"), config)
    found = pages.join(F.broadcast(drawn), ["domain", "layout_id"]).where("page = sample_page")
    return found.select("domain", "layout_id", "sample_page", "html", F.lit(template).alias("template"), F.lit(description).alias("description"))


def capped(pages: DataFrame, config: Config) -> DataFrame:
    """The first pages of each layout by name, as many as the configuration takes (all of them if it says nothing)."""
    if config.max_pages is None:
        return pages
    from ..operators.groundtruth import page_scope

    return pages.join(page_scope(pages.select("domain", "layout_id", "page").withColumn("skipped", F.lit(False)), pages, config.max_pages).select("domain", "layout_id", "page"), ["domain", "layout_id", "page"], "left_semi")


def long_rules(runs: DataFrame, config: Config, exp_id: str) -> DataFrame:
    """Rules of layouts that didn't fail: exp_id, layout_id, field, lang, rule."""
    lang = "regex" if config.lang == "regexn" else config.lang
    return runs.where("status = 'done'").select(F.lit(exp_id).alias("exp_id"), "layout_id", F.explode("rules").alias("field", "rule")).withColumn("lang", F.lit(lang))


def run(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, config: Config, model: Model, name: str, path: str, exp_id: str = "experiment", template: str = "page", repair: bool = False, layouts_per_commit: int = 64, cancelled: Callable[[], bool] = lambda: False, **calling) -> tuple[DataFrame, DataFrame]:
    """An experiment from pages to cells: (runs, cells), both kept under path by commits. Layouts that are done there aren't asked for again.

    pages: domain, layout_id, page, html. The model is asked before anything is scored, and its answers are committed first, about layouts_per_commit
    layouts at a time, so that neither a lost executor nor a second run asks twice for more than those. The jobs have the
    experiment's tag: ``cancel`` stops them, and cancelled() is asked between commits; what is committed by then stays, and a later run goes on
    from there. calling: retries, sleep and kept_chars of detect_rules.
    """
    spark = pages.sparkSession
    scope = capped(pages, config)
    wanted = scope.select("domain", "layout_id").distinct().join(_done(spark, f"{path}/runs", exp_id), ["domain", "layout_id"], "left_anti")
    parts = max(1, -(-wanted.count() // layouts_per_commit))
    spark.sparkContext.addJobTag(tag(exp_id))
    try:
        for k in range(parts):
            if cancelled():
                break
            some = wanted.where(F.pmod(F.xxhash64("domain", "layout_id"), F.lit(parts)) == k)
            samples = samples_of(scope.join(F.broadcast(some), ["domain", "layout_id"], "left_semi"), config, template)
            atomic.commit(detect_rules(samples, fields, config, model, name, repair, **calling).withColumn("exp_id", F.lit(exp_id)), f"{path}/runs")
        runs = atomic.committed(spark, f"{path}/runs", schema=f"{RUNS}, exp_id string").where(F.col("exp_id") == exp_id)
        if not cancelled():
            experiment.run(scope, fields, gt_rules, long_rules(runs, config, exp_id), runs.where("status = 'done'").select("layout_id", "sample_page"), f"{path}/cells")
    finally:
        spark.sparkContext.removeJobTag(tag(exp_id))
    return runs, atomic.committed(spark, f"{path}/cells", experiment.SLOTS, experiment.CELLS).where(F.col("exp_id") == exp_id)


def tag(exp_id: str) -> str:
    return "experiment-" + exp_id.replace(",", "_")


def cancel(spark: SparkSession, exp_id: str) -> None:
    """Stops the jobs of an experiment that runs in another thread."""
    spark.sparkContext.cancelJobsWithTag(tag(exp_id))


def _done(spark: SparkSession, path: str, exp_id: str) -> DataFrame:
    return atomic.committed(spark, path, schema=f"{RUNS}, exp_id string").where((F.col("exp_id") == exp_id) & (F.col("status") == "done")).select("domain", "layout_id").distinct()


def quick(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, config: Config, model: Model, name: str, layout_id: str) -> tuple[DataFrame, DataFrame]:
    """A trial on one layout's first pages, written nowhere: (runs, cells)."""
    from dataclasses import replace

    few = replace(config, max_pages=config.max_pages or QUICK_PAGES)
    scope = capped(pages.where(F.col("layout_id") == layout_id), few)
    samples = samples_of(scope, few, "page")
    answered = detect_rules(samples, fields, few, model, name).collect()  # one layout
    runs = pages.sparkSession.createDataFrame(answered, RUNS)
    cells = experiment.grid(scope, fields.where(F.col("layout_id") == layout_id), gt_rules, long_rules(runs, few, "quick"))
    return runs, experiment.mark_samples(cells, runs.select("layout_id", "sample_page"))


def progress(runs: DataFrame, scope: DataFrame, cancelled: bool = False) -> DataFrame:
    """Per experiment: layouts done, failed and in all, and a status: done, cancelled, or interrupted where some are missing. runs: exp_id, layout_id, status; scope: exp_id, layout_id."""
    last = runs.groupBy("exp_id", "layout_id").agg(F.max(F.struct((F.col("status") == "done").alias("ok"), "status"))["status"].alias("status"))
    per = scope.select("exp_id", "layout_id").distinct().join(last, ["exp_id", "layout_id"], "left").groupBy("exp_id").agg(F.count("status").alias("done"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("status", F.when(F.col("done") == F.col("total"), "done").otherwise("cancelled" if cancelled else "interrupted"))
