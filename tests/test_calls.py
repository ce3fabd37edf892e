"""Calls of busy models, and experiments that fail, are cancelled and go on."""

import json
import sys
import threading
import time
from datetime import datetime, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fieldloom.plans import calls, workflow
from fieldloom.plans.calls import Busy, Bucket, Limits
from fieldloom.plans.experiment import Config
from fieldloom.sinks import atomic

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PAGE = '<html><body><article><h1 class="title">Head {k}</h1><p>Text of page {k} that goes on</p></article></body></html>'


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s

    @classmethod
    def timer(cls):
        clock = cls()
        return clock, clock.sleep


def test_waits():
    assert [calls.wait_of(0, k) for k in range(5)] == [10, 20, 40, 60, 60] and calls.wait_of(25, 0) == 25 and calls.wait_of(900, 1) == 60 and calls.wait_of(3, 1) == 20
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert Busy(429, "7").asked() == 7 and Busy(429, "soon", "2024-01-01T00:00:33Z").asked(now) == 33 and Busy(503).asked() == 0 and Busy(503, None, "later").asked() == 0


def test_attempts():
    slept, left = [], [Busy(429), Busy(503, 44.0), {"raw": "x"}]

    def model(call):
        a = left.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    answer, made, paced, error = calls.attempted(model, {}, sleep=slept.append)
    assert answer == {"raw": "x"} and slept == [10, 44] and [a["status"] for a in made] == [429, 503, 200] and error is None and paced == 0
    left[:] = [Busy(500)]
    answer, made, _, error = calls.attempted(model, {}, sleep=slept.append)
    assert answer is None and len(made) == 1 and str(error) == "status 500"
    left[:] = [Busy(429)] * 9
    slept.clear()
    assert len(calls.attempted(model, {}, sleep=slept.append)[1]) == 6 and slept == [10, 20, 40, 60, 60]


def test_bucket():
    clock = Clock()
    b = Bucket(0.5, 2, clock, clock.sleep)
    assert [b.take() for _ in range(4)] == [0, 0, 2, 2]
    clock.now += 100
    assert [b.take() for _ in range(3)] == [0, 0, 2]
    assert Bucket(0, 1, clock, clock.sleep).take() == 0
    for bad in ({"rate": -1}, {"burst": 0}, {"lanes": 0}, {"retries": -1}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_calls_of_a_table(spark):
    rows = [(str(k), f"b{k % 2}", f"prompt {k}", k % 4) for k in range(40)]
    df = spark.createDataFrame(rows, "call_id string, backend string, prompt string, busy int").repartition(3)

    class Model:
        def __init__(self):
            self.times = {}

        def __call__(self, call):
            k = self.times[call["call_id"]] = self.times.get(call["call_id"], 0) + 1
            if call["busy"] == 3:
                raise KeyError("no")
            if k <= call["busy"]:
                raise Busy(429)
            return {"raw": call["prompt"].upper(), "tokens_in": 3}

    found = {r.call_id: r for r in calls.call_all(df, Model(), Limits(rate=0.1, lanes=2), Clock.timer).collect()}
    for call_id, _, prompt, busy in rows:
        r = found[call_id]
        assert (r.raw, r.error) == ((None, "KeyError: 'no'") if busy == 3 else (prompt.upper(), ""))
        assert len(r.attempts) == (1 if busy == 3 else busy + 1) and r.waited == sum([10, 20, 40][: busy % 3]) and r.paced >= 0
    assert sum(r.paced for r in found.values()) > 0
    assert calls.call_all(df.limit(0), Model()).count() == 0


@pytest.fixture(scope="module")
def study_(spark):
    names = [f"l{k}" for k in range(6)]
    pages = spark.createDataFrame([("d", x, f"article_{k:03}.html", PAGE.format(k=k)) for x in names for k in range(3)], "domain string, layout_id string, page string, html string")
    fields = spark.createDataFrame([(x, "title", "text", "rouge", False, True, 0) for x in names], "layout_id string, field string, type string, metric string, merge boolean, required boolean, ord int")
    return pages, fields, spark.createDataFrame([(x, "title", "h1") for x in names], "layout_id string, field string, rule string")


def knows(call):
    return {"raw": json.dumps({"title": "h1.title"}) + " " * 5000 + "end", "finish": "stop"}


class OnceBusy:
    def __init__(self):
        self.seen = set()

    def __call__(self, call):
        if call["layout_id"] not in self.seen:
            self.seen.add(call["layout_id"])
            raise Busy(503)
        return knows(call)


def slow(call):
    time.sleep(0.2 if call["layout_id"] in ("l0", "l1") else 60)
    return knows(call)


def cells_of(found):
    return sorted((r.layout_id, r.page, r.field, r.score, r.label, r.is_sample, tuple(r.pred)) for r in found.collect())


def test_busy_failed_cancelled_and_resumed_runs_give_the_cells_of_a_clean_one(spark, study_, tmp_path):
    config = Config(cleaning="whitelist")
    runs, cells = workflow.run(*study_, config, knows, "m", str(tmp_path / "clean"), "e")
    clean = cells_of(cells)
    assert len(clean) == 18 and {r.raw[-3:] for r in runs.collect()} == {"end"}  # whole answers are kept

    runs, cells = workflow.run(*study_, config, OnceBusy(), "m", str(tmp_path / "busy"), "e", sleep=lambda s: None)
    assert cells_of(cells) == clean and {(tuple(a.status for a in r.attempts), r.attempts[0].wait) for r in runs.collect()} == {((503, 200), 10.0)}

    def refuses(call):
        raise Busy(429 if call["layout_id"] == "l3" else 500, 1)

    runs, cells = workflow.run(*study_, config, refuses, "m", str(tmp_path / "bad"), "e", sleep=lambda s: None, kept_chars=10)
    assert cells.count() == 0 and {r.layout_id: (r.status, r.error, len(r.attempts)) for r in runs.collect()} == {f"l{k}": ("error", f"Busy: status {429 if k == 3 else 500}", 6 if k == 3 else 1) for k in range(6)}
    assert cells_of(workflow.run(*study_, config, knows, "m", str(tmp_path / "bad"), "e")[1]) == clean

    # stopped between commits
    turns = iter([False, True, True, True])
    at = str(tmp_path / "stopped")
    runs, cells = workflow.run(*study_, config, knows, "m", at, "e", layouts_per_commit=1, cancelled=lambda: next(turns, True))
    scope = study_[0].select(F.lit("e").alias("exp_id"), "layout_id").distinct()
    assert cells.count() == 0 and workflow.progress(runs, scope, cancelled=True).first().status == "cancelled"
    asked = runs.count()
    runs, cells = workflow.run(*study_, config, knows, "m", at, "e")
    assert cells_of(cells) == clean and 0 <= asked < 6 and runs.count() == 6

    # stopped in the middle of a job, from another thread
    at, failed = str(tmp_path / "killed"), []

    def work():
        try:
            workflow.run(*study_, config, slow, "m", at, "killed")
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    deadline = time.monotonic() + 60
    while not failed and time.monotonic() < deadline and thread.is_alive():
        time.sleep(3)
        workflow.cancel(spark, "killed")
    thread.join(60)
    assert failed and atomic.log(spark, f"{at}/runs").count() == 0
    assert cells_of(workflow.run(*study_, config, knows, "m", at, "killed")[1]) == clean
