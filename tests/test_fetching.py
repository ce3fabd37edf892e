"""Pages fetched with manners: robots.txt, pauses, answers that are pages, the data source, and decisions that expire in a stream."""

import json
import sys

import pytest
from pyspark import cloudpickle

from fieldloom.sources import fetch
from fieldloom.sources.fetch import Fetcher, PageSource, Policy, Recorded
from fieldloom.streaming import robots

cloudpickle.register_pickle_by_value(sys.modules[__name__])
RULES = "User-agent: *\nDisallow: /closed/\nCrawl-delay: 4\n\nUser-agent: fieldloom\nDisallow: /no-tools/\n"
PAGE = "<html>" + "x" * 1200 + "</html>"
REFUSED = "<html><a href='/x'>more</a>" + "x" * 3000 + "</html>"


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 3))
        self.now += s


def fetcher(answers, shown=None, **policy):
    clock, asked = Clock(), []
    client = Recorded(answers, shown)
    get = client.get
    client.get = lambda url: (asked.append(url), get(url))[1]
    return Fetcher(client, Policy(**policy), clock, clock.sleep), clock, asked


def test_rules_are_read_once_an_hour():
    f, clock, asked = fetcher({"https://a.example/robots.txt": (200, RULES)})
    assert f.robots("https://a.example/closed/1") == (True, "allowed", 0.0)  # the group that names the agent holds, without a delay of its own
    assert f.robots("https://a.example/no-tools/x") == (False, "disallowed", 0.0) and asked == ["https://a.example/robots.txt"]
    clock.now = 3599.0
    f.robots("https://a.example/")
    assert len(asked) == 1
    clock.now = 3600.0
    f.robots("https://a.example/")
    assert len(asked) == 2
    f, _, _ = fetcher({"https://a.example/robots.txt": (200, RULES)}, agent="another")
    assert f.robots("https://a.example/closed/1")[:2] == (False, "disallowed") and f.robots("https://a.example/1") == (True, "allowed", 4.0)


@pytest.mark.parametrize(("answer", "expected"), [((404, ""), (True, "no robots.txt")), ((403, "Forbidden"), (True, "no robots.txt")), ((503, ""), (False, "robots.txt unreachable")), (None, (False, "robots.txt unreachable"))])
def test_sites_that_cannot_say(answer, expected):
    f, _, _ = fetcher({"https://a.example/robots.txt": answer})
    assert f.robots("https://a.example/x")[:2] == expected
    f, _, asked = fetcher({}, respect_robots=False)
    assert f.robots("https://a.example/x") == (True, "not checked", 0.0) and asked == []


def test_requests_to_a_host_are_spaced():
    f, clock, _ = fetcher({})
    assert f.wait("a", 0.0) == 0.0
    clock.now += 0.4
    assert f.wait("a", 0.0) == pytest.approx(0.6) and f.wait("b", 0.0) == 0.0
    assert f.wait("a", 4.0) == pytest.approx(4.0) and f.wait("a", 600.0) == pytest.approx(30.0) and clock.slept == [0.6, 4.0, 30.0]
    assert Policy(min_delay=-3).min_delay == 0.0 and Policy(min_delay="99").min_delay == 60.0 and Policy(respect_robots=0).respect_robots is False
    with pytest.raises(ValueError):
        Policy(min_delay="soon")


def test_answers_that_are_pages():
    assert fetch.is_page(200, PAGE) and not fetch.is_page(200, "x" * 999) and fetch.is_page(403, REFUSED)
    assert not fetch.is_page(403, "x" * 4000) and not fetch.is_page(500, PAGE) and not fetch.is_page(None, None)
    ok = {"https://a.example/robots.txt": (404, "")}
    u = "https://a.example/1"
    row = lambda answers, shown=None: fetcher({**ok, **answers}, shown)[0].fetch(1, u)[3:6]
    assert row({u: (200, PAGE)}) == (PAGE, "direct", 200) and row({u: (503, "")}, {u: PAGE}) == (PAGE, "browser", 503)
    assert row({u: None}, {u: PAGE}) == (PAGE, "browser", None) and row({u: (200, "short")}, {u: "short"}) == (None, "failed", 200)
    f, _, asked = fetcher({"https://a.example/robots.txt": (200, "User-agent: *\nDisallow: /")})
    assert f.fetch(1, u)[4:9] == ("robots", None, "disallowed", 0.0, "disallowed") and u not in asked
    assert f.fetch(2, "no address")[4] == f.fetch(3, "http://[broken")[4] == "failed"


ANSWERS = {"https://a.example/robots.txt": (200, "User-agent: *\nDisallow: /closed/"), "https://b.example/robots.txt": (503, ""), "https://a.example/1": (200, PAGE), "https://a.example/2": (503, ""), "https://a.example/3": (403, REFUSED), "https://a.example/4": None, "https://b.example/1": (200, PAGE)}
SHOWN = {"https://a.example/2": PAGE}
URLS = ["https://a.example/1", "https://a.example/2", "https://a.example/3", "https://a.example/4", "https://a.example/closed/1", "https://b.example/1"]
EXPECTED = {"https://a.example/1": "direct", "https://a.example/2": "browser", "https://a.example/3": "direct", "https://a.example/4": "failed", "https://a.example/closed/1": "robots", "https://b.example/1": "robots"}


def test_data_source_and_table_of_requests_agree(spark, tmp_path):
    records = tmp_path / "records.json"
    records.write_text(json.dumps({"answers": ANSWERS, "shown": SHOWN}))
    spark.dataSource.register(PageSource)
    source = spark.read.format("fetched_pages").option("urls", json.dumps(URLS)).option("client", "fieldloom.sources.fetch:recorded_client").option("records", str(records)).option("minDelay", "0").load()
    assert source.rdd.getNumPartitions() == 2 and {r.url: r.method for r in source.collect()} == EXPECTED
    requests = spark.createDataFrame(list(enumerate(URLS)) + [(90, None), (91, "nothing")], "request_id long, url string").repartition(3)

    def timer():
        clock = Clock()
        return clock, clock.sleep

    rows = fetch.fetch_pages(requests, lambda batch: Recorded(ANSWERS, SHOWN), Policy(min_delay=2.0), timer).collect()
    assert {r.url: r.method for r in rows if r.request_id < 90} == EXPECTED and {r.method for r in rows if r.request_id >= 90} == {"failed"}
    columns = ["url", "host", "html", "method", "status", "robots", "error"]
    assert {tuple(r[c] for c in columns) for r in rows if r.request_id < 90} == {tuple(r) for r in source.select(*columns).collect()}
    assert [r.pause for r in sorted(rows, key=lambda r: r.request_id)[:5]] == [0.0, 2.0, 2.0, 2.0, 0.0]
    assert fetch.fetch_pages(requests.limit(0), lambda batch: Recorded({})).count() == 0


def test_decisions_expire_in_a_stream_and_equal_those_of_a_table(spark, tmp_path):
    rows, at = [], 1_700_000_000.0
    for k in range(90):
        at += [10, 700, 1900, 5][k % 4]
        rows.append((k, f"h{k % 3}", f"https://h{k % 3}/{'closed' if k % 2 else 'open'}/{k}", at, [404, 200, 503, None][k % 4], "User-agent: *\nDisallow: /closed/\nCrawl-delay: 2"))
    schema = "request_id long, host string, url string, at double, robots_status int, robots_text string"
    batches = [rows[:30], rows[30:31], rows[31:70], rows[70:]]
    folder = tmp_path / "in"
    folder.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, batch in enumerate(batches):  # a run per file goes on from the state of the one before
            names = [x.split(" ")[0] for x in schema.split(", ")]
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in batch))
            stream = robots.robots_stream(spark.readStream.schema(schema).json(str(folder)))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*[x.split(" ")[0] for x in robots.DECISIONS.split(", ")]).collect()))
    whole = sorted(map(tuple, robots.robots_decisions(spark.createDataFrame(rows, schema)).collect()))
    assert got == whole and len(got) == 90
    fresh = [r for r in whole if r[5]]
    assert 3 < len(fresh) < 90 and all(0 <= r[3] - r[4] < 3600 for r in whole)
    # an answer is read again once it has expired, and what it says then holds
    assert len({(r[1], r[4]) for r in whole}) == len(fresh) and {r[7] for r in whole} == {"allowed", "disallowed", "no robots.txt", "robots.txt unreachable"}
