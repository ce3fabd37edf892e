"""Pages fetched with manners: robots.txt is asked first, requests to a host are spaced, and a browser may help where the plain answer is no page.

The client is injected: an object with ``get(url) -> (status, text)``, which raises on a network error, and perhaps
``render(url) -> html`` for pages that need a browser. ``fetch_pages`` takes a table of requests of any size; a host's
requests go to one task, which spaces them as they must be. ``PageSource`` is the same as a data source for a list of addresses:

    spark.dataSource.register(PageSource)
    spark.read.format("fetched_pages").option("urls", json.dumps([...])).option("client", "module:factory").load()
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "request_id long, url string, host string, html string, method string, status int, robots string, pause double, error string"
LINK = re.compile(r"<a\s[^>]*href", re.IGNORECASE)
#: Characters that a page has at least, and one that came with a refusal; seconds a robots.txt is kept, and the longest pause that it may ask for.
LEAST, LEAST_REFUSED, KEEP, MOST_DELAY = 1000, 3000, 3600.0, 30.0


@dataclass(frozen=True)
class Policy:
    """min_delay: seconds between requests to a host, 0 to 60; bad values raise ValueError."""

    respect_robots: bool = True
    min_delay: float = 1.0
    agent: str = "fieldloom"

    def __post_init__(self):
        object.__setattr__(self, "respect_robots", bool(self.respect_robots))
        object.__setattr__(self, "min_delay", min(60.0, max(0.0, float(self.min_delay))))


class Robots:
    """What a host's robots.txt says; status is None where it couldn't be asked."""

    def __init__(self, status: int | None, text: str | None):
        self.status, self.rules = status, None
        if status is not None and 200 <= status < 300:
            self.rules = RobotFileParser()
            self.rules.parse((text or "").splitlines())

    def decide(self, url: str, agent: str) -> tuple[bool, str, float]:
        """(allowed, why, seconds between requests). A host without rules allows everything, one that can't say so nothing."""
        if self.rules is not None:
            allowed = self.rules.can_fetch(agent, url)
            return allowed, "allowed" if allowed else "disallowed", float(self.rules.crawl_delay(agent) or 0.0)
        if self.status is not None and 400 <= self.status < 500:
            return True, "no robots.txt", 0.0
        return False, "robots.txt unreachable", 0.0


def is_page(status: int | None, html: str | None) -> bool:
    """Whether an answer is a page: 200 and long enough, or a refusal that is a page after all, with links."""
    n = len(html or "")
    return status == 200 and n >= LEAST or status == 403 and n >= LEAST_REFUSED and LINK.search(html) is not None


class Fetcher:
    """Fetches one address after the other; robots.txt of each site is read once in KEEP seconds."""

    def __init__(self, client, policy: Policy, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.client, self.policy, self.clock, self.sleep = client, policy, clock, sleep
        self.known: dict[str, tuple[float, Robots]] = {}
        self.last: dict[str, float] = {}

    def robots(self, url: str) -> tuple[bool, str, float]:
        if not self.policy.respect_robots:
            return True, "not checked", 0.0
        site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if site not in self.known or self.clock() - self.known[site][0] >= KEEP:
            try:
                answer = Robots(*self.client.get(f"{site}/robots.txt"))
            except Exception:  # whatever the client raises, the site couldn't be asked
                answer = Robots(None, None)
            self.known[site] = (self.clock(), answer)
        return self.known[site][1].decide(url, self.policy.agent)

    def wait(self, host: str, delay: float) -> float:
        gap, last = max(self.policy.min_delay, min(delay, MOST_DELAY)), self.last.get(host)
        pause = 0.0 if last is None else max(0.0, gap - (self.clock() - last))
        if pause:
            self.sleep(pause)
        self.last[host] = self.clock()
        return pause

    def fetch(self, request_id: int | None, url: str) -> tuple:
        """A row of ROWS. method: direct, browser, robots (refused) or failed."""
        try:
            host = urlsplit(url).netloc
        except ValueError:
            host = ""
        if not host:
            return request_id, url, host, None, "failed", None, None, 0.0, "not an address"
        allowed, why, delay = self.robots(url)
        if not allowed:
            return request_id, url, host, None, "robots", None, why, 0.0, why
        pause, status, error = self.wait(host, delay), None, "no page"
        try:
            status, html = self.client.get(url)
            if is_page(status, html):
                return request_id, url, host, html, "direct", status, why, pause, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if hasattr(self.client, "render"):
            try:
                html = self.client.render(url)
                if html and len(html) >= LEAST:
                    return request_id, url, host, html, "browser", status, why, pause, None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return request_id, url, host, None, "failed", status, why, pause, error


def fetch_pages(requests: DataFrame, client_of: Callable[[pd.DataFrame], object], policy: Policy = Policy(), timer: Callable[[], tuple] = lambda: (time.monotonic, time.sleep)) -> DataFrame:
    """A row (ROWS) per row of requests (request_id, url, and whatever the client wants), in the order of request_id within each host.

    client_of makes the client from a batch of requests; timer gives the clock and the way to wait. A host's requests go to one task and
    are read there as a stream, however many they are. Fetching is not repeatable: write the result before using it twice. Null
    and broken addresses fail; an empty table gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher, names = Fetcher(None, policy, *timer()), [x.split(" ")[0] for x in ROWS.split(", ")]
        for frame in frames:
            fetcher.client = client_of(frame)
            rows = [fetcher.fetch(i, u or "") for i, u in zip(frame["request_id"], frame["url"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"status": "Int64", "request_id": "Int64"})

    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    dealt = requests.withColumn("_host", host).repartition("_host").sortWithinPartitions("_host", "request_id").drop("_host")
    return dealt.mapInPandas(run, ROWS)


class Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls, self.options = json.loads(options["urls"]), dict(options)
        self.policy = Policy(options.get("respectRobots", "true").lower() != "false", float(options.get("minDelay", "1")))

    def partitions(self) -> list[Hosts]:
        """One for each host."""
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [Hosts(urls) for _, urls in sorted(hosts.items())] or [Hosts([])]

    def read(self, partition: Hosts) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        fetcher = Fetcher(getattr(importlib.import_module(module), name)(self.options), self.policy)
        yield from (fetcher.fetch(i, url) for i, url in enumerate(partition.urls))


class PageSource(DataSource):
    """Options: urls (a list in JSON, which the driver holds), client (module:factory, called with the options), respectRobots, minDelay. request_id is the place in the host's list."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class Recorded:
    """A client that answers from records by address: (status, text) or None for a network error, and pages a browser would show."""

    def __init__(self, answers: dict[str, tuple[int, str] | None], shown: dict[str, str] | None = None):
        self.answers, self.shown = answers, shown or {}

    def get(self, url: str) -> tuple[int, str]:
        if self.answers.get(url) is None:
            raise ConnectionError("no answer")
        status, text = self.answers[url]
        return int(status), text

    def render(self, url: str) -> str | None:
        return self.shown.get(url)


def recorded_client(options: dict) -> Recorded:
    """The records in a JSON file: {"answers": {url: [status, text]}, "shown": {url: html}}."""
    with open(options["records"]) as f:
        kept = json.load(f)
    return Recorded(kept["answers"], kept.get("shown"))
