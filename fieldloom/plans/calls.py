"""Calls of models that may be busy: dealt by backend, spaced by a token bucket, tried again, and every attempt recorded.

The model is any callable ``(call: dict) -> dict``. It raises ``Busy`` where the backend asks for patience (429, 503); such a call is made again
after a wait that doubles, or as long as the backend asks for, and any other exception is the call's error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[dict], dict]
#: Answers that ask for patience, attempts after the first one, and the first and longest wait in seconds.
TRANSIENT, RETRIES, FIRST_WAIT, LONGEST_WAIT = (429, 503), 5, 10.0, 60.0
ATTEMPTS = "array<struct<attempt:int,status:int,error:string,wait:double>>"
ANSWERS = f"call_id string, backend string, raw string, finish string, tokens_in long, tokens_out long, error string, paced double, waited double, attempts {ATTEMPTS}"


class Busy(Exception):
    """A backend's answer that isn't one. retry_after: seconds as the backend gives them; resets_at: a time in ISO form."""

    def __init__(self, status: int, retry_after: str | float | None = None, resets_at: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after, self.resets_at = status, retry_after, resets_at

    def asked(self, now: datetime | None = None) -> float:
        """Seconds that the backend asks for; 0 if it says nothing that can be read."""
        try:
            return float(self.retry_after)
        except (TypeError, ValueError):
            pass
        try:
            at = datetime.fromisoformat(self.resets_at.replace("Z", "+00:00"))
            return (at - (now or datetime.now(timezone.utc))).total_seconds()
        except (AttributeError, TypeError, ValueError):
            return 0.0


def wait_of(asked: float, attempt: int) -> float:
    return min(max(asked, FIRST_WAIT * 2**attempt), LONGEST_WAIT)


@dataclass(frozen=True)
class Limits:
    """rate: calls a second and backend (0: no limit), burst: calls that may go out at once after a rest, lanes: tasks that share a backend's calls and its rate."""

    rate: float = 0.0
    burst: int = 1
    lanes: int = 1
    retries: int = RETRIES

    def __post_init__(self):
        if self.rate < 0 or self.burst < 1 or self.lanes < 1 or self.retries < 0:
            raise ValueError(f"bad limits: {self}")


class Bucket:
    """Tokens that fill up at a rate; taking one that isn't there yet waits for it."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> float:
        if not self.rate:
            return 0.0
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        wait = max(0.0, (1 - self.tokens) / self.rate)
        if wait:
            self.sleep(wait)
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= 1
        return wait


def attempted(model: Model, call: dict, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, take: Callable[[], float] = lambda: 0.0) -> tuple[dict | None, list[dict], float, Exception | None]:
    """(answer or None, attempts, seconds waited for tokens, the last exception)."""
    made, paced = [], 0.0
    for attempt in range(retries + 1):
        paced += take()
        try:
            answer = model(call)
            made.append({"attempt": attempt, "status": 200, "error": None, "wait": 0.0})
            return answer, made, paced, None
        except Busy as e:
            last = attempt == retries or e.status not in TRANSIENT
            wait = 0.0 if last else wait_of(e.asked(), attempt)
            made.append({"attempt": attempt, "status": e.status, "error": str(e), "wait": wait})
            if last:
                return None, made, paced, e
            sleep(wait)
        except Exception as e:  # the call's own failure, kept as its result
            made.append({"attempt": attempt, "status": None, "error": f"{type(e).__name__}: {e}", "wait": 0.0})
            return None, made, paced, e
    raise AssertionError


def patient(model: Model, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Model:
    """model with its attempts made again; the answer has them as ``attempts``, and so has the exception of the last one."""

    def call_(call: dict) -> dict:
        answer, made, _, error = attempted(model, call, retries, sleep)
        if error is not None:
            error.attempts = made
            raise error
        return {**answer, "attempts": made}

    return call_


def call_all(calls: DataFrame, model: Model, limits: Limits = Limits(), timer: Callable[[], tuple] = lambda: (time.monotonic, time.sleep)) -> DataFrame:
    """A row (ANSWERS) per row of calls (call_id, backend, prompt, and whatever the model wants): the answer or an error, with every attempt.

    Calls are dealt by backend and lane; a lane's calls go out one after the other at its share of the rate, however many they
    are, and are read as a stream. A lane that runs again after a lost executor calls again: write the result before using it twice.
    """
    names = [x.split(" ")[0] for x in ANSWERS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock, sleep = timer()
        buckets: dict[tuple, Bucket] = {}
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                key = (row["backend"], row.pop("_lane"))
                if key not in buckets:
                    buckets.clear()  # calls come lane by lane
                    buckets[key] = Bucket(limits.rate / limits.lanes, limits.burst, clock, sleep)
                answer, made, paced, error = attempted(model, row, limits.retries, sleep, buckets[key].take)
                answer = answer or {}
                said = "" if error is None else made[-1]["error"]
                out.append((str(row["call_id"]), row["backend"], answer.get("raw"), answer.get("finish"), answer.get("tokens_in"), answer.get("tokens_out"), said, paced, sum(a["wait"] for a in made), made))
            yield pd.DataFrame(out, columns=names).astype({"tokens_in": "Int64", "tokens_out": "Int64"})

    dealt = calls.withColumn("_lane", F.pmod(F.xxhash64("call_id"), F.lit(limits.lanes))).repartition("backend", "_lane").sortWithinPartitions("backend", "_lane", "call_id")
    return dealt.mapInPandas(run, ANSWERS)
