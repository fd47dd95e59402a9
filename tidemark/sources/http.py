"""Repository search and file fetches over HTTP (S1, S3, S16): a partition a query, or rows of requests dealt over connections.

Both use one policy of retries and waits, a function of an answer and the number of the attempt that
is tested without a network. Nothing is fetched by the driver. A task that is run again asks
again: requests only read. Land what is fetched (Parquet) before it is used more than once.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 45
# Seconds to wait before the next attempt (first, and more for each attempt after it).
BROKEN, FAILING, THROTTLED = (2, 2), (2, 2), (4, 4)


@dataclass
class Answer:
    status: int
    body: bytes = b""
    headers: dict = field(default_factory=dict)

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)


def after(answer: Answer | None, attempt: int, now: float) -> tuple[str, float]:
    """What follows an answer (None if there was none): 'take' it, 'give up', or ask 'again' after so many seconds.

    A used-up allowance waits until it is renewed and two seconds more; another refusal (403, 429) as
    long as it says, or longer each time; so do servers that fail and lines that break. Any other
    status from 400 on is final.
    """
    wait = lambda kind: float(kind[0] + kind[1] * attempt)
    if answer is None:
        return "again", wait(BROKEN)
    if answer.status in (403, 429):
        reset, asked = answer.header("X-RateLimit-Reset"), answer.header("Retry-After")
        if answer.header("X-RateLimit-Remaining") == "0" and reset:
            return "again", max(1.0, int(reset) - int(now) + 2.0)
        return "again", float(asked) if asked and asked.isdigit() else wait(THROTTLED)
    if answer.status >= 500:
        return "again", wait(FAILING)
    return ("give up", 0.0) if answer.status >= 400 else ("take", 0.0)


def send(url: str, headers: dict) -> Answer | None:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:
            return Answer(r.status, r.read(), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Answer(e.code, e.read(), dict(e.headers))
    except OSError:
        return None


def get(url: str, headers: dict, retries: int = 4, scale: float = 1.0, ask: Callable = send, sleep: Callable = time.sleep, clock: Callable = time.time) -> tuple[Answer | None, bool]:
    """The answer, if one was taken, and whether it ended by itself (False: attempts ran out)."""
    for attempt in range(retries):
        answer = ask(url, headers)
        what, seconds = after(answer, attempt, clock())
        if what != "again":
            return (answer if what == "take" else None), True
        sleep(seconds * scale)
    return None, False


# ---- paged search ---------------------------------------------------------------


@dataclass
class Query(InputPartition):
    """One query of the search: all its pages are one partition."""

    query: str

    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Query]:
        return [Query(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: Query) -> Iterator[tuple]:
        """Pages from the first on, up to the first that is empty or can't be had."""
        o = self.options
        headers = json.loads(o.get("headers", "{}"))
        for page in range(1, int(o.get("pages", 3)) + 1):
            asked = {"q": partition.query, "sort": "updated", "order": "desc", "per_page": o.get("per_page", "100"), "page": page}
            answer, _ = get(f"{o['url']}?{urllib.parse.urlencode(asked)}", headers, int(o.get("retries", 4)), float(o.get("wait_scale", 1)))
            if answer is None or not json.loads(answer.body).get("items"):
                return
            yield partition.query, page, answer.body.decode("utf-8", "replace")


class SearchSource(DataSource):
    """format("repository_search"): query, page, body. Options: url, queries (a JSON list), pages, per_page, retries, headers (JSON), wait_scale."""

    @classmethod
    def name(cls) -> str:
        return "repository_search"

    def schema(self) -> str:
        return "query string, page int, body string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


def search(spark: SparkSession, url: str, queries: list[str], **options) -> DataFrame:
    """Landed-page rows (query, page, body) of each query: what ``tables.search_results`` reads."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
    spark.dataSource.register(SearchSource)
    return spark.read.format("repository_search").options(url=url, queries=json.dumps(queries), **{k: str(v) for k, v in options.items()}).load()


# ---- fetches --------------------------------------------------------------------


def fetched(requests: DataFrame, url_col: str = "url", connections: int = 8, headers: dict | None = None, retries: int = 5, wait_scale: float = 1.0, strict: bool = True) -> DataFrame:
    """requests, all their columns, with status and body; body is null where there is nothing (404).

    Rows are dealt over ``connections`` tasks, each with one request at a time. Any other refusal, and
    attempts that run out, fail the task if ``strict``, and give a null status and body otherwise.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    sent = headers or {}
    place = requests.columns.index(url_col)

    def run(batches):
        for batch in batches:
            status, body = [], []
            for url in batch.column(place).to_pylist():
                seen = []
                answer, ended = (None, True) if url is None else get(url, sent, retries, wait_scale, lambda u, h: seen.append(send(u, h)) or seen[-1])
                last = seen[-1].status if seen and seen[-1] is not None else None
                if answer is None and url is not None and strict and not (ended and last == 404):
                    raise RuntimeError(f"{url}: {'status ' + str(last) if last else 'no answer'}")
                status.append(last if ended else None)
                body.append(answer.body.decode("utf-8", "replace") if answer else None)
            out = pa.Table.from_batches([batch]).append_column("status", pa.array(status, pa.int32())).append_column("body", pa.array(body, pa.string()))
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", status int, body string"
    return requests.repartition(connections, F.xxhash64(F.col(url_col))).mapInArrow(run, schema)
