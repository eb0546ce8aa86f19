"""Sources: JSON with a fallback, poll connectors with an ordered registry, saved pages, a synthetic series."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyloom.functions.scalars import clip


def read_json(spark: SparkSession, path: str, schema: str | StructType, unreadable_is_empty: bool = True) -> DataFrame:
    """The JSON document at ``path``; an empty table if it is missing or, if asked, unreadable."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE" if unreadable_is_empty else "FAILFAST").json(path)
        if unreadable_is_empty:
            rows = rows.where(F.coalesce(*[F.col(f"`{c}`").isNotNull().cast("int") * F.nullif(F.col(f"`{c}`").isNotNull().cast("int"), F.lit(0)) for c in rows.columns]).isNotNull())
        return rows
    except AnalysisException:
        return spark.createDataFrame([], schema)


def snapshots(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """All dated snapshots of a folder; missing days are just absent."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/forecast-*.json")


class RateLimited:
    """HTTP text with an interval for each host, a timeout and a few retries with doubling waits. A refusal (403,
    404) is final. ``clock`` and ``sleep`` stand for the time's, so that tests need not wait."""

    def __init__(self, agent: str = "tallyloom", interval: float = 1.5, timeout: float = 20.0, retries: int = 2, opener: Callable | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.agent, self.interval, self.timeout, self.retries = agent, interval, timeout, retries
        self.opener = opener or (lambda request, wait: urllib.request.urlopen(request, timeout=wait))
        self.clock, self.sleep = clock, sleep
        self.last: dict[str, float] = {}

    def text(self, url: str) -> str:
        host = urllib.request.urlparse(url).netloc
        for attempt in range(self.retries + 1):
            if host in self.last:
                self.sleep(max(0.0, self.last[host] + self.interval - self.clock()))
            self.last[host] = self.clock()
            try:
                with self.opener(urllib.request.Request(url, headers={"User-Agent": self.agent}), self.timeout) as reply:
                    return reply.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code in (403, 404) or attempt == self.retries:
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            self.sleep(2.0 * 2**attempt)
        raise AssertionError("unreachable")


def disallowed_paths(robots: str, agent: str) -> list[str]:
    """The paths that a robots.txt closes to everyone or to ``agent``; ``textops.robots_rules`` is its column form."""
    paths, ours = [], False
    for line in robots.splitlines():
        name, _, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            ours = value == "*" or value != "" and value.lower() in agent.lower()
        elif name == "disallow" and ours and value:
            paths.append(value)
    return paths


class HostPages(InputPartition):
    """The addresses of one host, in order; what names no host stands for itself."""

    def __init__(self, host: str, urls: list[str]):
        super().__init__(host)
        self.urls = urls


class PageReader(DataSourceReader):
    """One partition for each host, so that its pages are fetched by one task, one after the other at the host's pace,
    while other hosts' tasks run beside it. A host's robots.txt is read first; what it closes is not fetched (one that
    can't be read closes nothing). A page that fails, or is closed, is a row with an error.

    Options: ``urls`` (a JSON list), ``agent``, ``interval`` (seconds), ``retries``.
    """

    def __init__(self, options: dict, opener: Callable | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.urls = json.loads(options.get("urls", "[]"))
        self.agent, self.interval, self.retries = options.get("agent", "tallyloom"), float(options.get("interval", "1.5")), int(options.get("retries", "2"))
        self.opener, self.clock, self.sleep = opener, clock, sleep

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            hosts.setdefault(urllib.request.urlparse(url).netloc or url, []).append(url)
        return [HostPages(host, urls) for host, urls in hosts.items()]

    def read(self, partition: HostPages) -> Iterator[tuple]:
        http = RateLimited(self.agent, self.interval, retries=self.retries, opener=self.opener, clock=self.clock, sleep=self.sleep)
        closed: dict[str, list[str]] = {}
        for url in partition.urls:
            parts = urllib.request.urlparse(url)
            origin = f"{parts.scheme}://{parts.netloc}"
            try:
                if origin not in closed:
                    closed[origin] = self._closed(http, origin)
                path = parts.path or "/"
                if any(path.startswith(rule) for rule in closed[origin]):
                    yield url, None, "closed by robots.txt"
                else:
                    yield url, http.text(url), None
            except Exception as e:  # noqa: BLE001  a failing page is data
                yield url, None, f"{type(e).__name__}: {e}"[:500]

    def _closed(self, http: RateLimited, origin: str) -> list[str]:
        try:
            return disallowed_paths(http.text(f"{origin}/robots.txt"), self.agent)
        except Exception:  # noqa: BLE001  no rules to be read
            return []


class PageSource(DataSource):
    """``spark.read.format("survey_pages").option("urls", json)``: (url, html, error)."""

    @classmethod
    def name(cls) -> str:
        return "survey_pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)


def wiki_html(api: DataFrame, body: str = "html") -> DataFrame:
    """The page HTML inside a wiki API's ``action=parse`` reply."""
    return api.withColumn(body, F.get_json_object(body, "$.parse.text['*']"))


@dataclass
class Registry:
    """Connectors in order of registration; that order is their precedence."""

    sources: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, fetch: Callable[[SparkSession], DataFrame]) -> None:
        self.sources[name] = fetch

    def collect(self, spark: SparkSession, rules, id_: str = "id") -> tuple[DataFrame | None, DataFrame | None, list[tuple[str, str]]]:
        """(accepted, rejected, failures): each source by itself, so that one failure doesn't end the rest; every
        row is validated once; of rows with the same id the first registered source's stays.

        A source's rows are made and kept (a checkpoint) before the next one's, so a source that fails while its job
        runs, in a task, is reported like one that fails before, and the others' rows arrive.
        """
        from tallyloom.operators.quality import earliest_per_key, reasons, split_valid

        union, failures = None, []
        for ord_, (name, fetch) in enumerate(self.sources.items()):
            try:
                rows = fetch(spark).withColumn("origin", F.lit(name)).withColumn("source_ord", F.lit(ord_)).checkpoint()
            except Exception as e:  # noqa: BLE001  a failing source is reported, not fatal
                failures.append((name, str(e)[:500]))
                continue
            union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
        if union is None:
            return None, None, failures
        good, bad = split_valid(reasons(union, rules))
        return earliest_per_key(good, [id_], "source_ord", "ord").drop("reasons"), bad, failures


def failure_rows(spark: SparkSession, failures: list[tuple[str, str]]) -> DataFrame:
    """(source, error): the failures of ``Registry.collect`` as a table."""
    return spark.createDataFrame(failures, "source string, error string")


def fetch_pages(spark: SparkSession, urls: DataFrame, url: str = "url", **options) -> DataFrame:
    """(url, html, error) of the addresses in a table, whose order is theirs by text. The addresses of one fetch are
    a bounded list: section pages, or the articles that a section links."""
    spark.dataSource.register(PageSource)
    listed = sorted(r[0] for r in urls.select(url).where(F.col(url).isNotNull()).distinct().toLocalIterator())
    reader = spark.read.format(PageSource.name()).option("urls", json.dumps(listed))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def synthetic_attention(parties: DataFrame, days: int, last_day) -> DataFrame:
    """A deterministic placeholder series: day, party_id, volume_share, sentiment, engagement_share.

    ``parties``: party_id (string), base, drift, mood. Waves depend on the day and the length of the id.
    """
    t = F.col("t").cast("double")
    n = F.char_length("party_id")
    grid = parties.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t"))
    wave = F.sin((t + n) * 0.7) * 0.004
    return grid.select(
        F.date_sub(last_day, (F.lit(days - 1) - F.col("t")).cast("int")).alias("day"), "party_id",
        F.greatest(F.lit(0.001), F.col("base") + F.col("drift") * t + wave).alias("volume_share"),
        clip(F.col("mood") + F.sin(0.4 * t + n) * 0.03, -1.0, 1.0).alias("sentiment"),
        F.greatest(F.lit(0.001), F.col("base") + F.col("drift") * 0.8 * t + wave).alias("engagement_share"),
    )
