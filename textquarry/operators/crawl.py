"""Collection side: page parsing, breadth-first traversal and the filters of a fetcher."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import DENIED, page_parts
from ..sources.scratch import Scratch

MAX_BYTES = 15 * 1024 * 1024
ATTEMPTS = 4
BACK_OFF_MS = 2_000


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with title (first title element) and outgoing_links (sorted)."""
    rows = pages.withColumn("__page", page_parts(F.col(url), F.col(html), "first_title", "outgoing_links"))
    rows = rows.withColumns({"title": F.col("__page.first_title"), "outgoing_links": F.coalesce("__page.outgoing_links", F.array().cast("array<string>"))})
    return rows.drop("__page")


def fits(url: Column, html: Column, limit: int = MAX_BYTES) -> Column:
    """Whether a page with its address stays within the size limit in bytes."""
    return F.octet_length(html) + F.octet_length(url) <= limit


def _ending() -> str:
    return "(" + "|".join(e.replace(".", r"\.") for e in DENIED) + ")$"


def fetchable(url: Column) -> Column:
    """Whether the address has no denied ending; letter case counts, as it does before a fetch."""
    return ~url.rlike(_ending())


def followable(url: Column) -> Column:
    """Whether a found link may be followed: http(s), no denied ending in any letter case."""
    return url.rlike("^https?://") & ~F.lower(url).rlike(_ending())


def is_html(content_type: Column) -> Column:
    """A missing content type passes, any other has to contain html."""
    return content_type.isNull() | F.contains(content_type, F.lit("html"))


def traverse(pages: DataFrame, seeds: list[str], max_depth: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """url, depth, is_seed of the pages reached from ``seeds``, level by level, each at its smallest depth.

    ``pages`` has url and outgoing_links. ``keep`` materialises a level so that
    the plan does not grow with the depth (default: written tables).
    """
    spark = pages.sparkSession
    keep = keep or Scratch(spark, "traverse").keep
    links = pages.select("url", "outgoing_links")
    frontier = keep(spark.createDataFrame([(u,) for u in dict.fromkeys(seeds)], "url string"))
    visited = frontier.select("url", F.lit(0).alias("depth"), F.lit(True).alias("is_seed"))
    for depth in range(1, max_depth + 1):
        found = links.join(frontier, "url", "left_semi").select(F.explode("outgoing_links").alias("url")).distinct()
        frontier = keep(found.join(visited.select("url"), "url", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("url", F.lit(depth).alias("depth"), F.lit(False).alias("is_seed")))
    return visited.join(links.select("url"), "url", "left_semi")


class NotHtml(Exception):
    """The answer is no HTML."""


class DeniedEnding(Exception):
    """The address has an ending that is not fetched."""


class TooLarge(Exception):
    """The answer has more bytes than a page may have."""


def fetch(url: str, timeout: float = 30.0, limit: int = MAX_BYTES) -> str:
    """One page by HTTP. The status is not looked at, only the kind of content; of a body over the limit no more is read."""
    if url.endswith(DENIED):
        raise DeniedEnding(url)
    try:
        answer = urllib.request.urlopen(url, timeout=timeout)  # noqa: S310
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        kind = answer.headers.get("content-type")
        if kind is not None and "html" not in kind:
            raise NotHtml(url)
        body = answer.read(limit + 1)
        if len(body) > limit:
            raise TooLarge(url)
        return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch_retrying(url: str, get: Callable[[str], str] = fetch, attempts: int = ATTEMPTS, back_off_ms: int = BACK_OFF_MS) -> tuple[str | None, str]:
    """(page or None, status); answers that are no HTML are not tried again."""
    for attempt in range(1, attempts + 1):
        try:
            return get(url), "ok"
        except NotHtml:
            return None, "not_html"
        except DeniedEnding:
            return None, "denied_ending"
        except TooLarge:
            return None, "too_large"
        except Exception:  # noqa: BLE001  any failure of the network
            if attempt < attempts:
                time.sleep(attempt * back_off_ms / 1000)
    return None, "failed"


def fetched(frontier: DataFrame, concurrent: int = 150, get: Callable[[str], str] = fetch, attempts: int = ATTEMPTS, back_off_ms: int = BACK_OFF_MS) -> DataFrame:
    """url, html, status for the addresses of ``frontier``, over ``concurrent`` partitions."""

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            rows = [(u, *fetch_retrying(u, get, attempts, back_off_ms)) for u in batch["url"]]
            yield pd.DataFrame(rows, columns=["url", "html", "status"])

    return frontier.select("url").repartition(concurrent).mapInPandas(run, "url string, html string, status string")


def crawl(
    spark, seeds: list[str], max_depth: int = 0, concurrent: int = 150, get: Callable[[str], str] = fetch, keep: Callable[[DataFrame], DataFrame] | None = None,
    frontier_size: int | None = None, store: Callable[[DataFrame], None] | None = None, fetch_all: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """url, html, title, outgoing_links, depth, is_seed of fetched pages, one BFS level after the other.

    A level is fetched at once, or in batches of about ``frontier_size``
    addresses. ``keep`` (default: written tables) materialises what was
    fetched, so that nothing is fetched twice; ``store`` gets every batch
    before the next begins, so that a crawl that fails has stored what it had.
    ``fetch_all`` may take the place of ``fetched`` with its defaults.
    """
    fetch_all = fetch_all or (lambda rows: fetched(rows, concurrent, get))
    keep = keep or Scratch(spark, "crawl").keep
    frontier = keep(spark.createDataFrame([(u,) for u in dict.fromkeys(seeds)], "url string"))
    visited, out = frontier, None
    for depth in range(max_depth + 1):
        batches = 1 if not frontier_size else max(1, -(-frontier.count() // frontier_size))
        level = None
        for i in range(batches):
            part = frontier.where(F.pmod(F.xxhash64("url"), F.lit(batches)) == i) if batches > 1 else frontier
            got = fetch_all(part).where("status = 'ok'").where(fits(F.col("url"), F.col("html")))
            got = keep(parsed(got.drop("status")).withColumns({"depth": F.lit(depth), "is_seed": F.lit(depth == 0)}))
            if store:
                store(got)
            level = got if level is None else level.unionByName(got)
        out = level if out is None else out.unionByName(level)
        frontier = keep(level.select(F.explode("outgoing_links").alias("url")).distinct().join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return out
