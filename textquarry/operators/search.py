"""Search results: hits joined to their pages, with snippets and highlighting."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import DEFAULT, Analyzer
from .query import phrase

SNIPPET_BYTES = 200


def snippet(content: Column, limit: int = SNIPPET_BYTES) -> Column:
    """The content, or its beginning and '...' when it has more bytes than ``limit``."""
    return F.when(F.octet_length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)


def shown_content(cleaned: Column, raw: Column) -> Column:
    """Cleaned content where there is any, else the raw page."""
    return F.when(F.coalesce(cleaned, F.lit("")) != "", cleaned).otherwise(raw)


def highlight_terms(query: str) -> list[str]:
    """Words of the raw query, as typed and with repeats."""
    return query.split()


def strip_tags(text: Column) -> Column:
    """Text without scripts, styles and tags."""
    plain = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(plain, r"(?s)<[^>]*>", "")


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with each term, in any case and before a stop or space, in mark tags, one term after the other."""
    out = escape_html(text)
    for term in terms:
        clean = re.sub(r"[^A-Za-z0-9_\s]", "", term).strip()
        if clean:
            out = F.regexp_replace(out, rf"(?i)({clean})(?=[\s.,;:!?<]|$)", "<mark>$1</mark>")
    return out


def results(pages: DataFrame, hits: DataFrame, doc_id: str = "_id") -> DataFrame:
    """id, title, url, snippet, depth of the pages that were hit."""
    found = pages.join(hits.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
    content = shown_content(F.col("cleaned_content"), F.col("html_body"))
    return found.select(F.col(doc_id).alias("id"), "title", "url", snippet(content).alias("snippet"), "depth")


class Answer:
    """A search response: result rows, their number, the words to highlight and the time taken."""

    def __init__(self, rows: DataFrame, query: str, started: float):
        self.rows, self.query, self.highlight = rows, query, highlight_terms(query)
        self._started = started

    def collect(self, limit: int | None = None, after: str | None = None) -> dict:
        """The results in id order: all, or ``limit`` of them with ids over ``after``.

        ``total_results`` counts all results; where more follow, ``next`` is the
        id to go on after. With a limit the driver never holds more rows.
        """
        rows = self.rows if after is None else self.rows.where(F.col("id") > F.lit(after))
        found = [r.asDict() for r in (rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit + 1)).collect()]
        more = limit is not None and len(found) > limit
        shown = found[:limit] if more else found
        total = len(shown) if after is None and not more else self.rows.count()
        taken = int((time.time() - self._started) * 1000)
        out = {"query": self.query, "results": shown, "total_results": total, "highlighted_terms": self.highlight, "processing_time_ms": taken}
        return out | ({"next": shown[-1]["id"] if shown else after} if more else {})


def search(pages: DataFrame, index: DataFrame, query: str, analyzer: Analyzer = DEFAULT, strict: bool = False) -> Answer:
    """Pages that match ``query``; a blank query is refused."""
    if not query.strip():
        raise ValueError("the query is empty")
    return Answer(results(pages, phrase(index, query, analyzer, strict)), query, time.time())
