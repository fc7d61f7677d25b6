"""Command line: crawl, index, clean, search and serve over one base folder."""

from __future__ import annotations

import argparse
import http.server
import json
import pathlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.analysis import DEFAULT, Analyzer, stop_words_of, with_cleaned_content, with_stop_words
from .operators import crawl as crawling
from .operators import index as indexing
from .operators import search as searching
from .sources.segments import Store
from .sources.store import new_ids, unindexed

STATIC = pathlib.Path(__file__).parent / "static"


def _analyzer(args: argparse.Namespace) -> Analyzer:
    return with_stop_words(stop_words_of(args.stop_words)) if args.stop_words else DEFAULT


def _crawl(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = Store(spark, args.base).pages

    def store(got):
        pages.upsert(got.select(
            new_ids().alias("_id"), "url", "title", F.col("html").alias("html_body"), "outgoing_links", "depth", "is_seed", F.current_timestamp().alias("crawled_at")
        ))

    crawling.crawl(spark, [args.url], args.max_depth, args.max_concurrent_fetches, frontier_size=args.frontier_size, store=store)


def _index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Indexes the pages that are not yet, batch by batch; a batch is marked once its postings are durable."""
    store = Store(spark, args.base)
    # what is over a task's memory is spilled by Spark; the budget bounds the page text that a task reads at once
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(args.budget_bytes))
    while True:
        todo = unindexed(store.pages.read()).select("_id", "html_body")
        if args.page_fetch_limit:
            todo = todo.orderBy("_id").limit(args.page_fetch_limit)
        if todo.isEmpty():
            return
        ids = todo.select("_id")
        store.segments.replace(indexing.postings(todo, "_id", "html_body", _analyzer(args), unique=True), ids.withColumnRenamed("_id", "doc_id"))
        store.pages.mark_indexed(ids)


def _clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fills cleaned_content: the page's terms joined by a space, which snippets are then cut from."""
    pages = Store(spark, args.base).pages
    pages.overwrite(with_cleaned_content(pages.read(), "html_body", _analyzer(args)))


def _search(spark: SparkSession, args: argparse.Namespace) -> None:
    store = Store(spark, args.base)
    answer = searching.search(store.pages.read(), store.segments.index(), args.query, _analyzer(args), args.strict)
    print(json.dumps(answer.collect(args.limit, args.after)))


def handler(spark: SparkSession, base: str, most: int, analyzer: Analyzer = DEFAULT):
    """The request handler: POST /api/search with {"query": ...}, and the files of the user interface.

    A request may name a ``limit`` (at most ``most``) and the id to go on
    ``after``. A blank query is a bad request.
    """
    store = Store(spark, base)

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(STATIC))

        def end_headers(self):
            for name in ("Origin", "Methods", "Headers"):
                self.send_header(f"Access-Control-Allow-{name}", "*")
            super().end_headers()

        def _send(self, status: int, data: str, kind: str) -> None:
            body = data.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self):
            self._send(200, "", "text/plain")

        def do_POST(self):
            if self.path != "/api/search":
                return self._send(404, "Not found", "text/plain")
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                query, limit, after = body["query"], min(int(body.get("limit", most)), most), body.get("after")
                if not query.strip():
                    return self._send(400, "Query cannot be empty", "text/plain")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return self._send(422, f"Bad request: {e}", "text/plain")
            try:
                answer = searching.search(store.pages.read(), store.segments.index(), query, analyzer).collect(limit, after)
            except Exception as e:  # noqa: BLE001  whatever the search fails by is the server's fault
                return self._send(500, f"Search error: {e}", "text/plain")
            return self._send(200, json.dumps(answer), "application/json")

    return Handler


def _serve(spark: SparkSession, args: argparse.Namespace) -> None:
    http.server.ThreadingHTTPServer((args.host, args.port), handler(spark, args.base, args.max_results, _analyzer(args))).serve_forever()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textquarry")
    parser.add_argument("--base", default="textquarry-data", help="folder of all tables")
    parser.add_argument("--stop-words", default=None, metavar="FILE", help="another stop list, one word in a line; the same for index and search")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("crawl")
    p.add_argument("-u", "--url", required=True)
    p.add_argument("-d", "--max-depth", type=int, default=0)
    p.add_argument("-f", "--max-concurrent-fetches", type=int, default=150)
    p.add_argument("-s", "--frontier-size", type=int, default=None, help="addresses of a level that are fetched and stored together (default: all)")
    p.set_defaults(run=_crawl)
    p = sub.add_parser("index")
    p.add_argument("-p", "--page-fetch-limit", type=int, default=None, help="pages of a batch, by id (default: all pages are one batch)")
    p.add_argument("-b", "--budget-bytes", type=int, default=100_000_000, help="bytes of pages that a task reads at once; beyond its memory Spark spills")
    p.set_defaults(run=_index)
    sub.add_parser("clean").set_defaults(run=_clean)
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--limit", type=int, default=None, help="results to print (default: all)")
    p.add_argument("--after", default=None, help="id to go on after")
    p.set_defaults(run=_search)
    p = sub.add_parser("serve")
    p.add_argument("-p", "--port", type=int, default=3000)
    p.add_argument("-H", "--host", default="127.0.0.1")
    p.add_argument("--max-results", type=int, default=10_000, help="results of one answer; a request goes on after the last")
    p.set_defaults(run=_serve)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("textquarry").getOrCreate(), args)


if __name__ == "__main__":
    main()
