import http.server
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from textquarry import __main__ as cli
from textquarry.operators import crawl
from textquarry.sources.segments import Store
from textquarry.sources.store import Pages

NEW = "url string, title string, html_body string, outgoing_links array<string>, depth int, is_seed boolean"
SITE = {
    "/": ("text/html", "<title>Home</title><p>welcome to the harbour</p><a href=/boats>b</a><a href=/data>d</a><a href=/huge>h</a><a href=/x.pdf>x</a>"),
    "/boats": ("text/html; charset=latin-1", "<title>Boats</title><p>ferries and café boats</p><a href=/>home</a><a href=/deep>d</a>"),
    "/deep": (None, "<title>Deep</title><p>submarines</p>"),
    "/data": ("application/json", "{}"),
    "/huge": ("text/html", "x" * 3000),
}


@pytest.fixture
def main(spark, monkeypatch):
    monkeypatch.setattr(cli.SparkSession.builder.__class__, "getOrCreate", lambda self: spark)
    return cli.main


@pytest.fixture
def site():
    """A small web site on this machine; it fails once for each address."""
    failed = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path not in failed:
                failed.add(self.path)
                self.connection.close()
                return
            kind, body = SITE.get(self.path, ("text/html", "<p>missing</p>"))
            self.send_response(200 if self.path in SITE else 404)
            if kind:
                self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode("latin-1"))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_index_and_search(spark, main, tmp_path, capsys):
    base = str(tmp_path)
    pages = Pages(spark, base)
    pages.upsert(spark.createDataFrame([("http://a", "A", "<p>green apples grow</p>", [], 0, True), ("http://b", "B", "<p>red pears</p>", [], 1, False)], NEW))
    main(["--base", base, "index"])
    assert pages.count(F.col("indexed")) == 2
    pages.upsert(spark.createDataFrame([("http://b", "B2", "<p>green pears</p>", [], 1, False), ("http://c", "C", "", [], 1, False)], NEW))
    main(["--base", base, "index", "--page-fetch-limit", "1", "--budget-bytes", "1000000"])
    assert pages.count(F.col("indexed")) == 3
    capsys.readouterr()
    for query, titles in (("green", ["A", "B2"]), ("red", []), ("apples growing", ["A"])):
        main(["--base", base, "search", query])
        answer = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert sorted(r["title"] for r in answer["results"]) == titles and answer["total_results"] == len(titles)
    # a page that is emptied leaves the index
    pages.upsert(spark.createDataFrame([("http://a", "A", "<p> </p>", [], 0, True)], NEW))
    main(["--base", base, "index"])
    main(["--base", base, "search", "apples"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["results"] == []
    # cleaned content is what snippets are cut from
    main(["--base", base, "clean"])
    main(["--base", base, "search", "green"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["results"][0]["snippet"] == "green pear"


def test_another_stop_list(spark, main, tmp_path, capsys):
    pages = Pages(spark, str(tmp_path))
    pages.upsert(spark.createDataFrame([("http://a", "A", "<p>the used boat</p>", [], 0, True)], NEW))
    (tmp_path / "stop").write_text("used\n\nboat\n", encoding="utf-8")
    main(["--base", str(tmp_path), "--stop-words", str(tmp_path / "stop"), "index"])
    assert [r["term"] for r in Store(spark, str(tmp_path)).segments.index().collect()] == ["the"]
    main(["--base", str(tmp_path), "--stop-words", str(tmp_path / "stop"), "search", "used the"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total_results"] == 1


def test_index_goes_on_after_a_failure(spark, main, tmp_path, monkeypatch):
    """Postings are durable before pages are marked; a run that was cut off in between is repeated without doubling."""
    pages = Pages(spark, str(tmp_path))
    pages.upsert(spark.createDataFrame([("http://a", "A", "<p>apples apples</p>", [], 0, True)], NEW))
    mark = Pages.mark_indexed
    monkeypatch.setattr(Pages, "mark_indexed", lambda self, ids: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        main(["--base", str(tmp_path), "index"])
    monkeypatch.setattr(Pages, "mark_indexed", mark)
    main(["--base", str(tmp_path), "index"])
    assert [tuple(r) for r in Store(spark, str(tmp_path)).segments.index().select("term", "positions").collect()] == [("appl", [0, 1])]


def test_crawl_of_a_site(spark, main, site, tmp_path, monkeypatch):
    monkeypatch.setattr(crawl, "BACK_OFF_MS", 0)
    stored, batches = Pages.upsert, []
    monkeypatch.setattr(Pages, "upsert", lambda self, new, order=None: (stored(self, new, order), batches.append(self.count())))
    monkeypatch.setattr(cli.crawling.fetched, "__defaults__", (150, crawl.fetch, 4, 1))
    main(["--base", str(tmp_path), "crawl", "--url", site + "/", "--max-depth", "2", "--max-concurrent-fetches", "2", "--frontier-size", "2"])
    pages = {r["url"].removeprefix(site): r for r in Pages(spark, str(tmp_path)).read().collect()}
    assert set(pages) == {"/", "/boats", "/deep", "/huge"} and {u: r["depth"] for u, r in pages.items()} == {"/": 0, "/boats": 1, "/deep": 2, "/huge": 1}
    assert pages["/"]["title"] == "Home" and pages["/"]["is_seed"] and "café" in pages["/boats"]["html_body"]
    assert len(batches) >= 3 and batches[0] == 1  # each batch is stored before the next is fetched
    with pytest.raises(crawl.TooLarge):
        crawl.fetch(site + "/huge", limit=2999)
    with pytest.raises(crawl.NotHtml):
        crawl.fetch(site + "/data")
    assert crawl.fetch_retrying("http://127.0.0.1:1/", back_off_ms=0) == (None, "failed")


def test_serve(spark, tmp_path):
    base = str(tmp_path)
    store = Store(spark, base)
    store.pages.upsert(spark.createDataFrame([(f"http://{c}", c.upper(), f"<p>green apples {c}{c}</p>", [], 0, True) for c in "abc"], NEW))
    from textquarry.operators import index

    rows = store.pages.read()
    store.segments.replace(index.postings(rows, "_id", "html_body"), rows.selectExpr("_id as doc_id"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(spark, base, 2))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"

    def post(body, path="/api/search"):
        request = urllib.request.Request(root + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as answer:
            assert answer.headers["Access-Control-Allow-Origin"] == "*"
            return json.load(answer)

    first = post({"query": "Green apples"})
    assert first["total_results"] == 3 and len(first["results"]) == 2 and first["highlighted_terms"] == ["Green", "apples"] and first["processing_time_ms"] >= 0
    assert set(first["results"][0]) == {"id", "title", "url", "snippet", "depth"}
    rest = post({"query": "Green apples", "after": first["next"]})
    assert len(rest["results"]) == 1 and "next" not in rest and rest["total_results"] == 3
    assert {r["title"] for r in first["results"] + rest["results"]} == set("ABC")
    for body, status in (({"query": "  "}, 400), ({"words": "x"}, 422), ([], 422)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(body)
        assert e.value.code == status
    with pytest.raises(urllib.error.HTTPError):
        post({"query": "x"}, "/elsewhere")
    with urllib.request.urlopen(root + "/") as page:
        assert b"search.js" in page.read()
    with urllib.request.urlopen(root + "/search.js") as script:
        assert b"/api/search" in script.read()
    server.shutdown()
