import random

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import analysis
from textquarry.functions.analysis import UNSTEMMED, drop_numeric, drop_stop_words, lowercase, strip_punctuation, whitespace_tokens
from textquarry.functions.html import outgoing_links, page_text, read_page
from textquarry.functions.porter import stem, stem_terms
from textquarry.operators import index


def run(spark, stage, tokens):
    return spark.createDataFrame([(tokens,)], "t array<string>").select(stage(F.col("t")).alias("o")).first()["o"]


def test_tokenizer(spark):
    rows = spark.createDataFrame([("a\tb\nc\rd \n\t e",), ("  \t ",), ("",), ("wait, what?!",), ("a b c",)], "t string")
    got = [r["o"] for r in rows.select(analysis.whitespace_tokens(F.col("t")).alias("o")).collect()]
    assert got == [list("abcde"), [], [], ["wait,", "what?!"], list("abc")]


def test_punctuation(spark):
    words = "?! -- ~~ [] ((map.png)) @home \"(,)ox\" wind rain! row42 ..end.. z zz".split()
    assert run(spark, analysis.strip_punctuation, words) == "map.png home ox wind rain row42 end zz".split()
    assert run(spark, analysis.strip_punctuation, ["é", "世", "a"]) == ["é", "世"]


def test_numeric_lower_stop(spark):
    assert run(spark, analysis.drop_numeric, "77 3.14 row42 rain 1999 x9y".split()) == ["row42", "rain", "x9y"]
    assert run(spark, analysis.lowercase, ["ÖFEN", "Straße"]) == ["öfen", "straße"]
    assert run(spark, analysis.drop_stop_words(), "of the harbour in which it was".split()) == ["harbour"]
    assert run(spark, analysis.drop_stop_words(), "of it was".split()) == []
    assert run(spark, analysis.drop_stop_words(), ["Of", "ferry"]) == ["Of", "ferry"]


def test_porter(spark):
    # examples of the paper that the algorithm comes from, and words of its rules in a row
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper",
        "feudalism": "feudal", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr",
        "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "homologou": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
        "roll": "roll", "": "", "42": "42",
    }
    assert {w: stem(w) for w in pairs} == pairs
    rows = spark.createDataFrame([(["sailing", None, "skies"],), (None,), ([],)], "t array<string>")
    assert [r["o"] for r in rows.select(stem_terms(F.col("t")).alias("o")).collect()] == [["sail", None, "ski"], None, []]


def test_html_body():
    page = "<html><head><title>The ferry</title></head><body><h1>Noon</h1><p>It left</p> <div>late</div></body></html>"
    assert read_page(page)["body"] == "\n It left \n late"  # a line before each block, a space before each run of text
    assert read_page(page)["title"] == "The ferry" and read_page(page)["headings"] == ["Noon"]
    assert read_page("<div><p>It <span>left</span></p></div>")["body"].strip() == "It left"
    for mark in ("navbar", "NAVBAR", "footer", "sidebar", "cookie-banner", "ads-container"):
        assert read_page(f'<div class="{mark}"><p>gone</p></div><p>kept</p>')["body"].split() == ["kept"]
        assert read_page(f'<div id="{mark}">gone</div>kept')["body"].split() == ["kept"]
    assert read_page("<p>one<div>two")["body"].split() == ["one", "two"]
    assert read_page("<a>x</a><a><b>y</b></a>")["body"].split() == ["y"]
    assert read_page("wo<b>rd</b> co<!-- -->mment")["body"].split() == ["wo", "rd", "co", "mment"]
    assert read_page("<script>no</script><style>no</style><noscript>no</noscript>yes &amp; no")["body"].split() == ["yes", "&", "no"]
    assert read_page(None) is None and read_page("")["body"] == ""


def test_links(spark):
    page = '<title> T </title><a href="/x">a</a><a href="b.PDF">b</a><a href="https://o.org/y?q#f">c</a><a href="mailto:m@x">d</a><nav class=nav><a href="/x">e</a></nav>'
    rows = spark.createDataFrame([("http://h.com/d/", page), (None, None)], "url string, html string").withColumn("p", page_text("html"))
    got = rows.select("p.first_title", outgoing_links(F.col("url"), F.col("p.hrefs")).alias("l")).collect()
    assert got[0]["first_title"] == "T" and got[0]["l"] == ["http://h.com/x", "https://o.org/y?q#f"] and got[1]["l"] == []


def test_default_pipeline(spark):
    page = "<html><body><h1>Harbour</h1><p>The boats: sailing 12 34 567 were <b>(relational)</b> to hopping. Adjustable</p></body></html>"
    assert analysis.DEFAULT.terms(spark, page) == ["boat", "sail", "relat", "hop", "adjust"]
    assert analysis.DEFAULT.terms(spark, "<h1>x</h1>") == []


def test_stages_at_once_equal_the_stages_in_a_row(spark):
    """Signs of many kinds alone, inside words and at their ends; some change their length in lower case."""
    r = random.Random(5)
    signs = list("ab1 .-_'\t\n\x0b\x1c\x85\xa0\u2003\u3000éßİΣσА٣½Ⅷⓐ\u0301\u200b😀𐐀中ªʰ%K") + ["the ", "ΟΔΟΣ. ", "I'll "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["!" * 3000, "a" + "!" * 3000, "", None]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}x x{chr(c)}" for c in range(0x3000)]

    def in_a_row(text):
        terms = whitespace_tokens(text)
        for stage in (strip_punctuation, lowercase, drop_numeric, drop_stop_words()):
            terms = stage(terms)
        return terms

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", in_a_row(F.col("t")).alias("want"), UNSTEMMED.analyze(F.col("t")).alias("got"))
    assert rows.where("not (want <=> got)").count() == 0 and rows.where("size(got) > 3").count() > 1000


def test_terms_are_grouped_in_slices(spark, monkeypatch):
    r = random.Random(6)
    lists = [None, [], *([r.choice("abcdé") for _ in range(r.randint(0, 12))] for _ in range(200)), ["z"] * 50, []]
    for most in (1, 7, 40, 250_000):
        monkeypatch.setattr(index, "SORTED", most)
        got = index._grouped.func(pa.array(lists, pa.list_(pa.string()))).to_pylist()
        want = [{t: [i for i, x in enumerate(w or []) if x == t] for t in w or []} for w in lists]
        assert [{g["term"]: g["positions"] for g in row} for row in got] == want and all(len(row) == len(w) for row, w in zip(got, want))
