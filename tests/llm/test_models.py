"""Text extraction, scoring, classification, rules and search: brute force, held-out accuracy, edge cases."""

import collections
import fractions
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import html_extraction as hx
from textquarry.llm import language_id, lm_score, maxscore, quality_rules, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return hx.default_model()


def test_extraction_of_unseen_layouts(model):
    right = total = 0
    for page in hx.labelled_pages(60, seed=77):
        nodes, labels = hx._labels(page)
        model.marginals(nodes)
        for node, label in zip(nodes, labels):
            if node.chars:
                total += 1
                right += (node.p >= 0.5) == bool(label)
    assert right / total > 0.98


def test_marginals_equal_enumeration(model):
    nodes, _ = hx.parse("<nav><ul><li><a href=x>home</a></li></ul></nav><article><p>some words here</p><p>more</p></article>")
    model.marginals(nodes)
    own = [model.score(n) for n in nodes]
    weights = {}
    for state in itertools.product((0, 1), repeat=len(nodes)):
        x = sum(s * o for s, o in zip(state, own))
        for n, s in zip(nodes, state):
            if n.parent is not None:
                x += model.pair[hx.kind(n)][2 * state[nodes.index(n.parent)] + s]
        weights[state] = math.exp(x)
    total = sum(weights.values())
    for i, n in enumerate(nodes):
        assert n.p == pytest.approx(sum(w for s, w in weights.items() if s[i]) / total, abs=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1><a href=/>Site</a></h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p>First wo<b>rd</b> of   the\n text<br>next<p>Second &lt;p&gt; &eacute;.</p><form><input><button>Send</button></form></article>
<aside class=sidebar><p>Related things</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree</p></div></section>
<footer>&copy; 2020 someone</footer></body></html>"""


def test_extraction_of_a_page(model):
    assert hx.text_of(PAGE, model) == "Head & line First word of the text next Second <p> é."
    for odd in (None, "", "   ", "<", "<<<>>>", "</p></div>", "<p", "<!-- open", "<script>never closed", "a<b", "<p class='x>y"):
        assert isinstance(hx.text_of(odd, model), str)
    assert hx.text_of("<div>" * 3000 + "deep" + "</div>" * 3000, model) in ("deep", "")


def test_formulas_and_fallbacks_stay_in_their_paragraph(model):
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mn>42</mn></mrow><annotation encoding=tex>E=42 tex</annotation></semantics></math>"
    rest = " and a good many further words of plain prose follow here so that the paragraph is long enough"
    page = f"<body><article><p>The energy {formula} is known, <object data=x><param name=y>a fallback</object> too{rest}.</p><p>Second{rest}.</p></article></body>"
    text = hx.text_of(page, model)
    assert text == f"The energy E=42 is known, a fallback too{rest}. Second{rest}."


STORY = "The ferry left the harbour at noon and nobody on board had any idea how long the crossing would take."
MORE = "By the evening the wind had dropped, and the captain told them that they would have to wait for the tide."
# Pages written by hand, in layouts that the module's own templates don't have, with their main text.
LAYOUTS = {
    "no container": (f"<body><h1>A crossing</h1><p>{STORY}</p><p>{MORE}</p></body>", f"A crossing {STORY} {MORE}"),
    "unnamed divisions": (f"<body><div><p>{STORY}</p><p>Another one.</p></div></body>", f"{STORY} Another one."),
    "no tag at all": (STORY, STORY),
    "unclosed paragraphs": (f"<p>{STORY}<p>{MORE}", f"{STORY} {MORE}"),
    "nested divisions with breaks": (f"<body><div><div><div>{STORY}<br>{MORE}</div></div></div></body>", f"{STORY} {MORE}"),
    "a layout table": (f"<body><table><tr><td>{STORY}</td></tr><tr><td>{MORE}</td></tr></table></body>", f"{STORY} {MORE}"),
    "old formatting": (f"<body bgcolor=white><center><font size=2>{STORY}</font></center><hr><p>{MORE}</body>", f"{STORY} {MORE}"),
    "a header in the article": (
        f"<body><header><a href=/>The Gazette</a></header><article><header class='article-header'><h1>A crossing</h1></header><p>{STORY}</p><p>{MORE}</p></article><footer>Imprint</footer></body>",
        f"A crossing {STORY} {MORE}",
    ),
    "a plain page with menu and footer": (
        f"<body><ul class=menu><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><div><h2>A crossing</h2><p>{STORY}</p></div><div id=footer>All rights reserved</div></body>",
        f"A crossing {STORY}",
    ),
    "a drawing with labels": (f"<body><article><p>{STORY} <svg width=9><title>tip</title><g><text x=1>north</text></g></svg> {MORE}</p></article></body>", f"{STORY} north {MORE}"),
    "wrong heading ends": (f"<body><main><h2>A crossing</h3><p>{STORY}</p></main></body>", f"A crossing {STORY}"),
    "nothing but a frame": ("<body><nav><a href=/>Home</a></nav><footer>Imprint</footer></body>", ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_extraction_of_layouts_by_hand(model, name):
    page, text = LAYOUTS[name]
    assert hx.text_of(page, model) == text


def test_parsing_is_linear():
    """Stray end tags and unclosed elements cost no search of all open elements."""
    import time

    def seconds(make):
        took = []
        for n in (4000, 32000):
            page, least = make(n), math.inf
            for _ in range(3):
                begin = time.process_time()
                hx.parse(page)
                least = min(least, time.process_time() - begin)
            took.append(least)
        return took

    for make in (lambda n: "<div>" * n + "</p>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: "<head>" * n, lambda n: "<ul><li>" * n + "</ol>" * n):
        small, large = seconds(make)
        assert large < 24 * small + 0.05  # eight times the tags; quadratic would be 64 times


def test_extracted(spark, model):
    rows = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 0), (3, "v", "", 1)], "page_id long, url string, html string, text int")
    got = hx.extracted(rows, model).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["text"] == "" for r in got) == 2
    assert hx.extracted(rows.limit(0), model).count() == 0


def test_extraction_on_the_tables(spark, model):
    import html

    def expected(page):
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|<footer)", page)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("<(?:br|/?p|/?h1)>", inner)]
        return " ".join(x for x in parts if x)

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    want = {r["page_id"]: expected(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in hx.extracted(pages, model).collect()} == want


def test_lattice_equals_enumeration():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "é", "▁ab"]
    scores = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T)
    lattice = lm_score.Lattice(pieces)
    table = dict(zip(pieces, scores))

    def total(word):
        word = "▁" + word
        sums = [np.ones(2)] + [np.zeros(2) for _ in word]
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in table:
                    sums[end] = sums[end] + sums[start] * np.exp(table[word[start:end]])
            sums[end] = sums[end] + sums[end - 1] * lm_score.UNKNOWN * 256.0 ** -len(word[end - 1].encode())
        return np.log(sums[-1])

    words = ["a", "ab", "abab", "bbb", "é", "zé", "日本", "", "ababababab" * 4]
    got = lattice.log_sums(words, lm_score._with_never(scores))
    for w, g in zip(words, got):
        assert g == pytest.approx(total(w), rel=1e-9)
    points = np.stack([lm_score._points("▁" + "ab" * 50)])
    assert lattice._long(points, lm_score._with_never(scores)) == pytest.approx(lattice.forward(points, lattice.edges(points), lm_score._with_never(scores))[:, -1])


def test_long_words_teach_their_pieces(spark, monkeypatch):
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "é", "▁ab", "日本", "本", "ab" * 8]
    scores = lm_score._with_never(np.log(np.random.default_rng(4).dirichlet(np.ones(len(pieces)))[:, None]))
    lattice, r = lm_score.Lattice(pieces), random.Random(3)
    for word, step in [("a", 4096), ("ab", 1), ("ab" * 300, 64), ("".join(r.choices("abé日本z", k=5000)), 4096), ("ab" * 40, 7), ("日本" * 8, 16)]:
        points = lm_score._points(lm_score.START + word)
        _, piece, uses = lattice.expect(points[None], scores)
        want = np.bincount(piece, weights=uses, minlength=len(pieces))
        assert lattice.expect_long(points, scores[:, 0], step) == pytest.approx(want, rel=1e-7, abs=1e-12)

    # a word of several thousand characters counts in its own class like any other
    long = "".join(r.choices("abé日本", k=6000))
    monkeypatch.setattr(lm_score, "read_pieces", lambda _: (pieces, scores[:-1, 0]))
    table = spark.createDataFrame([(long, 1, 0), ("abba", 0, 2)], "word string, c0 long, c1 long").coalesce(1).toArrow().to_batches()

    class Local:
        def mapInArrow(self, f, schema):
            return spark.createDataFrame(f(iter(table)).__next__().to_pandas(), schema)

    got = np.exp(lm_score._piece_scores(Local(), "", 2))
    for k, word in enumerate([long, "abba"]):
        _, piece, uses = lattice.expect(lm_score._points(lm_score.START + word)[None], scores)
        want = 0.01 + np.bincount(piece, weights=uses, minlength=len(pieces))
        assert got[:, k] == pytest.approx(want / want.sum() * (1 - lm_score.UNKNOWN), rel=1e-6)


def test_lm_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT", 3)  # most words go through the join
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["The", "cat", "sat", "MAT", "élan", "x9"] + [f"rare{i}"], k=r.randint(0, 9))), r.choice(["en", "fr", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (None, "the cat", "en"), (3, "the cat", "en"), (3, "the cat", "en")]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double")
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    counts = collections.Counter()
    for d, t, _ in rows:
        if fold(d):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, _ in rows:
        w = [*(t or "").encode().lower().split(), None]
        want.append((str(d), fold(d) == 0, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 9)))
    got = lm_score.likelihoods(docs).collect()
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 9)) for x in got) == sorted(want)
    assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)
    twice = [x["score"] for x in got if x["doc_id"] == 3 and x["n_tokens"] == 3]
    assert max(twice) - min(twice) < 1e-9
    assert lm_score.likelihoods(docs.limit(0)).count() == 0
    alone = lm_score.likelihoods(docs.where("crc32(cast(doc_id as string)) % 10 = 0 and doc_id is not null")).collect()
    assert all(x["train_tokens"] == 0 and x["n_known"] == 0 and x["base_score"] == 0 and math.isfinite(x["score"]) for x in alone)


def segmentations(word, edges):
    """Every way to spell a marked word, as a list of (piece or None, weight); ``edges`` are weights of pieces."""
    if not word:
        yield []
        return
    steps = [(word[:k], edges[word[:k]]) for k in range(1, len(word) + 1) if word[:k] in edges]
    steps.append((None, lm_score.UNKNOWN * 256.0 ** -len(word[0].encode())))
    for piece, weight in steps:
        for rest in segmentations(word[len(piece or "x") :], edges):
            yield [(piece, weight), *rest]


def brute_scores(rows, prior, most_classes):
    """log10 probability of every text by listing all segmentations of all words in all classes."""
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    taught = [(lang, split(t)) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 10]
    order = sorted(collections.Counter(lang for lang, _ in taught).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    named = [lang for lang, _ in order[:most_classes]]
    groups = [[w for lang, w in taught if lang == x] for x in named] + [[w for lang, w in taught if lang not in named]]
    models = []
    for texts in (g for g in groups if g):
        counts, uses = collections.Counter(w for t in texts for w in t), dict.fromkeys(prior, 0.01)
        for word in counts:
            ways = [(way, math.prod(x for _, x in way)) for way in segmentations("▁" + word, prior)]
            total = sum(p for _, p in ways)
            for way, p in ways:
                for piece, _ in way:
                    if piece is not None:
                        uses[piece] += p / total
        all_uses = sum(uses.values())
        edges = {piece: u / all_uses * (1 - lm_score.UNKNOWN) for piece, u in uses.items()}
        v, n = len(counts), sum(counts.values()) + len(texts)
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        models.append((counts, edges, v, n, min(max(once / max(once + 2 * twice, 1), 0.1), 0.95), len(texts)))
    out = []
    for _, text, _ in rows:
        p = 0.0
        for counts, edges, v, n, d, ends in models:
            one = ends / len(taught) * ends / n
            for word in split(text):
                pieces = sum(math.prod(x for _, x in way) for way in segmentations("▁" + word, edges))
                one *= (max(counts[word] - d, 0) + d * v * pieces) / n
            p += one
        out.append(math.log10(p))
    return out


@pytest.mark.parametrize("most_classes", [1, 2, 12])
def test_lm_score_equals_all_segmentations(spark, tmp_path, monkeypatch, most_classes):
    monkeypatch.setattr(lm_score, "HOT", 4)
    weights = dict(zip(["▁", "▁a", "a", "b", "ab", "ba", "é", "▁ab"], np.random.default_rng(2).dirichlet(np.ones(8)).tolist()))
    file = tmp_path / "small.vocab"
    file.write_text("<unk>\t0\n" + "".join(f"{p}\t{math.log(w)!r}\n" for p, w in weights.items()), encoding="utf-8")
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["ab", "AB", "aba", "bé", "b", "zb", f"a{'b' * (i % 3)}é"], k=r.randint(0, 5))), r.choice(["en", "en", "fr", "es", None])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["score"] for x in lm_score.likelihoods(docs, str(file), most_classes).collect()}
    for (d, _, _), want in zip(rows, brute_scores(rows, weights, most_classes)):
        assert got[d] == pytest.approx(want, rel=1e-9)


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lm_score.likelihoods(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    r = out.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rates = {x["toxic"]: x["p"] for x in r}
    assert rates[1] > 0.85 and rates[0] < 0.03


def problem_rows(seed, n=40, width=12):
    r = np.random.default_rng(seed)
    rows = [np.flatnonzero(r.random(width) < 0.3) for _ in range(n)]
    y = (r.random(n) < 0.4).astype(float)
    pairs = [(np.flatnonzero(r.random(width) < 0.1), np.flatnonzero(r.random(width) < 0.1)) for _ in range(15)]
    return rows, y, pairs, width


def brute_loss(rows, y, pairs, w, b):
    """Both parts of the loss, row by row."""
    out = 0.0
    for row, label in zip(rows, y):
        p = 1 / (1 + math.exp(-(sum(w[i] for i in row) + b)))
        out -= 0.5 / (y.sum() if label else len(y) - y.sum()) * math.log(p if label else 1 - p)
    changes = [sum(w[i] for i in less) - sum(w[i] for i in more) for less, more in pairs]
    return out + toxicity.COUNTERFACTUAL * sum(x * x for x in changes) / len(changes)


def test_toxicity_loss_and_gradient():
    rows, y, pairs, width = problem_rows(3)
    problem = toxicity.Problem(rows, y, pairs, width)
    w, b, h = np.random.default_rng(1).normal(0, 1, width), 0.3, 1e-6
    assert problem.loss(w, b) == pytest.approx(brute_loss(rows, y, pairs, w, b), rel=1e-12)
    gradient, gradient_b = problem.gradient(w, b)
    for i in range(width):
        step = np.eye(width)[i] * h
        assert gradient[i] == pytest.approx((brute_loss(rows, y, pairs, w + step, b) - brute_loss(rows, y, pairs, w - step, b)) / (2 * h), abs=1e-7)
    assert gradient_b == pytest.approx((brute_loss(rows, y, pairs, w, b + h) - brute_loss(rows, y, pairs, w, b - h)) / (2 * h), abs=1e-7)


def test_toxicity_fit_is_the_minimum():
    """At the minimum of loss + l1 the gradient cancels the penalty, or is under it where a weight is 0."""
    rows, y, pairs, width = problem_rows(7, 200)
    w, b = toxicity.fit(rows, y, pairs, width)
    gradient, gradient_b = toxicity.Problem(rows, y, pairs, width).gradient(w, b)
    assert abs(gradient_b) < 1e-4 and (np.abs(gradient) <= toxicity.L1 + 1e-4).all()
    assert np.abs(gradient + toxicity.L1 * np.sign(w))[w != 0].max() < 1e-4


def test_toxicity_choice_of_features(spark):
    """The chosen features are those of a plain chi-square over the rows."""
    r = random.Random(4)
    texts = [(int(i % 3 == 0), " ".join(r.choices(["awful", "stupid", "fine"] if i % 3 == 0 else ["fine", "garden", "lovely"], k=6))) for i in range(120)]
    got = toxicity.choose(spark.createDataFrame(texts, "toxic int, text string"), 5)
    sets = [set(toxicity.text_features(toxicity.text_words(t)).tolist()) for _, t in texts]
    n, p = len(texts), sum(y for y, _ in texts)
    chi = {}
    for f in set().union(*sets):
        df, positive = sum(f in s for s in sets), sum(y for (y, _), s in zip(texts, sets) if f in s)
        if df >= toxicity.LEAST_ROWS:
            chi[f] = (positive - df * p / n) ** 2 / (df * p / n * (1 - p / n) * (1 - df / n) + 1e-9)
    best = sorted((f for f in chi if chi[f] > toxicity.LEAST_CHI), key=lambda f: (-chi[f], f))[:5]
    assert got.tolist() == sorted(best) and len(best) == 5


def test_counterfactual_penalty():
    """A term that occurs with toxic texts loses most of its weight when swaps are penalised."""
    r = random.Random(1)
    texts = [({"idiot", "muslim", *r.choices("abcdefgh", k=4)}, 1) for _ in range(60)] + [({*r.choices("abcdefgh", k=5)}, 0) for _ in range(60)]
    features = [toxicity.text_features(t) for t, _ in texts]
    chosen = np.unique(np.concatenate(features))
    rows, y = [np.searchsorted(chosen, f) for f in features], np.array([v for _, v in texts], float)
    pairs = [toxicity.swap_change(t, s, chosen) for t, _ in texts for s in toxicity.swapped(t)]

    def weight(model, word):
        return sum(w for f, w in zip(chosen.tolist(), model[0]) if f in toxicity.word_features(word))

    plain, fair = toxicity.fit(rows, y, [], len(chosen)), toxicity.fit(rows, y, pairs, len(chosen))
    assert weight(fair, "muslim") < 0.5 * weight(plain, "muslim") and weight(fair, "idiot") > weight(fair, "muslim")
    assert toxicity.swapped({"a", "b"}) == [] and all("gay" not in s for s in toxicity.swapped({"gay", "a"}))


def test_toxicity_learns_from_labels_only(spark):
    """The neutral sentences are no rows: with labels of one class there is nothing to tell apart, and the bias is that class."""
    docs = spark.createDataFrame([(i, "plain words") for i in range(50)], "doc_id long, text string")
    assert [len(x) for x in toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int"))[:2]] == [0, 0]
    assert toxicity.toxicity(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")).where("predicted = 0").count() == 0
    # an id that many rows share is one document to learn from
    hot = docs.unionByName(spark.range(500).selectExpr("7L as doc_id", "concat('copy ', id) as text"))
    sample = toxicity._sampled(hot, spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int"))
    assert sample.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "fine words", "k"), (2, None, "k"), (3, "", "k"), (None, "idiot", "k"), (1, "fine words", "k")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    many = spark.createDataFrame([(i, "bad idiot" if i % 2 else "good day") for i in range(40)] + [(90, None)], "doc_id long, text string")
    by_id = {r["doc_id"]: r for r in toxicity.toxicity(many, labels).collect()}
    assert by_id[1]["predicted"] == 1 and by_id[2]["predicted"] == 0
    kept = toxicity.keep_civil(many.withColumn("extra", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "extra"] and kept.where("doc_id % 2 = 1").count() == 0
    assert toxicity.toxicity(many.limit(0), labels).count() == 0


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark):
    r = random.Random(6)
    pool = ["the", "cat", "é#", "$x$", "a|b", " ", "日本"]
    texts = [r.choice([" ", "\n", "\t "]).join(r.choices(pool, k=r.randint(0, 80))) for _ in range(60)] + [None, "", " \n", "a b c", "a b c a b c", "x\nx\n\nx \n x", "\x0b a\x0cb\r", "w " * 30000]
    docs = spark.createDataFrame([(i, t, r.choice(["en", None]), "clash") for i, t in enumerate(texts)] + [(None, None, None, "clash"), (0, texts[0], "en", "clash")], "doc_id long, text string, lang string, n_words string")
    got = quality_rules.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        if row["doc_id"] is not None:
            want = brute_measures(texts[row["doc_id"]])
            assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
            assert row["kept"] == (not want[-1])
    assert quality_rules.judged(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def binomial_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_quality_cutoffs(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 6 == 0
        words = [f"w{r.randint(0, 9999)}" + ("###" if bad and r.random() < 0.7 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 10 else "xx"))
        labels.append((i, int(not bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality_rules.measures(docs).drop("text").persist()
    cut = {(x["stratum"], x["rule"]): x["cutoff"] for x in quality_rules.cutoffs(scored, lab, "lang").collect()}
    assert ("en", "symbols") in cut and not any(s == "xx" for s, _ in cut)  # too few labels prove nothing
    held = scored.join(lab, "doc_id").where("lang = 'en' and not __q.base_failed and quality = 1")
    n, k = held.count(), held.where(F.col("__r.symbols") > cut["en", "symbols"]).count()
    assert binomial_cdf(k, n, quality_rules.RISK) <= quality_rules.DELTA / (2 * len(quality_rules.RULES) * len(quality_rules.GRID))
    kept = quality_rules.keep_good(docs.withColumn("rule", F.lit(1)), lab)
    assert kept.columns == ["doc_id", "text", "lang", "rule"] and kept.where("doc_id % 6 = 0 and lang = 'en'").count() < 30
    assert kept.where("doc_id % 6 <> 0").count() >= 0.97 * 2500
    tail = spark.range(1).select(quality_rules._tail(F.lit(7).cast("long"), F.lit(900).cast("long"), 0.01).alias("t"), quality_rules._tail(F.lit(0).cast("long"), F.lit(10).cast("long"), 0.01).alias("z")).first()
    assert tail["t"] == pytest.approx(binomial_cdf(7, 900, 0.01)) and tail["z"] == pytest.approx(0.99**10)


@pytest.mark.parametrize("n", [900, 100_000, 4_000_000])
def test_quality_tail_at_any_size(spark, n):
    ks = sorted({1, 7, 15, 16, 17, n // 200, n // 100 - 2 * math.isqrt(n // 100), n // 100} & set(range(n // 100 + 1)))
    frame = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    got = {x["k"]: x["t"] for x in frame.select("k", quality_rules._tail(F.col("k"), F.col("n"), 0.01).alias("t")).collect()}
    for k in ks:
        # P(X <= k) with the terms as whole numbers: term(k) = C * 99^(n-k) / 100^n, terms below as exact fractions of it in 400 bits
        one = 1 << 400
        share = total = one
        for i in range(k, 0, -1):
            share = share * i * 99 // (n - i + 1)
            total += share
            if not share:
                break
        log_term = sum(math.log(n - i) for i in range(k)) if k < 100 else math.lgamma(n + 1) - math.lgamma(n - k + 1)
        log_term += k * math.log(0.01) + (n - k) * math.log1p(-0.01) - math.lgamma(k + 1)
        expected = math.exp(log_term + math.log(total / one))
        assert got[k] == pytest.approx(expected, rel=1e-6, abs=1e-300)
    assert got[n // 100] > 0.4  # a share at the risk itself is never certified


def test_quality_cutoffs_of_a_large_stratum(spark):
    """100,000 good labels with exactly 1% above every cutoff of one rule, and 20,000 bad ones to catch: no confidence, so no cutoff."""
    q, score = "struct(false as base_failed) as __q", "case when id < 1000 or id >= 100000 then 1000 else 0 end"
    scored = spark.range(120_000).selectExpr("id as doc_id", "'en' as lang", q, f"struct({', '.join(f'{score if r == 'symbols' else 0} as {r}' for r in quality_rules.RULES)}) as __r")
    labels = spark.range(120_000).selectExpr("id as doc_id", "cast(id < 100000 as int) as quality")
    assert quality_rules.cutoffs(scored, labels, "lang").collect() == []


def test_quality_is_native(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    plan = quality_rules.keep_good(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_top(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dims - len(v)))) for i, v in ok]
    out = set()
    for q, v in {(i, tuple(x)) for i, x in ok if i % 20 == 0}:
        scored = sorted((-int(np.dot(v, x)), i) for i, x in ok if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_maxscore(spark, seed, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "CHUNK_BYTES", 600)
    monkeypatch.setattr(maxscore, "SEED", 30)
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, [0.0] * 12), (2001, None), (2020, [float("nan")] * 12), (2040, [1.0, None]), (2060, [float("inf")]), (None, [0.1] * 12), (2080, [0.3, -0.2]), (2100, []), (5, rows[5][1])]
    table = spark.createDataFrame([(*x, "s") for x in rows], "vec_id long, embedding array<double>, score string")
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in maxscore.top_k(table).collect()}
    assert got == brute_top(rows)


@pytest.mark.parametrize("scale", [1.0, 9e6, 1e9, 1e300, None])
def test_maxscore_is_exact_for_all_finite_components(scale, monkeypatch):
    """Sums beyond 2**53 are exact, scores beyond a long count as its end; shards share their floors."""
    monkeypatch.setattr(maxscore, "SEED", 30)
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (300, 7)) * (10.0 ** r.integers(-3, 200, (300, 1)) if scale is None else scale)
    v[40:44] = v[40]
    if scale == 1e300:
        v[:3] = 1.7e308
    ids, exact = np.arange(300), [[math.floor(64 * fractions.Fraction(x)) for x in row] for row in v.tolist()]
    asked = maxscore.Queries(ids[::20], v[::20])
    best = maxscore.Best(15, 20)
    for begin in range(0, 300, 64):
        asked.meet(best, ids[begin : begin + 64], v[begin : begin + 64])
    for row, q in enumerate(range(0, 300, 20)):
        sums = [(min(max(sum(a * b for a, b in zip(exact[q], exact[c])), -(1 << 63)), (1 << 63) - 1), c) for c in range(300) if c != q]
        want = sorted(sums, key=lambda x: (-x[0], x[1]))[:20]
        assert list(zip(best.scores[row].tolist(), best.ids[row].tolist())) == want


def test_maxscore_of_large_components(spark):
    rows = [(0, [9.0e6, 9.0e6 + 1]), (1, [9.0e6 + 3, -1.0]), (2, [9.0e6 + 3, 5.0e6 + 1]), (3, [1e300, -1e300]), (4, [1.7e308, 1.7e308]), (5, [-1.7e308, 0.0])]
    got = [tuple(x) for x in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    ints = {i: [math.floor(64 * fractions.Fraction(x)) for x in v] for i, v in rows}
    want = sorted(((min(max(sum(a * b for a, b in zip(ints[0], ints[i])), -(1 << 63)), (1 << 63) - 1), i) for i in range(1, 6)), key=lambda x: (-x[0], x[1]))
    assert got == [(0, n, i, s) for n, (s, i) in enumerate(want, 1)]


def test_maxscore_small_tables(spark):
    table = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in maxscore.top_k(table).collect()] == [(0, 1, 1, 512)]
    assert maxscore.top_k(table.limit(0)).count() == 0 and maxscore.top_k(table.limit(1)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg("score").alias("score")).first()
    assert r["right"] > 0.98 and abs(r["score"] - r["right"]) < 0.02


def test_language_vectors_equal_brute_force():
    texts = ["The cat, the DOG", "le chat!", "ß é 日本 x", "a1b2"]
    df = np.zeros(language_id.BUCKETS)
    for text in texts:
        df[np.unique(language_id.ngrams(text))] += 1
    idf = language_id.inverse_frequency(df, len(texts))
    for text in texts:
        letters = re.sub(r"[^\w]|\d|_", " ", text.lower())
        joined = re.sub(r" +", lambda m: " ", letters)
        padded = f" {joined} "
        points = language_id.ngrams(text)
        # as many n-grams as the spaced text has, and equal ones in the same buckets
        spaced = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        if not joined.startswith(" ") and not joined.endswith(" "):
            assert len(points) == len(spaced)
            place = dict(zip(spaced, points.tolist()))
            assert all(place[g] == p for g, p in zip(spaced, points.tolist()))
            tf = collections.Counter(points.tolist())
            want = {b: f * (math.log((1 + len(texts)) / (1 + df[b])) + 1) for b, f in tf.items()}
            length = math.sqrt(sum(x * x for x in want.values()))
            got = language_id._vector(points, idf)
            assert {b: pytest.approx(x / length) for b, x in want.items()} == {int(b): got[b] for b in np.flatnonzero(got)}


def test_ftrl_equals_the_published_steps():
    """Each coordinate by itself, from the formulas of follow-the-regularised-leader with l1 and l2."""
    r, classes = np.random.default_rng(2), 3
    model = language_id.Ftrl(classes)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key):
        if abs(z[key]) <= language_id.L1:
            return 0.0
        return -(z[key] - math.copysign(language_id.L1, z[key])) / ((language_id.BETA + math.sqrt(n[key])) / language_id.ALPHA + language_id.L2)

    for _ in range(60):
        at, label = np.sort(r.choice(12, 4, replace=False)), int(r.integers(classes))
        x = r.normal(0, 1, 4)
        model.learn(at, x, label)
        w = {(i, k): weight((i, k)) for i in at.tolist() for k in range(classes)}
        sums = [sum(x[j] * w[i, k] for j, i in enumerate(at.tolist())) for k in range(classes)]
        total = sum(math.exp(s) for s in sums)
        for k in range(classes):
            error = math.exp(sums[k]) / total - (k == label)
            for j, i in enumerate(at.tolist()):
                g = error * x[j]
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language_id.ALPHA * w[i, k]
                n[i, k] += g * g
    got = model.weights()
    assert all(got[i, k] == pytest.approx(weight((i, k)), abs=1e-12) for i in range(12) for k in range(classes))
    assert (got[12:] == 0).all() and (got[:12] != 0).any()
    model.z[3] = np.array([0.9, -0.9, 1.1]) * language_id.L1  # sums of gradients within the l1 penalty leave no weight
    assert model.weights()[3].tolist()[:2] == [0, 0] and model.weights()[3][2] < 0


def test_temperature_is_the_best(spark):
    r = np.random.default_rng(4)
    rows = [(np.array([int(k)]), np.array([1.0])) for k in r.integers(0, 3, 300)]
    labels = [int(at[0]) if r.random() < 0.7 else int(r.integers(3)) for at, _ in rows]
    weights, temperature = language_id.fit(rows, labels, 3)
    held = [(weights[at[0]] + weights[language_id.BUCKETS], y) for i, ((at, _), y) in enumerate(zip(rows, labels)) if i % 5 == 4]
    loss = lambda t: -sum(math.log(math.exp(z[y] / t) / sum(math.exp(v / t) for v in z)) for z, y in held)
    assert loss(temperature) <= min(loss(t) for t in np.exp(np.linspace(-2.5, 2.5, 200))) + 1e-6


def test_language_predictions_equal_brute_force(spark):
    """Every score is the calibrated softmax of the trained weights over the text's own vector."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    languages, idf, weights, temperature = language_id.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in language_id.identified(docs).collect():
        counts = collections.Counter(language_id.ngrams(texts[row["doc_id"]]).tolist())
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        if not counts:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        at = np.array(list(counts))
        x = np.array(list(counts.values())) * idf[at]
        z = (x / math.sqrt((x * x).sum()) @ weights[at] + weights[language_id.BUCKETS]) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row["score"] == pytest.approx(p.max(), abs=1e-9) and row["lang_pred"] == languages[int(p.argmax())]


def test_language_id_edges(spark):
    rows = [(i, "the cat and dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (None, "the dog", None), (1, "the cat and dog", "en"), (103, "𝐱 long " * 5000, None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, score int")
    got = language_id.identified(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[100] == by[101] == by[102] == "und" and by[1] == "en" and by[2] == "fr"
    assert all(r["lang_pred"] == "und" for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language_id.identified(docs.limit(0)).count() == 0


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 2)  # a uniform share would expect 0.02 rows of the rare language
    rows = [(i, "le chat et le chien" if i % 100 == 7 else "the cat and dog", "fr" if i % 100 == 7 else "en") for i in range(4000)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r["lang"], r["lang_pred"]) for r in got.join(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id").select("lang", "lang_pred").distinct().collect()} == {("en", "en"), ("fr", "fr")}
