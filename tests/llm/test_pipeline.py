"""The stages of the corpus pipeline, one by one and together, against brute-force versions on a small corpus."""

import collections
import fractions
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_models import brute_measures
from test_pairs import brute_components, brute_removals, library

import corpus_pipeline
from textquarry.llm import quality_rules, toxicity

CLASHING = ["score", "kept", "key", "n", "stratum", "rule", "ranges", "label", "group", "seed"]


def small_corpus(seed=3):
    """Civil and toxic texts, texts full of signs, near copies, shared passages, blanks and nulls, with labels."""
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("river", "garden", "market", "window", "letter", "station", "winter", "bridge") for b in ("", "s", "side", "house", "man", "ward")]
    nasty = ["idiot", "stupid", "moron", "disgusting", "worthless", "pathetic"]
    rows, labels = [], []
    passage = r.choices(plain, k=60)
    for i in range(1500):
        words = r.choices(plain, k=r.randint(55, 90))
        toxic, bad = int(i % 15 == 4), int(i % 9 == 2)
        if toxic:
            for _ in range(12):
                words[r.randrange(len(words))] = r.choice(nasty)
        if bad:
            words = [w + "###" if r.random() < 0.6 else w for w in words]
        if i % 50 == 7 and not toxic and not bad:
            words[10:10] = passage
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), toxic))
    for i in range(40):  # near copies of earlier documents
        words = rows[7 * i][1].split(" ")
        words[0] = f"other{i}"
        rows.append((2000 + i, "\n".join(words)))
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "short text"), rows[0], rows[1]]
    labels += [(3000, None, None), (0, 1, 0), (None, 1, 1)]
    r.shuffle(rows)
    return rows, labels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rows, labels = small_corpus()
    path = tmp_path_factory.mktemp("corpus")
    ids, texts = zip(*rows)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": list(texts), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), path / "documents.parquet")
    ids, quality, toxic = zip(*labels)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32())}), path / "labels.parquet")
    return str(path)


def brute_civil(rows, model):
    chosen, weights, bias = model
    known = dict(zip(chosen.tolist(), weights.tolist()))
    return [x for x in rows if 1 / (1 + math.exp(-(bias + sum(known.get(f, 0.0) for f in toxicity.text_features(toxicity.text_words(x[1])).tolist())))) < 0.5]


def brute_good(rows, labels):
    """The rules with exact binomial tests in fractions; all rows are one stratum."""

    def scores(text):
        n_words, chars, symbols, dup, repeats, failed = brute_measures(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return {"symbols": 1000 * symbols // max(chars, 1), "dup_lines": 1000 * dup // max(len(lines), 1), "repeats": 1000 * repeats // max(n_words, 1), "word_length": 10 * chars // max(n_words, 1)}, failed

    judged = [(d, *scores(t)) for d, t in rows]
    quality = collections.defaultdict(list)
    for d, q, _ in labels:
        if q is not None and d is not None:
            quality[d].append(q)
    held = [(s, q) for d, s, failed in judged if not failed for q in quality[d]]
    risk, tests = fractions.Fraction(1, 100), len(quality_rules.RULES) * len(quality_rules.GRID)
    cutoffs = {}
    for rule in quality_rules.RULES:
        found = []
        for cutoff in quality_rules.GRID:
            n, k = sum(q == 1 for _, q in held), sum(q == 1 and s[rule] > cutoff for s, q in held)
            caught = sum(q != 1 and s[rule] > cutoff for s, q in held)
            p = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k <= n * risk else 1
            if p <= fractions.Fraction(5, 100) / tests and caught - quality_rules.GOOD_WEIGHT * k > 0:
                found.append((caught - quality_rules.GOOD_WEIGHT * k, cutoff))
        if found:
            cutoffs[rule] = max(found)[1]
    bad = {i for i, (_, s, failed) in enumerate(judged) if failed or any(s[rule] > c for rule, c in cutoffs.items())}
    return [x for i, x in enumerate(rows) if i not in bad], cutoffs


def brute_distinct(rows):
    first = {(d, n): c for d, n, c in brute_components(rows)}
    return [x for x in rows if any(d == x[0] and c in (None, d) for (d, _), c in first.items())]


def brute_cut(rows):
    """Rows as (doc_id, kept words): the digest of brute_removals tells nothing of the words, so they are cut here again."""
    owner, words = {}, [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 49):
            owner[tuple(w[i : i + 50])] = min(owner.get(tuple(w[i : i + 50]), d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert sorted((d, len(t.split())) for d, t in out) == sorted((d, n - gone) for d, n, gone, _ in brute_removals(rows))
    return out


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, folder):
    rows, labels = small_corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    civil = stages["toxicity"](spark, docs, folder)
    want = brute_civil(rows, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert plain(civil) == sorted(want, key=str)
    toxic = {d for d, _, t in labels if t and d is not None}
    kept = {d for d, _ in want}
    assert len(toxic & kept) < 0.1 * len(toxic) and len({d for d, _ in rows} - kept - toxic) < 10

    good = stages["quality"](spark, spark.createDataFrame(want, "doc_id long, text string").selectExpr("*", "'en' as lang"), folder)
    want, cutoffs = brute_good(want, labels)
    assert plain(good) == sorted(want, key=str) and "symbols" in cutoffs

    distinct = stages["near_duplicates"](spark, spark.createDataFrame(want, "doc_id long, text string"), folder)
    before, want = want, brute_distinct(want)
    assert plain(distinct) == sorted(want, key=str) and len(before) - len(want) > 10

    cut = stages["passages"](spark, spark.createDataFrame(want, "doc_id long, text string"), folder)
    shorter = brute_cut(want)
    assert sorted((d, " ".join((t or "").split())) for d, t in plain(cut)) == sorted(shorter)
    assert sum(len(t) for _, t in shorter) < sum(len(t) for _, t in want) - 1000


def test_the_whole_pipeline_equals_the_chain_of_brute_force(spark, folder):
    _, lib = library()
    rows, labels = small_corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    civil = brute_civil(rows, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    want = brute_cut(brute_distinct(brute_good(civil, labels)[0]))
    got = corpus_pipeline.run(spark, folder).toPandas()
    expected = collections.Counter((d, len(lib.encode(t, add_special_tokens=False).ids) + 1) for d, t in want)
    assert collections.Counter(map(tuple, got[got.start == 0][["doc_id", "doc_tokens"]].values.tolist())) == expected
    assert got.length.sum() == sum(n * c for (_, n), c in expected.items())
    once = [(d, t) for d, t in want if sum(c for (x, _), c in expected.items() if x == d) == 1]
    for d, t in once:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= sums.sum() / 2048 + 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_nulls_and_clashing_columns(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = ", ".join(f"'{c}' as `{c}`" for c in CLASHING)
    rows = [(1, "a few words", "en"), (1, "a few words", "en"), (2, None, None), (3, "", "en"), (None, "no id here", "fr"), (None, None, None), (4, "x" * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "cast(length(text) as long) as n_chars", extra.split(", ")[0], *extra.split(", ")[1:])
    out = stage(spark, docs, folder)
    got = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert all(r[c] == c for r in got for c in CLASHING)
        assert len(got) == {"toxicity": 7, "quality": 0, "near_duplicates": 7, "passages": 7}[name]
    else:
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None}
    assert stage(spark, docs.limit(0), folder).count() == 0
