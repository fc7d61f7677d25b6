"""Near duplicates, repeated passages, packing and encoding against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import bpe, jaccard_join, packing, substring_dedup, text
from textquarry.llm.components import contract
from textquarry.llm.scratch import Scratch

WORDS = [f"w{i}" for i in range(60)] + ["É", "ß", "x\x1cy"]


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, repeats, blanks and nulls."""
    r = random.Random(seed)
    text = lambda a, b: r.choices(WORDS, k=r.randint(a, b))
    base = text(80, 120)
    passage = text(55, 70)
    rows = [(i, " ".join(text(1, 90))) for i in range(n // 3)]
    for i in range(n // 3, n):
        kind = r.random()
        if kind < 0.3:
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(WORDS)
        elif kind < 0.6:
            words = text(0, 40) + passage + text(0, 40)
        elif kind < 0.7:
            words = passage + passage[: r.randint(0, 60)]
        else:
            words = rows[r.randrange(len(rows))][1].split(" ") if rows else []
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE two"), (None, "one two"), (1005, "one two three")]
    rows += [rows[0], rows[0]]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "extra", 7) for x in rows], "doc_id long, text string, key string, n long")


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        out.append((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, small", [(1, 16), (2, 2), (3, 1)])
def test_jaccard_components(spark, seed, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", small)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1 + seed)
    rows = corpus(seed)
    got = sorted((tuple(r) for r in jaccard_join.components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_chain_and_star(spark, monkeypatch):
    """Links in a chain, whose ends don't link, and a hub of near copies that don't link with each other."""
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 1)
    monkeypatch.setattr(jaccard_join, "HOT_COUNT", 2)
    base = [f"b{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for k in range(1, 13):
        words = list(base)
        words[8 * k] = f"edit{k}"
        words[(8 * k + 40) % 100 + 2] = f"more{k}"
        rows.append((k, " ".join(words)))
    chain = list(range(120))
    for k in range(6):
        rows.append((100 + k, " ".join(f"c{x}" for x in chain[k * 8 : k * 8 + 70])))
    assert sorted((tuple(r) for r in jaccard_join.components(frame(spark, rows)).collect()), key=str) == brute_components(rows)


def test_order_filters_lose_nothing():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(1, 60))
        common = r.integers(0, 1 << 63, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, r.integers(0, 1 << 63, int(r.integers(0, n // 3 + 1))).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, r.integers(0, 1 << 63, int(r.integers(0, n // 3 + 1))).astype(np.uint64)]))
        if jaccard_join.similar(a, b):
            assert jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b))


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, "z " + a), (None, "q " + b)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.components(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, None)}


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words than those before it"), (None, None)]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "n"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_contract(spark, one_task):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 600 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["label"] for x in contract(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), one_task).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in loops}


@pytest.mark.parametrize("order", ["rising", "zigzag", "random", "star of chains"])
def test_contract_takes_few_rounds(spark, order):
    """A chain of 1,000 links, by all tasks: the number of tables grows with the logarithm."""
    r = random.Random(5)
    nodes = {"rising": list(range(1001)), "zigzag": [i // 2 if i % 2 else 1000 - i // 2 for i in range(1001)], "random": r.sample(range(5000), 1001)}.get(order)
    edges = list(zip(nodes, nodes[1:])) if nodes else [(10_000 if i % 50 == 0 else i, i + 1) for i in range(1000)]
    scratch = Scratch(spark, "t")
    got = contract(spark.createDataFrame(edges, "a long, b long"), scratch, 0)
    assert {x["label"] for x in got.collect()} == {min(min(e) for e in edges)} and got.count() == len({x for e in edges for x in e})
    assert scratch.n <= 40


def test_lists_in_blocks():
    """Lists that go over blocks give the same pairs and rows as all rows at once."""
    r = np.random.default_rng(3)
    token = np.sort(np.concatenate([r.integers(0, 400, 1500), np.full(300, 77), np.full(40, 399)]))
    rows = [token, r.integers(0, 90, len(token)), r.integers(5, 9, len(token)), r.integers(0, 3, len(token))]
    rows[2:] = [rows[1] % 4 + 5, rows[1] % 3]  # a key's size and place go with it

    def result(step):
        lists, pairs, longer = jaccard_join._Lists(75), set(), set()
        parts = [[x[i : i + step] for x in rows] for i in range(0, len(token), step)]
        out = [b for i, p in enumerate(parts) for b in lists.take(p, last=i == len(parts) - 1)] + list(lists.flush())
        for batch in out:
            for t, k, n, at, other in zip(*(batch.column(c).to_pylist() for c in ("token", "key", "n", "at", "other"))):
                pairs.add((k, other)) if t is None else longer.add((t, k, n, at))
        return pairs, longer

    pairs, longer = set(), set()
    for t in set(token.tolist()):
        held = sorted({(int(k), int(n), int(at)) for k, n, at in zip(rows[1][token == t], rows[2][token == t], rows[3][token == t])})
        if len(held) > jaccard_join.SMALL_LIST:
            longer |= {(t, *x) for x in held}
        else:
            pairs |= {(a[0], b[0]) for i, a in enumerate(held) for b in held[i + 1 :] if jaccard_join.overlap_possible(a[1], b[1], a[2], b[2])}
    for step in (5000, 100, 17, 1):
        assert result(step) == (pairs, longer)


def test_sets_with_equal_keys_stay_apart(spark, monkeypatch):
    """64 bits of the digest name a class; sets that share them get other names."""
    rows = corpus(6)
    whole = jaccard_join.signatures

    def crowded(docs, hot, percent=75):
        return whole(docs, hot, percent).withColumn("key", F.pmod("key", F.lit(5)).cast("long"))

    monkeypatch.setattr(jaccard_join, "signatures", crowded)
    got = sorted((tuple(r) for r in jaccard_join.components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def brute_removals(rows, length=50):
    owner = {}
    words = [(text or "").encode().split() for _, text in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - length + 1 if d is not None else 0):
            k = tuple(w[i : i + length])
            owner[k] = min(owner.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if owner[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 5])
def test_substring(spark, seed):
    rows = corpus(seed, 80) + [(2000, "a " * 200), (2001, "a " * 120), (2002, "b " + "a " * 70), (2003, "a " * 49)]
    got = sorted((tuple(r) for r in substring_dedup.removals(frame(spark, rows)).collect()), key=str)
    assert got == brute_removals(rows)
    cut = substring_dedup.cut_repeats(frame(spark, rows))
    assert cut.columns == ["doc_id", "text", "key", "n"]
    digests = sorted((str(r["doc_id"]), hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in cut.collect())
    assert digests == sorted((str(x[0]), x[3]) for x in brute_removals(rows))


def test_cut_repeats_counts_chars_and_leaves_others(spark):
    p = " ".join(f"é{i}" for i in range(50))
    rows = spark.createDataFrame([(1, f" {p}\n\nend ", 9), (2, f"start\t{p}\nfin", 9), (3, "  as is ", 9)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.cut_repeats(rows).collect()}
    assert got[1][0] == f" {p}\n\nend " and got[2] == ("start\nfin", 9) and got[3] == ("  as is ", 8)


def test_substring_rows_that_share_an_id(spark):
    """Different texts under one id lose each only what they have in common with smaller ids themselves."""
    shared, other = [f"s{i}" for i in range(60)], [f"o{i}" for i in range(200)]
    rows = [(1, " ".join(shared)), (2, " ".join([*shared, "tail"])), (2, " ".join(other)), (2, " ".join(other)), (3, " ".join(other[20:90] + shared[:55])), (2, None), (3, "")]
    got = sorted((tuple(r) for r in substring_dedup.removals(frame(spark, rows)).collect()), key=str)
    assert got == brute_removals(rows)
    assert sorted(n for _, _, n, _ in got) == [0, 0, 0, 0, 0, 60, 125]
    cut = substring_dedup.cut_repeats(frame(spark, rows)).where("doc_id = 2").select("text").collect()
    assert sorted(str(r["text"]) for r in cut) == sorted(["None", "tail", " ".join(other), " ".join(other)])
    found = sorted(tuple(r) for r in substring_dedup.maximal_repeats(frame(spark, rows)).collect())
    assert found == [(2, 0, 60, " ".join(shared)), (3, 0, 125, " ".join(other[20:90] + shared[:55]))]


def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def strange_texts(n):
    r = random.Random(2)
    pool = "abcdefghijstABCÉéÈçßΣσİıñ'’sstrevell 0123 \t\n\x1c\x85\xa0 !?<>|#$%&*日本語한글ﬁé́é🙂\x00"
    out = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(n)]
    return out + ["<|endoftext|>a <|startoftext|>B<|endoftext|>", "", "a" * 3000, " \n"]


def test_bpe_equals_the_library():
    path, lib = library()
    tree, quick = bpe.Bpe(path), bpe.QuickBpe(path)
    for text in strange_texts(1500):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert tree.encode(text) == ids == quick.encode(text)
        assert tree.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_every_token_has_one_pair():
    """The file's own cut of a token before its merge is the only one, so ranks of joined tokens decide alike."""
    path, _ = library()
    tree, quick = bpe.Bpe(path), bpe.QuickBpe(path)
    value = {c: bytes([i]) for i, c in enumerate(bpe.byte_letters())}
    for i in range(49406):
        name = tree.names[i]
        ended = name.endswith("</w>") and name != "</w>"
        raw = b"".join(value[c] for c in (name[:-4] if ended else name))
        if ended:
            assert tree.merge(raw) == [i] == quick.quick._encode_single_piece(raw + quick.END)
        elif len(raw) > 1:
            assert tree.merge(raw + b"0") == quick.quick._encode_single_piece(raw + b"0" + quick.END)


def test_encoded(spark):
    path, lib = library()
    rows = [(i, t) for i, t in enumerate(strange_texts(60))] + [(None, "x"), (7, None), (7, None)]
    got = sorted((str(tuple(r)) for r in bpe.encoded(frame(spark, rows), path).collect()))
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append(str((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert got == sorted(want)


def test_differencing():
    r = random.Random(3)
    for _ in range(30):
        sizes = [r.randint(1, 512) for _ in range(r.randint(1, 300))]
        parts = packing.windows(sizes)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) <= 2048 and len(parts) <= -(-sum(sizes) // 2048) + 2
    assert packing.windows([]) == [] and packing.windows([2047, 2]) in ([[0], [1]], [[1], [0]])
    assert sorted(map(sorted, packing.difference([4, 5, 6, 7, 8], 2))) in ([[0, 3, 1], [2, 4]], [[0, 1, 3], [2, 4]], [[0, 1, 2], [3, 4]])


def test_packed(spark):
    path, lib = library()
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "beta-7", "gamma!", "Δ"], k=r.choice([0, 1, 30, 400, 3000])))) for i in range(80)] + [(900, None), (901, "")]
    got = packing.packed(frame(spark, rows), path).toPandas()
    for d, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all() and list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == list(mine.ids_crc32)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= sums.sum() / 2048 + 4


def test_packing_takes_texts_in_slices_and_gives_back(spark):
    path, lib = library()

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, cut, schema):
            return cut

    cut = packing.pieces(Rows(), path, 2048, 512)
    n = 1201
    given = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [f"alpha beta-{i}" for i in range(n)]})
    bpe.memory("another", path, bpe.QuickBpe, lambda b, ids: ids)["alpha"]
    parts = list(cut([given]))
    assert len(parts) > 1 and max(x.num_rows for x in parts) <= 500
    assert [i for x in parts for i in x.column("doc_id").to_pylist()] == list(range(n))
    assert [i for x in parts for i in x.column("doc_tokens").to_pylist()] == [len(lib.encode(f"alpha beta-{i}", add_special_tokens=False).ids) + 1 for i in range(n)]
    assert list(text.MEMORIES) == [("bytes", path)]
    held = text.MEMORIES["bytes", path]
    list(cut([given]))
    assert text.MEMORIES["bytes", path] is held  # from task to task
    list(text.slices([given]))
    assert not text.MEMORIES  # a task of another operator


def test_empty_tables(spark):
    path, _ = library()
    none = frame(spark, [])
    assert jaccard_join.components(none).count() == 0 and substring_dedup.removals(none).count() == 0
    assert bpe.encoded(none, path).count() == 0 and packing.packed(none, path).count() == 0
    assert jaccard_join.keep_one(none).count() == 0 and substring_dedup.cut_repeats(none).count() == 0
    assert none.select(F.count("*")).first()[0] == 0
