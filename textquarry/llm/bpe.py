"""Operator 6: byte-pair encoding and decoding with a segment tree over pair ranks.

The vocabulary file is a tokenizers JSON with a byte-level BPE model that marks
word ends. A word starts as its bytes; the leaves of a segment tree hold the
merge rank of each adjacent pair, inner nodes the smaller of their children,
and equal ranks compare by place, so the root names the leftmost lowest-rank
pair. A merge changes three leaves, each in logarithmic time, until the root
holds no rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import MEMORIES

#: A word of letters, one digit, or a run of other signs; the pattern of the vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
#: Characters that str.split() cuts at though they are no Unicode white space.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class SegmentTree:
    """Smallest key of an array of fixed size, with point updates."""

    NONE = 1 << 62

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        tree = self.tree = [self.NONE] * size + keys + [self.NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def root(self) -> int:
        return self.tree[1]

    def put(self, i: int, key: int) -> None:
        tree = self.tree
        i += self.size
        if tree[i] == key:
            return
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return
            tree[i] = key


class Bpe:
    """Encoder and decoder of one vocabulary file, with bounded memories of words and chunks."""

    def __init__(self, path: str, memory: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a] << 20 | vocab[b]] = (rank << 32, vocab[a + b])
        self.memory = memory
        self.words: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by repeated leftmost lowest-rank merges."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        n, get, none = len(ids), self.merges.get, SegmentTree.NONE
        found = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]
        if not any(found):
            return ids
        tree = SegmentTree([f[0] | i if f else none for i, f in enumerate(found)])
        nodes, put = tree.tree, tree.put
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := nodes[1]) < none:
            i = best & 0xFFFFFFFF
            j = after[i]
            merged = ids[i] = found[i][1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                f = found[i] = get(merged << 20 | ids[k])
                put(j, none)
                put(i, f[0] | i if f else none)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                f = found[h]
                g = found[h] = get(ids[h] << 20 | merged)
                if f or g:
                    put(h, g[0] | h if g else none)
        return [x for x in ids if x >= 0]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a normalised run without white space."""
        out: list[int] = []
        words = self.words
        for piece in PIECES.findall(chunk):
            ids = words.get(piece)
            if ids is None:
                ids = self.old.get(piece) or tuple(self.merge(piece.encode()))
                if len(words) >= self.memory:
                    self.old = dict(words)
                    words.clear()
                words[piece] = ids
            out += ids
        return out

    def parts(self, text: str) -> list[str | int]:
        """The chunks of a text in order; ids of special tokens stand as ints."""
        if "<|" not in text or not (marks := list(self.special.finditer(text))):
            return normal_chunks(text)
        out: list[str | int] = []
        at = 0
        for m in marks:
            out += [*normal_chunks(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return out + normal_chunks(text[at:])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            out += [part] if isinstance(part, int) else self.chunk(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a space; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def normal_chunks(text: str) -> list[str]:
    """NFC, lower case letter by letter, cut at white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    if _SEPARATORS.search(text):
        return [x for x in SPACES.split(text) if x]
    return text.split()


class QuickBpe(Bpe):
    """The same ids from the merge loop of tiktoken, for callers that only need ids.

    A byte that no text holds marks the word's end. That loop merges by the
    rank of the joined token instead of the pair; as every token of a trained
    file has one pair, which is how the file itself cuts the token before its
    merge, both give the same ids (a test checks it for the whole file).
    """

    END = b"\xff"

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        value = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        ranks = {}
        for token, i in model["vocab"].items():
            ended = token.endswith(suffix) and token != suffix
            ranks[b"".join(value[c] for c in (token[: -len(suffix)] if ended else token)) + self.END * ended] = i
        if sorted(ranks.values()) != list(range(len(ranks))) or any(self.merges[k][1] != len(self.inner) * 2 + (self.merges[k][0] >> 32) for k in self.merges):
            raise ValueError("the ids of this file don't follow its merges")
        self.quick = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in PIECES.findall(chunk):
            out += self.quick._encode_single_piece(piece.encode() + self.END)
        return out


class _Memory(dict):
    """chunk (or special id) -> whatever ``make`` gives for its ids.

    Holds at most twice ``limit`` chunks: when full, the newer half becomes the
    older, from which chunks in use come back. Chunks over ``LONGEST``
    characters are not kept, so that the memory is bounded in bytes too.
    """

    LONGEST = 256

    def __init__(self, bpe: Bpe, make, limit: int = 250_000):
        super().__init__()
        self.bpe, self.make, self.limit, self.old = bpe, make, limit, {}

    def __missing__(self, part):
        value = self.old.get(part)
        if value is None:
            value = self.make([part] if isinstance(part, int) else self.bpe.chunk(part))
            if not isinstance(part, int) and len(part) > self.LONGEST:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[part] = value
        return value


def memory(kind: str, vocabulary: str, encoder: type[Bpe], make, limit: int = 250_000) -> _Memory:
    """The process's memory of ``kind``, made at first use; ``make`` takes the encoder and ids.

    It outlives a task, until one begins that gives back what it does not need.
    """
    key = (kind, vocabulary)
    if key not in MEMORIES:
        bpe = encoder(vocabulary)
        MEMORIES[key] = _Memory(bpe, lambda ids: make(bpe, ids), limit)
    return MEMORIES[key]


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens (digests of ''). Repeated rows give
    repeated rows, null ids stay null, extra columns are ignored and an empty
    table gives an empty result. Texts of any length are encoded whole.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        both = memory("digests", vocabulary, Bpe, lambda bpe, ids: (" ".join(map(str, ids)), bpe.decode(ids)))
        bpe = both.bpe
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                pairs = list(map(both.__getitem__, bpe.parts(text or "")))
                ids, names = (" ".join(x) for x in zip(*pairs)) if pairs else ("", "")
                out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(names.encode()).hexdigest()))
            n, ids, names = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(names, pa.string()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
