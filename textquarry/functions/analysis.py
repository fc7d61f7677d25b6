"""Text analysis as column expressions: character filters, a tokenizer and token filters in order.

Every stage is a function from Column to Column, so an ``Analyzer`` is an
expression that Catalyst sees whole; only HTML reading and stemming are Arrow
functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import page_text
from .porter import stem_terms

Stage = Callable[[Column], Column]

#: What is trimmed from the ends of a token: anything but letters and numbers of any script.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
MIN_BYTES = 2

# English stop words.
STOP_WORDS = tuple(
    (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll "
    "she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's "
    "who's why's would "
    ).split()
)


def html_body(text: Column) -> Column:
    """Character filter: the searchable text of a page."""
    return page_text(text, "body")["body"]


def whitespace_tokens(text: Column) -> Column:
    """Tokens between runs of Unicode white space, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


#: A run of other than white space, from its first letter or number to its last; one sign alone has a single byte if it is ASCII.
_ALNUM = r"[\p{IsAlphabetic}\p{N}]"
_CORE = rf"(?U){_ALNUM}\S*{_ALNUM}|(?![A-Za-z0-9]){_ALNUM}"


def bare_tokens(text: Column) -> Column:
    """``strip_punctuation`` of ``whitespace_tokens`` in one pass."""
    return F.regexp_extract_all(text, F.lit(_CORE), F.lit(0))


class Keep:
    """A token filter that looks at each token by itself; those that follow each other are applied at once."""

    def __init__(self, *conditions: Stage):
        self.conditions = conditions

    def __call__(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda x: reduce(lambda a, b: a & b, (c(x) for c in self.conditions)))


def strip_punctuation(tokens: Column, min_bytes: int = MIN_BYTES) -> Column:
    """Tokens without signs at either end; those under ``min_bytes`` UTF-8 bytes go."""
    ends = f"^{NOT_ALNUM}|{NOT_ALNUM}$"
    return F.filter(F.transform(tokens, lambda x: F.regexp_replace(x, ends, "")), lambda x: (F.octet_length(x) >= min_bytes) & (x != ""))


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


#: Keeps tokens with a letter.
drop_numeric = Keep(lambda x: x.rlike(r"\p{IsAlphabetic}"))


def drop_stop_words(words: Sequence[str] = STOP_WORDS) -> Stage:
    return Keep(lambda x: ~x.isin(*words))


def compress_whitespace(text: Column) -> Column:
    """Trimmed lines without the blank ones."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@dataclass(frozen=True)
class Analyzer:
    """Character filters, then a tokenizer, then token filters, each applied in order."""

    char_filters: tuple[Stage, ...] = (html_body,)
    tokenizer: Stage = whitespace_tokens
    token_filters: tuple[Stage, ...] = (strip_punctuation, lowercase, drop_numeric, drop_stop_words(), stem_terms)

    def analyze(self, text: Column) -> Column:
        """Array of terms; a term's position is its place in the array."""
        for stage in self.char_filters:
            text = stage(text)
        filters = self.token_filters
        if self.tokenizer is whitespace_tokens and filters[:1] == (strip_punctuation,):
            terms, filters = bare_tokens(text), filters[1:]
        else:
            terms = self.tokenizer(text)
        for alike, stages in groupby(filters, lambda s: isinstance(s, Keep)):
            for stage in [Keep(*(c for s in stages for c in s.conditions))] if alike else stages:
                terms = stage(terms)
        return terms

    def terms(self, spark, text: str) -> list[str]:
        """Terms of one string, by the same expression as for tables."""
        row = spark.createDataFrame([(text,)], "text string").select(self.analyze(F.col("text")).alias("t")).first()
        return list(row["t"] or [])


def stop_words_of(path: str) -> tuple[str, ...]:
    """Stop words of a text file, one in a line; blank lines don't count."""
    with open(path, encoding="utf-8") as f:
        return tuple(dict.fromkeys(w for w in (line.strip() for line in f) if w))


def with_stop_words(words: Sequence[str], char_filters: tuple[Stage, ...] = (html_body,)) -> Analyzer:
    """The whole pipeline with another stop list."""
    return Analyzer(char_filters=char_filters, token_filters=(strip_punctuation, lowercase, drop_numeric, drop_stop_words(words), stem_terms))


#: The whole pipeline for pages, and parts of it for plain text.
DEFAULT = Analyzer()
PLAIN = Analyzer(char_filters=())
UNSTEMMED = Analyzer(char_filters=(), token_filters=(strip_punctuation, lowercase, drop_numeric, drop_stop_words()))


def tokens(docs: DataFrame, doc_id: str, text: str, analyzer: Analyzer = DEFAULT) -> DataFrame:
    """doc_id, pos, term: one row for each surviving token, positions counted after all filters."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(analyzer.analyze(F.col(text))).alias("pos", "term"))


def with_cleaned_content(docs: DataFrame, text: str, analyzer: Analyzer = DEFAULT) -> DataFrame:
    """``docs`` with ``cleaned_content``: its terms joined by a space."""
    return docs.withColumn("cleaned_content", F.array_join(F.coalesce(analyzer.analyze(F.col(text)), F.array().cast("array<string>")), " "))
