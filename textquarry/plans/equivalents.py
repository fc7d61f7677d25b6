"""DuckDB text for what is long in SQL: Porter's stems and the searchable text of a page."""

from __future__ import annotations

from ..functions.html import LINE_ELEMENTS
from ..functions.porter import STEP2, STEP3, STEP4

_V, _C = "[aeiouy]", "[^aeiouy]"  # of words in which a y that is a consonant is written Y


def _ends(*suffixes: str) -> str:
    return "(" + " or ".join(f"suffix(w, '{s}')" for s in suffixes) + ")"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})" if n else "w"


def _more_than(n: int, stem: str) -> str:
    """Whether a stem has more than n vowel-consonant sequences."""
    return f"regexp_matches({stem}, '^{_C}*({_V}+{_C}+){{{n + 1}}}')"


def _once(stem: str) -> str:
    return f"regexp_matches({stem}, '^{_C}*{_V}+{_C}+{_V}*$')"


def _vowel(stem: str) -> str:
    return f"regexp_matches({stem}, '{_V}')"


def _cvc(stem: str) -> str:
    return f"regexp_matches({stem}, '{_C}{_V}[^aeiouyYwx]$')"


def _rules(rules) -> str:
    found = sorted(rules, key=lambda r: -len(r[0]))
    return "case " + " ".join(f"when suffix(w, '{s}') then case when {_more_than(0, _cut(len(s)))} then {_cut(len(s))} || '{new}' else w end" for s, new in found) + " else w end"


def stems(terms: str) -> str:
    """CTEs ``p0`` to ``stems(term, stem)`` for the distinct terms of a table ``terms`` (term)."""
    step1a = f"case when {_ends('sses', 'ies')} then {_cut(2)} when suffix(w, 's') and not suffix(w, 'ss') then {_cut(1)} else w end"
    ed, ing = f"suffix(w, 'ed') and {_vowel(_cut(2))}", f"suffix(w, 'ing') and {_vowel(_cut(3))}"
    step1b = f"case when suffix(w, 'eed') then case when {_more_than(0, _cut(3))} then {_cut(1)} else w end when {ed} then {_cut(2)} when {ing} then {_cut(3)} else w end"
    doubled = f"length(w) > 1 and lower(right(w, 1)) = lower(left(right(w, 2), 1)) and regexp_matches(w, '[^aeiouylsz]$')"
    mended = f"case when not was_cut then w when {_ends('at', 'bl', 'iz')} then w || 'e' when {doubled} then {_cut(1)} when {_once('w')} and {_cvc('w')} then w || 'e' else w end"
    step1c = f"case when regexp_matches(w, '[yY]$') and {_vowel(_cut(1))} then {_cut(1)} || 'i' else w end"
    step4 = "case " + " ".join(
        f"when suffix(w, '{s}') then case when {_more_than(1, _cut(len(s)))}" + (f" and regexp_matches({_cut(3)}, '[st]$')" if s == "ion" else "") + f" then {_cut(len(s))} else w end"
        for s in sorted(STEP4, key=lambda s: -len(s))
    ) + " else w end"
    step5a = f"case when suffix(w, 'e') and ({_more_than(1, _cut(1))} or ({_once(_cut(1))} and not {_cvc(_cut(1))})) then {_cut(1)} else w end"
    step5b = f"case when suffix(w, 'll') and {_more_than(1, _cut(1))} then {_cut(1)} else w end"
    out = [rf"p0 as (select distinct term, regexp_replace(term, '(^|{_V})y', '\1Y', 'g') w from {terms})", f"p1 as (select term, {step1a} w from p0)"]
    out.append(f"p2 as (select term, {step1b} w, not suffix(w, 'eed') and (({ed}) or ({ing})) was_cut from p1)")
    for i, step in enumerate((mended, step1c, _rules(STEP2), _rules(STEP3), step4, step5a, step5b), 3):
        out.append(f"p{i} as (select term, {step} w from p{i - 1})")
    out.append("stems as (select term, case when length(term) < 3 then term else lower(w) end stem from p9)")
    return ", ".join(out)


_SIGNS = (("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#x27;", 39), ("&copy;", 169), ("&middot;", 183), ("&amp;", 38))


def page_body() -> str:
    """Expression of the searchable text of ``html``, for the markup of the test pages only.

    A line element that opens is marked by chr(1), a run of text by chr(2)
    before it; then a run of chr(1) becomes one line end and a run of chr(2)
    one space, or none at the start.
    """
    text = "regexp_replace(html, '(?s)^.*?<body[^>]*>', '')"
    for gone in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<title[^>]*>.*?</title>", "<h1[^>]*>.*?</h1>", "<a [^>]*>.*?</a>", "<!--.*?-->"):
        text = f"regexp_replace({text}, '(?s){gone}', '<x>', 'g')"
    plain = "x"
    for sign, code in _SIGNS:
        plain = f"replace({plain}, '{sign}', chr({code}))"
    opens = "^<(" + "|".join(sorted(LINE_ELEMENTS)) + ")[ >/]"
    marked = rf"list_transform(regexp_extract_all({text}, '<[^>]*>|[^<]+'), lambda x: case when regexp_matches(x, '{opens}') then chr(1) when prefix(x, '<') then '' else chr(2) || regexp_replace({plain}, '^\s+|\s+$', '', 'g') end)"
    body = f"coalesce(list_aggregate({marked}, 'string_agg', ''), '')"
    body = rf"regexp_replace(regexp_replace(regexp_replace({body}, '\x01+', chr(10), 'g'), '\x02+', chr(2), 'g'), '^\x02', '')"
    return f"replace({body}, chr(2), ' ')"
