"""DuckDB equivalents of the corpus queries that SQL can express."""

from .quality_rules import DELTA, GOOD_WEIGHT, GRID, MIN_WORDS, RISK, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MAXSCORE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""

_SYMBOLS = r"[^#*$%&|<>]+"
_BASE = f"""
w as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') text, {_WORDS} l from documents),
t as (select doc_id, unnest(l) x, generate_subscripts(l, 1) p from w),
g as (select doc_id, p, x a, lead(x) over (partition by doc_id order by p) b, lead(x, 2) over (partition by doc_id order by p) c from t),
h as (select doc_id, p, count(*) over (partition by doc_id, a, b, c) n from g where c is not null),
cov as (select doc_id, count(distinct q) n from (select doc_id, unnest([p, p + 1, p + 2]) q from h where n > 1) group by doc_id),
li as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from w),
m as (select w.doc_id, w.lang, cast(len(w.l) as bigint) n_words, cast(length(array_to_string(w.l, '')) as bigint) word_chars,
             cast(length(regexp_replace(w.text, '{_SYMBOLS}', '', 'g')) as bigint) n_symbols, cast(len(li.l) as bigint) n_lines,
             cast(len(li.l) - len(list_distinct(li.l)) as bigint) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
      from w join li using (doc_id) left join cov using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)"""
_SCORES = " union all ".join(f"select doc_id, lang, base_failed, '{rule}' as rule, {sql.replace(' div ', ' // ')} as score from b" for rule, sql in RULES.items())
QUALITY = f"""
with {_BASE}, sc as ({_SCORES}),
held as (select sc.*, quality from sc join labels using (doc_id) where not base_failed and quality is not null),
gr as (select unnest([{', '.join(map(str, GRID))}]) cutoff),
te as (select lang, rule, cutoff, count(*) filter (quality = 1) n, count(*) filter (quality = 1 and score > cutoff) k,
              count(*) filter (quality <> 1 and score > cutoff) caught from held, gr group by all),
st as (select count(distinct lang) n_strata from te),
ok as (select te.* from te, st where caught > 0 and k <= n * {RISK} and
       list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))
       <= {DELTA} / (n_strata * {len(RULES)} * {len(GRID)})),
cut as (select lang, rule, arg_max(cutoff, (caught - {GOOD_WEIGHT} * k) * 1000000 + cutoff) cutoff, max(caught - {GOOD_WEIGHT} * k) gain from ok group by lang, rule),
bad as (select distinct sc.doc_id from sc join cut using (lang, rule) where gain > 0 and score > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) as kept from b"""

JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.replace('text', _LOWER)} l from documents),
sh as (select doc_id, unnest(list_distinct(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
                                                when len(l) > 0 then [array_to_string(l, ' ')] else [] end)) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
k as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from k union select b, a from k),
r(id, comp) as (select distinct a, a from e union select e.b, r.comp from r join e on e.a = r.id)
select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(x.comp, w.doc_id) component_id
from w left join n using (doc_id) left join (select id, min(comp) comp from r group by id) x on x.id = w.doc_id"""

SUBSTRING = f"""
with w as (select doc_id, {_WORDS} l from documents),
win as (select doc_id, i, array_to_string(l[i:i + 49], ' ') s from (select doc_id, l, unnest(range(1, len(l) - 48)) i from w where len(l) >= 50)),
own as (select s, min(doc_id) m from win group by s),
cov as (select distinct doc_id, unnest(range(i, i + 50)) p from win join own using (s) where m < doc_id),
t as (select doc_id, unnest(l) x, generate_subscripts(l, 1) p from w),
k as (select t.doc_id, count(*) filter (cov.p is not null) gone, string_agg(t.x, ' ' order by t.p) filter (cov.p is null) kept from t left join cov using (doc_id, p) group by t.doc_id)
select w.doc_id, cast(len(w.l) as bigint) n_words, coalesce(k.gone, 0) n_removed, sha256(coalesce(k.kept, '')) kept_sha256 from w left join k using (doc_id)"""

SQL = {"op4_quality_rules": QUALITY, "op5_maxscore_topk": MAXSCORE, "op9_ngram_jaccard_join": JACCARD, "op10_substring_dedup": SUBSTRING}
