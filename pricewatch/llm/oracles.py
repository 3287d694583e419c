"""DuckDB SQL for the corpus queries that SQL can state."""

from __future__ import annotations

from pricewatch.llm.quality import GRIDS

_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY_COUNTS = f"""
texts as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text from documents),
words as (
  select rid, unnest(regexp_extract_all(text, '{_WORD}')) as w,
         generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) as i
  from texts
),
windows as (
  select rid, i, w || ' ' || lead(w) over p || ' ' || lead(w, 2) over p as g
  from words window p as (partition by rid order by i)
),
twins as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from windows where g is not null)
  where c > 1
),
covered as (select rid, count(distinct i + d) as n_repeat_words from twins, range(3) as r(d) group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as l from texts),
line_counts as (
  select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
  from lines where regexp_matches(l, '{_WORD}') group by rid
),
counted as (
  select t.rid, t.doc_id, t.lang,
    len(regexp_extract_all(text, '{_WORD}'))::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0) as n_lines,
    length(text) - length(translate(text, '!', '')) as shouts,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper_chars
  from texts t left join covered using (rid) left join line_counts using (rid)
),
scored as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when word_chars > 0 then n_symbols::double / word_chars else 0 end as symbol_share,
    case when word_chars > 0 then shouts::double / word_chars else 0 end as shout_share,
    case when word_chars > 0 then upper_chars::double / word_chars else 0 end as upper_share,
    case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end as dup_line_share,
    case when n_words > 0 then n_repeat_words::double / n_words else 0 end as repeat_share
  from counted
)"""


def quality(risk: float = 0.02, delta: float = 0.05, good_weight: int = 10) -> str:
    grid = ", ".join(f"('{rule}', {float(c)!r}::double)" for rule, cuts in GRIDS.items() for c in cuts)
    score = " ".join(f"when '{rule}' then {rule}" for rule in GRIDS)
    return f"""
with {_QUALITY_COUNTS},
grid(rule, cutoff) as (values {grid}),
rule_scores as (select rid, doc_id, lang, rule, cutoff, (case rule {score} end) > cutoff as above from scored, grid),
tests as (
  select lang, rule, cutoff,
    count(*) filter (quality = 1) as n_good,
    count(*) filter (quality = 1 and above) as false_rejections,
    count(*) filter (quality <> 1 and above) as bad_rejected
  from rule_scores join labels using (doc_id) where quality is not null group by all
),
strata as (select lang, max(n_good) as n_good, count(*) over () as strata from tests group by lang),
terms as (
  select lang, strata, i,
    n_good * ln(1 - {risk}::double) + i * ln({risk}::double / (1 - {risk}::double))
      + coalesce(sum(ln((n_good - i + 1)::double / i)) filter (i > 0) over (partition by lang order by i), 0) as term
  from strata, unnest(range(0, least(n_good, ceil(n_good * {risk}::double))::bigint + 1)) as r(i)
),
limits as (
  select lang, coalesce(max(i) filter (tail <= {delta}::double / (strata * {len(GRIDS)})), -1) as most
  from (select *, sum(exp(term)) over (partition by lang order by i) as tail from terms) group by lang
),
certified as (
  select t.lang, rule, cutoff, bad_rejected - {good_weight} * false_rejections as gain
  from tests t join limits l on t.lang is not distinct from l.lang
  where false_rejections <= most and bad_rejected - {good_weight} * false_rejections > 0
),
chosen as (select lang, rule, max(cutoff) as cutoff from (
  select *, gain = max(gain) over (partition by lang, rule) as top from certified) where top group by lang, rule),
fired as (
  select distinct r.rid from rule_scores r join chosen c
  on r.lang is not distinct from c.lang and r.rule = c.rule and r.cutoff = c.cutoff where r.above
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rid not in (select rid from fired) as kept
from scored
"""
