"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from .source_divergence import LEAST_DOCUMENTS


def _weight(column: str, weights: dict) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {float(v)}" for k, v in weights.items()) + " else 1.0 end" if weights else "1.0"


def _split(name: str, children: str, parent: str, level: str) -> str:
    """children(parent.., level, cap, w, budget) -> parent.., level, budget. parent: columns with commas."""
    return f"""
{name}_a as (select *, cast(cap as double) / w as ratio,
    (budget - coalesce(sum(cap) over (partition by {parent} order by cast(cap as double) / w, {level} rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (partition by {parent} order by cast(cap as double) / w, {level} rows between current row and unbounded following) as lvl from {children}),
{name}_b as (select *, min(case when lvl < ratio then [ratio, lvl] end) over (partition by {parent}) as rest from {name}_a),
{name} as (select {parent}, {level}, case when lvl >= ratio then cap else least(cap, floor(greatest(0.0, rest[2]) * w)::bigint) end as budget from {name}_b)"""


def mix_sql(documents: str = "documents") -> str:
    """Rows: doc_id, domain, lang, source, copies. One running sum per leaf where the operator uses buckets."""
    return f"""
with d as (select doc_id, coalesce(cast(coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint), 0) % 4 as varchar), '(none)') as domain,
    coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::bigint as n from {documents}),
leaf as (select 0 as root, domain, lang, source, sum(n)::bigint as tokens, sum(n)::bigint * {MIX_EPOCHS} as cap from d group by all),
c1 as (select root, domain, sum(cap)::bigint as cap, {_weight("domain", MIX_WEIGHTS[0])} as w, (select floor(sum(tokens) * {MIX_SHARE})::bigint from leaf) as budget from leaf group by root, domain),
{_split("b1", "c1", "root", "domain")},
c2 as (select x.root, x.domain, x.lang, x.cap, {_weight("lang", MIX_WEIGHTS[1])} as w, b1.budget from (select root, domain, lang, sum(cap)::bigint as cap from leaf group by all) x join b1 using (root, domain)),
{_split("b2", "c2", "root, domain", "lang")},
c3 as (select x.root, x.domain, x.lang, x.source, x.cap, {_weight("source", MIX_WEIGHTS[2])} as w, b2.budget from leaf x join b2 using (root, domain, lang)),
{_split("b3", "c3", "root, domain, lang", "source")},
plan as (select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as whole, case when tokens > 0 then budget % tokens else 0 end as part, tokens from leaf join b3 using (root, domain, lang, source)),
o as (select d.*, whole, part, tokens, sum(n) over (partition by domain, lang, source order by md5('{MIX_SEED}/' || whole || '/' || doc_id), n rows unbounded preceding) as upto from d join plan using (domain, lang, source)),
r as (select doc_id, domain, lang, source, (whole + case when whole < {MIX_EPOCHS} and tokens > 0 and upto <= part then 1 else 0 end)::int as copies from o)
select * from r where copies > 0
"""


def divergence_sql(documents: str = "documents", least: int = LEAST_DOCUMENTS, top: int = 10) -> str:
    """Rows: lang, source, part, item, value, rank; every group with every kept term, one by one."""
    p = "1 + (1000000000::hugeint * ({0} + 2)) // ({1} + 2 * terms)::hugeint"
    f = "((a - b) * (a - b)) // (a + b)"
    return f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as found from {documents}),
kept as (select lang, term from (select lang, unnest(list_distinct(found)) as term from d) group by all having count(*) >= {least}),
n as (select lang, source, term, count(*) as n from (select lang, source, unnest(found) as term from d) join kept using (lang, term) group by all),
g as (select lang, source, coalesce(sum(n.n), 0) as total from (select distinct lang, source from d) left join n using (lang, source) group by all),
l as (select g.lang, sum(g.total) as total, coalesce(any_value(v), 0) as terms from g left join (select lang, count(*) as v from kept group by lang) k on k.lang = g.lang group by g.lang),
p as (select g.lang, g.source, kept.term, coalesce(n.n, 0) as n, {p.format("coalesce(n.n, 0)", "g.total")} as p, {p.format("sum(coalesce(n.n, 0)) over (partition by g.lang, kept.term)", "l.total")} as q
    from g join l on l.lang = g.lang join kept on kept.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = kept.term),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(v.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source
    left join (select lang, s, t, sum({f}) as value from (select x.lang, x.source as s, y.source as t, x.p as a, y.p as b from p x join p y on x.lang = y.lang and x.term = y.term) group by all) v
    on v.lang = x.lang and v.s = x.source and v.t = y.source),
terms as (select lang, source, 'term' as part, term as item, ({f})::bigint as value from (select *, p as a, q as b from p) where n > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from pairs
union all select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from terms) where rank <= {top}
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_budget_mix": mix_sql(), "op12_term_vectors": divergence_sql()}
