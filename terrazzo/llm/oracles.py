"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

import math

from . import mixing, preference, quality_rules

_SPLIT = r"[\x20\x09-\x0D]+"

_HOST = "translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter(rules, labels, folds: int) -> str:
    def fits(rule) -> str:
        return f"((host = '{rule.host}' or ends_with(host, '.{rule.host}')) and starts_with(path, '{rule.path}'))"

    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"when {fits(r)} then '{r.name}'" for r in ordered)
    verdict = " ".join(f"when {fits(r)} then '{r.verdict}'" for r in ordered)
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"""with p as (select page_id, url, case when url is null or strpos(url, '://') = 0 then '' else {_HOST} end host,
  case when url is null or strpos(url, '://') = 0 then '' else regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) end path from pages),
q as (select *, regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') query from p),
c as (select *, case when host <> '' then regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', '') || case when query <> '' then '?' || query else '' end end canonical from q),
l as (select distinct canonical from c where canonical is not null and list_has_any(string_split(host, '.'), [{listed}]) and page_id % {folds} = 0),
v as (select page_id, host, path, canonical, case {rule} end rule, case {verdict} end ruled from c)
select page_id, host, path, rule, coalesce(ruled, case when l.canonical is not null then 'block' else 'allow' end) verdict, v.canonical, ruled is null and l.canonical is not null listed from v left join l on v.canonical = l.canonical"""


def mixing_copies() -> str:
    digest = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, chr(30))" for c in ("doc_id", "text", "lang", "source", "n_chars")) + "))"
    u = f"('0x' || substr(md5('{mixing.SEED}:' || digest || ':' || ordinal || ':' || j), 1, 12))::bigint / 281474976710656.0"
    return f"""with m as (select source, sum(length(coalesce(text, '')) + 1.0) mass, pow(sum(length(coalesce(text, '')) + 1.0), {mixing.TEMPERATURE}) weight from documents group by 1),
t as (select sum(mass) all_mass, sum(weight) all_weight from m),
r as (select source, weight * all_mass / (all_weight * mass) rate from m, t),
s as (select source, rate, greatest(ceil(rate / {mixing.MAX_RATE_PER_DRAW}), 1)::int draws, rate / greatest(ceil(rate / {mixing.MAX_RATE_PER_DRAW}), 1) mean from r),
k as (select source, mean, unnest(range(0, (ceil(mean + 12 * sqrt(mean) + 30))::bigint + 1)) k from s),
p as (select source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) cdf from k),
e as (select *, {digest} digest, row_number() over (partition by doc_id, text, lang, source, n_chars) ordinal from documents),
d as (select e.*, rate, draws, unnest(range(1, draws + 1)) j from e join s on e.source is not distinct from s.source),
n as (select doc_id, text, lang, d.source, n_chars, digest, ordinal, rate, (select count(*) from p where p.source is not distinct from d.source and p.cdf <= {u}) own from d),
c as (select doc_id, text, lang, source, n_chars, any_value(rate) mix_rate, sum(own)::int mix_copies from n group by doc_id, text, lang, source, n_chars, digest, ordinal having sum(own) > 0)
select doc_id, text, lang, source, n_chars, mix_rate, mix_copies, unnest(range(1, mix_copies + 1))::int mix_copy from c"""


def preference_pairs() -> str:
    o, b, c = (repr(x).replace("\\n", "' || chr(10) || '") for x in (preference.OPEN, preference.BETWEEN, preference.CLOSE))
    head, tail = len(preference.OPEN) + len(preference.BETWEEN), len(preference.CLOSE)
    role = preference.LEARNED_ROLE
    render = f"coalesce(string_agg({o} || role || {b} || text || {c}, '' order by turn, role, text) filter (where {{f}}), '')"
    begin = f"(place + {head} + length(role))::varchar"
    end = f"(place + {head} + length(role) + length(text) + {tail})::varchar"
    spans = f"coalesce(string_agg({begin} || '-' || {end}, ',' order by turn) filter (where {{f}} and role = '{role}'), '')"
    return f"""with t as (select conv_id, turn, role, coalesce(text, '') text from conversations where conv_id is not null),
a as (select conv_id, (min({{'turn': turn, 'text': text}})).text first_text, min(turn) first_turn, max(turn) last_turn from t where role = '{role}' group by 1),
s as (select conv_id, turn, role, text, 0 side from t union all
  select t.conv_id, turn, role, case when role = '{role}' and turn = last_turn then (case when first_turn < last_turn then first_text else '' end) else text end, 1 from t left join a using (conv_id)),
e as (select x.conv_id, min(case when x.text <> y.text then x.turn end) differs, count(*) n from s x join s y on x.conv_id = y.conv_id and x.turn = y.turn and x.side = 0 and y.side = 1 group by 1),
m as (select s.*, coalesce(s.turn < e.differs, true) shared from s join e using (conv_id)),
l as (select *, coalesce(sum({head} + length(role) + length(text) + {tail}) over (partition by conv_id, side, shared order by turn rows between unbounded preceding and 1 preceding), 0) place from m)
select conv_id, true complete, (count(*) filter (where side = 0 and shared))::int prompt_turns, {render.format(f='side = 0 and shared')} prompt,
 {render.format(f='side = 0 and not shared')} chosen, {spans.format(f='side = 0 and not shared')} chosen_mask,
 {render.format(f='side = 1 and not shared')} rejected, {spans.format(f='side = 1 and not shared')} rejected_mask from l group by 1"""


def quality() -> str:
    """The same bins of equal relative width; a quantile is the upper bound of the bin of that rank."""
    names = list(quality_rules.LEAST_SPREAD)
    width = repr(math.log(quality_rules.GAMMA))
    bins = ", ".join(f"case when {n} > 0 then ceil(ln({n}) / {width})::int else {quality_rules.ZERO_BIN} end b_{n}" for n in names)
    bound = lambda n, q: f"(case quantile_disc(b_{n}, {q}) when {quality_rules.ZERO_BIN} then 0.0 else exp(quantile_disc(b_{n}, {q}) * {width}) end)"
    fence = lambda n: f"{bound(n, 0.75)} + {quality_rules.FENCE} * greatest({bound(n, 0.75)} - {bound(n, 0.25)}, {quality_rules.LEAST_SPREAD[n]}) {n}"
    fences = ", ".join(map(fence, names))
    pick = ", ".join(f"case when g.n >= {quality_rules.MIN_GROUP} then g.{n} when k.n >= {quality_rules.MIN_GROUP} then k.{n} else a.{n} end max_{n}" for n in names)
    failed = ", ".join(f"case when {n} > max_{n} then '{n}' end" for n in names)
    w = quality_rules.WINDOW
    return f"""with d as (select row_number() over () id, doc_id, lang, source, coalesce(text, '') text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '{_SPLIT}'), lambda x: x <> '') words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
x as (select id, unnest(range(1, len(words) - {w - 2})) i, words from w where len(words) >= {w}),
y as (select id, i, array_to_string(words[i:i+{w - 1}], ' ') win from x),
z as (select id, i, count(*) over (partition by id, win) c from y),
o as (select id, least({w}, coalesce(lead(i) over (partition by id order by i) - i, {w})) own from z where c > 1),
h as (select id, sum(own)::bigint n_repeat_words from o group by 1),
b as (select doc_id, lang, source, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars, len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words from w left join h using (id)),
r as (select *, n_symbols / greatest(n_words, 1) symbol_ratio, n_dup_lines / greatest(n_lines, 1) dup_line_ratio, n_repeat_words / greatest(n_words, 1) repeat_ratio, word_chars / greatest(n_words, 1) word_length from b),
rb as (select *, {bins} from r),
g as (select lang, source, count(*) n, {fences} from rb group by 1, 2), k as (select lang, count(*) n, {fences} from rb group by 1), a as (select {fences} from rb),
t as (select g.lang, g.source, case when g.n >= {quality_rules.MIN_GROUP} then 'source' when k.n >= {quality_rules.MIN_GROUP} then 'lang' else 'all' end level, {pick} from g join k on g.lang is not distinct from k.lang cross join a),
j as (select r.*, level, {', '.join(f'max_{n}' for n in names)}, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words base_failed, list_filter([{failed}], lambda x: x is not null) failed_rules from r join t on r.lang is not distinct from t.lang and r.source is not distinct from t.source)
select * replace (array_to_string(failed_rules, ',') as failed_rules), not base_failed and len(failed_rules) = 0 kept from j"""
