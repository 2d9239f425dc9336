"""DuckDB spelling of the stand-in inputs (same rows as ``sources.fixtures``).

The driver registers the parquet tables as DuckDB views; each oracle query is
``WITH <fixtures> <query>``.
"""

from __future__ import annotations

from ..schemas import COMPARISONS, DIMENSIONS
from ..sources.fixtures import (CHECKPOINT_BIAS, CHECKPOINT_PCT, JSON_SUITE, ODD_SCORES, OPEN_SUITE,
                                TURNS, WINNER_LABELS)


def H(s: str) -> str:
    """Portable hash in DuckDB SQL."""
    return f"cast('0x' || substr(md5({s}), 1, 8) as bigint)"


def _values(pairs, names):
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")"
                     for p in pairs)
    return f"(values {rows}) v({', '.join(names)})"


INSTRUCT = f"""instruct as (
  select conv_id, turn, conv_id*{TURNS}+turn as prompt_id,
         text as instruction, coalesce(sys,'') as input, nxt as output
  from (select c.*, lead(role) over w as nrole, lead(text) over w as nxt,
               max(case when role='system' then text end)
                 over (partition by conv_id) as sys
        from conversations c
        window w as (partition by conv_id order by turn)) q
  where role='user' and nrole='assistant')"""

_KEEP = f"""{H("concat(cast(prompt_id as varchar), '|', checkpoint, '|', cast(i as varchar))")} % 100 < pct"""
RESPONSES = f"""responses as (
  select '{OPEN_SUITE}' as suite, prompt_id, checkpoint,
         case when b = 0 then '[no output]' when b = 1 then '[error: x]' when b = 3 then ''
              else array_to_string(case b % 4 when 0 then kept when 1 then list_reverse(kept) when 2 then swapped
                   else list_concat(kept[len(kept) // 2 + 1:], kept[1:len(kept) // 2]) end, ' ') end as response
  from (select prompt_id, checkpoint, {H("concat(cast(prompt_id as varchar), '|', checkpoint)")} % 20 as b,
               list_filter(string_split(output, ' '), lambda w, i: {_KEEP}) as kept,
               list_transform(string_split(output, ' '), lambda w, i: case when {_KEEP} then w else 'so' end) as swapped
        from instruct cross join {_values(CHECKPOINT_PCT, ['checkpoint', 'pct'])}) x
  where b <> 2)"""

JSON_ITEMS = f"""json_items as (
  select event_id as prompt_id, checkpoint, event_type as task_type, expected,
    case b
      when 0 then expected
      when 1 then concat('{{"user_id": ', u, ', "k": ', k, ', "event_type": "', t, '"}}')
      when 2 then concat('{{"event_type": "', t, '", "k": ', k, ', "user_id": ', u, ', "extra": true}}')
      when 3 then concat('{{"event_type": "', t, '", "k": ', k, '}}')
      when 4 then concat('{{"event_type": "', t, '", "k": "', k, '", "user_id": ', u, '}}')
      when 5 then concat('```json', chr(10), expected, chr(10), '```')
      when 6 then substr(expected, 1, length(expected) - 1)
      when 7 then replace(expected, '"', chr(39))
      when 8 then concat('Sure: ', expected, ' Done.')
      else '' end as response
  from (select *, case when hh < bias then 0 else hh % 10 end as b,
               concat('{{"event_type": "', t, '", "k": ', k, ', "user_id": ', u, '}}') as expected
        from (select e.event_id, e.event_type, e.event_type as t, cast(e.user_id as varchar) as u,
                     regexp_extract(e.props, '([0-9]+)', 1) as k, v.checkpoint, v.bias,
                     {H("concat(cast(e.event_id as varchar), '|', v.checkpoint)")} % 100 as hh
              from events e cross join {_values(CHECKPOINT_BIAS, ['checkpoint', 'bias'])}) y) z)"""


def _scores(side: str) -> str:
    parts, odd = [], "[" + ", ".join(f"'{x}'" for x in ODD_SCORES) + "]"
    for i, d in enumerate(DIMENSIONS):
        parts.append("'" + ("" if i == 0 else ", ") + f'"{d}": ' + "'")
        parts.append(f"coalesce(case when h_{side}{d} % 211 < {len(ODD_SCORES)} then {odd}[h_{side}{d} % 211 + 1] end, "
                     f"cast(h_{side}{d} % 7 as varchar))")
    return "concat('{', " + ", ".join(parts) + ", '}')"


def _verdict_hashes() -> str:
    def h(tag):
        return H(f"concat(cast(i.prompt_id as varchar), '|', v.comparison, '|{tag}')")
    cols = [f"{h(s + d)} as h_{s}{d}" for s in ("a", "b") for d in DIMENSIONS]
    cols += [f"{h('swap')} % 2 as swap", f"{h('w')} % 4 as wi", f"{h('b')} % 10 as bi"]
    return ",\n               ".join(cols)


_WIN = "[" + ", ".join(f"'{w}'" for w in WINNER_LABELS) + "]"
VERDICTS = f"""verdicts as (
  select comparison, prompt_id, cast(swap as int) as swap,
         case when bi <= 6 then body when bi <= 8 then concat('Verdict: ', body, ' End.')
              else 'no verdict' end as raw
  from (select *, concat('{{"response_a_scores": ', {_scores('a')},
                         ', "response_b_scores": ', {_scores('b')},
                         ', "winner": "', {_WIN}[wi + 1],
                         '", "justification": "pair ', cast(prompt_id as varchar), '"}}') as body
        from (select i.prompt_id, v.comparison,
               {_verdict_hashes()}
              from instruct i cross join
                   (values {", ".join(f"('{c}')" for c, _, _ in COMPARISONS)}) v(comparison)) x) y)"""

def _units(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, '.'), lambda x: trim(x, ' ')), lambda x: x <> '')"


TOKENS = f"""tok_units as (
  select prompt_id, checkpoint, side, {H("unit")} as h, {H("unit")} % (select count(*) from embeddings) as vec_id
  from (select prompt_id, checkpoint, 'p' as side, unnest({_units("response")}) as unit from responses
        union all
        select r.prompt_id, r.checkpoint, 'r', unnest({_units("i.output")})
        from responses r join instruct i using (prompt_id)) u),
vec_sims as (
  select a.vec_id as i, b.vec_id as j,
         list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s
  from embeddings a, embeddings b),
tok_sims as (
  select p.prompt_id, p.checkpoint, p.rowid as pv, r.rowid as rv,
         case when p.h % 41 = 0 or r.h % 41 = 0 then 0.0 else s end as s
  from (select *, row_number() over () as rowid from tok_units where side = 'p') p
  join (select *, row_number() over () as rowid from tok_units where side = 'r') r using (prompt_id, checkpoint)
  join vec_sims on i = p.vec_id and j = r.vec_id),
bert as (
  select r.prompt_id, r.checkpoint, coalesce(p, 0) as p, coalesce(q, 0) as r,
         case when coalesce(p + q, 0) <> 0 then 2 * p * q / (p + q) else 0.0 end as f
  from responses r
  left join (select prompt_id, checkpoint, avg(m) as p from (select prompt_id, checkpoint, pv, max(s) as m from tok_sims group by all) a group by all) x using (prompt_id, checkpoint)
  left join (select prompt_id, checkpoint, avg(m) as q from (select prompt_id, checkpoint, rv, max(s) as m from tok_sims group by all) b group by all) y using (prompt_id, checkpoint))"""

COMPARISON_TABLE = "comparisons as (select * from " + _values(
    COMPARISONS, ["comparison", "challenger", "opponent"]) + ")"

_DEPS = {
    "instruct": [],
    "responses": ["instruct"],
    "verdicts": ["instruct"],
    "json_items": [],
    "tokens": ["responses"],
    "comparisons": [],
}
_SQL = {"instruct": INSTRUCT, "responses": RESPONSES, "verdicts": VERDICTS,
        "json_items": JSON_ITEMS, "tokens": TOKENS, "comparisons": COMPARISON_TABLE}


def with_fixtures(names, extra_ctes: str = "") -> str:
    """``with`` clause holding the named fixtures (dependencies first)."""
    order = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    ctes = [_SQL[n] for n in order]
    if extra_ctes:
        ctes.append(extra_ctes)
    return "with " + ",\n".join(ctes) + "\n"


__all__ = ["H", "with_fixtures", "JSON_SUITE", "OPEN_SUITE"]
