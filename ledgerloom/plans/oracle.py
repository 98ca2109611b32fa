"""The same queries as SQL for DuckDB."""

from __future__ import annotations

_STRIP = r"regexp_replace(regexp_replace({c}, '^[\s\x{{85}}\x{{a0}}]+', ''), '[\s\x{{85}}\x{{a0}}]+$', '')"


def strip(c: str) -> str:
    return _STRIP.format(c=c)


def filled(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def amount(c: str) -> str:
    bare = f"replace(replace(replace({strip(c)}, ',', ''), '₹', ''), ' ', '')"
    return f"case when regexp_full_match({bare}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') then try_cast({bare} as decimal(24,6)) end"


def date(c: str) -> str:
    s = strip(c)
    return (
        f"coalesce(case when regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_strptime({s}, '%Y-%m-%d') end,"
        f" case when regexp_full_match({s}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') then try_strptime({s}, '%Y/%m/%d') end,"
        + ",".join(f" case when regexp_full_match({s}, '[0-9]{{1,2}}{p}[0-9]{{1,2}}{p}[0-9]{{4}}') then try_strptime({s}, '%d{q}%m{q}%Y') end" for p, q in (("/", "/"), ("-", "-"), ("[.]", ".")))
        + ")::date"
    )


def amount_key(c: str) -> str:
    return f"coalesce(cast({amount(c)} as varchar), '?' || {filled(c)})"


def gstin(c: str) -> str:
    return rf"nullif(upper(regexp_replace({c}, '[\s-]', '', 'g')), '')"


_VALUES = ", ".join(
    [gstin("vendor_gstin"), f"coalesce(cast({date('invoice_date')} as varchar), '?' || {filled('invoice_date')})",
     rf"regexp_replace({filled('place_of_supply')}, '\s+', ' ', 'g')"]
    + [amount_key(c) for c in ("tax_rate", "taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value")]
)

P1 = f"""
with rows as (
  select upper({filled('invoice_id')}) as k, {filled('gstr2b_period')} as s, row({_VALUES}) as v from gstr2b_prior_period
), periods as (
  select s, lead(s) over (order by s) as next_s, lag(s) over (order by s) as last_s from (select distinct s from rows where s is not null)
), once as (select k, s, max(v) as v from rows where k is not null and s is not null group by k, s
), pairs as (
  select o.k, o.s, p.last_s, p.next_s, o.v, b.v as v_before, b.k is not null as was, a.k is not null as stays
  from once o join periods p on o.s = p.s
  left join once b on b.k = o.k and b.s = p.last_s left join once a on a.k = o.k and a.s = p.next_s
)
select s as gstr2b_period, k as invoice_id, 'added' as change from pairs where last_s is not null and not was
union all select next_s, k, 'removed' from pairs where next_s is not null and not stays
union all select s, k, 'changed' from pairs where was and v is distinct from v_before
"""

_P5_SIDE = ", ".join(f"max({amount_key(c)}) as {c}" for c in ("taxable_value", "cgst", "sgst", "igst"))
P5 = f"""
with a as (select upper({filled('invoice_id')}) as k, {_P5_SIDE} from gstr2b_prior_period
           where {filled('gstr2b_period')} = '2026-03' and {filled('invoice_id')} is not null group by 1),
     b as (select upper({filled('invoice_id')}) as k, {_P5_SIDE} from gstr2b_prior_copy
           where {filled('invoice_id')} is not null group by 1)
select k as invoice_id, 'missing_in_copy' as difference from a where k not in (select k from b)
union all select k, 'missing_in_prior' from b where k not in (select k from a)
""" + "".join(
    f"union all select a.k, '{c}' from a join b on a.k = b.k where a.{c} is distinct from b.{c}\n"
    for c in ("taxable_value", "cgst", "sgst", "igst")
)

P_SQL: dict[str, str] = {
    "p1_found": P1,
    "p1_by_snapshot": f"select gstr2b_period, count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed,"
    f" count(*) filter (change = 'changed') as changed from ({P1}) group by 1",
    "p5_found": P5,
}


def all_sql() -> dict[str, str]:
    """SQL of all core queries that SQL can express."""
    from . import ledger_oracle

    return P_SQL | ledger_oracle.SQL
