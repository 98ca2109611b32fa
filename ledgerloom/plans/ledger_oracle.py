"""SQL for DuckDB of the queries in ledger_queries."""

from __future__ import annotations

from .oracle import amount, date, filled, gstin, strip

_COLUMNS = [
    "record_id", "invoice_id", "vendor_name", "vendor_gstin", "invoice_date", "place_of_supply", "tax_rate", "taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value",
]
_NUMERIC = ("taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value")
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _blank(c: str) -> str:
    return f"coalesce({strip(c)}, '')"


def _digit(g: str) -> str:
    p = f"((instr('{_ALPHABET}', substr({g}, i, 1)) - 1) * (case when i % 2 = 0 then 2 else 1 end))"
    return f"substr('{_ALPHABET}', (36 - (list_sum([{p} // 36 + {p} % 36 for i in range(1, 15)])::int % 36)) % 36 + 1, 1)"


def _valid_gstin(g: str) -> str:
    shape = "(0[1-9]|[12][0-9]|3[0-8]|97|99)[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]"
    return f"case when regexp_full_match({g}, '{shape}') then substr({g}, 15, 1) = {_digit(g)} else false end"


_LATER = ("itc_claimed_date", "rule88d_intimation_date", "supplier_filing_date", "simulated_current_date")
_FILINGS = f"""select {', '.join(f"r.{c}" for c in (*_COLUMNS, *_LATER[2:]))} from (select max(row({', '.join(_COLUMNS)}, supplier_filing_date, gstr2b_period, simulated_current_date)) as x, max_by(t, row({', '.join(f"coalesce({c}, '')" for c in _COLUMNS)})) as r
  from gstr2b_prior_period t where gstr2b_period = (select max(gstr2b_period) from gstr2b_prior_period) group by record_id)"""

_ERRORS = (
    [(f"{_blank(c)} = ''", "missing_required_field", c) for c in ("invoice_id", "vendor_gstin", "invoice_date", "taxable_value")]
    + [(" and ".join(f"{_blank(c)} = ''" for c in ("cgst", "sgst", "igst")), "missing_required_field", "cgst|sgst|igst")]
    + [(f"not ({_valid_gstin(_blank('vendor_gstin'))})", "invalid_gstin_format", "vendor_gstin")]
    + [("d is null", "unparseable_or_implausible_date", "invoice_date"), ("d not between date '2017-07-01' and date '2030-12-31'", "unparseable_or_implausible_date", "invoice_date")]
    + [x for c in _NUMERIC for x in ((f"{_blank(c)} <> '' and {amount(c)} is null", "non_numeric_or_negative_amount", c), (f"coalesce({amount(c)}, 0) < 0", "non_numeric_or_negative_amount", c))]
)
_FIRST = "case " + " ".join(f"when {w} then row('{e}', '{f}')" for w, e, f in _ERRORS) + " end"
_ALL = "[x for x in [" + ", ".join(f"case when {w} then {{'e': '{e}', 'f': '{f}'}} end" for w, e, f in _ERRORS) + "] if x is not null]"

_RAW = f"""both_raw as (
  select 'purchase_register' as source, {', '.join(f"coalesce({c}, '') as {c}" for c in (*_COLUMNS, *_LATER[:2]))}, '' as supplier_filing_date, coalesce(simulated_current_date, '') as simulated_current_date from purchase_register
  union all select 'gstr2b', {', '.join(f"coalesce({c}, '')" for c in _COLUMNS)}, '', '', coalesce(supplier_filing_date, ''), coalesce(simulated_current_date, '') from ({_FILINGS})
), judged as (select *, {_FIRST} as err from (select *, {date('invoice_date')} as d from both_raw))"""
_TEXT = rf"regexp_replace({_blank('vendor_name')}, '\s+', ' ', 'g')"
_NAME = rf"regexp_replace(trim(regexp_replace({_TEXT}, '^(M/[sS]|Messrs)\.?\s+', ''), ' .,;:-'), '\s+', ' ', 'g')"
_two = lambda c: f"coalesce(cast(cast({amount(c)} as decimal(24,2)) as varchar), {_blank(c)})"
_CHANGED = {"vendor_gstin": ("gstin", f"coalesce({gstin('vendor_gstin')}, '')"), "vendor_name": ("text", _NAME)}
_CHANGED |= {c: ("date", f"coalesce(cast({date(c)} as varchar), {_blank(c)})") for c in ("invoice_date", *_LATER)} | {c: ("amount", _two(c)) for c in _NUMERIC}
_LOGGED = f"{_RAW}, logged as (select source, record_id, {', '.join(f'{c} as raw_{c}, {x} as {c}' for c, (_, x) in _CHANGED.items())} from judged where err is null)"
_NORMAL = f"""{_RAW}, valid as (
  select source, record_id, invoice_id, coalesce({gstin('vendor_gstin')}, '') as vendor_gstin, {_NAME} as vendor_name, coalesce(cast(d as varchar), {_blank('invoice_date')}) as invoice_date,
    {', '.join(f"{_two(c)} as {c}" for c in ('taxable_value', 'cgst', 'sgst', 'igst'))}, d, vendor_gstin as raw_gstin, invoice_date as raw_date, taxable_value as raw_value
  from judged where err is null
), num as (select *, try_cast(taxable_value as decimal(24,2)) as amount, coalesce(try_cast(igst as decimal(24,2)), 0) as i, coalesce(try_cast(cgst as decimal(24,2)), 0) as c, coalesce(try_cast(sgst as decimal(24,2)), 0) as s from valid
), l as (select * from num where source = 'purchase_register'), r as (select * from num where source = 'gstr2b')"""
_PROFILE = "case when {p}i > 0 and ({p}c > 0 or {p}s > 0) then 'mixed' when {p}i > 0 then 'igst' when {p}c > 0 or {p}s > 0 then 'cgst_sgst' else 'none' end"
_BEST = "case when l.vendor_gstin <> '' and l.vendor_gstin = r.vendor_gstin then 30.0 when length(l.vendor_gstin) = 15 and length(r.vendor_gstin) = 15 and substr(l.vendor_gstin, 3, 10) = substr(r.vendor_gstin, 3, 10) then 20.0 else 0.0 end"
_AMT = "case when abs(l.a - r.a) <= 1.0 then 30.0 when abs(l.a - r.a) / greatest(abs(l.a), abs(r.a), 1.0) <= 0.02 then 12.0 when abs(l.a - r.a) / greatest(abs(l.a), abs(r.a), 1.0) <= 0.10 then 6.0 else 0.0 end"
_DAY = "case when l.d = r.d then 6.0 when abs(l.d - r.d) <= 2 then 4.0 when abs(l.d - r.d) <= 7 then 2.0 when abs(l.d - r.d) <= 30 then 1.0 else 0.0 end"
_WORDS = r"array_to_string(list_sort([x for x in regexp_split_to_array(upper({c}), '\s+') if x <> '']), ' ')"
_PAIRS = f"""p as (select l.record_id as left_id, r.record_id as right_id, {_BEST} as gstin, {_AMT} as amount, {_DAY} as "date", case when l.invoice_id <> '' and l.invoice_id = r.invoice_id then 40.0 else 0.0 end as invoice,
    l.invoice_id as li, r.invoice_id as ri, l.w as lw, r.w as rw
  from (select *, amount::double as a, {_WORDS.format(c='vendor_name')} as w from l) l, (select *, amount::double as a, {_WORDS.format(c='vendor_name')} as w from r) r)"""


def _ratio(x: str, y: str) -> str:
    """Twice the longest common subsequence over both lengths; the row of its table is held in the bits of a number."""
    mask = f"list_sum([case when {x}[i] = {y}[j] then 1::hugeint << (i - 1)::int else 0::hugeint end for i in range(1, length({x}) + 1)])::hugeint"
    full = f"((1::hugeint << length({x})::int) - 1)"
    row = f"list_reduce([{mask} for j in range(1, length({y}) + 1)], lambda t, m: ((t + (t & m)) | (t - (t & m))) & {full}, {full})"
    return f"2 * (length({x}) - bit_count({row}))::double / (length({x}) + length({y}))"


def _points(ratio: str, start: str, most: str) -> str:
    return f"case when {ratio} > {start} then {most} * ({ratio} - {start}::double) / (1::double - {start}::double) else 0 end"


# Pairs that reach the floor, and the one-to-one pairs: in each round those that are first for both their sides, until none is left.
_SCORED = f"""{_NORMAL}, {_PAIRS}, t as (select *, case when lw <> '' and rw <> '' then {_ratio('lw', 'rw')} else 0 end as nr, case when invoice = 0 and li <> '' and ri <> '' then {_ratio('li', 'ri')} else 0 end as ir
  from p where gstin + amount + "date" + invoice + 10 + case when invoice > 0 then 0 else 8 end >= 45
), u as (select left_id, right_id, gstin, amount, "date", {_points('nr', '0.60', '10::double')} as name, case when invoice > 0 then invoice else {_points('ir', '0.85', '8::double')} end as invoice from t
), scored as (select *, round(invoice::double + gstin::double + amount::double + name + "date"::double, 6) as score from u where round(invoice::double + gstin::double + amount::double + name + "date"::double, 6) >= 45)"""
_ASSIGNED = f"""{_SCORED}, rounds as (
  select left_id, right_id, score, false as won from scored
  union all
  select left_id, right_id, score, won from (
    select *, bool_or(won) over (partition by left_id) as lt, bool_or(won) over (partition by right_id) as rt from (
      select left_id, right_id, score, row_number() over (partition by left_id order by score desc, right_id) = 1 and row_number() over (partition by right_id order by score desc, left_id) = 1 as won
      from rounds where not won)) where won or not (lt or rt)
), pairs as (select left_id, right_id, score from rounds where won)"""
_EVIDENCE = f"""{_ASSIGNED}, e as (
  select l.record_id as left_id, r.record_id as right_id, l.invoice_id, r.record_id is not null as found, l.vendor_gstin as lg, r.vendor_gstin as rg, l.i + l.c + l.s as tax,
    l.amount - r.amount as amount_delta, l.d - r.d as date_delta, (l.i + l.c + l.s) - (r.i + r.c + r.s) as tax_delta,
    coalesce(abs(l.amount - r.amount) <= 1.00, false) as amount, coalesce(l.d = r.d, false) as "date", coalesce(l.vendor_gstin = r.vendor_gstin, false) as gstin, coalesce(l.invoice_id = r.invoice_id, false) as invoice_number,
    coalesce({_PROFILE.format(p='l.')} = {_PROFILE.format(p='r.')} and r.record_id is not null, false) as tax_heads, coalesce(upper(l.vendor_name) = upper(r.vendor_name), false) as vendor_name
  from l left join pairs p on p.left_id = l.record_id left join r on r.record_id = p.right_id
), c as (
  select *, round(100.0 * (30 * gstin::int + 30 * amount::int + 20 * invoice_number::int + 10 * "date"::int + 5 * vendor_name::int + 5 * tax_heads::int) / 100, 4)::double as confidence,
    case when not found then 'N1' when substr(lg, 3, 10) <> substr(rg, 3, 10) then 'N2' when abs(amount_delta) > 1.00 then 'N3' end as rule_id
  from e
), d as (select *, case when confidence >= 80.25 and gstin and amount and invoice_number then 'auto_reconcile' when rule_id is not null then 'classified_exception' else 'indeterminate' end as outcome from c)"""
_DELIVERED = (*_COLUMNS, "supplier_filing_date", "gstr2b_period", "simulated_current_date")
_BOOKED = ("record_id", "invoice_id", "vendor_id", *_COLUMNS[2:], "itc_claimed_date", "rule88d_intimation_date", "simulated_current_date")
_EVERY = sorted({*_DELIVERED, *_BOOKED})
_LINE = r"regexp_replace(coalesce(raw_line, ''), '(\r\n|\n|\r)$', '')"
_keys_of = lambda cs: "[" + ", ".join(f"'{c}'" for c in sorted(cs)) + "]"
_unquoted = lambda x: f"case when {x}[1] = '\"' then replace(substr({x}, 2, length({x}) - 2), '\"\"', '\"') else {x} end"
# Delivered lines and logged snapshots as text cells with what is wrong with their shape, then the first error of each record.
_READ = rf"""outlined as (
  select line_id, {_LINE} as t, regexp_replace(replace({_LINE}, chr(1), chr(2)), '"[^"]*"', chr(1), 'g') as o from raw_filing_lines where line_no <> 1
), shaped as (
  select *, case when regexp_matches(o, '[^,\x01]\x01|\x01[^,\x01]|"|[\r\n]') then 'broken_quoting' when length(o) - length(replace(o, ',', '')) <> {len(_DELIVERED) - 1} then 'column_count' end as shape from outlined
), split as (select line_id, shape, case when shape is null then regexp_extract_all(t || ',', '((?:"[^"]*")+|[^,"]*),', 1) end as x from shaped
), snapshots as (
  select id, source, case when json_valid(raw_record_snapshot) and json_type(raw_record_snapshot) = 'OBJECT' then raw_record_snapshot::json end as j from quarantine_log
), known as (select *, case when j is null then 'broken_json' when list_sort(list_distinct(json_keys(j))) = case when source = 'purchase_register' then {_keys_of(_BOOKED)} when source in ('gstr2b', 'gstr2b_prior_period') then {_keys_of(_DELIVERED)} end then null else 'column_count' end as shape from snapshots
), cells as (
  select 'raw_filing_lines' as origin, line_id as row_id, shape, {', '.join(_unquoted(f'x[{_DELIVERED.index(c) + 1}]') + f' as {c}' if c in _DELIVERED else f'null::varchar as {c}' for c in _EVERY)} from split
  union all select 'quarantine_log', id, shape, {', '.join(f"case when shape is null then j ->> '$.{c}' end" for c in _EVERY)} from known
), read as (select *, {date('invoice_date')} as d from cells)"""
_WHY = f"{_READ}, why as (select *, case when shape is not null then shape else {_FIRST}[1] end as reason from read)"
_FIELDS = ("amount", "date", "gstin", "invoice_number", "tax_heads", "vendor_name")
_MATCHED = " + ".join(f'"{f}"::int' for f in _FIELDS)
_TYPE = f"case when outcome = 'auto_reconcile' then case when {_MATCHED} = 6 then 'exact' else 'fuzzy' end when outcome = 'classified_exception' then 'rule_classified' else 'none' end"
_SWEEP = f"""{_EVIDENCE}, grid as (select range * 0.5 as threshold, range as i from range(0, 201)
), points as (select threshold, i, count(*) filter (confidence >= threshold and "date") as tp, count(*) filter (confidence >= threshold and not "date") as fp,
    count(*) filter (confidence < threshold and not "date") as tn, count(*) filter (confidence < threshold and "date") as fn from grid, d group by 1, 2
), rated as (select *, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end + case when tn + fp = 0 then 0 else tn::double / (tn + fp) end - 1 as j from points)"""
_TOTALS = f"{_NORMAL}, totals as (select vendor_gstin, sum(i + c + s) as total from l group by 1)"
SQL: dict[str, str] = {
    "p2_found": f"with {_WHY} select origin, row_id, reason from why where reason is not null",
    "p2_loaded": f"with {_WHY} select origin, row_id, {', '.join(_EVERY)}, d as invoice_date_typed, {', '.join(f'{amount(c)} as {c}_typed' for c in _NUMERIC)} from why where reason is null",
    "validation_errors": f"with {_RAW} select source, record_id, err[1] as error_type, err[2] as field from judged where err is not null",
    "quarantine_by_error": f"with {_RAW} select source, err[1] as error_type, count(*) as n from judged where err is not null group by 1, 2",
    "all_errors": f"with {_RAW} select source, record_id, x.e as error_type, x.f as field from (select source, record_id, unnest({_ALL}) as x from judged)",
    "gstin_checks": f"with {_RAW} select g as vendor_gstin, {_valid_gstin('g')} as valid, case when regexp_full_match(g, '[0-9A-Z]{{14}}.') then {_digit('g')} end as digit from (select distinct {filled('vendor_gstin')} as g from both_raw) where g is not null",
    "normalized_ledger": f"with {_NORMAL} select source, record_id, invoice_id, vendor_gstin, vendor_name, invoice_date, taxable_value, cgst, sgst, igst from valid",
    "change_log": f"with {_LOGGED} " + " union all ".join(f"select source, record_id, '{f}' as field, raw_{f} as raw, {f} as normalized, '{rule}' as rule from logged where raw_{f} <> {f}" for f, (rule, _) in _CHANGED.items()),
    "messy_names": rf"with {_RAW} select distinct vendor_name from both_raw where {_blank('vendor_name')} <> '' and (regexp_matches({strip('vendor_name')}, '[^A-Za-z0-9 &.,''()\-/]') or regexp_matches(vendor_name, '[0-9][A-Za-z]|[A-Za-z][0-9]') or regexp_matches(vendor_name, '[A-Za-z][,;][A-Za-z]'))",
    "head_profiles": f"with {_NORMAL} select source, {_PROFILE.format(p='')} as profile, count(*) as n from num group by 1, 2",
    "sure_pairs": f"""with {_NORMAL}, {_PAIRS} select left_id, right_id, gstin::double as gstin, amount::double as amount, "date"::double as "date", invoice::double as invoice, (gstin + amount + "date" + invoice)::double as sure from p where gstin + amount + "date" + invoice >= 45""",
    "scored_pairs": f'with {_SCORED} select left_id, right_id, score, gstin::double as gstin, amount::double as amount, "date"::double as "date", invoice::double as invoice, name from scored',
    "assigned_pairs": f"with recursive {_ASSIGNED} select l.record_id as left_id, p.right_id, p.score from l left join pairs p on p.left_id = l.record_id",
    "unmatched_filings": f"with recursive {_ASSIGNED} select record_id, invoice_id from r where record_id not in (select right_id from pairs)",
    "in_earlier_snapshot": f"select record_id, coalesce(invoice_id, '') as invoice_id, coalesce(invoice_id, '') in (select invoice_id from gstr2b_prior_period where gstr2b_period = (select max(gstr2b_period) from gstr2b_prior_period where gstr2b_period < (select max(gstr2b_period) from gstr2b_prior_period)) and invoice_id <> '' and invoice_id is not null) as present from purchase_register",
    "evidence_fields": f"with recursive {_EVIDENCE} " + " union all ".join(f"select left_id, '{f}' as field, \"{f}\" as match from e" for f in _FIELDS),
    "evidence_deltas": f"with recursive {_EVIDENCE} select left_id, right_id, amount_delta::double as amount_delta, date_delta, tax_delta::double as tax_delta from e where found",
    "decisions": f"with recursive {_EVIDENCE} select left_id, confidence, outcome, rule_id from d",
    "outcome_counts": f"with recursive {_EVIDENCE} select o as outcome, count(d.outcome) as n from (values ('auto_reconcile'), ('classified_exception'), ('indeterminate')) v(o) left join d on d.outcome = o group by 1",
    "match_rates": f"with recursive {_EVIDENCE}, kinds as (select {_TYPE} as t from d), numbers as (select count(*) filter (t = 'exact') as exact, count(*) filter (t = 'fuzzy') as fuzzy, count(*) filter (t = 'rule_classified') as rule_classified, count(*) filter (t = 'none') as \"none\", count(*) as total from kinds) select *, exact + fuzzy + rule_classified as resolved, coalesce((exact + fuzzy + rule_classified)::double / nullif(total, 0), 0.0) as rate from numbers",
    "exceptions_by_category": f"with recursive {_EVIDENCE} select case rule_id when 'N1' then 'no_counterpart' when 'N2' then 'other_holder' else 'amount_differs' end as category, count(*) as n from d where outcome = 'classified_exception' group by 1",
    "confidence_summary": f"with recursive {_EVIDENCE} select outcome, count(*) as n, round(avg(confidence), 6) as mean, min(confidence) as least, max(confidence) as most from d group by rollup (outcome)",
    "confidence_histogram": f"with recursive {_EVIDENCE} select confidence, count(*) as n from d group by 1",
    "threshold_sweep": f"with recursive {_SWEEP} select threshold::double as threshold, tp, fp, tn, fn, round(j, 9) as youden_j from rated",
    "threshold_plateau": f"with recursive {_SWEEP}, top as (select *, i - row_number() over (order by i) as run from rated where abs(j - (select max(j) from rated)) < 1e-12), runs as (select run, min(threshold)::double as low, max(threshold)::double as high, count(*) as n from top group by 1) select low, high, (low + high) / 2 as threshold from runs order by n desc, low limit 1",
    "split_sizes": "select place_of_supply, split, n from (select coalesce(place_of_supply, '') as place_of_supply, round(0.7 * count(*))::bigint as a, count(*) as b from purchase_register group by 1) t, lateral (values ('calibration', a), ('frozen_test', b - a)) v(split, n) where n > 0",
    "supplier_totals": f"with {_TOTALS} select vendor_gstin, total::double as total, case when total > 75000 then 'breached' else 'within_threshold' end as status from totals",
    "supplier_exposure": f"with {_TOTALS} select sum(total)::double as total, coalesce(sum(total) filter (total > 75000), 0)::double as above_total, count(*) as groups, count(*) filter (total > 75000) as groups_above from totals",
    "review_queue": f"with recursive {_EVIDENCE} select row_number() over (order by case when found then 1 else 2 end, tax desc, left_id) as place, left_id, tax::double as at_risk from d where outcome <> 'auto_reconcile'",
    "decision_fields": f"with recursive {_EVIDENCE} select left_id as record_id, invoice_id, right_id as matched_record_id, outcome, array_to_string([x for x in [" + ", ".join(f"case when not \"{f}\" then '{f}' end" for f in _FIELDS) + "] if x is not null], '|') as differing_fields from d",
    "name_points": f"with recursive {_ASSIGNED}, n as (select p.left_id, l.vendor_name as a, r.vendor_name as b, {_WORDS.format(c='l.vendor_name')} as x, {_WORDS.format(c='r.vendor_name')} as y from pairs p join l on l.record_id = p.left_id join r on r.record_id = p.right_id) select left_id, round(case when a = '' or b = '' then (a = b)::int::double else {_ratio('a', 'b')} end, 9) as ratio, round(case when x = '' or y = '' then (x = y)::int::double else {_ratio('x', 'y')} end, 9) as sorted_ratio from n",
    "contributions": f"with recursive {_EVIDENCE} " + " union all ".join(f"select left_id, '{f}' as field, case when \"{f}\" then {w}::double else 0::double end as points from e" for f, w in (("gstin", 30), ("amount", 30), ("invoice_number", 20), ("date", 10), ("vendor_name", 5), ("tax_heads", 5))),
    "check_counts": f"with recursive {_EVIDENCE}, k as (select case when sum(tax) over (partition by lg) > 75000 then 'breached' else 'within_threshold' end as status from d) select 'sum' as check_id, status, count(*) as n from k group by 2",
    "check_flags": f"with recursive {_EVIDENCE} select left_id, case when sum(tax) over (partition by lg) > 75000 then 'breached' else 'within_threshold' end as status from d",
    "running_totals": f"with {_NORMAL} select record_id, (sum(i + c + s) over (partition by vendor_gstin order by record_id rows unbounded preceding))::double as so_far from l",
    "calibrated": f"with recursive {_SWEEP}, top as (select *, i - row_number() over (order by i) as run from rated where abs(j - (select max(j) from rated)) < 1e-12), runs as (select run, min(threshold)::double as low, max(threshold)::double as high, count(*) as n from top group by 1), best as (select low, high, (low + high) / 2 as t from runs order by n desc, low limit 1) select t as threshold, low, high, tp, fp, tn, fn from best, rated order by abs(threshold::double - t), threshold limit 1".replace("order by abs(threshold::double - t), threshold limit 1", "order by abs(rated.threshold::double - t), rated.threshold limit 1"),
    "stricter_decisions": f"with recursive {_EVIDENCE}, s as (select left_id, outcome as outcome_1, case when confidence >= 95 and gstin and amount and invoice_number then 'auto_reconcile' when rule_id is not null then 'classified_exception' else 'indeterminate' end as outcome_2 from d) select * from s where outcome_1 <> outcome_2",
    "pending_by_run": "select run_id, count(*) as n from (select run_id from quarantine_log qualify row_number() over (partition by record_id order by run_sequence desc, id desc) = 1) group by 1",
    "log_runs": "select run_id, count(*) as n, strftime(min(timestamp at time zone 'UTC'), '%Y-%m-%d %H:%M:%S') as first_timestamp from quarantine_log group by 1",
    "log_counts_by_error": "select run_id, coalesce(validation_error, '(none)') as validation_error, count(*) as n from quarantine_log group by 1, 2",
    "log_latest": "select record_id, run_id, run_sequence, id from quarantine_log qualify row_number() over (partition by record_id order by run_sequence desc, id desc) = 1",
}
