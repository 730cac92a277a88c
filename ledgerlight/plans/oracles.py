"""The registered queries in DuckDB's SQL, built up from common table expressions."""

from __future__ import annotations

from ..functions.text import HONORIFICS
from ..operators.ablation import CATALOGUE
from ..operators.anomaly import COLUMNS, PEER_FLOOR
from ..operators import memos
from ..operators.rulebook import NUMERIC, SQL_OPERATORS, TRUTHS, digest
from .build import RULES
from .corpus import AGENCY_FLOOR, AS_OF, SYNTHETIC_EVERY, rulebook

_RUPEES = "cast(round_even({0}, 0) as bigint)"

MEMBERS = f"""members as (
  select c_custkey as member, r_name as state, n_name as district, n_name || '/' || c_mktsegment as agency,
         {_RUPEES.format("greatest(c_acctbal, 0.0)")} as allocated_amt
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

WORKS = f"""{MEMBERS},
lines as (
  select l_orderkey, min(l_partkey) as part, max(cast(l_shipdate as date)) as last,
         sum({_RUPEES.format("l_extendedprice")}) filter (l_returnflag = 'A') as certified_amt
  from lineitem group by l_orderkey),
works as (
  select 'WS/MP' || member || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || '/' || o_orderkey as work_id,
         member, state, district, agency, year(o_orderdate) || '-' || (year(o_orderdate) + 1) as fy, p_name as description,
         o_orderkey as order_key, o_orderpriority as category,
         case o_orderstatus when 'F' then 'Work Completed' when 'P' then 'Work partially Completed' else 'Sanction' end as status,
         {_RUPEES.format("o_totalprice")} as sanctioned_amt, cast(o_orderdate as date) as sanction_date,
         lag(cast(o_orderdate as date)) over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey) as recommended_date,
         case when o_orderstatus = 'F' then last end as completion_date,
         case when o_orderstatus <> 'F' then 'not_applicable' when last is null then 'not_published' else 'published' end as completion_why,
         cast(certified_amt as bigint) as certified_amt,
         case when o_orderstatus = 'F' and o_orderpriority[1] <> '3' then o_orderpriority[1] <> '5' end as image,
         o_orderkey % {SYNTHETIC_EVERY} = 1 as is_synthetic
  from orders join members on o_custkey = member left join lines on l_orderkey = o_orderkey left join part on p_partkey = part),
payments as (
  select work_id, agency, l_suppkey as vendor_id, {_RUPEES.format("l_extendedprice")} as paid_amt, cast(l_shipdate as date) as payment_date
  from lineitem join works on l_orderkey = order_key)"""

EDGES = """edges as (select agency, vendor_id, cast(sum(paid_amt) as bigint) as vendor_paid from payments group by all),
shares as (select *, cast(sum(vendor_paid) over (partition by agency) as bigint) as agency_paid from edges)"""

FEATURES = f"""{WORKS}, {EDGES},
by_vendor as (select work_id, vendor_id, sum(paid_amt) as v, count(*) as n, min(payment_date) as lo, max(payment_date) as hi from payments group by all),
paid as (
  select work_id, cast(sum(v) as bigint) as paid_amt, cast(sum(n) as bigint) as n_payments, min(lo) as first_payment, max(hi) as last_payment,
         arg_max(vendor_id, (v, -vendor_id)) as top_vendor
  from by_vendor group by work_id),
spent as (select member, cast(sum(sanctioned_amt) as bigint) as account_sanctioned from works group by member),
keyed as (select *, nullif(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), '') as dkey from works),
texts as (select agency, dkey, count(*) as n, list_sort(list_distinct(string_split(dkey, ' '))) as words from keyed where dkey is not null and agency is not null group by agency, dkey),
word_pairs as (
  select a.agency, a.dkey, list_sort(list_intersect(a.words, b.words)) as shared, list_sort(list_filter(a.words, lambda w: not list_contains(b.words, w))) as mine,
         list_sort(list_filter(b.words, lambda w: not list_contains(a.words, w))) as theirs
  from texts a join texts b on a.agency = b.agency and a.dkey <> b.dkey where a.n = 1),
joined as (select *, array_to_string(shared, ' ') as s, array_to_string(list_concat(shared, mine), ' ') as p, array_to_string(list_concat(shared, theirs), ' ') as q from word_pairs),
matched as (
  select *, length(p) - bit_count(list_reduce(list_prepend((1::bigint << length(p)) - 1, list_transform(string_split(q, ''),
           lambda c: list_sum(list_transform(range(1, length(p) + 1), lambda i: case when p[i] = c then 1::bigint << (i - 1)::int else 0 end))::bigint)),
           lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::bigint << length(p)) - 1))) as lcs
  from joined),
best as (
  select agency, dkey, max(case when len(shared) > 0 and (len(mine) = 0 or len(theirs) = 0) then 100.0::double
           else greatest(200.0::double * lcs / (length(p) + length(q)), case when len(shared) > 0 then greatest(200.0::double * length(s) / (length(s) + length(p)), 200.0::double * length(s) / (length(s) + length(q))) else 0 end) end) / 100.0::double as best
  from matched group by agency, dkey),
same as (select agency, dkey, count(*) as same_count, sum(count(*)) over (partition by agency) as described from keyed where dkey is not null group by agency, dkey),
features as (
  select w.* exclude (dkey), w.dkey as dkey, p.paid_amt, p.first_payment, p.last_payment, same_count, described,
         (p.paid_amt - sanctioned_amt) / nullif(sanctioned_amt, 0) * 100.0 as variance_sanction_to_disbursement,
         case when sanctioned_amt = 0 then 'published_zero' when p.paid_amt is null then 'not_published' else 'published' end as variance_sanction_to_disbursement__why,
         case when p.paid_amt <> 0 then (certified_amt - p.paid_amt) / p.paid_amt * 100.0 end as variance_disbursement_to_certification,
         case when p.paid_amt is null then 'not_published' when p.paid_amt = 0 then 'published_zero' when certified_amt is null then 'not_published' else 'published' end as variance_disbursement_to_certification__why,
         sanction_date - recommended_date as sanction_lag_days,
         case when recommended_date is null then 'not_published' else 'published' end as sanction_lag_days__why,
         first_payment - sanction_date as sanction_to_first_payment_days,
         case when n_payments is null then 'not_applicable' else 'published' end as sanction_to_first_payment_days__why,
         completion_date - first_payment as first_payment_to_completion_days,
         case when n_payments is null then 'not_applicable' when completion_date is null then completion_why else 'published' end as first_payment_to_completion_days__why,
         completion_date - sanction_date as execution_days, completion_why as execution_days__why,
         date '{AS_OF}' - last_payment as days_since_last_payment,
         case when last_payment is null then 'not_published' else 'published' end as days_since_last_payment__why,
         case when agency_paid > {AGENCY_FLOOR} then vendor_paid / agency_paid * 100.0 end as vendor_share_in_agency_pct,
         case when agency_paid > {AGENCY_FLOOR} then 'published' when agency_paid <= {AGENCY_FLOOR} then 'not_applicable' else 'not_published' end as vendor_share_in_agency_pct__why,
         status = 'Work Completed' and n_payments is null as completed_without_payment, 'published' as completed_without_payment__why,
         not image as asset_image_absent, case when image is null then 'not_published' else 'published' end as asset_image_absent__why,
         case when allocated_amt <> 0 then coalesce(account_sanctioned, 0) / allocated_amt * 100.0 end as mp_utilisation_pct,
         case when allocated_amt = 0 then 'published_zero' else 'published' end as mp_utilisation_pct__why,
         case when w.dkey is not null and described > 1 then case when same_count > 1 then 1.0 else b.best end end as duplicate_similarity,
         case when w.dkey is null then 'not_published' when described > 1 then 'published' else 'not_applicable' end as duplicate_similarity__why,
         same_count as same_desc_same_agency_count, case when same_count is null then 'not_published' else 'published' end as same_desc_same_agency_count__why,
         coalesce(n_payments, 0) as payment_count
  from keyed w left join paid p using (work_id) left join shares s on s.agency = w.agency and s.vendor_id = top_vendor
       left join same c on c.agency = w.agency and c.dkey = w.dkey left join best b on b.agency = w.agency and b.dkey = w.dkey
       left join spent using (member) join (select member, allocated_amt from members) m using (member))"""


def _rule(r) -> str:
    threshold = str(r.threshold).lower() if isinstance(r.threshold, bool) else float(r.threshold)
    shown = f"cast({r.field} as varchar)" if r.field in TRUTHS else f"cast(cast({r.field} as double) as varchar)"
    return f"""select work_id, '{r.id}' as rule_id, {r.weight} as weight, {r.field}__why as why, {shown} as value,
      case when {r.field} is null then 'skipped' when {r.field} {SQL_OPERATORS[r.operator]} {threshold} then 'fired' else 'passed' end as status from features"""


_BOOK = rulebook()
TRACE = FEATURES + ",\ntrace as (" + "\n union all ".join(map(_rule, _BOOK.rules)) + ")"
CASES = f"""{TRACE},
base as (
  select work_id, cast(coalesce(sum(weight) filter (status = 'fired'), 0) as bigint) as subtotal,
         cast(round_even(({_BOOK.weight_total} - coalesce(sum(weight) filter (status = 'skipped'), 0)) / {_BOOK.weight_total}.0 * 100, 0) as bigint) as coverage_pct
  from trace group by work_id),
banded as (
  select f.*, subtotal, coverage_pct, 'NG-' || upper(substring(sha256(work_id), 1, 10)) as case_id,
         case when least(subtotal, 100) >= {_BOOK.high} then 'HIGH' when least(subtotal, 100) >= {_BOOK.medium} then 'MEDIUM' else 'LOW' end as base_severity
  from features f join base using (work_id)),
peered as (
  select *, count(*) filter (base_severity = 'HIGH') over (partition by agency, fy) - cast(base_severity = 'HIGH' as int) as peer_count from banded),
bonused as (select *, case when peer_count >= {_BOOK.bonus_least} then {_BOOK.bonus_weight} else 0 end as bonus from peered),
cases as (
  select *, subtotal + bonus as raw_score, least(subtotal + bonus, 100) as score,
         case when least(subtotal + bonus, 100) >= {_BOOK.high} then 'HIGH' when least(subtotal + bonus, 100) >= {_BOOK.medium} then 'MEDIUM' else 'LOW' end as severity
  from bonused)"""

_MEASURES = """count(*) as cases, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium,
  count(*) filter (severity = 'LOW') as low, count(*) filter (bonus > 0) as with_bonus, count(*) filter (paid_amt is null) as unpaid,
  cast(sum(sanctioned_amt) as bigint) as sanctioned, cast(sum(coalesce(paid_amt, 0)) as bigint) as paid,
  round(sum(coverage_pct) / count(*), 6) as mean_coverage, max(raw_score) as worst"""
_ORDER = "order by score desc, raw_score desc, coverage_pct desc, case_id"
_ITEM = "case_id, work_id, state, district, agency, score, raw_score, severity, coverage_pct"


def _rollup(keys: str, distinct: str) -> str:
    return f"with {CASES} select {keys}, {_MEASURES}, count(distinct {distinct}) as n_{distinct} from cases where not is_synthetic group by {keys}"


_HITS = f"with {CASES}, hits as (select c.case_id, t.* from trace t join cases c using (work_id))"
_ROLLED = f"with {CASES}, rolled as (select state, {_MEASURES} from cases where not is_synthetic group by state)"

_LINK = """links as (select distinct 'A' || agency as a, 'V' || vendor_id as b from edges)"""

_PREFIXES = "|".join(HONORIFICS)
_RAW = """raw as (
  select event_id, props, cast(ts as date) as d, user_id, event_type, value,
         case when event_id % 11 = 0 then ' ws/mp' || user_id || '/2024-2025 /' || event_id || '-x'
              when event_id % 13 = 0 then 'NA-' || event_type
              else 'WS/MP' || user_id || '/2024-2025/' || cast(event_id - event_id % 7 as varchar) end as work,
         case when event_id % 17 = 0 then '' when event_id % 19 = 0 then 'twelve' when event_id % 23 = 0 then '0'
              else cast(cast(floor(value * 100) as bigint) as varchar) || '.5' end as amount,
         case when event_id % 29 = 0 then 'N/A' when event_id % 31 = 0 then '31-31-2024' else strftime(ts, '%d-%b-%Y') end as on_text
  from events),
parsed as (
  select *, upper(regexp_replace(work, '\\s+', '', 'g')) as id,
         case when upper(trim(amount)) in ('', 'N/A', 'NA', '-', 'NULL', 'NONE', 'NAN') then null else cast(round_even(try_cast(amount as double), 0) as bigint) end as amt,
         case when on_text = 'N/A' then null else cast(try_strptime(on_text, '%d-%b-%Y') as date) end as on_date
  from raw),
idd as (select *, nullif(regexp_extract(id, '^(WS/MP(\\d+)/(\\d{4}-\\d{4})/(\\d+))', 1), '') as canon from parsed),
faults as (
  select *, case when canon is null then 'work_id_unparseable' when amt is null and amount <> '' then 'unparseable_amount'
                 when amt is null then 'null_required_field' when on_date is null and on_text <> 'N/A' then 'unparseable_date' end as fault
  from idd),
seen as (select *, min(event_id) filter (fault is null) over (partition by canon) as first_ok from faults),
judged as (
  select *, case when canon is null then 'work_id_unparseable' when first_ok < event_id then 'duplicate_work_id' else fault end as reason from seen)"""

_ATTRIBUTED = f"""{CASES}, fields as (
  select 'expenditure_linkage' as field, unnest(['utilisation_shortfall', 'stalled_work', 'vendor_concentration']) as rule_id, 'not_published' as reason
  union all select 'asset_image_publication_scope', 'asset_evidence_missing', 'not_published'),
attributed as (
  select field, t.rule_id, any_value(weight) as weight,
         count(*) filter (t.status = 'skipped' and why = reason and case field when 'expenditure_linkage' then payment_count = 0 else completion_date is null end) as skips,
         count(*) filter (t.status = 'fired') as fired, count(*) filter (t.status = 'passed') as passed
  from trace t join fields f using (rule_id) join cases c using (work_id) group by field, t.rule_id)"""

ORACLE_SQL = {
    "case_ranking_topn": f"with {CASES} select {_ITEM} from cases {_ORDER} limit 100",
    "feature_dictionary": f"""with {FEATURES} select work_id, round(variance_sanction_to_disbursement, 6) as variance_sanction_to_disbursement, variance_sanction_to_disbursement__why,
  round(variance_disbursement_to_certification, 6) as variance_disbursement_to_certification, variance_disbursement_to_certification__why,
  sanction_lag_days, sanction_lag_days__why, sanction_to_first_payment_days, sanction_to_first_payment_days__why,
  first_payment_to_completion_days, first_payment_to_completion_days__why, execution_days, execution_days__why,
  days_since_last_payment, days_since_last_payment__why, round(vendor_share_in_agency_pct, 6) as vendor_share_in_agency_pct, vendor_share_in_agency_pct__why,
  completed_without_payment, asset_image_absent, asset_image_absent__why, round(mp_utilisation_pct, 6) as mp_utilisation_pct, mp_utilisation_pct__why,
  duplicate_similarity, duplicate_similarity__why, same_desc_same_agency_count, payment_count from features""",
    "rule_trace_long": f"{_HITS} select case_id, rule_id, status, case when status = 'fired' then weight else 0 end as contribution, case when status = 'skipped' then why end as skip_reason from hits",
    "rule_firing_counts": f"with {TRACE} select rule_id, count(*) filter (status = 'fired') as fired, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'skipped') as skipped from trace group by rule_id",
    "coverage_by_severity": f"with {CASES} select severity, count(*) as cases, round(avg(coverage_pct), 6) as mean_coverage, min(coverage_pct) as least, max(coverage_pct) as most from cases group by severity",
    "corroboration_peers": f"with {CASES} select case_id, agency, fy, peer_count, bonus, score, severity from cases where peer_count > 0",
    "corroboration_evidence": f"""with {CASES}, high as (select agency, fy, work_id, case_id from cases where base_severity = 'HIGH')
  select c.case_id, any_value(c.peer_count) as peer_count, array_to_string(list(h.case_id order by h.work_id)[1:3], ',') as matched
  from cases c join high h on h.agency = c.agency and h.fy = c.fy and h.case_id <> c.case_id where c.bonus > 0 group by c.case_id""",
    "gap_hop_slowest_lag": f"""with {FEATURES} select work_id,
  case when variance_sanction_to_disbursement < -60 then 'sanction_to_disbursement' when variance_disbursement_to_certification < -60 then 'disbursement_to_certification' end as gap_hop,
  case greatest(sanction_lag_days, sanction_to_first_payment_days, first_payment_to_completion_days) when sanction_lag_days then 'recommend_to_sanction'
       when sanction_to_first_payment_days then 'sanction_to_first_payment' when first_payment_to_completion_days then 'first_payment_to_completion' end as slowest_lag from features""",
    "fund_accounts_two_grain": f"""with {FEATURES}, sums as (
  select member, fy, sum(sanctioned_amt) as s, sum(coalesce(paid_amt, 0)) as p, count(*) as works from features group by member, fy
  union all select member, 'term_to_date', sum(sanctioned_amt), sum(coalesce(paid_amt, 0)), count(*) from features group by member)
  select member, fy, cast(s as bigint) as sanctioned, cast(p as bigint) as paid, works, case when fy = 'term_to_date' then allocated_amt end as allocated,
         round(s / nullif(case when fy = 'term_to_date' then allocated_amt end, 0) * 100.0, 6) as utilisation_pct
  from sums join members using (member)""",
    "rollup_state": _rollup("state", "district"),
    "rollup_district": _rollup("state, district", "agency"),
    "rollup_agency": _rollup("state, district, agency", "member"),
    "rollup_member": _rollup("member", "district"),
    "rollup_retotal": f"""{_ROLLED} select cast(sum(cases) as bigint) as cases, cast(sum(high) as bigint) as high, cast(sum(medium) as bigint) as medium, cast(sum(low) as bigint) as low,
  cast(sum(sanctioned) as bigint) as sanctioned, cast(sum(paid) as bigint) as paid, round(sum(mean_coverage * cases) / sum(cases), 4) as mean_coverage, max(worst) as worst from rolled""",
    "national_top_states": f"{_ROLLED} select state, cases, high, sanctioned from rolled order by high desc, sanctioned desc, state limit 10",
    "district_queue": f"with {CASES} select {_ITEM} from cases where state = 'EUROPE' and district = 'NATION_13' {_ORDER} limit 25",
    "member_worst_cases": f"with {CASES} select {_ITEM} from cases where member = 7 {_ORDER} limit 5",
    "member_utilisation_percentile": f"""with {FEATURES}, u as (select distinct member, account_sanctioned / nullif(m.allocated_amt, 0) * 100.0 as pct from spent join members m using (member))
  select member, round(pct, 6) as utilisation_pct, round(cume_dist() over (order by pct) * 100, 1) as percentile from u where pct is not null""",
    "case_search_paged": f"""with {CASES} select {_ITEM} from cases where severity <> 'LOW' and not is_synthetic and (contains(lower(work_id), 'plate') or contains(lower(case_id), 'plate') or contains(lower(state), 'plate')
  or contains(lower(district), 'plate') or contains(lower(agency), 'plate') or contains(lower(description), 'plate') or contains(lower(agency), 'building')) {_ORDER} limit 20 offset 10""",
    "scoped_state": f"with {CASES} select severity, count(*) as cases from cases where state = 'EUROPE' group by severity",
    "scoped_district": f"with {CASES} select severity, count(*) as cases from cases where state = 'EUROPE' and district = 'NATION_13' group by severity",
    "scoped_member": f"with {CASES} select {_ITEM} from cases where member = 1",
    "ambiguous_names": "select c_mktsegment as district, count(distinct n_name) as states from customer join nation on c_nationkey = n_nationkey group by 1 having count(distinct n_name) > 1",
    "exact_clusters": f"""with {FEATURES} select 'DC-' || upper(substring(sha256(agency || chr(31) || dkey), 1, 8)) as cluster_id, agency, dkey as description_key, count(*) as works,
  min(work_id) as first_work from features where dkey is not null group by agency, dkey having count(*) >= 2""",
    "cluster_stats_topk": f"""with {FEATURES}, c as (select agency, dkey, count(*) as works from features where dkey is not null group by agency, dkey)
  select agency, dkey as description_key, works from c where works >= 3 order by works desc, agency, dkey limit 20""",
    "vendor_share": f"with {WORKS}, {EDGES} select agency, vendor_id, vendor_paid, agency_paid, round(vendor_paid / agency_paid * 100.0, 6) as share_pct from shares",
    "vendor_span": f"with {WORKS}, {EDGES} select vendor_id, count(*) as agency_span from edges group by vendor_id",
    "agency_hhi": f"""with {WORKS}, {EDGES}, degree as (select vendor_id, count(*) as span from edges group by vendor_id)
  select agency, count(*) as vendors, round(sum((vendor_paid / agency_paid) ** 2), 9) as hhi, round(max(vendor_paid / agency_paid), 9) as top_share,
         round(sum(vendor_paid) filter (span > 1) / any_value(agency_paid), 9) as shared_exposure
  from shares join degree using (vendor_id) group by agency""",
    "concentrated_pairs": f"with {WORKS}, {EDGES} select agency, vendor_id, vendor_paid from shares where vendor_paid / agency_paid * 100.0 > 2.5 and agency_paid > 5000000",
    "graph_components": f"""with recursive {WORKS}, {EDGES}, big as (select agency, vendor_id from shares where vendor_paid / agency_paid * 100.0 > 2.0),
  both_ways as (select 'A' || agency as a, 'V' || vendor_id as b from big union select 'V' || vendor_id, 'A' || agency from big),
  reach as (select a as node, a as root from both_ways union select b.b, r.root from reach r join both_ways b on b.a = r.node)
  select node, min(root) as root from reach group by node""",
    "ingest_rejects": f"with {_RAW} select event_id as row_number, canon as work_id, reason from judged where reason is not null",
    "ingest_reconcile": f"with {_RAW} select event_type as file, count(*) as read, count(*) filter (reason is null) as loaded, count(*) filter (reason is not null) as rejected from judged group by event_type",
    "rejects_by_reason": f"with {_RAW} select reason, count(*) as rows from judged where reason is not null group by reason",
    "parsed_amounts_dates": f"with {_RAW} select event_id, canon as work_id, amt as amount, case when amt is null then 'not_published' when amt = 0 then 'published_zero' else 'published' end as amount__why, on_date from idd",
    "duplicate_ids": f"with {_RAW} select canon as work_id, count(*) as rows from judged where reason = 'duplicate_work_id' group by canon",
    "join_yields": """select count(distinct o_orderkey) as works, count(distinct l_orderkey) as paid_works,
  (select count(*) from (select o_orderkey from orders intersect select l_orderkey from lineitem)) as joined from orders left join lineitem on l_orderkey = o_orderkey""",
    "vocabulary_drift": "select event_type as value, count(*) as rows from events where event_type not in ('click', 'view') group by event_type",
    "first_source_merge": """with src as (
    select event_id % 500 as id, 1 as precedence, event_id, case when event_id % 3 = 0 then event_type end as status, case when event_id % 4 = 0 then value end as amount from events where event_type = 'click'
    union all select event_id % 500, 2, event_id, event_type, case when event_id % 2 = 0 then value end from events where event_type <> 'click')
  select id, first(status order by precedence, event_id) filter (status is not null) as status, round(first(amount order by precedence, event_id) filter (amount is not null), 6) as amount from src group by id""",
    "majority_vote": """with n as (select user_id, event_type, count(*) as c, min(event_id) as f from events group by all)
  select user_id, arg_max(event_type, (c, -f)) as winner, cast(max(c) as bigint) as votes from n group by user_id""",
    "clean_text_keys": r"""select doc_id, nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '') as description_key from documents""",
    "member_names": f"""with raw as (select c_custkey as member, 'Dr. Shri ' || c_name || ' (2022-28) (2022-2028)' as name from customer),
  bare as (select member, trim(regexp_replace(name, '\\s*\\(\\s*(\\d{{4}}\\s*-\\s*\\d{{2,4}})\\s*\\)', '', 'g')) as name from raw)
  select member, upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '^((?:{_PREFIXES})\\.?\\s+)+', '', 'i'), '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g'))) as name,
         2022 as term_start, 2028 as term_end from bare""",
    "case_ids": f"with {WORKS} select work_id, 'NG-' || upper(substring(sha256(work_id), 1, 10)) as case_id, regexp_extract(work_id, 'MP(\\d+)/', 1) as mp_code, fy, cast(fy[1:4] as int) as fy_start from works",
    "alerts_new": f"""with {CASES} select case_id, 'high_severity' as kind, state, district, score from cases where severity = 'HIGH' and not is_synthetic and order_key % 5 <> 0""",
    "alerts_loudest_rule": f"{_HITS} select case_id, arg_min(rule_id, (-weight, rule_id)) as rule_id, cast(max(weight) as bigint) as contribution from hits where status = 'fired' group by case_id",
    "alerts_inbox_order": f"""with {CASES}, a as (select case_id, score, ['open', 'acknowledged', 'escalated', 'closed'][(order_key % 4 + 1)::int] as status from cases where severity = 'HIGH')
  select case_id, status, score from a order by list_position(['open', 'acknowledged', 'escalated', 'closed'], status), score desc, case_id limit 50""",
    "alerts_orphans": f"with {CASES} select case_id from cases where severity = 'HIGH' and order_key % 9 = 0",
    "ablation_attribution": f"""with {_ATTRIBUTED} select field, rule_id, skips, fired, passed, skips * weight as unrealised_weight,
  round(fired / nullif(fired + passed, 0), 9) as firing_rate, cast(round_even(fired / nullif(fired + passed, 0) * skips, 0) as bigint) as extrapolated_fires from attributed""",
    "ablation_rank": f"""with {_ATTRIBUTED}, names as (select unnest([{", ".join(f"'{f.key}'" for f in CATALOGUE)}]) as field),
  sums as (select n.field, coalesce(cast(sum(skips * weight) as bigint), 0) as criterion from names n left join attributed a using (field) group by n.field)
  select field, criterion, case when criterion > 0 and count(*) over (partition by criterion) = 1 then 1 + (select count(distinct s2.criterion) from sums s2 where s2.criterion > sums.criterion) end as position from sums""",
    "trace_diff": f"""{_HITS}, other as (select *, case when value is null then 'skipped' when rule_id = 'stalled_work' and cast(value as double) > 400 then 'fired' when rule_id = 'stalled_work' then 'passed' else status end as now from hits)
  select case_id, rule_id, 'status' as field, status as before, now as after from other where status <> now""",
    "forecast_populations": f"""with {FEATURES} select case when completion_date is not null then 'completed' when date '{AS_OF}' - sanction_date > 1000 then 'past_horizon' else 'open' end as population,
  count(*) as works, cast(sum(sanctioned_amt) as bigint) as sanctioned from features group by 1""",
    "risk_percentile": f"""with {FEATURES} select work_id, round((row_number() over (partition by fy order by sanctioned_amt, work_id) - 1) / nullif(count(*) over (partition by fy) - 1, 0) * 100.0, 6) as percentile from features""",
    "peer_groups": f"""with {WORKS}, n as (select category, state, fy, count(*) as size from works group by all) select category, state, fy, size, size >= 5 as comparable from n""",
    "busiest_scopes": f"""with {CASES}, s as (select 'state' as scope, state as name, count(*) as cases, count(*) filter (severity = 'HIGH') as high from cases group by state
  union all select 'district', district, count(*), count(*) filter (severity = 'HIGH') from cases group by district
  union all select 'agency', agency, count(*), count(*) filter (severity = 'HIGH') from cases group by agency)
  select scope, name, cases, high from s qualify row_number() over (partition by scope order by high desc, cases desc, name) = 1""",
    "audit_openings": f"""{_HITS} select case_id, 'CASE_OPENED' as event, cast(null as varchar) as rule_id from cases
  union all select case_id, 'RULE_FIRED', rule_id from hits where status = 'fired'
  union all select case_id, 'DUPLICATE_LINKED', cast(null as varchar) from hits where status = 'fired' and rule_id = 'duplicate_work'
  union all select case_id, 'PATTERN_LINKED', cast(null as varchar) from cases where bonus > 0""",
    "corpus_measures": f"""with {CASES} select count(*) as cases, count(distinct agency) as agencies, count(distinct member) as members, cast(sum(sanctioned_amt) as bigint) as sanctioned,
  count(*) filter (bonus > 0) as with_bonus, count(*) filter (severity = 'HIGH') as high, count(*) filter (payment_count = 0) as unpaid, round(avg(coverage_pct), 6) as mean_coverage from cases""",
}

_ITEMS = "unnest(['works', 'cases', 'hits', 'shares', 'notes'])"
_VERSION = f"'{_BOOK.version}' as version, '{digest(RULES.read_text(encoding='utf-8'))}' as yaml_sha256, {_BOOK.weight_total} as weight_total, {len(_BOOK.rules)} as n_rules"
_FIRED = f"""{CASES}, fired as (
  select work_id, string_agg(rule_id, ',' order by rule_id) filter (status = 'fired') as fired, string_agg(rule_id, ',' order by rule_id) filter (status = 'skipped') as skipped,
         count(*) filter (status = 'fired') as n from trace group by work_id)"""
_HOP = "case when {0} is null then 'unavailable' when {0} < -60 then 'open' else 'closed' end"
_SHOWN = "coalesce(cast({0} as varchar), '-')"
#: The log's rows of member 7, and their hashes: SHA-256 of JSON with sorted keys, the hash before it last.
_LOG = f"""with recursive {CASES}, mine as (select case_id, work_id, bonus, score, member, severity from cases),
  fires as (select m.case_id, m.score, t.rule_id, list_position([{", ".join(f"'{r.id}'" for r in _BOOK.rules)}], t.rule_id) as pos from mine m join trace t using (work_id) where status = 'fired'),
  events as (
    select case_id, score, 0 as k, 0 as pos, 'CASE_OPENED' as event, cast(null as varchar) as rule_id from mine
    union all select case_id, score, 1, pos, 'RULE_FIRED', rule_id from fires
    union all select case_id, score, 2, 0, 'DUPLICATE_LINKED', null from fires where rule_id = 'duplicate_work'
    union all select case_id, score, 3, 0, 'PATTERN_LINKED', null from mine where bonus > 0),
  numbered as (select *, row_number() over (partition by case_id order by k, pos) - 1 as id from events),
  bodies as (
    select case_id, id, event, '{{"actor":"system","actor_id":null,"actor_role":"system","at":"{AS_OF}T00:00:00","case_id":"' || case_id || '","event":"' || event || '","payload_json":"{{\\"rule_id\\":'
           || coalesce('\\"' || rule_id || '\\"', 'null') || ',\\"score\\":' || score || '}}","prev_hash":"' as body
    from numbered),
  log as (
    select case_id, id, event, repeat('0', 64) as prev_hash, sha256(body || repeat('0', 64) || '"}}') as row_hash from bodies where id = 0
    union all select b.case_id, b.id, b.event, l.row_hash, sha256(b.body || l.row_hash || '"}}') from log l join bodies b on b.case_id = l.case_id and b.id = l.id + 1)"""
_NOTE = '{{"actor":"officer","actor_id":"7","actor_role":"state","at":"2002-01-0{0}T00:00:00","case_id":"\' || case_id || \'","event":"NOTE_ADDED","payload_json":"{{\\"text\\":\\"{1}\\"}}","prev_hash":"'
#: The log with two batches of notes behind the opening events.
_APPENDED = _LOG.replace("  log as (", f"""  longest as (select case_id, max(id) as last from bodies group by case_id),
  noted as (
    select case_id, 1 as batch, '{_NOTE.format(1, "seen")}' as body from mine where severity = 'HIGH'
    union all select case_id, 2, '{_NOTE.format(2, "asked the office")}' from mine where member % 5 = 0),
  opened as (select * from bodies),
  whole as (
    select * from opened union all
    select case_id, last + row_number() over (partition by case_id order by batch), 'NOTE_ADDED', body from noted join longest using (case_id)),
  log as (""").replace("from bodies where id = 0", "from whole where id = 0").replace("join bodies b", "join whole b")
_PAID_RAW = f"""{_RAW}, dirty as (
  select *, case when event_id % 1999 = 1998 then true else false end as footer, event_id % 37 = 0 as no_state, event_id % 41 = 0 as no_status, event_id % 43 = 0 as no_member from idd),
checked as (
  select *, case when footer then 'grand_total_row' when canon is null then 'work_id_unparseable' when no_state or no_status then 'null_required_field' when amt is null and amount <> '' then 'unparseable_amount'
                 when on_date is null and on_text <> 'N/A' then 'unparseable_date' when no_member then 'null_required_field' end as why,
            case when footer then 'grand_total_row' when no_state then 'null_required_field' when amt is null and amount <> '' then 'unparseable_amount' when no_member then 'null_required_field'
                 when event_id % 97 >= 90 then 'unresolved_reference' end as allocation_why
  from dirty)"""
_RECOVERED = f"""{_ATTRIBUTED}, lost as (select work_id, sum(weight) filter (status = 'skipped') as w from trace group by work_id),
got as (
  select f.field, t.work_id, sum(t.weight) as w from trace t join fields f using (rule_id) join cases c using (work_id)
  where t.status = 'skipped' and why = reason and case field when 'expenditure_linkage' then payment_count = 0 else completion_date is null end group by all),
names as (select unnest([{", ".join(f"'{f.key}'" for f in CATALOGUE)}]) as field),
measured as (
  select n.field, count(g.work_id) as works_affected, cast(coalesce(sum(g.w), 0) as bigint) as unrealised_weight, avg(c.coverage_pct) as now,
         avg(round_even(({_BOOK.weight_total} - coalesce(l.w, 0) + coalesce(g.w, 0)) / {_BOOK.weight_total}.0 * 100, 0)) as later
  from names n cross join cases c left join lost l using (work_id) left join got g on g.field = n.field and g.work_id = c.work_id group by n.field)"""
_TEXT_PEERS = """all_pairs as (
  select a.agency, a.dkey, b.dkey as other, list_sort(list_intersect(a.words, b.words)) as shared, list_sort(list_filter(a.words, lambda w: not list_contains(b.words, w))) as mine,
         list_sort(list_filter(b.words, lambda w: not list_contains(a.words, w))) as theirs
  from texts a join texts b on a.agency = b.agency),
spelled as (select *, array_to_string(shared, ' ') as s, array_to_string(list_concat(shared, mine), ' ') as p, array_to_string(list_concat(shared, theirs), ' ') as q from all_pairs),
common as (
  select *, length(p) - bit_count(list_reduce(list_prepend((1::bigint << length(p)) - 1, list_transform(string_split(q, ''),
           lambda c: list_sum(list_transform(range(1, length(p) + 1), lambda i: case when p[i] = c then 1::bigint << (i - 1)::int else 0 end))::bigint)),
           lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::bigint << length(p)) - 1))) as lcs
  from spelled),
ratios as (
  select agency, dkey, other, case when dkey = other or len(shared) > 0 and (len(mine) = 0 or len(theirs) = 0) then 100.0::double
           else greatest(200.0::double * lcs / (length(p) + length(q)), case when len(shared) > 0 then greatest(200.0::double * length(s) / (length(s) + length(p)), 200.0::double * length(s) / (length(s) + length(q))) else 0 end) end / 100.0::double as ratio
  from common),
peers as (
  select a.work_id, b.work_id as peer, ratio as score, row_number() over (partition by a.work_id order by ratio desc, b.work_id) as rank
  from features a join ratios r on r.agency = a.agency and r.dkey = a.dkey join features b on b.agency = r.agency and b.dkey = r.other and b.work_id <> a.work_id
  qualify rank <= 8)"""

ORACLE_SQL |= {
    "ladders": f"""with {FEATURES} select work_id,
  {_SHOWN.format("sanctioned_amt")} || ',' || {_SHOWN.format("paid_amt")} || ',' || {_SHOWN.format("certified_amt")} as amounts,
  'start,' || {_HOP.format("variance_sanction_to_disbursement")} || ',' || {_HOP.format("variance_disbursement_to_certification")} as states,
  '-,' || variance_sanction_to_disbursement__why || ',' || variance_disbursement_to_certification__why as hop_reasons,
  {_SHOWN.format("recommended_date")} || ',' || {_SHOWN.format("sanction_date")} || ',' || {_SHOWN.format("first_payment")} || ',' || {_SHOWN.format("completion_date")} as dates,
  '-,' || {_SHOWN.format("sanction_lag_days")} || ',' || {_SHOWN.format("sanction_to_first_payment_days")} || ',' || {_SHOWN.format("first_payment_to_completion_days")} as lags,
  '-,' || sanction_lag_days__why || ',' || sanction_to_first_payment_days__why || ',' || first_payment_to_completion_days__why as lag_reasons,
  concat_ws(',', case when execution_days__why <> 'published' then 'execution_days:' || execution_days__why end, case when sanction_lag_days__why <> 'published' then 'sanction_lag_days:' || sanction_lag_days__why end,
            case when asset_image_absent__why <> 'published' then 'asset_image_absent:' || asset_image_absent__why end) as unavailable from features""",
    "graph_findings": f"""with {WORKS}, {EDGES}, h as (select agency, sum((vendor_paid / agency_paid) ** 2) as hhi from shares group by agency)
  select work_id, round(hhi, 9) as hhi, case when hhi is null then 'not_applicable' else 'published' end as hhi__why from works left join h using (agency)""",
    "reject_ledger": f"""with {_RAW} select event_type as file, event_id as row_number, reason, '{{"work":' || to_json(work) || ',"amount":' || to_json(amount) || ',"on_text":' || to_json(on_text) || '}}' as raw_row from judged where reason is not null""",
    "similar_works_topk": f"with {FEATURES}, {_TEXT_PEERS} select work_id, peer, score, rank from peers",
    "recommended_amounts": f"""with {WORKS} select work_id, sanctioned_amt, case when order_key % 3 <> 0 then sanctioned_amt + order_key % 1000 end as recommended_amt,
  case when order_key % 3 <> 0 then 'published' else 'not_published' end as recommended_amt__why from works""",
    "payments_of_works": f"""with {WORKS} select work_id, cast(l_shipdate as date) as payment_date, l_suppkey as vendor_id, s_name as vendor_name, {_RUPEES.format("l_extendedprice")} as paid_amt, l_linenumber as line
  from lineitem join works on l_orderkey = order_key left join supplier on s_suppkey = l_suppkey where member = 7""",
    "case_version": f"with {WORKS} select min('NG-' || upper(substring(sha256(work_id), 1, 10))) as case_id, {_VERSION} from works where member = 7 having count(*) > 0",
    "case_sheets": f"""with {_FIRED} select case_id, work_id, score, severity, coalesce(fired, '') as fired, coalesce(skipped, '') as skipped,
  'start,' || {_HOP.replace("-60", "-15").format("variance_sanction_to_disbursement")} || ',' || {_HOP.replace("-60", "-15").format("variance_disbursement_to_certification")} as fund, bonus > 0 as applied, bonus as contribution
  from cases join fired using (work_id) where member = 7""",
    "scope_reach": f"""with {CASES} select 'ministry' as role, cast(null as varchar) as state, cast(null as varchar) as district, cast(null as bigint) as member, count(*) as cases, count(*) filter (severity = 'HIGH') as high from cases
  union all select 'state', 'EUROPE', null, null, count(*), count(*) filter (severity = 'HIGH') from cases where state = 'EUROPE'
  union all select 'district', 'EUROPE', 'NATION_13', null, count(*), count(*) filter (severity = 'HIGH') from cases where state = 'EUROPE' and district = 'NATION_13'
  union all select 'member', null, null, 7, count(*), count(*) filter (severity = 'HIGH') from cases where member = 7""",
    "health_counts": f"""with {WORKS}, {EDGES}, n as (
    select 'works' as name, count(*) as rows from works union all select 'cases', count(*) from works union all select 'hits', count(*) * {len(_BOOK.rules)} from works
    union all select 'shares', count(*) from shares union all select 'notes', 0)
  select name, rows, case when rows > 0 then 'ok' else 'empty' end as status from n""",
    "status_tally": f"""with {CASES}, s as (select ['open', 'acknowledged', 'escalated'][(order_key % 3 + 1)::int] as status from cases where severity = 'HIGH')
  select k.status, count(s.status) as rows from (select unnest(['open', 'acknowledged', 'escalated', 'closed']) as status) k left join s using (status) group by k.status""",
    "agency_shares_of_district": f"""with {CASES}, r as (select state, district, agency, cast(sum(sanctioned_amt) as bigint) as v from cases where not is_synthetic group by all)
  select state, district, agency, round(v / sum(v) over (partition by state, district) * 100.0, 6) as share_pct, round(v / max(v) over (partition by state, district), 6) as scale from r""",
    "districts_ranked": f"""with {CASES}, r as (select state, district, {_MEASURES} from cases where not is_synthetic group by all)
  select row_number() over (order by high desc, sanctioned desc, state, district) as place, state, district, cases, high, sanctioned from r""",
    "agencies_ranked": f"""with {CASES}, r as (select state, district, agency, {_MEASURES} from cases where not is_synthetic group by all)
  select row_number() over (order by high desc, sanctioned desc, state, district, agency) as place, state, district, agency, cases, high, sanctioned from r""",
    "district_preview": f"with {CASES} select state, district, count(*) as cases, count(*) filter (severity = 'HIGH') as high from cases where not is_synthetic group by all order by high desc, cases desc, state, district limit 6",
    "vendor_first_names": """with n as (
    select l_suppkey as vendor_id, l_orderkey, l_linenumber, case (l_orderkey + l_linenumber) % 3 when 0 then upper(s_name) when 1 then 'M/s ' || s_name else s_name end as vendor_name from lineitem join supplier on l_suppkey = s_suppkey)
  select vendor_id, arg_min(vendor_name, (l_orderkey, l_linenumber, vendor_name)) as vendor_name from n group by vendor_id""",
    "agency_best_variants": """select c_mktsegment as agency, arg_max(c_name, (round(c_acctbal, 0), -c_custkey)) as raw, max(round(c_acctbal, 0)) as match from customer group by 1""",
    "synthetic_control": f"""with {WORKS}, w as (select is_synthetic, count(*) as rows from works group by 1)
  select 'synthetic ' || is_synthetic as kind, rows + case when is_synthetic then 1 else 0 end as rows from w union all select 'case_id_collision', 1""",
    "duplicate_evidence": f"""{_HITS}, {_TEXT_PEERS} select h.case_id, string_agg(peer, ',' order by rank) as cited, round(max(p.score), 6) as best
  from hits h join peers p on p.work_id = h.work_id and p.rank <= 2 where h.rule_id = 'duplicate_work' and h.status = 'fired' group by h.case_id""",
    "badges_attached": f"""with {CASES}, h as (select agency, sum((vendor_paid / agency_paid) ** 2) as hhi from shares group by agency)
  select case_id, c.score, severity, round(hhi, 6) as graph_value, case when hhi is null then 'not_applicable' else 'published' end as graph_why,
         case when same_count >= 2 then 'DC-' || upper(substring(sha256(agency || chr(31) || dkey), 1, 8)) end as cluster_cluster_id, case when same_count >= 2 then same_count end as cluster_works,
         case when same_count >= 2 then 'published' else 'not_applicable' end as cluster_works__why from cases c left join h using (agency)""",
    "fired_counts": f"with {_FIRED} select work_id, n + case when bonus > 0 then 1 else 0 end as n_fired from cases join fired using (work_id)",
    "ablation_measures": f"with {_RECOVERED} select field, works_affected, unrealised_weight, round(now, 6) as coverage_now, round(later, 6) as coverage_if_published, round(later - now, 6) as uplift from measured",
    "ablation_order": f"""with {_RECOVERED}, placed as (
    select field, unrealised_weight as criterion, case when unrealised_weight > 0 and count(*) over (partition by unrealised_weight) = 1 then dense_rank() over (order by unrealised_weight desc) end as position from measured)
  select field, criterion, position, row_number() over (order by position asc nulls last, criterion desc, field) as place from placed""",
    "band_histogram": f"with {CASES} select severity, count(*) as cases from cases group by severity",
    "recompute_diff": f"""with {CASES}, late as (select work_id, weight, case when days_since_last_payment > 400 then 1 else 0 end - case when trace.status = 'fired' then 1 else 0 end as step from trace join features f using (work_id) where rule_id = 'stalled_work' and f.days_since_last_payment is not null),
  again as (select case_id, c.score, c.raw_score, c.severity, c.raw_score + step * weight as raw2 from cases c join late using (work_id) where step <> 0),
  full2 as (select *, least(raw2, 100) as score2, case when least(raw2, 100) >= {_BOOK.high} then 'HIGH' when least(raw2, 100) >= {_BOOK.medium} then 'MEDIUM' else 'LOW' end as severity2 from again)
  select case_id, 'raw_score' as field, cast(raw_score as varchar) as before, cast(raw2 as varchar) as after from full2
  union all select case_id, 'score', cast(score as varchar), cast(score2 as varchar) from full2 where score <> score2
  union all select case_id, 'severity', severity, severity2 from full2 where severity <> severity2""",
    "alerts_folded": """with recursive e as (
    select cast(user_id as varchar) as case_id, (['raise', 'acknowledge', 'raise', 'escalate', 'acknowledge', 'close', 'raise'])[event_id % 7 + 1] as action, row_number() over (partition by user_id order by event_id) as k from events),
  moves as (select * from (values ('none', 'raise', 'open'), ('open', 'raise', 'open'), ('open', 'acknowledge', 'acknowledged'), ('acknowledged', 'acknowledge', 'acknowledged'), ('open', 'escalate', 'escalated'),
    ('acknowledged', 'escalate', 'escalated'), ('escalated', 'escalate', 'escalated'), ('acknowledged', 'close', 'closed'), ('escalated', 'close', 'closed'), ('closed', 'close', 'closed')) m(f, a, t)),
  folded as (
    select distinct case_id, 0::bigint as k, 'none' as status, cast(null as varchar) as refused from e
    union all select e.case_id, e.k, coalesce(m.t, f.status), case when m.t is null then f.status || ':' || e.action end
    from folded f join e on e.case_id = f.case_id and e.k = f.k + 1 left join moves m on m.f = f.status and m.a = e.action),
  last as (select case_id, arg_max(status, k) as status, count(refused) as refused from folded group by case_id),
  named as (select case_id, string_agg(refused || '=' || n, ',' order by refused || '=' || n) as said from (select case_id, refused, count(*) as n from folded where refused is not null group by all) group by case_id)
  select case_id, 'high_severity' as kind, status, refused, coalesce(said, '') as refused_moves from last left join named using (case_id)""",
    "audit_chain_verify": "select cast(user_id as varchar) as case_id, min(event_id) as first_broken from events where event_id % 1999 = 5 group by user_id",
    "audit_log_hashes": f"{_LOG} select case_id, id, event, prev_hash, row_hash from log",
    "audit_trail": f"{_LOG} select case_id, id, event, id <> 2 as sound from log where case_id in (select case_id from mine where member = 7 order by case_id limit 5)",
    "audit_log_appended": f"{_APPENDED} select case_id, id, event, prev_hash, row_hash from log",
    "recompute_snapshots": f"""with {CASES}, pointed as (select *, 'v0.' || (member % 3) || '.0' as version from cases),
  asked as (
    select p.case_id, p.version, p.raw_score, p.coverage_pct, p.severity, t.rule_id, t.weight, t.status,
           case when t.status = 'skipped' then 'skipped' when t.rule_id = 'stalled_work' and f.days_since_last_payment > 400 or t.rule_id = 'execution_delay' and f.execution_days > 500 then 'fired' else 'passed' end as status2
    from pointed p join trace t using (work_id) join features f using (work_id) where t.rule_id = 'stalled_work' and p.member % 3 = 1 or t.rule_id = 'execution_delay' and p.member % 3 = 2),
  moved as (
    select case_id, raw_score + case when status = status2 then 0 when status2 = 'fired' then weight else -weight end as raw2,
           case when status = status2 then rule_id || '.threshold' else rule_id || '.threshold,' || rule_id || '.contribution,' || rule_id || '.status' end as said from asked)
  select p.case_id, p.version as rulebook_version, least(coalesce(raw2, raw_score), 100) as score,
         case when least(coalesce(raw2, raw_score), 100) >= {_BOOK.high} then 'HIGH' when least(coalesce(raw2, raw_score), 100) >= {_BOOK.medium} then 'MEDIUM' else 'LOW' end as severity,
         coverage_pct, said is null as identical, coalesce(said, '') as moved
  from pointed p left join moved m using (case_id)""",
    "expenditure_rejects": f"with {_PAID_RAW} select event_id, why as reason from checked where why is not null",
    "allocation_rejects": f"with {_PAID_RAW} select allocation_why as reason, count(*) as rows from checked where allocation_why is not null group by 1",
    "csv_ingest": f"""with {_PAID_RAW} select case event_id % 2 when 0 then 'lok_sabha' else 'rajya_sabha' end as file, count(*) as read, count(*) filter (why is null) as loaded, count(*) filter (why = 'null_required_field') as blank,
  count(*) filter (why = 'grand_total_row') as footers, count(*) as last_row, 1 as first_row from checked group by 1""",
    "build_counts": f"""{_HITS}, n as (select (select count(*) from cases) as c, (select count(*) from hits where status = 'fired') as f, (select count(*) from hits where status = 'fired' and rule_id = 'duplicate_work') as dup, (select count(*) from cases where bonus > 0) as b)
  select 'works' as name, c as rows from n union all select 'cases', c from n union all select 'hits', (select count(*) from hits) union all select 'shares', (select count(*) from shares)
  union all select 'rollup_state', (select count(distinct state) from cases where not is_synthetic) union all select 'rollup_district', (select count(distinct (state, district)) from cases where not is_synthetic)
  union all select 'rollup_agency', (select count(distinct (state, district, agency)) from cases where not is_synthetic) union all select 'rollup_member', (select count(distinct member) from cases where not is_synthetic)
  union all select 'rulebook_versions', 1 union all select 'audit_log', c + f + dup + b from n""",
}


def _sql_rupees(c: str) -> str:
    """Digits in groups of two before the last three; written backwards, as there the groups begin."""
    head = f"reverse(trim(regexp_replace(reverse(left(d, length(d) - 3)), '(..)', '\\1,', 'g'), ','))"
    return f"(select case when {c} is null then 'an unpublished amount' else case when {c} < 0 then '-' else '' end || 'Rs ' || case when length(d) > 3 then {head} || ',' || right(d, 3) else d end end from (select cast(abs({c}) as varchar) as d))"


_AND = "case when len({0}) <= 1 then array_to_string({0}, '') else array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[len({0})] end"
_ORDER_OF = f"list_position([{', '.join(repr(r.id) for r in _BOOK.rules)}], rule_id)"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CLAUSE = """case rule_id when 'execution_delay' then 'carrying it out took ' || format('{:,}', execution_days) || ' days, where the limit is 1,000'
      when 'vendor_concentration' then 'one vendor has ' || format('{:,.2f}', vendor_share_in_agency_pct) || ' % of what the agency paid, where the limit is 2.5 %'
      when 'status_payment_mismatch' then 'it is reported as completed and no payment for it is published' when 'asset_evidence_missing' then 'no picture of the asset was filed'
      when 'account_underutilisation' then 'sanctions stand at ' || format('{:,.2f}', mp_utilisation_pct) || ' % of the member''s allocation, where the least is 20,000 %' end"""
_WHY_SKIPPED = "case " + " ".join(f"when rule_id = '{r}' and why = '{w}' then {_quoted(t)}" for (r, w), t in memos.RULE_REASONS.items()) + " " + " ".join(f"when why = '{w}' then {_quoted(t)}" for w, t in memos.REASONS.items()) + " end"
_DETAIL = "case " + " ".join(f"when field = '{f}' and why = '{w}' then {_quoted(t)}" for (f, w), t in memos.DETAILS.items()) + " " + " ".join(f"when why = '{w}' then {_quoted(t)}" for w, t in memos.DETAIL_REASONS.items()) + " end"
_BLANK = " union all ".join(f"select case_id, '{f}' as field, {f}__why as why from cases where {f} is null" for f in (*NUMERIC, *TRUTHS) if f != "payment_count")

ORACLE_SQL |= {
    "case_memos": f"""with {CASES}, {_TEXT_PEERS},
  cited as (select work_id, list(peer order by rank) as cited from peers where rank <= 2 group by work_id),
  said as (select work_id, coalesce(list({_CLAUSE} order by {_ORDER_OF}) filter (status = 'fired' and {_CLAUSE} is not null), []) as others,
      coalesce(list(replace(rule_id, '_', ' ') || ' - ' || {_WHY_SKIPPED} order by {_ORDER_OF}) filter (status = 'skipped'), []) as skipped,
      cast(sum(weight) filter (status = 'skipped') as bigint) as lost,
      count(*) filter (rule_id = 'duplicate_work' and status = 'fired') as alike, count(*) filter (rule_id = 'split_sanction' and status = 'fired') as split
    from trace join (select work_id, execution_days, vendor_share_in_agency_pct, mp_utilisation_pct from features) f using (work_id) group by work_id)
  select case_id, concat_ws(' ',
    case when is_synthetic then {_quoted(memos.CONTROL)} end,
    'Work ' || work_id || ' (' || coalesce('''' || description || '''', 'no published description') || ') was sanctioned ' || {_sql_rupees("sanctioned_amt")} || ' on ' || strftime(sanction_date, '%-d %B %Y') || ' by ' || agency
      || coalesce(', ' || format('{{:,}}', sanction_lag_days) || ' days after its recommendation of ' || strftime(recommended_date, '%-d %B %Y'), '') || '.',
    case when variance_sanction_to_disbursement is not null then {_sql_rupees("paid_amt")} || ' was paid in ' || payment_count || case when payment_count = 1 then ' payment, ' else ' payments, ' end
      || format('{{:,.2f}}', abs(variance_sanction_to_disbursement)) || case when variance_sanction_to_disbursement > 0 then ' % above the sanction' else ' % below the sanction' end
      || '; the last was on ' || strftime(last_payment, '%-d %B %Y') || ', ' || format('{{:,}}', days_since_last_payment) || ' days ago.'
      when payment_count = 0 then 'No payment for it is published, so how much of the sanction was drawn is not known.' end,
    case when alike + split > 0 then case when same_count > 1 then 'The same description stands on ' || format('{{:,}}', same_count) || ' works of the agency' else 'The description is close to that of other work of the agency' end
      || case when alike > 0 then '; compare ' || {_AND.format("cited")} || ' before anything is concluded, as such works are often repeated for good reason.' else ', which asks for a review and is no finding.' end end,
    case when len(others) > 0 then 'The case also shows that ' || {_AND.format("others")} || '.' end,
    'The agency has ' || format('{{:,}}', peer_count) || ' other HIGH cases in ' || fy || case when bonus > 0 then ', a pattern that adds ' || bonus || ' points.' else ' of the {_BOOK.bonus_least} that a pattern takes; nothing is added for it.' end,
    case when len(skipped) > 0 then 'Not evaluated: ' || {_AND.format("skipped")} || '. That is ' || lost || ' of {_BOOK.weight_total} points of the rulebook, so the score rests on ' || coverage_pct || ' % of it; no other rule gets their weight.' end,
    'Score ' || cases.score || ' of 100, ' || severity || ', under rulebook {_BOOK.version}.',
    {_quoted(memos.NOTICE)}) as memo
  from cases join said using (work_id) left join cited using (work_id)""",
    "unavailable_details": f"with {CASES}, blank as ({_BLANK}) select case_id, field, why, {_DETAIL} as detail from blank",
    "trace_citations": f"""{_HITS}, {_TEXT_PEERS} select h.case_id, 'duplicate_work' as rule_id, cast(p.rank - 1 as int) as at, p.peer as cited, round(max(p.score) over (partition by h.case_id), 6) as best
  from hits h join peers p on p.work_id = h.work_id and p.rank <= 2 where h.rule_id = 'duplicate_work' and h.status = 'fired'""",
}

ORACLE_SQL |= {
    "gap_measures": f"""with {CASES}, r as (select * exclude (status) from cases where not is_synthetic),
  t as (select rule_id, status, count(*) as n from trace join r using (work_id) group by all),
  v as (select count(distinct vendor_id) as vendors from payments join r using (work_id))
  select count(*) as corpus_works, count(*) filter (certified_amt is null) as certification_not_published, count(certified_amt) as certification_rows, count(*) filter (payment_count > 0) as works_with_payment,
         count(*) filter (payment_count = 0) as works_without_payment, count(*) filter (completion_date is null) as works_without_completion, count(*) filter (payment_count > 0 and completion_date is null) as paid_without_completion,
         count(completion_date) as asset_image_published, {", ".join(f"coalesce((select n from t where rule_id = '{rule}' and t.status = '{status}'), 0) as {name}" for rule, status, name in (("asset_evidence_missing", "fired", "asset_evidence_fires"), ("asset_evidence_missing", "passed", "asset_evidence_passes"), ("duplicate_work", "fired", "duplicate_work_fires"), ("split_sanction", "fired", "split_sanction_fires"), ("vendor_concentration", "fired", "vendor_concentration_fires")))},
         count(distinct agency) as agencies, format('{{:,.2f}}', sum(sanctioned_amt) / 1e7) as sanctioned_value, count(*) filter (order_key % 3 <> 0) as degeneracy_matched,
         count(*) filter (order_key % 3 <> 0 and order_key % 1000 <> 0) as degeneracy_differing, count(*) filter (order_key % 3 = 0) as recommended_not_published, (select vendors from v) as vendors from r""",
}


_WORK_ROWS = """raw as (
    select o_orderkey as k, o_custkey % 2 as h, case when o_orderkey % 89 <> 3 then 'WS/MP' || o_custkey % 3 || '/2024-2025/' || o_orderkey // 2 end as work_id,
           case when o_orderkey % 11 = 0 then 'ws/' || chr(9) || ' mp' || o_custkey % 3 || '/2024-2025 /' || o_orderkey // 2 else 'WS/MP' || o_custkey % 3 || '/2024-2025/' || o_orderkey // 2 end as work_id_raw,
           case when o_orderkey % 37 <> 0 then 'State A' end as state, (['ANAND', 'BELA', 'CHAND'])[o_custkey % 3 + 1] as member, o_orderkey % 41 = 0 as no_member, o_orderkey % 43 = 0 as signs_only,
           case when o_orderkey % 13 = 0 then 'Other thing' else o_orderpriority end as category, case when o_orderkey % 7 <> 0 then 'Road, ' || o_orderkey % 100 end as description, o_orderstatus as status,
           o_orderkey % 17 <> 0 and o_orderkey % 19 = 0 as bad_amount, case when o_orderkey % 17 = 0 or o_orderkey % 19 = 0 then null when o_orderkey % 23 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as amount,
           case when o_orderkey % 29 <> 0 and o_orderkey % 31 <> 0 then cast(o_orderdate as date) end as sanction_on, o_orderkey % 29 <> 0 and o_orderkey % 31 = 0 as bad_sanction,
           case when o_orderkey % 29 <> 1 and o_orderkey % 31 <> 1 then cast(o_orderdate as date) + 90 end as completed_on, o_orderkey % 29 <> 1 and o_orderkey % 31 = 1 as bad_completion,
           case when o_orderkey % 53 = 0 then cast(o_orderdate as date) + 10 when o_orderkey % 5 <> 0 then cast(o_orderdate as date) - 20 end as recommended_on, o_orderkey % 2 = 0 as image from orders),
  rows0 as (
    select 'sanctioned' as d, 0 as p, * from raw where k % 5 <> 2 union all select 'completed', 1, * from raw where k % 3 = 0 union all select 'recommended', 2, * from raw where k % 4 <> 1),
  faulty as (
    select *, d || case h when 0 then '_lok_sabha' else '_rajya_sabha' end as file, k % 1999 = 7 as footer,
           case when k % 1999 = 7 then 'grand_total_row' when work_id is null then 'work_id_unparseable' when state is null or no_member then 'null_required_field'
                when d <> 'completed' and bad_amount then 'unparseable_amount' when d = 'sanctioned' and amount is null then 'null_required_field' when d = 'sanctioned' and bad_sanction or d = 'completed' and bad_completion then 'unparseable_date'
                when d = 'sanctioned' and sanction_on is null then 'null_required_field' when d = 'sanctioned' and recommended_on > sanction_on then 'negative_lag' when signs_only then 'null_required_field' end as fault from rows0),
  judged as (
    select *, case when footer then 'grand_total_row' when work_id is null then 'work_id_unparseable'
                   when k > min(case when fault is null then k end) over (partition by d, h, work_id) then 'duplicate_work_id' else fault end as reason from faulty),
  merged as (
    select work_id, arg_min(work_id_raw, (p, h, k)) as work_id_raw, arg_min(member, (p, h, k)) as member, case arg_min(h, (p, h, k)) when 0 then 'lok_sabha' else 'rajya_sabha' end as house, any_value(state) as state,
           arg_min(category, (p, h, k)) as category, arg_min(file, (p, h, k)) as source_file, arg_min(description, (p, h, k)) filter (description is not null) as description, arg_min(status, h) filter (d = 'sanctioned') as status,
           arg_min(image, h) filter (d = 'completed') as image, bool_or(d = 'sanctioned') as in_sanctioned, bool_or(d = 'completed') as in_completed, bool_or(d = 'recommended') as in_recommended,
           arg_max(struct_pack(a := amount, o := sanction_on, r := recommended_on), h) filter (d = 'sanctioned') as s, arg_max(struct_pack(a := amount, o := completed_on), h) filter (d = 'completed') as c,
           arg_max(struct_pack(a := amount), h) filter (d = 'recommended') as r from judged where reason is null group by work_id)"""


def _said(present: str, value: str, zero: bool = False) -> str:
    return f"case when {present} then case when {value} is null then 'not_published' {f"when {value} = 0 then 'published_zero'" if zero else ''} else 'published' end end"


ORACLE_SQL |= {
    "work_level_load": f"""with {_WORK_ROWS}
  select work_id, work_id_raw, member, house, state, 'NORTH' as district, 'District Office' as agency, '2024-2025' as fy, category, source_file, in_sanctioned, in_completed, in_recommended,
         description, {_said("true", "description")} as description__why, status, {_said("true", "status")} as status__why, image, {_said("true", "image")} as image__why,
         s.a as sanctioned_amt, {_said("in_sanctioned", "s.a", True)} as sanctioned_amt__why, s.o as sanction_date, s.r as recommended_date, {_said("in_sanctioned", "s.r")} as recommended_date__why,
         c.o as completion_date, {_said("in_completed", "c.o")} as completion_date__why, c.a as completed_amt, {_said("in_completed", "c.a", True)} as completed_amt__why,
         r.a as recommended_amt, {_said("in_recommended", "r.a", True)} as recommended_amt__why from merged""",
    "work_level_report": f"""with {_WORK_ROWS}, files as (select distinct file from judged)
  select file, 'read' as measure, count(*) as rows from judged group by file union all select file, 'loaded', count(*) filter (reason is null) from judged group by file
  union all select file, 'new_category', count(*) filter (reason is null and category = 'Other thing') from judged group by file
  union all select file, 'new_status', count(*) filter (reason is null and d = 'sanctioned' and status not in ('F', 'O')) from judged group by file
  union all select file, reason, count(*) from judged where reason is not null group by all
  union all select 'all', unnest(['works', 'sanctioned', 'sanctioned_recommended', 'completed', 'completed_sanctioned']),
    unnest([count(*), count(*) filter (in_sanctioned), count(*) filter (in_sanctioned and in_recommended), count(*) filter (in_completed), count(*) filter (in_completed and in_sanctioned)]) from merged""",
    "work_level_members": f"""with {_WORK_ROWS} select member as name, case h when 0 then 'lok_sabha' else 'rajya_sabha' end as house, 'State A' as state, max(case when h = 0 then 'NORTH' end) as constituency,
    2019 as term_start, 2024 as term_end from judged where reason is null group by all""",
}


_BANDS = f"""{_RECOVERED}, lists as (
  select f.field, t.work_id, list_sort(list(t.weight)) as light from trace t join fields f using (rule_id) join cases c using (work_id)
  where t.status = 'skipped' and why = reason and case field when 'expenditure_linkage' then payment_count = 0 else completion_date is null end group by all),
gaps as (select l.field, l.work_id, light, list_reverse_sort(light) as heavy, case when score < {_BOOK.medium} then {_BOOK.medium} - score when score < {_BOOK.high} then {_BOOK.high} - score end as gap from lists l join cases using (work_id)),
short as (
  select *, len(list_filter(range(1, len(light) + 1), lambda i: list_sum(light[1:i]) < gap)) as lightest, len(list_filter(range(1, len(heavy) + 1), lambda i: list_sum(heavy[1:i]) < gap)) + 1 as heaviest from gaps),
needs as (select field, work_id, case when gap is null then len(light) else lightest end as absorbs, case when gap is not null and heaviest <= len(light) then heaviest end as fires from short),
budgets as (select field, cast(coalesce(sum(round_even(fired / nullif(fired + passed, 0) * skips, 0)), 0) as bigint) as budget from attributed group by field),
used as (select field, sum(fires) over (partition by field order by fires, work_id rows unbounded preceding) as used from needs where fires is not null),
ranges as (
  select field, (select count(fires) from needs n where n.field = b.field) as can_change, budget, (select cast(coalesce(sum(absorbs), 0) as bigint) from needs n where n.field = b.field) as absorb_capacity,
         (select count(*) from used u where u.field = b.field and u.used <= budget) as ceiling from budgets b)"""

ORACLE_SQL |= {
    "ablation_band_range": f"with {_BANDS} select can_change, budget, ceiling from ranges where field = 'expenditure_linkage'",
    "ablation_band_range_by_field": f"with {_BANDS} select field, can_change, budget, absorb_capacity, greatest(0, budget - absorb_capacity) as floor, ceiling from ranges",
}

ORACLE_SQL |= {
    "scoped_tables": f"""with {CASES}, who as (
    select case_id, work_id, severity, unnest(list_filter(['ministry', case when state = 'EUROPE' then 'state' end, case when state = 'EUROPE' and district = 'NATION_13' then 'district' end, case when member = 7 then 'member' end], lambda r: r is not null)) as role from cases),
  names as (select n.name, r.role from (select unnest(['works', 'cases', 'payments', 'hits', 'alerts']) as name) n cross join (select unnest(['ministry', 'state', 'district', 'member']) as role) r),
  seen as (
    select 'works' as name, role, count(*) as rows from who group by role union all select 'cases', role, count(*) from who group by role union all select 'payments', role, count(*) from payments join who using (work_id) group by role
    union all select 'hits', role, count(*) from trace join who using (work_id) group by role union all select 'alerts', role, count(*) from who where severity = 'HIGH' group by role)
  select name, role, coalesce(rows, 0) as rows from names left join seen using (name, role)""",
}

_FORMED = " and ".join(f"{c} is not null" for c in COLUMNS)
ORACLE_SQL |= {
    "graph_payloads": f"""with recursive {WORKS}, {EDGES}, near as (select distinct a.agency as a, b.agency as b from edges a join edges b using (vendor_id)),
  reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on n.a = r.b),
  groups as (select a as agency, min(b) as root, count(*) as component_agencies from reach group by a),
  sizes as (select root, count(distinct vendor_id) as n_vendors from edges join groups using (agency) group by root),
  span as (select vendor_id, count(*) as agency_span from edges group by vendor_id),
  s as (select agency, count(*) as vendors, any_value(agency_paid) as disbursed_total, arg_min(vendor_id, (-vendor_paid, vendor_id)) as top_vendor, max(vendor_paid / agency_paid * 100) as top_share_pct,
      sum((vendor_paid / agency_paid) ** 2) as hhi, cast(coalesce(sum(vendor_paid) filter (agency_span > 1), 0) as double) as shared, max(agency_span) as widest_span from shares join span using (vendor_id) group by agency),
  own as (select work_id, string_agg(vendor_id || ':' || s_name || ':' || agency_span, ',' order by vendor_id) as work_vendors
    from (select distinct work_id, vendor_id from payments) join span using (vendor_id) join supplier on s_suppkey = vendor_id group by work_id)
  select work_id, case when hhi is null then 'not_applicable' else 'published' end as hhi__why, vendors, disbursed_total, disbursed_total > {AGENCY_FLOOR} as above_floor, top_vendor, s_name as top_vendor_name,
    round(top_share_pct, 6) as top_share_pct, round(hhi, 6) as hhi, round(shared / disbursed_total * 100, 6) as shared_exposure_pct, widest_span, component_agencies + n_vendors as component_size, component_agencies, work_vendors
  from works left join s using (agency) left join groups using (agency) left join sizes using (root) left join supplier on s_suppkey = top_vendor left join own using (work_id)""",
    "cluster_payloads": f"""with {CASES}, {_TEXT_PEERS}, firsts as (select agency, dkey, min(work_id) as first_work from features group by agency, dkey),
  cites as (select p.work_id, string_agg(peer, ',' order by rank) as cited, max(p.score) as best from peers p join trace t on t.work_id = p.work_id and t.rule_id = 'duplicate_work' and t.status = 'fired' where rank <= 2 group by p.work_id)
  select c.work_id, case when same_count >= 2 then 'DC-' || upper(substring(sha256(agency || chr(31) || dkey), 1, 8)) end as cluster_id, case when same_count >= 2 then same_count end as works,
    case when same_count >= 2 then first_work end as first_work, case when same_count >= 2 then 'published' else 'not_applicable' end as works__why, cited, round(best, 6) as best
  from cases c left join firsts using (agency, dkey) left join cites on cites.work_id = c.work_id""",
    "findings_by_kind": f"""with {FEATURES}, h as (select distinct agency from shares), sized as (select *, count(*) over (partition by category, state, fy) as peer_size from features),
  said as (
    select 'duplicate_cluster' as kind, case when same_count >= 2 then 'published' else 'not_applicable' end as why from features
    union all select 'statistical_outlier', case when not ({_FORMED}) then 'not_published' when peer_size >= {PEER_FLOOR} then 'published' else 'not_applicable' end from sized
    union all select 'delay_risk', case when completion_date is null and date '{AS_OF}' - sanction_date <= 1000 then 'published' else 'not_applicable' end from features
    union all select 'vendor_concentration_graph', case when h.agency is null then 'not_applicable' else 'published' end from features left join h using (agency))
  select kind, why, count(*) as works, count(*) filter (why = 'published') as measured, cast(0 as bigint) as scored, cast(1 as bigint) as versions from said group by kind, why""",
}

_SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
ORACLE_SQL |= {
    "dirty_names": f"""with {_RAW.split("parsed as (")[0].rstrip().rstrip(",")}, t as (
    select event_id, work, case when event_id % 7 = 0 then ' North ' || chr(9) || ' East' when event_id % 7 > 1 then 'south ' || event_type || ' ' end as district,
      case event_id % 7 when 0 then 'Dist. Office, No ' || user_id when 1 then 'Plain  Office ' || user_id else 'Rural-Works ' || user_id end as agency,
      case when event_id % 5 > 1 then 'a ' || event_type || ' b' end as said, 'State ' || event_type as state from raw)
  select event_id, case when work like 'NA-%' then null when work like ' %' then trim(left(work, length(work) - 2)) else work end as raw_id, said, case when said is null then 'not_published' else 'published' end as said__why,
    state, upper(state) as vendor, upper({_SPACED.format("district")}) as district, agency, upper(trim(regexp_replace(agency, '[^A-Za-z0-9]+', ' ', 'g'))) as agency_key from t""",
    "typed_values": f"""{_HITS} select case_id, rule_id, case when rule_id in ({", ".join(repr(r.id) for r in _BOOK.rules if r.field in TRUTHS)}) then cast(value as boolean) end as as_bool, cast(null as bigint) as as_int,
    case when rule_id not in ({", ".join(repr(r.id) for r in _BOOK.rules if r.field in TRUTHS)}) then round_even(cast(value as double), 2) end as as_float, cast(null as varchar) as as_text from hits where value is not null""",
    "alert_messages": f"""{_HITS}, loud as (select case_id, arg_min(rule_id, (-weight, rule_id)) as rule_id from hits where status = 'fired' group by case_id)
  select case_id, 'Case ' || case_id || ' in ' || district || ' (' || state || ') scores ' || score || '; loudest rule: ' || coalesce(rule_id, 'none') || '.' as message from cases left join loud using (case_id) where severity = 'HIGH'""",
    "trace_diff_fields": f"""{_HITS}, s as (select case_id, status, case when value is null then 'skipped' when cast(value as double) > 400 then 'fired' else 'passed' end as now from hits where rule_id = 'stalled_work')
  select case_id, 'stalled_work' as rule_id, unnest(['threshold', 'weight']) as field, unnest(['845.0', '16']) as before, unnest(['400.0', '20']) as after from s
  union all select case_id, 'stalled_work', 'status', status, now from s where status <> now
  union all select case_id, 'stalled_work', 'contribution', case when status = 'fired' then '16' else '0' end, case when now = 'fired' then '20' else '0' end from s where status = 'fired' or now = 'fired'""",
    "busiest_member": f"with {CASES} select member, count(*) as cases, count(*) filter (severity = 'HIGH') as high from cases group by member order by high desc, cases desc, member limit 1",
    "case_list_by_status": f"with {CASES} select case_id, work_id, district, score, severity from cases where state = 'EUROPE' and status = 'Sanction' and not is_synthetic",
}
