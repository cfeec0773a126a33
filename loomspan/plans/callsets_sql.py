"""The queries over calls as plain SQL over the same tables."""

from .genomics_sql import _EXACT

_BASE = r"""
with v as (select row_id, any_value(ref_allele) as "ref", any_value(alt_allele) as alt from variants group by row_id),
c as (select call_id, any_value(row_id) as row_id, any_value(sample_id) as sample_id, any_value(rep_no) as rep_no, coalesce(any_value(gt), '.') as gt, coalesce(any_value(ad), '.') as ad, coalesce(any_value(bsdp), '.') as bsdp, coalesce(any_value(ro), '.') as ro, coalesce(any_value(ao), '.') as ao from vcf_calls group by call_id),
a as (select v.*, case when coalesce(alt, '.') = '.' then 0 else len(alt) - len(replace(alt, ',', '')) + 1 end as others, coalesce(len("ref") = 1 and len(alt) = 1 and alt <> '.', false) as pair from v),
"""
_STATS = _BASE + r"""
g as (select row_id, others, starts_with(gt, '.') as missing, case when starts_with(gt, '.') then [] else [try_cast(x as int) for x in regexp_split_to_array(gt, '[/|]')] end as al from c join a using (row_id)),
n as (select a.row_id, others, any_value("ref") as "ref", any_value(alt) as alt, any_value(pair) as pair, count(g.row_id) as samples, count(*) filter (g.missing) as missing,
  count(*) filter (len(al) = 2 and g.others = 1 and al[1] = 0 and al[2] = 0) as n00, count(*) filter (len(al) = 2 and g.others = 1 and al[1] = 1 and al[2] = 1) as n11, count(*) filter (len(al) = 2 and g.others = 1) as two
  from a left join g using (row_id, others) group by all),
k as (select *, two - n00 - n11 as n01 from n),
ak as (select row_id, others, unnest(range(0, others + 1)) as allele from a),
cc as (select row_id, u.allele, count(*) as n from (select row_id, unnest(al) as allele from g) u group by all),
an as (select row_id, list(coalesce(n, 0) order by allele) as alleles, sum(coalesce(n, 0)) as total, min(n) filter (n > 0) as least, 1 - sum(coalesce(n, 0)::double * coalesce(n, 0)) / nullif(sum(coalesce(n, 0))::double * sum(coalesce(n, 0)), 0) as eh from ak left join cc using (row_id, allele) group by row_id),
t as (select k.*, alleles, total, case when total > 0 then least / total end as maf, case when total > 0 then eh end as eh, case when pair and total > 0 then upper("ref") || upper(alt) in ('AG', 'GA', 'CT', 'TC') end as transition, pair and total > 0 and samples >= 5 as tested,
  (2 * n00 + n01) / nullif(2.0 * two, 0) as p from k join an using (row_id)),
x as (select *, case when tested then coalesce(case when 2 * p * (1 - p) * two > 0 then (n01 - 2 * p * (1 - p) * two) * (n01 - 2 * p * (1 - p) * two) / (2 * p * (1 - p) * two) end, 0) end as chi2 from t),
"""
_TESTED = _STATS + _EXACT.replace("select distinct n0, n1, n2 from n", "select distinct n00 as n0, n01 as n1, n11 as n2 from x") + """,
s as (select x.*, case when tested then case when two = 0 then 1.0 else ex.p end end as hwe_p from x left join ex on ex.n0 = n00 and ex.n1 = n01 and ex.n2 = n11)
"""
_COUNT = "try_cast({} as double)"
_READS = _BASE + r"""
r0 as (select c.*, "ref", string_split(alt, ',')[1] as alt1, pair, string_split(bsdp, ',') as b, string_split(ad, ',') as d, string_split(ao, ',') as o, regexp_split_to_array(gt, '[/|]') as al from c join a using (row_id)),
r1 as (select *, case when len("ref") = 1 and instr('ACGT', upper("ref")) > 0 then try_cast(b[instr('ACGT', upper("ref"))] as double) end as base_ref, case when len(alt1) = 1 and instr('ACGT', upper(alt1)) > 0 then try_cast(b[instr('ACGT', upper(alt1))] as double) end as base_alt from r0),
r2 as (select *, case when bsdp = '.' then null when len(b) = 4 then base_ref when len(b) >= 2 then try_cast(b[2] as double) end as br, case when bsdp = '.' then null when len(b) = 4 then base_alt when len(b) >= 2 then try_cast(b[1] as double) end as ba,
  case when ad = '.' then null when trim(d[1]) = '.' then 0 else try_cast(d[1] as double) end as dr, case when ad = '.' then null when trim(d[2]) = '.' then 0 else try_cast(d[2] as double) end as da, try_cast(ro as double) as rr, try_cast(o[1] as double) as ra from r1),
r3 as (select *, case when ba is not null then br end as bsdp_ref, case when br is not null then ba end as bsdp_alt, case when da is not null then dr end as ad_ref, case when dr is not null then da end as ad_alt, case when ra is not null then rr end as ro_ref, case when rr is not null then ra end as ro_alt from r2),
r4 as (select *, coalesce(bsdp_ref, ad_ref, ro_ref) as any_ref, coalesce(bsdp_alt, ad_alt, ro_alt) as any_alt, not starts_with(gt, '.') as called, len([z for z in al if z = '0'])::double as g0, len([z for z in al if z not in ('0', '.', '')])::double as g1, len([z for z in al if z <> '0'])::double as h1 from r3),
r5 as (select *, case when any_ref + any_alt > 0 then any_alt / (any_ref + any_alt) end as f from r4)
"""

SQL = {
    "call_site_stats": _TESTED + "select row_id, samples, missing, n00, n01, n11, alleles, transition, round(maf, 9) as maf, round(eh, 9) as eh, round(chi2, 9) as chi2, round(hwe_p, 9) as hwe_p from s",
    "call_summary": _TESTED + """
select count(*) as variants, count(*) filter (len("ref") = 1 and len(string_split(alt, ',')[1]) = 1) as snps, count(*) filter (not (len("ref") = 1 and len(string_split(alt, ',')[1]) = 1)) as indels,
  count(*) filter (transition) as transitions, count(*) filter (not transition) as transversions, count(*) filter (alt = '.') as mono, count(*) filter (alt <> '.' and not contains(alt, ',')) as bi, count(*) filter (alt <> '.' and contains(alt, ',')) as multi,
  round(avg(eh), 9) as mean_eh, count(hwe_p) as hwe_tested, count(*) filter (hwe_p < 0.05) as hwe_violations, round(avg(chi2), 9) as mean_chi2, count(*) filter (maf > 0) as segregating from s""",
    "call_histograms": _TESTED + """,
h as (select 'missing' as kind, case when samples > 0 then least(missing * 10 // samples, 9) end as bin from s
  union all select 'maf', least(floor(round(maf, 12) * 100), 49) from s union all select 'eh', least(floor(round(eh, 12) * 10), 9) from s
  union all select 'chi2', case when chi2 < 2 then 0 when chi2 < 3.84 then 1 when chi2 < 7 then 2 when chi2 < 10 then 3 when chi2 >= 10 then 4 end from (select round(chi2, 12) as chi2 from s))
select kind, bin::int as bin, count(*) as n from h where bin is not null group by all""",
    "call_filter_diploid": _BASE + """
f as (select row_id, others, gt = '.' or starts_with(gt, './') as gone, regexp_split_to_array(gt, '[/|]') as al from c join a using (row_id)),
f2 as (select *, case when gone then [] else al[1 : coalesce(nullif(list_position(al, '.'), 0), len(al) + 1) - 1] end as used, not gone and list_contains(al, '.') as dot from f),
f3 as (select *, [z::int for z in used if z::int <= others] as held, gone or dot or len([z for z in used if z::int > others]) > 0 as missing from f2),
m as (select row_id, count(f3.row_id) as samples, count(*) filter (missing) as missing, count(*) filter (not missing and len(held) = 2 and held[1] = 0 and held[2] = 0) as n0, count(*) filter (not missing and len(held) = 2 and held[1] = 1 and held[2] = 1) as n2, count(*) filter (not missing and len(held) = 2) as two from f3 group by row_id),
n as (select *, two - n0 - n2 as n1 from m),
cc as (select row_id, allele, count(*) as n from (select row_id, unnest(held) as allele from f3) group by all),
an as (select row_id, min(n)::double / sum(n) as maf, 1 - sum(n::double * n) / (sum(n)::double * sum(n)) as eh from cc group by row_id),
"""
    + _EXACT
    + """select row_id, round(missing / samples, 9) as missing, round(maf, 9) as maf, round(eh, 9) as eh from n join an using (row_id) join a using (row_id) left join ex using (n0, n1, n2)
where missing / samples <= 0.2 and maf >= 0.05 and eh >= 0.1 and (not pair or two < 5 or p >= 0.01)""",
    "call_filter_polyploid": _READS + """,
q as (select row_id, case when called and any_ref + any_alt >= 10 then floor(f * 4 + 0.5) end as k from r5 where pair),
w as (select row_id, count(*) as samples, count(k) as held, sum(k)::double as alt, count(k) * 4.0 - sum(k) as re from q group by row_id having count(k) > 0),
z as (select row_id, 1 - held / samples as missing, case when alt = 0 or re = 0 then 1.0 else least(alt, re) / (alt + re) end as maf, 1 - (alt * alt + re * re) / ((alt + re) * (alt + re)) as eh from w)
select row_id, round(missing, 9) as missing, round(maf, 9) as maf, round(eh, 9) as eh from z where missing <= 0.6 and maf >= 0.05 and eh >= 0.1""",
    "call_read_counts": _READS + """
select call_id, any_ref, any_alt, bsdp_ref, bsdp_alt, ad_ref, ad_alt, ro_ref, ro_alt,
  round(case when any_ref is not null then f when called and g0 + g1 > 0 then g1 / (g0 + g1) end, 9) as counts_then_gt, round(f, 9) as counts, round(case when called then h1 else f * 4 end, 9) as gt_then_counts,
  round(case when called then len(regexp_replace(gt, '[^1-9]', '', 'g'))::double end, 9) as gt_digits, round(case when f is not null then 1 - f when called then g0 / len(al) end, 9) as ref_fraction from r5""",
    "call_sample_report": _BASE + """
z as (select sample_id, row_id, gt, starts_with(gt, '.') as missing, [y for y in regexp_split_to_array(gt, '[/|]') if y not in ('.', '')] as al, regexp_split_to_array(gt, '[/|]') as every from c),
cc as (select row_id, u.allele, count(*) as n from (select row_id, unnest(al) as allele from z) u group by all),
e as (select avg(eh) as eh from (select row_id, 1 - sum(n * n)::double / (sum(n)::double * sum(n)::double) as eh from cc group by row_id)),
m as (select sample_id, count(*) filter (missing) as mi, count(*) filter (not missing) as ge, count(*) filter (not missing and len(list_distinct(every)) = 1 and every[1] = '0') as hr, count(*) filter (not missing and len(list_distinct(every)) = 1 and every[1] <> '0') as ha,
  count(*) filter (not missing and len(list_distinct(every)) > 1) as he from z group by sample_id),
f as (select *, case when ge > 0 then he / ge else 0 end as oh, (select count(*) from v) as variants from m)
select format('{}\t0.00\t{}\t{:.2f}\t{}\t{}\t{}\t{}\t{}\t0\t0\t0\t0.000\t{:.4f}\t{:.4f}', sample_id, mi, round(mi / greatest(variants, 1)::double * 100, 2), ge, hr, ha, he, ha + he, round(oh, 4), round(case when eh > 0 then 1 - oh / eh else 0.0 end, 4)) as line from f cross join e""",
}
