"""Those queries as plain SQL over the same tables, where SQL can say them."""

_P2 = r"""
with h as (select hit_id, any_value(chromosome) as c, any_value(run_day) as run_day, any_value(p_value) as p from gwas_hits where p_value > 0 and p_value <= 1 group by hit_id),
k as (select *, lower(regexp_replace(c, '\s+', '', 'g')) as low from h),
m as (select *, regexp_extract(low, '^(?:chromosome|chrom|chr|scaffold)?[_\-.:]*0*([0-9]+)$', 1) as num from k),
g as (select case when num = '' then trim(c) when starts_with(low, 'scaffold') then 'scaffold_' || case when len(num) < 3 then lpad(num, 3, '0') else num end else 'Chr' || case when len(num) < 2 then '0' || num else num end end as chromosome, run_day, p from m),
q as (select chromosome, run_day, count(*) as n, quantile_cont(p, [0.25, 0.5, 0.75]) as v from g group by all having count(*) >= 50),
u as (select chromosome, run_day, unnest([25, 50, 75])::int as pct, n, unnest(v) as v from q)
"""

SQL = {
    "p2_percentiles": _P2 + "select chromosome, run_day, pct, n, round(v, 9) as percentile from u",
    "p2_found": _P2 + "select chromosome, run_day, pct from u where round(v, 9) < pct * 0.8 / 100",
    "p3_found": """
with recursive r as (select pca_id, any_value(run_id) as run_id, any_value(ancestry_proportions) as q from pca_results where len(ancestry_proportions) > 0 group by pca_id),
n as (select pca_id, run_id, [x / list_sum(q) for x in q] as v from r),
e as (select a.pca_id as a, b.pca_id as b from n a join n b on a.run_id = b.run_id and len(a.v) = len(b.v) and a.pca_id <> b.pca_id and list_max([abs(a.v[i] - b.v[i]) for i in range(1, len(a.v) + 1)]) <= 0.06 + 1e-9),
reach as (select pca_id as a, pca_id as b from n union select reach.a, e.b from reach join e on reach.b = e.a),
k as (select b as pca_id, min(a) as cluster_key from reach group by b)
select cluster_key, pca_id from k where cluster_key in (select cluster_key from k group by cluster_key having count(*) >= 3)
""",
}
