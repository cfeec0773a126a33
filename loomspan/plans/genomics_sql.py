"""The genomic queries as plain SQL over the same tables."""

_CELLS = """
with cells as (
  select p_brand as chrom, l_partkey as pos, s_nationkey as sample,
    sum(case when l_linenumber % 2 = 1 then l_quantity else 0 end) as ref_d, sum(case when l_linenumber % 2 = 0 then l_quantity else 0 end) as alt_d
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all),
dos as (select chrom, pos, sample, ref_d + alt_d as depth, alt_d / (ref_d + alt_d) as d from cells where ref_d + alt_d > 0),
every as (select distinct chrom, pos from cells),
axis as (select unnest(range(25)) as sample)
"""


def _stats(depth: int) -> str:
    return f""",
cnt as (select chrom, pos, count(*) as n, sum(floor(d * 10 + 0.5)) as a, count(*) * 10.0 as t from dos where depth >= {depth} group by all),
st as (select every.chrom, every.pos, 1 - coalesce(n, 0) / 25.0 as missing,
  case when n is null then null when a = 0 or a = t then 1.0 else least(a, t - a) / t end as maf, 1 - (a / t) * (a / t) - ((t - a) / t) * ((t - a) / t) as eh
  from every left join cnt using (chrom, pos))
"""


def _histogram(name: str, bins: int) -> str:
    return _CELLS + _stats(0) + f"select greatest(least(floor(round({name}, 9) * {bins}), {bins - 1}), 0)::int as bin, count(*) as n from st where {name} is not null group by 1"


_POPS = _CELLS + """,
pops as (select pos as site, n_regionkey as pop, 10.0 as copies, floor(d * 10 + 0.5) as alt from dos join nation on n_nationkey = sample),
bp as (select site, pop, sum(copies) as n, sum(alt) as a from pops group by all)
"""
_ROUND = _CELLS + ", rd as (select pos, sample, ceil(d * 10 - 0.5) / 10 + 0.0 as d from dos)\n"
_GRID = "(select pos, sample from every cross join axis)"


def _distance(expr: str) -> str:
    return _CELLS + f""", v as (select a.sample as i, b.sample as j, {expr} as value, count(*) as n from dos a join dos b on a.pos = b.pos and a.sample < b.sample group by all)
select x.sample::bigint as i, y.sample::bigint as j, round(value, 9) as value, coalesce(n, 0) as shared from axis x join axis y on x.sample < y.sample left join v on v.i = x.sample and v.j = y.sample"""


def _key(c: str) -> str:
    """One spelling of a chromosome's name."""
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^(chromosome|chr)', ''), '^[_-]', ''), '^0+(.)', '\1')"


_LD = _CELLS + """,
g as (select chrom, pos, sample, d from dos where depth >= 5),
m as (select chrom, pos, avg(d) as f from g group by all),
k as (select * from m where least(f, 1 - f) >= 0.05),
h as (select g.* from g join k using (chrom, pos)),
pr as (select a.chrom, a.pos as pos1, b.pos as pos2, b.pos - a.pos as distance, count(*) as n, sum(a.d) as sa, sum(b.d) as sb, sum(a.d * a.d) as aa, sum(b.d * b.d) as bb, sum(a.d * b.d) as ab
  from h a join h b on a.chrom = b.chrom and a.sample = b.sample and b.pos > a.pos and b.pos - a.pos <= 50000 group by all),
ld as (select chrom, pos1, pos2, distance, case when n * aa - sa * sa <= 1e-9 or n * bb - sb * sb <= 1e-9 then 0 else (n * ab - sa * sb) * (n * ab - sa * sb) / ((n * aa - sa * sa) * (n * bb - sb * sb)) end as r2 from pr where n >= 3),
dc as (select floor(distance / 1000)::bigint as bin, round(avg(r2), 9) as mean_r2, count(*) as n from ld group by 1)
"""
_KIN = _CELLS + """,
c as (select pos, sample, floor(d * 10 + 0.5) as x from dos),
s as (select pos, count(*) as n, avg(x) as mu from c group by all),
k as (select pos, mu, mu / 10 as f from s where 1 - n / 25.0 <= 0.6 and least(mu / 10, 1 - mu / 10) >= 0.05),
z as (select k.pos, axis.sample, coalesce(x, mu) - mu as z from k cross join axis left join c on c.pos = k.pos and c.sample = axis.sample),
w as (select sum(10 * f * (1 - f)) + 1e-10 as scale from k),
kin as (select a.sample::bigint as i, b.sample::bigint as j, round(sum(a.z * b.z) / (select scale from w), 9) as value from z a join z b on a.pos = b.pos and a.sample <= b.sample group by a.sample, b.sample)
"""
_V = "with v as (select row_id, any_value(vcf_id) as vcf_id, any_value(chrom) as chrom, any_value(pos) as pos, any_value(ref_allele) as r, any_value(alt_allele) as a from variants group by row_id)\n"
_GT = """with g as (select call_id, any_value(row_id) as row_id, any_value(sample_id) as sample_id, any_value(gt) as gt from vcf_calls group by call_id),
al as (select *, [x for x in regexp_split_to_array(gt, '[/|]') if x not in ('.', '')] as al from g),
zy as (select *, case when gt is null or len(al) = 0 then 'missing' when len(list_distinct(al)) > 1 then 'het' when al[1] = '0' then 'hom_ref' else 'hom_alt' end as z from al)
"""
# 20 rounds of means from the levels of ploidy 10, of each site's dosages
_KMEANS = """, vs as (select chrom, pos, list(d order by sample) as v from dos group by all),
km as (select chrom, pos, v, list_reduce([[x / 10.0::double for x in range(11)] for i in range(21)], lambda c, z:
  [coalesce(list_avg([x for x in v if list_position([abs(x - q) for q in c], list_min([abs(x - q) for q in c])) - 1 = k]), c[k + 1]) for k in range(11)]) as cs from vs)"""
# the exact test of each (n0, n1, n2) of n
_EXACT = """kd as (select distinct n0, n1, n2 from n),
hs as (select *, n0 + n1 + n2 as m, 2 * least(n0, n2) + n1 as rare, unnest(range((2 * least(n0, n2) + n1) % 2, 2 * least(n0, n2) + n1 + 1, 2)) as h from kd),
lp as (select n0, n1, n2, h, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(m - h - (rare - h) / 2 + 1) as lp from hs),
rl as (select n0, n1, n2, h, exp(lp - max(lp) over (partition by n0, n1, n2)) as w from lp),
ob as (select n0, n1, n2, w as seen from rl where h = n1),
ex as (select n0, n1, n2, least(1, sum(w) filter (w <= seen + 1e-9) / sum(w)) as p from rl join ob using (n0, n1, n2) group by all)
"""
_HITS = """with h as (select hit_id, any_value(trait) as trait, any_value(marker_id) as marker_id, any_value(chromosome) as chrom, any_value(pos) as pos, any_value(p_value) as p, any_value(aic) as aic, any_value(gwas_model) as model from gwas_hits where p_value > 0 and p_value <= 1 group by hit_id)
"""
# the normal quantile of 1 - p / 2 by bisection of its tail: erfc isn't built in, so the tail is summed by a series
_PROBIT = """steps as (select unnest(range(0, 400001)) as i), dens as (select i, 0.00002 * i as x, exp(-0.5 * (0.00002 * i) * (0.00002 * i)) / sqrt(2 * pi()) as f from steps),
cdf as (select i, x, 0.5 + 0.00002 * (sum(f) over (order by i) - 0.5 * f - 0.5 / sqrt(2 * pi())) as c from dens),
probit as (select arg_min(x + (1 - md.p / 2 - c) / (exp(-0.5 * x * x) / sqrt(2 * pi())), abs(c - (1 - md.p / 2))) as z from cdf, md)"""
_GENES = """with genes as (select 'G' || p_partkey as gene_id, p_brand as chrom, p_partkey * 10 as "start", p_partkey * 10 + p_size as "end", p_partkey % 2 as odd from part),
ln as (select l_orderkey as block_id, l_linenumber as ord, 'G' || l_partkey as gene1, 'G' || (l_partkey + 1) as gene2, (l_suppkey * 7 + l_partkey) % 320 as k from lineitem)
"""
_BASES = "with b as (select doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as s from documents)\n"
_NEXT = _BASES.rstrip() + """,
n as (select x.doc_id, x.s, y.s as t, least(len(x.s), len(y.s)) as m from b x join b y on y.doc_id = x.doc_id + 1 where len(x.s) > 0 and len(y.s) > 0),
i as (select doc_id, list_sum([case when s[q] = t[q] then 1 else 0 end for q in range(1, m + 1)])::double / m as identity from n)
"""

SQL = {
    "site_missingness_maf_eh": _CELLS + _stats(0) + "select chrom, pos, round(missing, 9) as missing, round(maf, 9) as maf, round(eh, 9) as eh from st",
    "top_n_eh": _CELLS + _stats(0) + "select chrom, pos, round(eh, 9) as eh from st where eh is not null order by round(eh, 9) desc, pos limit 100",
    "site_filter_chain": _CELLS + _stats(20) + "select chrom, pos, round(missing, 9) as missing, round(maf, 9) as maf, round(eh, 9) as eh from st where missing <= 0.6 and maf >= 0.05 and eh >= 0.2",
    "maf_histogram": _histogram("maf", 50),
    "eh_histogram": _histogram("eh", 10),
    "missing_histogram": _histogram("missing", 10),
    "tajima_components": _CELLS + _stats(0) + """,
u as (select count(*) as s, sum(2 * ((t - a) / t) * (a / t) * t / (t - 1)) as pi, round(avg(t))::bigint as n from cnt),
q as (select *, (select sum(1.0 / x) from range(1, n) r(x)) as a1, (select sum(1.0 / (x * x)) from range(1, n) r(x)) as a2 from u),
e as (select *, ((n + 1.0) / (3 * (n - 1)) - 1 / a1) / a1 as e1, (2 * (n * n + n + 3.0) / (9.0 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) as e2 from q)
select s, round(pi, 9) as pi, n, round(s / a1, 9) as theta, round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 9) as d from e""",
    "fst_pairwise": _POPS + """,
q as (select site, sum(a) / sum(n) as q from bp group by all),
m as (select x.pop as pop1, y.pop as pop2, avg(2 * q * (1 - q)) as ht, avg((2 * (x.a / x.n) * (1 - x.a / x.n) + 2 * (y.a / y.n) * (1 - y.a / y.n)) / 2) as hs from bp x join bp y on x.site = y.site and x.pop < y.pop join q on q.site = x.site group by all)
select pop1, pop2, round(ht, 9) as ht, round(hs, 9) as hs, round((ht - hs) / ht, 9) as fst from m""",
    "fst_clusters": _POPS + """,
m as (select site, 2 * (sum(a) / sum(n)) * (1 - sum(a) / sum(n)) as ht, sum(2 * (a / n) * (1 - a / n) * n) / sum(n) as hs from bp group by all)
select site, round(case when ht < 1e-4 then 0 else (ht - hs) / ht end, 9) as fst from m""",
    "dosage_matrix_round": _ROUND + f"select g.pos, g.sample::bigint as sample, round(d, 9) as d from {_GRID} g left join rd using (pos, sample)",
    "dosage_mode_impute": _ROUND + f""", n as (select pos, d, count(*) as n from rd group by all), mo as (select pos, arg_min(d, struct_pack(a := -n, b := d)) as mo from n group by pos)
select g.pos, g.sample::bigint as sample, round(coalesce(d, mo), 9) as d from {_GRID} g left join rd using (pos, sample) left join mo using (pos)""",
    "dosage_mean_impute": _CELLS + f", me as (select pos, round_even(avg(d), 6) as me from dos group by pos)\nselect g.pos, g.sample::bigint as sample, round(coalesce(d, me), 9) as d from {_GRID} g left join dos using (pos, sample) left join me using (pos)",
    "dist_manhattan": _distance("avg(abs(a.d - b.d))"),
    "dist_euclidean": _distance("sqrt(avg((a.d - b.d) * (a.d - b.d)))"),
    "dist_nei": _distance("-ln(greatest(case when sum(a.d * a.d) > 0 and sum(b.d * b.d) > 0 then sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)) else 0 end, 1e-10))"),
    "ld_pairs": _LD + "select chrom, pos1, pos2, distance, round(r2, 9) as r2 from ld",
    "ld_decay_bins": _LD + "select * from dc",
    "ld_half_decay": _LD + "select max(mean_r2) as max_r2, min(bin) filter (mean_r2 <= (select max(mean_r2) from dc) / 2) as half_bin from dc",
    "haplotype_windows": _CELLS + ", w as (select chrom, pos, (row_number() over (partition by chrom order by pos) - 1) // 5 as block from every)\nselect chrom, block, min(pos) as \"start\", max(pos) as \"end\", count(*) as n from w group by all",
    "kinship_vanraden": _KIN + "select * from kin",
    "relationship_class": _KIN + "select i, j, case when value > 0.45 then 'Duplicate/Clone' when value > 0.2 then 'Full-Sib/Parent-Offspring' when value > 0.1 then 'Half-Sib' when value > 0.05 then 'Distant Relative' when value < -0.05 then 'Unrelated (Divergent)' else 'Unrelated' end as relation from kin where i < j",
    "acgt_export": _CELLS + f"""select g.pos, g.sample::bigint as sample, case when d is null then 'NNNN' else repeat(case when g.pos % 2 = 0 then 'A' else 'C' end, floor((1 - d) * 4 + 0.5)::int) || repeat('G', 4 - floor((1 - d) * 4 + 0.5)::int) end as genotype from {_GRID} g left join dos using (pos, sample)""",
    "variant_class_counts": _V + """, c as (select *, split_part(a, ',', 1) as a1, upper(r) || upper(a) as ra from v)
select count(*) as variants, count(*) filter (len(r) = 1 and len(a1) = 1) as snps, count(*) filter (not (len(r) = 1 and len(a1) = 1)) as indels,
 count(*) filter (len(r) = 1 and len(a) = 1 and a <> '.' and ra in ('AG', 'GA', 'CT', 'TC')) as transitions, count(*) filter (len(r) = 1 and len(a) = 1 and a <> '.' and ra not in ('AG', 'GA', 'CT', 'TC')) as transversions,
 count(*) filter (a = '.') as mono, count(*) filter (a <> '.' and not contains(a, ',')) as bi, count(*) filter (a <> '.' and contains(a, ',')) as multi from c""",
    "density_bins": _V + f"select {_key('chrom')} as chrom, pos // 1000000 as bin, count(*) as n from v group by all",
    "marker_ids": _V + """select row_id, case when vcf_id is null or vcf_id = '.' then chrom || ':' || pos else vcf_id end as marker,
 regexp_replace(regexp_replace(regexp_replace(lower(trim(chrom)), '^(chromosome|chr)', ''), '^[_-]', ''), '^0+(.)', '\\1') as key_a,
 regexp_replace(regexp_replace(regexp_replace(lower(trim(chrom)), '^(chromosome|chr|contig|scaffold)_?', ''), '[^a-z0-9]', '', 'g'), '^0+(.)', '\\1') as key_b from v""",
    "sample_call_summary": _GT + "select sample_id, count(*) as calls, count(*) filter (z = 'missing') as missing, count(*) filter (z = 'het') as het, count(*) filter (z = 'hom_ref') as hom_ref, count(*) filter (z = 'hom_alt') as hom_alt, round(case when count(*) filter (z <> 'missing') > 0 then count(*) filter (z = 'het') / count(*) filter (z <> 'missing') end, 9) as obs_het from zy group by sample_id",
    "sample_inbreeding": _GT + """, c as (select row_id, u.a, count(*) as n from (select row_id, unnest(al) as a from zy) u group by all),
e as (select avg(eh) as eh from (select row_id, 1 - sum(n * n)::double / (sum(n)::double * sum(n)::double) as eh from c group by row_id)),
o as (select sample_id, case when count(*) filter (z <> 'missing') > 0 then count(*) filter (z = 'het') / count(*) filter (z <> 'missing') end as oh from zy group by sample_id)
select sample_id, round(1 - oh / eh, 9) as f from o cross join e""",
    "hwe_counts": _GT + """, k as (select row_id, len([x for x in al if x = '1']) as k from zy where len(al) = 2 and len([x for x in al if x not in ('0', '1')]) = 0),
n as (select row_id, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2, count(*)::double as n from k group by row_id having count(*) >= 5),
p as (select *, (2 * n0 + n1) / (2 * n) as p from n)
select row_id, n0, n1, n2, round(case when 2 * p * (1 - p) * n > 0 then (n1 - 2 * p * (1 - p) * n) * (n1 - 2 * p * (1 - p) * n) / (2 * p * (1 - p) * n) end, 9) as chi2 from p""",
    "hwe_exact": _GT + """, k as (select row_id, len([x for x in al if x = '1']) as k from zy where len(al) = 2 and len([x for x in al if x not in ('0', '1')]) = 0),
n as (select row_id, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2, count(*) as n from k group by row_id having count(*) >= 5),
"""
    + _EXACT
    + "select row_id, round(p, 9) as p from n join ex using (n0, n1, n2)",
    "go_enrichment": """with t as (select distinct p_partkey as g, p_brand as block_id, unnest(string_split(p_type, ' ')) as term from part),
gd as (select term, count(distinct g) as good from t group by term), dr as (select block_id, count(distinct g) as draws from t group by block_id), tt as (select count(distinct g) as total from t),
k as (select block_id, term, count(distinct g) as hits, draws, good, total from t join gd using (term) join dr using (block_id) cross join tt group by all),
x as (select *, unnest(range(greatest(hits, draws - (total - good), 0), least(draws, good) + 1)) as x from k),
p as (select block_id, term, hits, draws, good, least(1, sum(exp(lgamma(good + 1) - lgamma(x + 1) - lgamma(good - x + 1) + lgamma(total - good + 1) - lgamma(draws - x + 1) - lgamma(total - good - draws + x + 1)
  - lgamma(total + 1) + lgamma(draws + 1) + lgamma(total - draws + 1)))) as p from x group by all having p < 0.05),
r as (select *, row_number() over (partition by block_id order by p, term) as rank, count(*) over (partition by block_id) as m from p)
select block_id, term, hits, draws, good, round(p, 9) as p, round(min(least(1, p * m / rank)) over (partition by block_id order by rank desc rows unbounded preceding), 9) as q from r""",
    "ploidy_estimate": _CELLS + """, l as (select sample, d, unnest([2, 4, 6, 8, 10, 12]) as p from dos where d > 0.05 and d < 0.95),
m as (select sample, p, avg((d - round(d * p) / p) * (d - round(d * p) / p) * p * p) as m, count(*) as sites from l group by all),
r as (select *, row_number() over (partition by sample order by m, p) as k, lead(m) over (partition by sample order by m, p) as second from m)
select sample::int as sample, p::int as ploidy, round(case when second > 0 then 1 - m / second else 0 end, 9) as confidence, sites from r where k = 1""",
    "dosage_knn_impute": _ROUND + f""", ds as (select a.sample as i, b.sample as j, avg(abs(a.d - b.d)) as v from rd a join rd b on a.pos = b.pos and a.sample <> b.sample group by all),
ho as (select g.pos, g.sample from {_GRID} g anti join rd using (pos, sample)),
nb as (select ho.pos, ho.sample, rd.d, row_number() over (partition by ho.pos, ho.sample order by round(v, 12), j) as k from ho join ds on ds.i = ho.sample join rd on rd.pos = ho.pos and rd.sample = ds.j),
im as (select pos, sample, ceil(round(avg(d) * 10, 9) - 0.5) / 10 + 0.0 as d from nb where k <= 5 group by all)
select g.pos, g.sample::bigint as sample, round(coalesce(rd.d, im.d), 9) as d from {_GRID} g left join rd using (pos, sample) left join im using (pos, sample)""",
    "ld_prune": _CELLS.replace("with cells", "with recursive cells", 1) + """, z as (select every.chrom, every.pos, sample, d from every left join dos using (chrom, pos)),
pr as (select a.chrom, a.pos as p, b.pos as q, count(*) as n, sum(a.d) as sa, sum(b.d) as sb, sum(a.d * a.d) as aa, sum(b.d * b.d) as bb, sum(a.d * b.d) as ab from dos a join dos b on a.chrom = b.chrom and a.sample = b.sample and b.pos > a.pos group by all),
hi as (select chrom, p, q from pr where n >= 3 and n * aa - sa * sa > 1e-9 and n * bb - sb * sb > 1e-9 and (n * ab - sa * sb) * (n * ab - sa * sb) >= 0.5 * (n * aa - sa * sa) * (n * bb - sb * sb)),
ok as materialized (select a.chrom, a.pos as p, min(b.pos) as q from every a join every b on a.chrom = b.chrom and b.pos > a.pos where not exists (select 1 from hi where hi.chrom = a.chrom and hi.p = a.pos and hi.q = b.pos) group by all),
walk as (select chrom, min(pos) as pos from every group by chrom union all select ok.chrom, ok.q from walk join ok on ok.chrom = walk.chrom and ok.p = walk.pos)
select chrom, pos from walk""",
    "dosage_adaptive": _CELLS
    + _KMEANS
    + f"""
select g.pos, g.sample::bigint as sample, round(case when dos.d is not null then (list_position([abs(dos.d - q) for q in cs], list_min([abs(dos.d - q) for q in cs])) - 1) / 10.0 end, 9) as d
from {_GRID} g left join dos using (pos, sample) left join km using (pos)""",
    "snp_clusters": _CELLS
    + _KMEANS
    + """
select pos as row_id, chrom || '_' || pos as marker, [len([x for x in v if floor(x * 49) = b])::int for b in range(50)] as histogram, [round(q, 9) for q in cs] as centroids,
  [len([x for x in v if list_position([abs(x - q) for q in cs], list_min([abs(x - q) for q in cs])) - 1 = k])::int for k in range(11)] as sizes from km""",
    "merge_full_outer": _CELLS + """,
c as (select chrom, pos, sample, ref_d::bigint || ',' || alt_d::bigint as call from cells),
f as (select * from c where sample < 15), s as (select * from c where sample >= 10),
st as (select distinct chrom, pos from f union select distinct chrom, pos from s)
select st.chrom, st.pos, string_agg(coalesce(f.call, s.call, './.'), ' ' order by axis.sample) as calls
from st cross join axis left join f on f.pos = st.pos and f.sample = axis.sample left join s on s.pos = st.pos and s.sample = axis.sample group by all""",
    "fdr_bh": _HITS + """, r as (select hit_id, p, row_number() over (order by p, hit_id) as rank, count(*) over () as m from h)
select hit_id, rank, round(min(least(1, p * m / rank)) over (order by rank desc rows unbounded preceding), 9) as q from r""",
    "fdr_by_trait": _HITS + """, r as (select hit_id, trait, p, row_number() over (partition by trait order by p, hit_id) as rank, count(*) over (partition by trait) as m from h)
select hit_id, rank, round(min(least(1, p * m / rank)) over (partition by trait order by rank desc rows unbounded preceding), 9) as q from r""",
    "best_model": _HITS + """, r as (select *, row_number() over (partition by trait, marker_id order by aic nulls first, p, model, hit_id) as k from h)
select trait || '|' || marker_id as marker, hit_id, aic, p from r where k = 1""",
    "qq_ranks": _HITS + """, b as (select *, row_number() over (partition by marker_id order by aic nulls first, p, model, hit_id) as k from h),
r as (select hit_id, p, row_number() over (order by p, marker_id) as rank from b where k = 1)
select hit_id, rank, round(-log10(rank / (select count(*) from h)), 9) as expected, round(-log10(p), 9) as observed from r""",
    "chrom_offsets": _HITS + f", k as (select {_key('chrom')} as chrom, pos from h)" + """, c as (select chrom, max(pos) as max_pos, regexp_matches(lower(chrom), '^(chr|ch|[0-9])') as main, coalesce(try_cast(regexp_replace(chrom, '[^0-9]', '', 'g') as bigint), 1099511627776) as num from k where chrom is not null group by chrom)
select chrom, max_pos, coalesce(sum(max_pos + 5000000) over (order by num, chrom rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from c where main
union all select chrom, max_pos, (select coalesce(sum(max_pos + 5000000), 0) from c where main)::bigint from c where not main""",
    # a lead is the best of what no better lead is near
    "lead_snps": _HITS.replace("with h as", "with recursive h as", 1) + f", k as (select hit_id, {_key('chrom')} as chrom, pos, p from h where chrom is not null and pos is not null)" + """,
o as (select *, row_number() over (partition by chrom order by p, hit_id) as r from k),
walk as (
  select chrom, hit_id, pos, p, r, [pos] as kept from o where r = 1
  union all
  select o.chrom, o.hit_id, o.pos, o.p, o.r, list_append(walk.kept, o.pos) from walk, lateral (select * from o where o.chrom = walk.chrom and o.r > walk.r and len([x for x in walk.kept if abs(x - o.pos) <= 5000000]) = 0 order by r limit 1) o)
select hit_id, chrom, pos, p from walk""",
    "lambda_median_pick": _HITS + """, r as (select p, row_number() over (order by p, hit_id) - 1 as k, count(*) over () as m from h), md as (select p from r where k = m // 2),
"""+ _PROBIT + """
select round(z * z / 0.4549, 3) as lambda, case when round(z * z / 0.4549, 3) < 0.9 then 'conservative' when round(z * z / 0.4549, 3) > 1.1 then 'inflated' else 'calibrated' end as label from probit""",
    "orphans_anti": _GENES + "select gene_id from genes where odd = 0 and gene_id not in (select gene1 from ln)",
    "synteny_report_counts": _GENES + """, l as (select * from ln),
r as (select 'Syntenic' as status, a.chrom as chrom1, b.chrom as chrom2 from l left join genes a on a.gene_id = l.gene1 and a.odd = 0 left join genes b on b.gene_id = l.gene2 and b.odd = 1
union all select 'Orphan_G1', chrom, null from genes where odd = 0 and gene_id not in (select gene1 from l) union all select 'Orphan_G2', null, chrom from genes where odd = 1 and gene_id not in (select gene2 from l))
select status, chrom1, chrom2, count(*) as n from r group by all""",
    "block_bounding_box": _GENES + "select block_id, arg_max(chrom, row(ord, \"start\", \"end\", chrom)) as chrom, min(\"start\") as \"start\", max(\"end\") as \"end\" from ln join genes on gene_id = gene1 group by block_id",
    "interval_overlap_semi": _GENES + ", sv as (select 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) as chrom, s_suppkey * 200 as s, s_suppkey * 200 + s_nationkey * 10 as e from supplier)\nselect gene_id from genes where odd = 0 and exists (select 1 from sv where sv.chrom = genes.chrom and sv.s <= genes.\"end\" and sv.e >= genes.\"start\")",
    "snp_in_interval_count": _GENES + "select gene_id, count(*) as n from genes join part on p_brand = chrom and p_partkey * 10 between \"start\" - 500 and \"end\" + 500 where odd = 0 group by gene_id",
    "window_gene_join": _GENES + """, m as (select 'm' || p_partkey as marker, p_brand as chrom, p_partkey * 10 + 3 as pos from part)
select marker, gene_id, case when odd = 0 then 'primary' else 'secondary' end as source, case when pos between "start" and "end" then 0 else least(abs(pos - "start"), abs(pos - "end")) end as distance
from m join genes on genes.chrom = m.chrom and "start" <= pos + 5000 and "end" >= greatest(pos - 5000, 1)""",
    "nearby_snp_count": "select a.p_partkey, count(*) as near from part a join part b on a.p_brand = b.p_brand and abs(a.p_partkey - b.p_partkey) < 30 group by a.p_partkey",
    "ks_histogram_smooth_peaks": _GENES + """, k as (select (k + 0.5::double) / 100 as ks from ln),
n as (select floor((ks - 0.01::double) / 0.05::double)::bigint as bin, count(*) as n from k where ks > 0.01 and ks < 3 group by 1),
e as (select b.bin, coalesce(n, 0) as n from (select unnest(range(60)) as bin) b left join n using (bin)),
s as (select *, avg(n) over (order by bin rows between 1 preceding and 1 following) as smooth from e),
p as (select *, lag(smooth) over (order by bin) as a, lead(smooth) over (order by bin) as b, max(smooth) over () as top from s)
select bin, n, round(smooth, 9) as smooth, coalesce(smooth > a and smooth > b and smooth >= top * 0.01, false) as peak, round((0.01::double + (bin + 0.5::double) * 0.05::double) / (2 * 6.96e-9) / 1e6, 3) as mya from p""",
    "chrom_pair_mean_ks": _GENES + "select a.chrom as chrom1, b.chrom as chrom2, round(avg((k + 0.5) / 100), 9) as mean_ks, count(*) as n from ln join genes a on a.gene_id = gene1 join genes b on b.gene_id = gene2 where (k + 0.5) / 100 > 0.01 and (k + 0.5) / 100 < 3 group by all",
    "go_term_counts": "select term, count(distinct p_partkey) as n from (select p_partkey, unnest(string_split(p_type, ' ')) as term from part) group by term",
    "forward_fill_blocks": "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as block_id from events",
    "gc_content": _BASES + "select doc_id, round(case when len(s) > 0 then len(regexp_replace(s, '[^GC]', '', 'g')) / len(s) end, 9) as gc, len(s) as n from b",
    "codon_translate": _BASES + """select doc_id, coalesce(list_aggregate([substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (16 * (instr('TCAG', c[1]) - 1) + 4 * (instr('TCAG', c[2]) - 1) + instr('TCAG', c[3]))::int, 1) for c in regexp_extract_all(s, '...')], 'string_agg', ''), '') as protein from b""",
    "jukes_cantor": _NEXT + "select doc_id, round(identity, 9) as identity, round(case when 1 - identity >= 0.75 then 3.0 else -0.75 * ln(1 - 4 * (1 - identity) / 3) + 0.0 end, 9) as distance from i",
}
