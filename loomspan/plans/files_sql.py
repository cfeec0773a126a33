"""What those queries must give, as plain SQL over the same tables."""

from .callsets_sql import _BASE
from .genomics_sql import _BASES, _CELLS, _GENES, _GRID, _HITS

_FDR = _HITS + """, r as (select hit_id, p, row_number() over (order by p, hit_id) as rank, count(*) over () as m from h),
q as (select *, min(least(1, p * m / rank)) over (order by rank desc rows unbounded preceding) as q from r)
"""

SQL = {
    "vcf_round_trip": _BASE + """
k as (select row_id, list(replace(gt || ':' || ad || ':' || bsdp || ':' || ro || ':' || ao, chr(9), ' ') order by sample_id, rep_no, call_id) as calls from c group by row_id),
w as (select row_id, any_value(chrom) as chrom, any_value(pos) as pos from variants group by row_id)
select coalesce(chrom, '.') as chrom, pos, coalesce("ref", '.') as "ref", coalesce(alt, '.') as alt, 'GT:AD:BSDP:RO:AO' as format, coalesce(calls, []) as calls from v join w using (row_id) left join k using (row_id)""",
    "genes_round_trip": """select 'G' || p_partkey as gene_id, replace(p_brand, '#', '_') as chrom, p_partkey * 10 as "start", p_partkey * 10 + p_size as "end", '+' as strand, trim(translate(p_name, ';=', '  ')) as name from part""",
    "collinearity_round_trip": _GENES + "select block_id::varchar as block_id, row_number() over (partition by block_id order by ord, gene1, k) as ord, 'gene:' || gene1 as gene1, gene2, round(k / 1000, 9) as e_value from ln",
    "fasta_round_trip": _BASES + "select 'doc' || doc_id as seq_id, s as seq from b",
    "dosage_round_trip": _CELLS + f"select g.pos, g.sample::bigint as sample, round(d::float::double, 5) as d from {_GRID} g left join dos using (pos, sample)",
    "synteny_tsv": _GENES + """,
a as (select * from genes where odd = 0), b as (select * from genes where odd = 1),
l as (select block_id || '\t' || 'Syntenic' || '\t' || ln.gene1 || '\t' || coalesce(a.chrom, 'NA') || '\t' || coalesce(a."start", -1) || '\t' || coalesce(a."end", -1) || '\t' || case when a.gene_id is null then '.' else '+' end || '\t'
  || ln.gene2 || '\t' || coalesce(b.chrom, 'NA') || '\t' || coalesce(b."start", -1) || '\t' || coalesce(b."end", -1) || '\t' || case when b.gene_id is null then '.' else '+' end || '\t' || format('{:.2e}', k / 1000) || '\t0\t0\t0\t0' as line
  from ln left join a on a.gene_id = ln.gene1 left join b on b.gene_id = ln.gene2)
select line from l
union all select 'None' || '\t' || 'Orphan_G1' || '\t' || gene_id || '\t' || chrom || '\t' || "start" || '\t' || "end" || '\t+\tNA\tNA\t-1\t-1\t.\tNA\t0\t0\t0\t0' from a where gene_id not in (select gene1 from ln)
union all select 'None' || '\t' || 'Orphan_G2' || '\tNA\tNA\t-1\t-1\t.\t' || gene_id || '\t' || chrom || '\t' || "start" || '\t' || "end" || '\t+\tNA\t0\t0\t0\t0' from b where gene_id not in (select gene2 from ln)""".replace("\\t", "\t"),
    "gwas_significance": _FDR + "select count(*) as m, round(0.05 / greatest(count(*), 1) * 1e6, 9) as bonferroni_millionths, count(*) filter (p < 0.05 / m) as significant, count(*) filter (q < 0.05) as discoveries, round(coalesce(min(-log10(p)) filter (q < 0.05), 0), 9) as threshold from q",
    "qq_thinned": _FDR + "select hit_id, rank from q where p <= 0.05 or (rank - 1) % 40 = 0",
    "elite_genotypes": """with h as (select hit_id, any_value(effect) as effect, any_value(chromosome) as chrom from gwas_hits where p_value > 0 and p_value <= 1 group by hit_id),
k as (select *, try_cast(regexp_replace(chrom, '[^0-9]', '', 'g') as bigint) as num, list_reduce(list_prepend(0::bigint, [ord(x)::bigint for x in string_split(chrom, '')]), lambda s, x: (s * 31 + x) % 4294967296) as code from h where effect is not null and chrom is not null)
select hit_id, case when effect > 0 then 4 else 0 end as dosage, case when effect > 0 then 'GGGG' else 'AAAA' end as genotype, (abs(coalesce(num, case when code >= 2147483648 then code - 4294967296 else code end)) % 8)::int as colour from k""",
    "tree_leaves": "select 's' || x as name, case when x % 2 = 0 then (x % 3)::varchar else '?' end as kmeans from range(25) r(x)",
    "ancestry_bars": """with a as (select pca_id, any_value(ancestry_proportions) as q from pca_results where len(ancestry_proportions) > 0 group by pca_id)
select lpad(pca_id::varchar, 12, '0') as name, row_number() over (order by list_position(q, list_max(q)), list_max(q) desc, pca_id) - 1 as ord from a""",
}
