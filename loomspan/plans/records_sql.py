"""The record preparation queries as plain SQL over the same tables."""

_P5 = r"""
with s as (select sample_id, any_value(panel_idx) as panel_idx, any_value(population) as population from samples group by sample_id),
d as (select dosage_id, any_value(dosages) as dosages from dosage_results group by dosage_id),
e as (select dosage_id, unnest(dosages) as x, unnest(range(len(dosages))) as i from d),
f as (select dosage_id, i, population, coalesce(x >= 0 and x <= 1, false) as ok from e join s on s.panel_idx = e.i where population is not null),
site as (select row_id, any_value(':' || vcf_format || ':') as fmt from variants group by row_id),
c as (select call_id, any_value(row_id) as row_id, any_value(sample_id) as sample_id, any_value(ad) as ad, any_value(bsdp) as bsdp from vcf_calls group by call_id),
v as (
  select 'ad' as src, call_id, row_id, population, coalesce(regexp_matches(ad, '(^|[,;|/\s"''()\[\]{}])[0-9]+($|[,;|/\s"''()\[\]{}])'), false) as ok
  from c join site using (row_id) join s using (sample_id) where fmt like '%:AD:%' and population is not null
  union all
  select 'bsdp', call_id, row_id, population, coalesce(regexp_matches(bsdp, '(^|[,;|/\s"''()\[\]{}])[0-9]+($|[,;|/\s"''()\[\]{}])'), false)
  from c join site using (row_id) join s using (sample_id) where fmt like '%:BSDP:%' and population is not null)
select 'dosages' as src, dosage_id as rec_id, i::int as elem_idx from f join (select distinct dosage_id, population from f where ok) using (dosage_id, population) where not ok
union all
select src, call_id, 0 from v join (select distinct src, row_id, population from v where ok) using (src, row_id, population) where not ok
"""

_P6_MATCHED = r"""
with l as (select distinct file_id, stream_id, file_seq, vcf_format, unnest(calls) as call from vcf_batches),
z as (select file_id, stream_id, file_seq, string_split(vcf_format, ':') as tags, string_split(call, ':') as vals from l),
y as (select file_id, stream_id, file_seq, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as k, vals from z),
x as (select file_id, stream_id, file_seq, tag, nullif(nullif(vals[k], '.'), '') as v from y),
t as (select file_id, stream_id, file_seq, tag,
  case when coalesce(bool_and(regexp_full_match(v, '[+-]?[0-9]+')), true) then 0
       when bool_and(regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) then 1
       when bool_and(regexp_full_match(v, '[+-]?[0-9]+(,[+-]?[0-9]+)*')) then 2
       when bool_and(regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?(,[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)*')) then 3
       else 4 end as kind from x group by all),
h as (select file_id, tag, min(lower(regexp_replace(descr, '\s+', '', 'g'))) as descr from vcf_format_headers group by all),
f as (select t.*, h.descr from t left join h using (file_id, tag)),
files as (select file_id, stream_id, lag(file_id) over (partition by stream_id order by file_seq, file_id) as was from (select distinct file_id, stream_id, file_seq from f)),
a as (select files.file_id, p.tag, p.kind, p.descr from files join f p on p.file_id = files.was),
b as (select files.file_id, n.tag, n.kind, n.descr from files join f n on n.file_id = files.file_id where was is not null),
gone as (select a.* from a anti join b using (file_id, tag)),
new as (select b.* from b anti join a using (file_id, tag)),
ren as (select new.file_id, new.tag, gone.tag as old, new.kind, gone.kind as old_kind from new join gone on new.file_id = gone.file_id and new.descr = gone.descr and new.descr <> '')
"""

_P6 = _P6_MATCHED + r"""
select file_id, tag, 'renamed' as change_kind from ren
union all select file_id, tag, 'added' from new anti join ren using (file_id, tag)
union all select file_id, gone.tag, 'removed' from gone where not exists (select 1 from ren where ren.file_id = gone.file_id and ren.old = gone.tag)
union all select b.file_id, b.tag, 'retyped' from a join b using (file_id, tag) where a.kind <> b.kind and b.tag <> 'GT'
union all select file_id, tag, 'retyped' from ren where kind <> old_kind and tag <> 'GT'
"""

_KIND = "(['whole', 'number', 'whole_list', 'number_list', 'text'])[{} + 1]"
_P6_CHANGES = _P6_MATCHED + f"""
select file_id, tag, 'renamed' as change_kind, old as was from ren
union all select file_id, tag, 'added', null from new anti join ren using (file_id, tag)
union all select file_id, gone.tag, 'removed', null from gone where not exists (select 1 from ren where ren.file_id = gone.file_id and ren.old = gone.tag)
union all select b.file_id, b.tag, 'retyped', {_KIND.format('a.kind')} from a join b using (file_id, tag) where a.kind <> b.kind and b.tag <> 'GT'
union all select file_id, tag, 'retyped', {_KIND.format('old_kind')} from ren where kind <> old_kind and tag <> 'GT'
"""

# a field's chain along its stream, its commonest description, and the tag that most files use for that
_P6_CALLS = _P6_MATCHED.replace("with l as", "with recursive l as", 1) + r""",
chain as (
  select f.file_id, f.tag, f.descr, f.file_id as root_file, f.tag as root_tag from f join files using (file_id)
  where not exists (select 1 from f p where p.file_id = files.was and p.tag = f.tag) and not exists (select 1 from ren where ren.file_id = f.file_id and ren.tag = f.tag)
  union all
  select f.file_id, f.tag, f.descr, chain.root_file, chain.root_tag from chain join files on files.was = chain.file_id join f on f.file_id = files.file_id
  where f.tag = chain.tag or exists (select 1 from ren where ren.file_id = f.file_id and ren.old = chain.tag and ren.tag = f.tag)),
dc as (select descr, arg_min(tag, struct_pack(a := -n, b := tag)) as name from (select descr, tag, count(*) as n from f where descr <> '' group by all) group by descr),
mc as (select root_file, root_tag, arg_min(descr, struct_pack(a := -n, b := descr)) as descr from (select root_file, root_tag, descr, count(*) as n from chain where descr <> '' group by all) group by all),
oc as (select root_file, root_tag, min(tag) as own from chain group by all),
wn as (select chain.file_id, chain.tag, coalesce(dc.name, oc.own) as name from chain join oc using (root_file, root_tag) left join mc using (root_file, root_tag) left join dc on dc.descr = mc.descr),
rk as (select *, row_number() over (partition by file_id, name order by tag <> name, tag) = 1 as has from wn),
gv as (select file_id, list(name) as given from rk where has group by file_id),
nm as (select file_id, tag, case when has then name when list_contains(given, tag) then tag || '~' else tag end as name from rk join gv using (file_id)),
li as (select file_id, line_no, any_value(chrom) as chrom, any_value(pos) as pos, any_value(ref_allele) as ref_allele, any_value(string_split(vcf_format, ':')) as tags, any_value(calls) as calls from vcf_batches where vcf_format is not null group by all),
ca as (select * exclude (calls), unnest(calls) as call, unnest(range(1, len(calls) + 1)) as call_no from li),
ce as (select file_id, line_no, call_no, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as k, string_split(call, ':') as vals from ca),
va as (select ce.file_id, line_no, call_no, name, k, nullif(nullif(vals[k], '.'), '') as v from ce join nm using (file_id, tag)),
un as (select file_id, line_no, call_no, name, arg_min(v, k) as v, min(k) as k from va where v is not null group by all),
ro as (select file_id, line_no, call_no, max(v) filter (name = 'GT') as gt, max(trunc(try_cast(v as double))::bigint) filter (name = 'RO') as ro, max(trunc(try_cast(v as double))::bigint) filter (name = 'AO') as ao,
  '{' || coalesce(string_agg('"' || name || '":"' || v || '"', ',' order by k) filter (name not in ('GT', 'RO', 'AO')), '') || '}' as rest from un group by all)
select ca.file_id, ca.line_no, chrom, pos, ref_allele, ca.call_no::int as call_no, gt, ro, ao, case when call is not null then coalesce(rest, '{}') end as rest from ca left join ro using (file_id, line_no, call_no)
"""

_P7_ROWS = r"""
with r as (select file_id, line_no, regexp_replace(any_value(raw_line), '\r$', '') as line from vcf_raw_lines where raw_line is not null group by file_id, line_no),
w as (select file_id, arg_min(len(string_split(line, chr(9))), line_no) as width from r where starts_with(line, '#CHROM') group by file_id),
q as (select r.*, width, (len(line) - len(replace(line, '"', ''))) % 2 = 1 as odd,
  [replace(u, chr(1), chr(9)) for u in string_split(list_aggregate([case when k % 2 = 0 then replace(p, chr(9), chr(1)) else p end for p, k in string_split(line, '"')], 'string_agg', '"'), chr(9))] as f
  from r left join w using (file_id) where not starts_with(line, '#') and trim(line, ' ' || chr(9) || chr(13)) <> ''),
g as (select *, string_split(f[9], ':') as tags, [string_split(c, ':') for c in f[10:]] as calls from q),
j as (select *, case
  when odd then 'quoting'
  when coalesce(len(f) <> width, len(f) < 8) then 'columns'
  when f[9] is not null and (not regexp_full_match(f[9], 'GT(:[A-Z][A-Z0-9_]*)*') or len(list_distinct(tags)) < len(tags) or len([c for c in calls if len(c) > len(tags)]) > 0) then 'tags'
  when list_position(tags, 'BSDP') > 0 and len([c for c in calls if len(c) >= list_position(tags, 'BSDP') and not regexp_full_match(c[list_position(tags, 'BSDP')], '\.|([0-9]+|\.)(,([0-9]+|\.)){1,3}')]) > 0 then 'bsdp'
  when not (regexp_full_match(f[2], '0*[1-9][0-9]*') and regexp_full_match(f[4], '[ACGTNacgtn]+') and regexp_full_match(f[6], '\.|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) then 'fixed'
  end as reason from g)
"""

SQL = {
    "p5_found": _P5,
    "p6_found": _P6,
    "p6_changes": _P6_CHANGES,
    "p6_calls": _P6_CALLS,
    "p7_found": _P7_ROWS + "select file_id, line_no, reason from j where reason is not null",
    "p7_valid": _P7_ROWS + "select file_id, line_no, f[1] as chrom, f[2]::bigint as pos, f[3] as id, f[4] as \"ref\", f[5] as alt, try_cast(f[6] as double) as qual, f[7] as \"filter\", f[8] as info, f[9] as format, f[10:] as calls from j where reason is null",
}
