"""SQL that gives the same rows as the registered queries of the core."""

from __future__ import annotations

# Blocks in form lines: lines without a CR at their end, empty ones at the end
# dropped. Blocks in form csv: the record without line ends at its end; rec and val
# match a whole record and one value of it.
_REC = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*"""
_VAL = r"""(?:^|,)("(?:[^"]|"")*"|[^",\r\n]*)"""
_BLOCKS = f"""
    raw as (
        select *, fields_txt is null or regexp_full_match(fields_txt, '[ \\t\\r\\n]*') as blank,
            regexp_replace(fields_txt, '[\\r\\n]+$', '') as rec,
            list_transform(string_split(fields_txt, chr(10)), lambda x: regexp_replace(x, '\\r$', '')) as all_lines
        from raw_blocks),
    cut as (
        select *, list_slice(all_lines, 1, coalesce(list_max(list_transform(range(1, len(all_lines) + 1), lambda i: case when all_lines[i] <> '' then i else 0 end)), 0)) as l,
            case when form = 'csv' and not blank and regexp_full_match(rec, '{_REC}') then regexp_extract_all(rec, '{_VAL}', 1) end as c
        from raw),
    shaped as (
        select *, case when blank then 'empty' when form = 'lines' then
                case when len(l) <> 8 then 'arity' when l[1][1] <> '@' or l[5][1] <> '@' then 'header'
                    when l[3] = '' or l[3][1] <> '+' or l[7] = '' or l[7][1] <> '+' then 'separator'
                    when right(l[1], 2) <> '/1' or right(l[5], 2) <> '/2' or left(l[1], length(l[1]) - 2) <> left(l[5], length(l[5]) - 2) then 'mate' end
            else case when c is null then 'quoting' when len(c) <> 5 then 'arity' end end as fault
        from cut),
    named as (
        select block_no, tag, fault,
            case when fault is null then case when form = 'lines' then [l[1], l[2], l[4], l[6], l[8]]
                else list_transform(c, lambda x: case when left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) end end as v
        from shaped),
    told as (
        select *, replace(replace(translate(v[1], ' :#-', '____'), '@', ''), '/1', '') as name from named),
    judged as (
        select block_no, name, v, case when fault is not null then fault
            when not regexp_full_match(v[2], '[ACGTNacgtn]+') or not regexp_full_match(v[4], '[ACGTNacgtn]+') then 'bases'
            when not regexp_full_match(v[3], '[!-~]+') or not regexp_full_match(v[5], '[!-~]+') then 'quality'
            when name = '' or tag is null or name <> tag then 'tag' end as reason
        from told)"""


_RC = "reverse(translate(regexp_replace({0}, '[^ACGT]', '', 'g'), 'ACGT', 'TGCA'))"


def _rc(x: str) -> str:
    return _RC.format(x)


def _trim(x: str) -> str:
    t = f"regexp_replace({x}, 'N+$', '')"
    n = f"length(regexp_extract({t}, '^N*'))"
    return f"case when {n} > 0 and length({t}) - {n} > {n} then substr({t}, {n} + 1, length({t}) - 2 * {n}) else {t} end"


# the eight-line blocks of raw_blocks, cleaned
_PREP = f"""
    cut as (
        select block_no, list_transform(string_split(regexp_replace(coalesce(fields_txt, ''), '[\\r\\n]+$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) as l
        from raw_blocks),
    clean as (
        select block_no, len(l) = 8 as eight, replace(replace(translate(l[1], ' :#-', '____'), '@', ''), '/1', '') as id,
            {_trim('upper(l[2])')} as seq_f, {_trim('upper(l[6])')} as seq_r from cut),
    judged as (
        select *, case when not eight then 'input_lines_invalid' when least(length(seq_f), length(seq_r)) <= 21 then 'very_reads_short'
            else 'reads_good' end as verdict
        from clean)"""

# the blocks of both forms, cleaned; pairs with odd letters stay
_HEAD = r"""^("(?:[^"]|"")*"|[^",\r\n]*)(?:,|$)"""
_PREP_ALL = f"""{_BLOCKS},
    bare as (
        select block_no, case when blank then 'empty' when form = 'lines' then case when len(l) <> 8 then 'arity' end
                when form = 'csv' then case when c is null then 'quoting' when len(c) <> 5 then 'arity' end else 'form' end as fault,
            case when form = 'lines' then [l[1], l[2], l[6]]
                else list_transform([c[1], c[2], c[4]], lambda x: case when left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) end as w
        from cut),
    tidy as (
        select block_no, fault, replace(replace(translate(w[1], ' :#-', '____'), '@', ''), '/1', '') as id,
            {_trim('upper(w[2])')} as seq_f, {_trim('upper(w[3])')} as seq_r from bare),
    ruled as (
        select *, case when fault is not null then fault when least(length(seq_f), length(seq_r)) <= 21 then 'very_reads_short' else 'reads_good' end as verdict
        from tidy)"""

_MATES = """
    m as (
        select read_no, 'f' as mate, upper(seq_f) as s from read_pairs where seq_f is not null
        union all select read_no, 'r', upper(seq_r) from read_pairs where seq_r is not null)"""

_NODES = """
    n as (
        select id, read_f as f, read_r as r, min(cov) as cov from nodes
        where id is not null and length(read_f) > 21 and length(read_r) > 21 group by 1, 2, 3),
    u as (select id, f, r, cov, length(f) as lf, length(r) as lr from n)"""

_ANCHORS = f"""{_NODES},
    ends as (
        select id, cov, substr(f, 1, 21) as f0, substr(f, lf - 20, 21) as f1, substr(r, 1, 21) as r0, substr(r, lr - 20, 21) as r1, lf, lr from u),
    ends_of as (
        select id, cov, f0 as kmer, 'ff' as edge_type, lf as overlap from ends union all select id, cov, {_rc('f0')}, 'fr', lf from ends
        union all select id, cov, {_rc('f1')}, 'fe', lf from ends union all select id, cov, f1, 'ef', lf from ends
        union all select id, cov, r0, 're', lr from ends union all select id, cov, {_rc('r0')}, 'er', lr from ends
        union all select id, cov, {_rc('r1')}, 'rr', lr from ends union all select id, cov, r1, 'rf', lr from ends),
    anchors as (select * from ends_of where regexp_full_match(kmer, '[ACGT]{{21}}'))"""

_KMERS = f"""{_ANCHORS},
    at_f as (select id, cov, f, lf, unnest(range(1, lf - 21)) as i from u),
    at_r as (select id, cov, r, unnest(range(1, lr - 21)) as i from u),
    win_f as (select id, cov, substr(f, cast(i as bigint) + 1, 21) as w, lf - i as overlap from at_f),
    win_r as (select id, cov, substr(r, cast(i as bigint) + 1, 21) as w, i + 21 as overlap from at_r),
    inner_ones as (
        select id, cov, w as kmer, 'ff' as edge_type, overlap from win_f union all select id, cov, {_rc('w')}, 'fr', overlap from win_f
        union all select id, cov, {_rc('w')}, 'rr', overlap from win_r union all select id, cov, w, 'rf', overlap from win_r),
    windows as (select * from inner_ones where regexp_full_match(kmer, '[ACGT]{{21}}')),
    kmers as (
        select id, kmer, edge_type, cast(overlap as integer) as overlap, true as is_anchor from anchors
        union all select id, kmer, edge_type, cast(overlap as integer), false from windows),
    canon as (
        select id, least(kmer, {_rc('kmer')}) as kmer, edge_type, overlap, is_anchor from kmers
        where case when is_anchor then edge_type in ('ff', 'fe', 'rr', 're') else edge_type in ('ff', 'rr') end)"""

_FULL = f"""{_KMERS},
    full_edges as (
        select distinct a.id as src, a.edge_type, o.id as dst, o.overlap from kmers a join kmers o on a.kmer = o.kmer and a.id <> o.id where a.is_anchor)"""

_CANON = f"""{_KMERS},
    canon_edges as (
        select distinct a.id as src, a.edge_type, o.id as dst, o.overlap from canon a join canon o on a.kmer = o.kmer and a.id <> o.id where a.is_anchor)"""

_EDGES = """
    e as (select distinct src, edge_type, dst, overlap from edges where src is not null and dst is not null)"""


def _mirror(table: str) -> str:
    return f"""
    lists as (select src, edge_type, list(dst || '!' || overlap order by dst || '!' || overlap) as l from {table} group by 1, 2),
    gone as (
        select b.src, b.edge_type from lists a join lists b on a.src = b.src and a.l = b.l
            and (a.edge_type, b.edge_type) in (('ff', 'fr'), ('rr', 'rf'), ('fe', 'ef'), ('re', 'er'))),
    kept as (select * from {table} t where not exists (select 1 from gone g where g.src = t.src and g.edge_type = t.edge_type))"""


_LINKED = f"""{_EDGES},
    reads as (select id, read_f, min(cov) as cov from nodes where id is not null and read_f is not null group by 1, 2),
    linked as (select e.*, read_f, coalesce(cov, 1.0) as cov from e join reads on reads.id = dst)"""

_BLACK = f"""{_LINKED},
    black as (select src as id, edge_type as con, dst as node_id, read_f as seq, overlap as oval_size, cov from linked
        where overlap < 30 and edge_type in ('ff', 'fr', 'rf', 'rr')),
    gray as (select src as id, edge_type as con, dst as node_id from e where overlap between 30 and 40),
    ids as (select distinct id, d from nodes, (values ('f'), ('r')) v(d) where id is not null)"""

_ITEMS = f"""{_LINKED},
    items as (select src as grp, read_f as seq, cast(trunc(cov) as bigint) as w, cov as weight,
        row_number() over (partition by src order by length(read_f) desc, read_f, cov) as k from linked),
    shape as (
        select grp, count(*) as items, max(case when k = 2 then length(seq) end) as len2, max(case when k = 3 then length(seq) end) as len3,
            max(case when k = 1 then weight end) + max(case when k = 2 then weight end) as w12, max(case when k = 1 then seq end) as only_one
        from items group by grp)"""


def _consensus(length: str, pick: str) -> str:
    return f"""with {_ITEMS},
    s as (select *, {length} as len from shape),
    chars as (select grp, len, w, unnest(range(1, least(length(seq), len) + 1)) as p, seq from items join s using (grp) where items > 1),
    sums as (
        select grp, p, sum(case when substr(seq, cast(p as bigint), 1) = 'A' then w else 0 end) as a, sum(case when substr(seq, cast(p as bigint), 1) = 'T' then w else 0 end) as t,
            sum(case when substr(seq, cast(p as bigint), 1) = 'C' then w else 0 end) as c, sum(case when substr(seq, cast(p as bigint), 1) = 'G' then w else 0 end) as g, sum(w) as total
        from chars group by grp, p),
    text as (select grp, string_agg({pick}, '' order by p) as x from sums group by grp)
    select grp, case when items = 1 then only_one when len = 0 then '' when 10 * (length(x) - length(replace(x, 'N', ''))) <= 9 * len then x end as consensus
    from s left join text using (grp)"""


_WALK = r"""
    st as (
        select src as id, left(edge_type, 1) as dir, min(dst) as tail, min(right(edge_type, 1)) as tail_dir, min(overlap) as oval_size
        from {0} where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1, 2 having count(*) = 1),
    steps as (
        select a.* from st a join st b on b.id = a.tail and b.dir = case a.tail_dir when 'f' then 'r' else 'f' end and b.tail = a.id
        where a.tail in (select id from nodes)),
    walk(id, dir, cur, cdir, dist, oval_size, seen) as (
        select distinct nodes.id, d, nodes.id, d, cast(0 as bigint), 0, [nodes.id] from nodes, (values ('f'), ('r')) v(d) where nodes.id is not null
        union all
        select w.id, w.dir, s.tail, s.tail_dir, w.dist + 1, s.oval_size, list_append(w.seen, s.tail)
        from walk w join steps s on s.id = w.cur and s.dir = w.cdir where not list_contains(w.seen, s.tail)),
    far as (select id, dir, max(dist) as dist from walk group by 1, 2)
    select w.id, w.dir, w.cur as tail, case w.cdir when 'f' then 'r' else 'f' end as tail_dir, w.dist, w.oval_size
    from walk w join far f on f.id = w.id and f.dir = w.dir and f.dist = w.dist"""

def _dark(walk: str) -> str:
    """The walk that neither leaves a node in a direction with black edges nor enters a node with any."""
    out = walk.replace("group by 1, 2 having count(*) = 1)", "group by 1, 2 having count(*) = 1 and (src, left(edge_type, 1)) not in (select (id, left(con, 1)) from black))", 1)
    return out.replace("where a.tail in (select id from nodes)", "where a.tail in (select id from nodes) and a.tail not in (select id from black)", 1)


# ids with their numbers of edges in both directions
_DEGREES = f"""{_EDGES},
    d as (select src, count(*) filter (where left(edge_type, 1) = 'f') as f, count(*) filter (where left(edge_type, 1) = 'r') as r from e where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1),
    g as (
        select id, min(cov) as cov, coalesce(max(f), 0) as f, coalesce(max(r), 0) as r from nodes left join d on src = id where id is not null group by 1)"""

_MSG = f"""{_EDGES},
    lists as (select src as id, edge_type, string_agg(dst || '!' || overlap, chr(9) order by dst || '!' || overlap) as l, count(*) as n from e group by 1, 2),
    wide as (select id, {', '.join(f"max(case when edge_type = '{t}' then l end) as {t}_" for t in ('ff', 'fe', 'fr', 'ef', 'rr', 're', 'rf', 'er'))},
        max(case when edge_type = 'ff' then n end) as n_ff from lists group by id)"""


def _encoded(x: str) -> str:
    """Two bases a letter, A to T: five letters a base."""
    at = lambda c: f"(instr('ACGT', {c}) - 1)"
    pair = lambda p: f"chr(cast(65 + 5 * {at(f'substr({p}, 1, 1)')} + case when length({p}) = 2 then {at(f'substr({p}, 2, 1)')} + 1 else 0 end as integer))"
    four = f"substr({x}, cast(4 * i + 1 as bigint), 4)"
    return f"""array_to_string(list_transform(range(0, cast(ceil(length({x}) / 4.0) as bigint)), lambda i:
        case when regexp_matches({four}, '[^ACGT]') then 'null'
            else {pair(f'substr({four}, 1, 2)')} || case when length({four}) > 2 then {pair(f'substr({four}, 3, 2)')} else '' end end), '')"""


# all ids of nodes, with any reads or none
_MSG_ALL = f"""{_MSG},
    every as (select id, read_f as f, read_r as r, min(cov) as cov from nodes where id is not null group by 1, 2, 3),
    a as (
        select id, case when f is not null or r is not null then coalesce({_encoded('f')}, '') || '!' || coalesce({_encoded('r')}, '') end as s,
            case when cov is not null then printf('%.2f', cov) end as v from every)"""


def oracle_sql() -> dict[str, str]:
    """tests compare find_tails and the FASTQ source with models of their own, too."""
    found = {
        "p2_found": f"with {_BLOCKS} select block_no, reason from judged where reason is not null",
        "p2_loaded": f"""with {_BLOCKS}
            select block_no, name, v[2] as seq_f, v[3] as qual_f, v[4] as seq_r, v[5] as qual_r from judged where reason is null""",
        "p3_found": """
            select least(upper(kmer), upper(kmer_r)) as kmer_key, count(*) as n_rows, count(distinct id) as n_ids, max(overlap) as max_overlap
            from occurrences where kmer is not null and kmer_r is not null group by 1""",
        "fastq_scan": f"with {_BLOCKS} select name as id, v[2] as seq_f, v[3] as qual_f, v[4] as seq_r, v[5] as qual_r from judged where reason is null",
        "prep_reads": f"with {_PREP} select id, seq_f, seq_r, cast(2.0 as float) as cov from judged where verdict = 'reads_good'",
        "prep_rejects": f"with {_PREP} select block_no, verdict from judged where verdict <> 'reads_good'",
        "prep_metrics": f"""with {_PREP}
            select 'input_lines_invalid' as counter, count(*) as n from judged where verdict = 'input_lines_invalid'
            union all select 'f_reads_with_non_dna_characters', count(*) from judged where eight and regexp_matches(seq_f, '[^ACGT]')
            union all select 'r_reads_with_non_dna_characters', count(*) from judged where eight and regexp_matches(seq_r, '[^ACGT]')
            union all select 'very_reads_short', count(*) from judged where verdict = 'very_reads_short'
            union all select 'reads_good', count(*) from judged where verdict = 'reads_good'""",
        "normalize_ids": f"with {_PREP} select block_no, id from clean",
        "prep_reads_all": f"with {_PREP_ALL} select id, seq_f, seq_r, cast(2.0 as float) as cov from ruled where verdict = 'reads_good'",
        "prep_rejects_all": f"with {_PREP_ALL} select block_no, verdict from ruled where verdict <> 'reads_good'",
        "prep_metrics_all": f"""with {_PREP_ALL} select verdict as counter, count(*) as n from ruled group by 1
            union all select 'f_reads_with_non_dna_characters', count(*) from ruled where fault is null and regexp_matches(seq_f, '[^ACGT]') having count(*) > 0
            union all select 'r_reads_with_non_dna_characters', count(*) from ruled where fault is null and regexp_matches(seq_r, '[^ACGT]') having count(*) > 0""",
        "normalize_ids_all": f"""with {_BLOCKS},
            h as (
                select block_no, form, case when form = 'csv' then case when regexp_matches(coalesce(rec, ''), '{_HEAD}') then regexp_extract(coalesce(rec, ''), '{_HEAD}', 1) end
                    else coalesce(regexp_replace(string_split(regexp_replace(coalesce(fields_txt, ''), '[\\r\\n]+$', ''), chr(10))[1], '\\r$', ''), '') end as x from raw),
            b as (select block_no, case when form = 'csv' and left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end as x from h)
            select block_no, replace(replace(translate(x, ' :#-', '____'), '@', ''), '/1', '') as id from b""",
        "revcomp": f"with {_MATES} select read_no, mate, {_rc('s')} as rc from m",
        "trim_n": f"with {_MATES} select read_no, mate, {_trim('s')} as trimmed from m",
        "trim_n_clean": f"with {_MATES} select read_no, mate, regexp_replace(regexp_replace(s, 'N+$', ''), '^N+', '') as trimmed from m",
        "encode_dna": f"with {_MATES} select read_no, mate, {_encoded('s')} as code from m",
        "decode_dna": f"with {_MATES} select read_no, mate, s from m where not regexp_matches(s, '[^ACGT]')",
        "mate_name": """
            select read_no, case read_no % 3 when 0 then id || '_2' when 1 then id || '_1' else
                case when right(id, 2) = '_1' then left(id, length(id) - 2) || '_2' when right(id, 2) = '_2' then left(id, length(id) - 2) || '_1' end end as mate
            from read_pairs""",
        "flip_dir": f"with {_EDGES} select *, case left(edge_type, 1) when 'f' then 'r' else 'f' end as flipped from e where edge_type in ('ff', 'fr', 'rf', 'rr')",
        "flip_link": f"""with {_EDGES} select *, case edge_type when 'ff' then 'rr' when 'rr' then 'ff' when 'fr' then 'rf' when 'rf' then 'fr' when 'fe' then 're' else 'fe' end as flipped
            from e where edge_type not in ('ef', 'er')""",
        "edge_types": "select edge_type, count(*) as n from edges group by 1",
        "edit_distance": f"""with {_LINKED}
            select src, edge_type, dst, overlap, cast(levenshtein(r.read_f, l.read_f) as integer) as distance from linked l join reads r on r.id = src""",
        "fast_compare": """
            with t as (select doc_id, text as x, translate(text, '0123456789', '9876543210') as y, length(text) as n, length(text) // 100 as s from documents where text is not null)
            select doc_id, case when n > 1000 then
                    len(list_filter(range(0, 100), lambda i: substr(x, cast(i * s + 1 as bigint), s) = substr(y, cast(i * s + 1 as bigint), s)))
                        + case when substr(x, 99 * s + 1) = substr(y, 99 * s + 1) then 1 else 0 end >= 90
                else 10 * levenshtein(x, y) < n end as alike from t""",
        "str_concat": f"""with {_LINKED}
            select src, edge_type, dst, overlap, r.read_f || substr(l.read_f, overlap + 1) as merged from linked l join reads r on r.id = src
            where length(r.read_f) >= overlap and length(l.read_f) >= overlap""",
        "count_pair_end": f"""with {_EDGES}
            select a.src as id, count(*) filter (where exists (select 1 from e b where b.edge_type = 'rr' and b.src = a.src and b.dst = a.dst)) as pair_ends
            from e a where a.edge_type = 'ff' group by 1""",
        "kmer_anchors": f"with {_ANCHORS} select id, kmer, edge_type, cast(overlap as integer) as overlap from anchors",
        "kmer_windows": f"with {_KMERS} select id, kmer, edge_type, overlap from kmers where not is_anchor",
        "canonical_kmers": f"with {_KMERS} select * from canon",
        "kmer_coverage": f"with {_KMERS} select kmer, count(*) as n, cast(sum(cast(trunc(cov) as bigint)) as bigint) as cov_sum from windows group by 1",
        "high_freq_cap": f"""with {_KMERS}, r as (
                select *, row_number() over (partition by kmer order by overlap desc, id, edge_type, is_anchor) as k from canon)
            select kmer, id, edge_type, overlap, is_anchor from r where k <= 5""",
        "overlap_edges_full": f"with {_FULL} select * from full_edges",
        "overlap_edges_canonical": f"with {_CANON} select * from canon_edges",
        "mirror_removed_edges": f"with {_FULL}, {_mirror('full_edges')} select * from kept",
        "mirror_removed_links": f"with {_EDGES}, {_mirror('e')} select * from kept",
        "digraph": f"""with {_CANON}
            select case when edge_type in ('ff', 'fe') then src else dst end as src, case when edge_type in ('ff', 'fe') then dst else src end as dst from canon_edges""",
        "digraph_degree": f"""with {_CANON}
            select src as id, left(edge_type, 1) as dir, count(*) as degree from canon_edges where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1, 2""",
        "kmers_all": f"with {_KMERS} select * from kmers",
        "kmer_counts_all": f"""with {_NODES}, m as (select f as s from u union all select r from u),
            w as (select substr(s, cast(i as bigint), 21) as k from (select s, unnest(range(1, length(s) - 19)) as i from m))
            select 'kmers_kept' as counter, count(*) filter (where regexp_full_match(k, '[ACGT]{{21}}')) as n from w
            union all select 'kmers_omitted', count(*) filter (where not regexp_full_match(k, '[ACGT]{{21}}')) from w""",
        "overlap_edges_all": f"with {_CANON} select * from canon_edges",
        "graph_metrics": f"""with {_CANON}
            select 'nodes' as counter, count(*) as n from u union all select 'anchors', count(*) from canon where is_anchor
            union all select 'windows', count(*) from canon where not is_anchor union all select 'edges', count(*) from canon_edges
            union all select 'nodes_with_edges', count(distinct src) from canon_edges union all select 'digraph_rows', count(*) from canon_edges""",
        "without_contained": f"""with {_NODES}, {_EDGES}
            select id, f as seq_f, r as seq_r from u where id not in (select src from e where overlap < 40)""",
        "link_degree": f"with {_EDGES} select src as id, left(edge_type, 1) as dir, count(*) as degree from e where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1, 2",
        "has_edge": f"""with {_EDGES}
            select dst as src, edge_type, src as dst, overlap, exists (select 1 from e b where b.src = a.dst and b.dst = a.src and b.edge_type = a.edge_type and b.overlap = a.overlap) as found from e a""",
        "get_edge": f"""with {_EDGES}
            select src, edge_type, dst, right(edge_type, 1) as dir, 1 as dist, min(overlap) as oval_size from e group by 1, 2, 3 having max(overlap) >= 40""",
        "remove_link": f"with {_EDGES} select * from e where overlap % 3 <> 0",
        "remove_link_first": f"""with {_EDGES},
            k as (select *, row_number() over (partition by src, edge_type, dst order by overlap) as n, max(overlap % 3 = 0) over (partition by src, edge_type, dst) as hit from e)
            select src, edge_type, dst, overlap from k where not (hit and n = 1)""",
        "remove_link_update": f"""with {_EDGES}
            select * from e a where not exists (select 1 from e b where b.src = a.src and b.edge_type = a.edge_type and b.dst = a.dst and b.overlap + 1 = a.overlap)""",
        "replace_link": f"""with {_EDGES}, c as (select * from e where edge_type = 'ff' and overlap % 2 = 0)
            select * from e where not exists (select 1 from c where c.src = e.src and c.edge_type = e.edge_type and c.dst = e.dst)
            union all select src, 'fr', dst, overlap + 1 from c""",
        "replace_link_oval": f"""with {_EDGES}, c as (select * from e where edge_type = 'ff' and overlap % 2 = 0)
            select * from e where not (edge_type = 'ff' and overlap % 2 = 0) union all select src, 'fr', dst, overlap + 1 from c""",
        "contained_reads": f"with {_EDGES} select src as id, list(dst order by dst) as contained from e where overlap < 40 group by 1",
        "black_degree": f"with {_BLACK} select id, left(con, 1) as dir, count(*) as blkdegree from black group by 1, 2",
        "keep_black": f"with {_BLACK} select id, con, node_id, oval_size from black where left(con, 1) = 'f'",
        "clear_black": f"with {_BLACK} select id, con, node_id, oval_size from black where left(con, 1) <> 'f'",
        "keep_black_r": f"with {_BLACK} select id, con, node_id, oval_size from black where left(con, 1) = 'r'",
        "clear_black_r": f"with {_BLACK} select id, con, node_id, oval_size from black where left(con, 1) <> 'r'",
        "merged_lists": """
            select src, edge_type, list(dst || '!' || overlap order by dst || '!' || overlap) as links from edges where src is not null and dst is not null group by 1, 2""",
        "pair_ends": f"""with {_EDGES}, m as (select src, list(distinct dst order by dst) as l from e where edge_type in ('fe', 're') group by 1)
            select id, coalesce(l, [id]) as mates from (select distinct id from nodes where id is not null) left join m on src = id""",
        "is_black": f"""with {_BLACK}
            select id, d as dir, not exists (
                select 1 from e where src = ids.id and edge_type in (d || 'f', d || 'r')
                    and not exists (select 1 from black b where b.id = ids.id and left(b.con, 1) = d and b.node_id = e.dst)) as black from ids""",
        "is_gray": f"""with {_BLACK}, marks as (select id, con, node_id from black union all select id, con, node_id from gray)
            select id, case d when 'f' then 'r' else 'f' end as dir, exists (
                select 1 from e join marks b on b.id = e.src and b.node_id = e.dst and left(b.con, 1) = left(e.edge_type, 1)
                where e.src = ids.id and e.edge_type in (d || 'f', d || 'r') and b.con in ('ff', 'fr', 'rf', 'rr')) as gray from ids""",
        "node_message": f"""with {_MSG_ALL}
            select a.id, a.id || chr(9) || 'N' || coalesce(chr(9) || '*s' || chr(9) || s, '') || coalesce(chr(9) || '*v' || chr(9) || v, '')
                || {" || ".join(f"coalesce(chr(9) || '*{t}' || chr(9) || {t}_, '')" for t in ('ff', 'fe', 'fr', 'ef', 'rr', 're', 'rf', 'er'))} as line
            from a left join wide on wide.id = a.id""",
        "node_parse": f"with {_MSG_ALL} select a.id, s, v, cast(coalesce(n_ff, 0) as integer) as n_ff from a left join wide on wide.id = a.id",
        "node_parse_only": f"""with {_MSG_ALL}
            select a.id, edge_type as code, replace(l, chr(9), ',') as list from a join lists on lists.id = a.id where edge_type in ('ff', 'rr')""",
        "consensus_majority": _consensus(
            "case when items >= 3 and w12 <= 2 then len3 else len2 end",
            "case when 2 * a > total then 'A' when 2 * t > total then 'T' when 2 * c > total then 'C' when 2 * g > total then 'G' else 'N' end",
        ),
        "consensus_plurality": _consensus(
            "len2", "case when a > greatest(t, c, g) then 'A' when t > greatest(a, c, g) then 'T' when c > greatest(a, t, g) then 'C' when g > greatest(a, t, c) then 'G' else 'N' end"
        ),
        "select_black_edge": f"""with {_BLACK},
            b as (
                select *, con in ('ff', 'fr') as fits, row_number() over (partition by id order by length(seq) - oval_size desc, node_id, con, oval_size, seq, cov) as k,
                    row_number() over (partition by id order by con in ('ff', 'fr') desc, length(seq) * cast(cov as double) desc, node_id, con, oval_size, seq, cov) as best from black),
            items as (
                select id, row_number() over (partition by id order by k) as k, cast(trunc(cov) as bigint) as w,
                    substr(case when right(con, 1) = 'r' then {_rc('seq')} else seq end, oval_size + 1) as s from b where fits),
            shape as (select id, count(*) as items, max(case when k = 2 then length(s) end) as len from items group by id),
            chars as (select id, w, unnest(range(1, least(length(s), len) + 1)) as p, s from items join shape using (id) where items > 1),
            sums as (select id, p, {', '.join(f"sum(case when substr(s, cast(p as bigint), 1) = '{x}' then w else 0 end) as {x}" for x in 'ATCG')}, sum(w) as total from chars group by 1, 2),
            text as (select id, string_agg(case when total = 0 then 'N' {' '.join(f"when 5 * {x} >= 3 * total then '{x}'" for x in 'ATCG')} else 'N' end, '' order by p) as x from sums group by 1),
            told as (
                select id, coalesce(items, 0) as items, coalesce(len >= 20 and (contains(x, 'NNNN') or 5 * (length(x) - length(replace(x, 'N', ''))) >= 2 * len), false) as bad
                from (select distinct id from b) left join shape using (id) left join text using (id))
            select t.id, case when items > 1 and not bad then y.con when items <= 1 and z.fits then z.con end as con,
                case when items > 1 and not bad then y.node_id when items <= 1 and z.fits then z.node_id end as node_id
            from told t join b y on y.id = t.id and y.best = 1 join b z on z.id = t.id and z.k = 1""",
        "tails": f"""with {_BLACK},
            one as (select src as id, left(edge_type, 1) as dir, min(dst) as tail, min(right(edge_type, 1)) as tail_dir, min(overlap) as oval_size
                from e where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1, 2 having count(*) = 1)
            select * from one where not exists (select 1 from black b where b.id = one.id and left(b.con, 1) = one.dir)""",
        "find_tails": f"with recursive {_EDGES}, {_WALK.format('e')}",
        "find_tails_overlaps": f"""with recursive {_CANON},
            x as (select src, edge_type, dst, max(overlap) as overlap from canon_edges where edge_type in ('ff', 'rr') group by 1, 2, 3), {_WALK.format('x')}""",
    }
    more = {
        **{name: found["fastq_scan"] for name in ("fastq_gzip", "fastq_bzip2", "fastq_malformed")},
        "fastq_line_cap": f"select * from ({found['fastq_scan']}) where greatest(length(id) + 3, length(seq_f), length(qual_f), length(seq_r), length(qual_r)) <= 60",
        "digraph_all": found["digraph"],
        **{f"{name}_all": found[name] for name in ("node_message", "node_parse", "node_parse_only")},
        "node_file_scan": found["node_parse"],
        "edges_tsv": f"with {_EDGES} select * from e",
        "node_flags": f"with {_DEGREES} select id, f = 1 as cf, r = 1 as cr, coalesce(cov <= 2, false) as u from g",
        "compressible": f"with {_DEGREES} select id from g where f = 1 and r = 1",
        "node_colors": f"""with {_DEGREES}
            select id, case f when 0 then 'W' when 1 then 'G' else 'B' end as fcolor, case when f > 0 then case r when 0 then 'W' when 1 then 'G' else 'B' end end as rcolor from g""",
        "scalar_fields": f"""with {_DEGREES}
            select id, id || '_t' as mertag, case when f > r then 'f' when r > f then 'r' end as merge_dir, case when f > 1 then id end as replacement,
                case when cov is not null then printf('%.2f', cov) end as coverage from g""",
        "custom_fields": f"with {_DEGREES} select id, r <= 1 as has_q, case when r <= 1 then f || ',' || r end as q, 'new' || f as z from g",
        "edge_lists": f"""with {_EDGES}, lists as (select src as id, edge_type as code, string_agg(dst || '!' || overlap, ',' order by dst || '!' || overlap) as l from e group by 1, 2)
            select id, code, l as list from lists where code not in ('ff', 'rr', 'fe') union all select id, 'fe', l from lists where code = 'ef'
            union all select i.id, 'ff', concat_ws(',', l, i.id || '!21') from (select distinct src as id from e) i left join lists on lists.id = i.id and code = 'ff'""",
        "read_attributes": f"with {_DEGREES} select id, case when f = r then 'd' || f else 'd' || f || ',d' || r end as attributes, id as contained from g",
        "edge_notes": f"""with {_LINKED}, p as (select *, left(edge_type, 1) as d, cast(cast(cov as float) as varchar) as c from linked where edge_type in ('ff', 'fr', 'rf', 'rr'))
            select src as id, 'g' as code, edge_type || '|' || dst as note from p where overlap between 30 and 40
            union all select src, 'b', edge_type || '|' || dst || '|' || read_f || '|' || overlap || '|' || c || '|' || d from p where overlap < 30
            union all select src, case overlap % 3 when 1 then 'a' else 'e' end, dst || '|' || d || '|' || edge_type || '|' || overlap from p where overlap % 3 in (0, 1)
            union all select src, 'x', dst || '|' || c || '|' || src from p where edge_type = 'ff'
            union all select src, 'p', src || '|' || d || '|' || dst || '|' || d || '|' || src || '|' || c || '|' || overlap from p where edge_type = 'rr'""",
        "note_scan": f"with {_BLACK} select id, con, node_id, seq as str_raw, oval_size, cast(cov as float) as cov, left(con, 1) as end from black",
        "tail_texts": f"""with {_EDGES}
            select src as id, left(edge_type, 1) as dir, min(dst) || ' ' || min(right(edge_type, 1)) || ' 1' as tail from e where edge_type in ('ff', 'fr', 'rf', 'rr') group by 1, 2 having count(*) = 1""",
        "candidate_texts": f"with {_LINKED} select src, edge_type, dst || '!' || overlap || '|' || cast(cast(cov as float) as varchar) as candidate from linked",
        "overlap_messages": f"with {_LINKED} select src, edge_type || ' ' || dst || ' ' || overlap || ' ' || read_f as shown from linked",
        "select_black_edge_r": found["select_black_edge"].replace("('ff', 'fr') as fits", "('rf', 'rr') as fits").replace("con in ('ff', 'fr') desc", "con in ('rf', 'rr') desc"),
        "find_tails_black": f"with recursive {_BLACK}, {_dark(_WALK.format('e'))}",
    }
    return found | more
