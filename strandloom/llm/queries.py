"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import dictionary, groups, leaks, quality, similar, spans, terms, tokens


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """Counts of the terms of ``nodes``, built from two deliveries of the table."""
    counts = terms.TermCounts(spark, k=21)
    for changed in terms.deliveries(_read(spark, at, "nodes"), "loaded_at", "id"):
        counts.apply(changed)
    return counts.spelled(counts.counts().where("n_records >= 2")).select("term", "n_total", "n_records", "mark")


def p1_revised(spark: SparkSession, at: str) -> DataFrame:
    """The same counts after a revision of the table: records without coverage are
    deleted, reads are cut before their first N."""
    nodes = _read(spark, at, "nodes")
    revised = nodes.where("cov is not null").withColumns({c: F.substring_index(c, "N", 1) for c in ("read_f", "read_r")})
    counts = terms.TermCounts(spark, k=21)
    for state in (nodes, revised):
        counts.apply_snapshot(state)
    return counts.spelled(counts.counts().where("n_records >= 2")).select("term", "n_total", "n_records", "mark")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return similar.near_duplicates(_read(spark, at, "read_pairs"))


def p4_classes(spark: SparkSession, at: str) -> DataFrame:
    return similar.linked_classes(_read(spark, at, "read_pairs"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    return dictionary.copies(_read(spark, at, "read_pairs"))


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return groups.groups(_read(spark, at, "edges"))


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return spans.shared_bases(_read(spark, at, "nodes"))


def p8_ids(spark: SparkSession, at: str) -> DataFrame:
    return tokens.encode(_read(spark, at, "documents"))


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    return leaks.leaks(_read(spark, at, "documents"), _read(spark, at, "eval_items"))


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    return quality.text_stats(_read(spark, at, "documents"), _read(spark, at, "common_words"))


def p10_rules(spark: SparkSession, at: str) -> DataFrame:
    return quality.failed_rules(_read(spark, at, "documents"))


def p10_quality(spark: SparkSession, at: str) -> DataFrame:
    """All statistics, the share of bullets among them, with the reasons of the rules."""
    return quality.text_quality(_read(spark, at, "documents"), _read(spark, at, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_revised, p4_found, p4_classes, p5_found, p6_found, p7_found, p8_ids, p9_found, p10_found, p10_rules, p10_quality)
    return {f.__name__: f for f in own}


_PAIRS = """
    content as (
        select read_no, regexp_replace(upper(seq_f), '[^A-Z]', '', 'g') as x, regexp_replace(upper(seq_r), '[^A-Z]', '', 'g') as y
        from read_pairs where seq_f is not null and seq_r is not null),
    kept as (
        select read_no, least(x, y) as a, greatest(x, y) as b from content
        where regexp_matches(x, '[ACGT]') and regexp_matches(y, '[ACGT]')),
    members as (select read_no, min(read_no) over (partition by a, b) as rep, a, b from kept)"""

_SIMILAR = f"""{_PAIRS},
    mates as (select rep, a as t from members where read_no = rep union all select rep, b from members where read_no = rep),
    shingles as (
        select distinct rep, substr(t, cast(i as bigint), 10) as s
        from (select rep, t, unnest(range(1, length(t) - 8)) as i from mates where length(t) >= 10)),
    sizes as (select rep, count(*) as n from shingles group by rep),
    common as (
        select p.rep as ra, q.rep as rb, count(*) as c from shingles p join shingles q on p.s = q.s and p.rep < q.rep group by 1, 2),
    linked as (
        select ra, rb from common join sizes p on p.rep = ra join sizes q on q.rep = rb where 10 * c >= 6 * (p.n + q.n - c))"""

_TERMS = """
    reads as (select id, 0 as mate, read_f as t from r union select id, 1, read_r from r),
    terms as (
        select id, substr(t, cast(i as bigint), 21) as term
        from (select id, t, unnest(range(1, length(t) - 19)) as i from reads where length(t) >= 21)),
    c as (select term, count(*) as n_total, count(distinct id) as n_records from terms where not regexp_matches(term, '[^ACGT]') group by term)
    select term, n_total, n_records,
        case when 100 * n_records >= (select count(distinct id) from r) then 'common' when n_records < 4 then 'rare' else 'useful' end as mark
    from c where n_records >= 2"""

_STATS = r"""
    t as (
        select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') as words,
            list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') as lines
        from documents where text is not null)"""

_SYMBOLS = r"""'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'"""


def oracle_sql() -> dict[str, str]:
    """p8_ids has none: its tests compare it with a public tokenizer library."""
    sql = {
        "p1_found": f"with r as (select distinct id, read_f, read_r from nodes where id is not null), {_TERMS}",
        "p1_revised": f"""with r as (
            select distinct id, split_part(read_f, 'N', 1) as read_f, split_part(read_r, 'N', 1) as read_r from nodes where id is not null and cov is not null), {_TERMS}""",
        "p4_found": f"""
            with {_SIMILAR}
            select least(p.read_no, q.read_no) as read_a, greatest(p.read_no, q.read_no) as read_b
            from linked join members p on p.rep = ra join members q on q.rep = rb""",
        "p4_classes": f"""
            with {_SIMILAR},
            ends as (select ra as rep from linked union all select rb from linked)
            select read_no, m.rep as class_no, coalesce(n, 0) as links
            from members m left join (select rep, count(*) as n from ends group by rep) e on e.rep = m.rep""",
        "p5_found": f"""
            with {_PAIRS}
            select rep as keep_no, count(*) as copies from members group by rep having count(*) > 1""",
        "p6_found": """
            with recursive e as (
                select src as a, dst as b from edges where src is not null and dst is not null
                union select dst, src from edges where src is not null and dst is not null),
            reach(n, m) as (select a, a from e union select r.n, e.b from reach r join e on e.a = r.m)
            select n as nodeid, min(m) as group_id from reach group by n""",
        "p7_found": """
            with r as (select distinct id, read_f, read_r from nodes where id is not null),
            reads as (select id, 0 as mate, read_f as t from r union select id, 1, read_r from r),
            w as (
                select id, mate, t, i, substr(t, cast(i as bigint), 40) as s
                from (select id, mate, t, unnest(range(1, length(t) - 38)) as i from reads where length(t) >= 40)),
            good as (select * from w where not regexp_matches(s, '[^ACGT]')),
            twice as (select s from good group by s having min(id) < max(id)),
            hit as (select id, mate, t, i from good join twice using (s))
            select id, count(*) as shared_bases from (select distinct id, mate, t, unnest(range(i, i + 40)) as p from hit) group by id""",
        "p9_found": """
            with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
            q as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from eval_items where text is not null),
            dr as (select doc_id, array_to_string(list_slice(w, cast(i as bigint), cast(i as bigint) + 12), ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
            qr as (select item_id, array_to_string(list_slice(w, cast(i as bigint), cast(i as bigint) + 12), ' ') as run from (select item_id, w, unnest(range(1, len(w) - 11)) as i from q where len(w) >= 13))
            select distinct doc_id, item_id from dr join qr using (run)""",
        "p10_found": f"""
            with {_STATS},
            n as (
                select doc_id, len(words) as nw, len(lines) as nl, length(text) as size,
                    length(translate(text, ' ' || chr(9) || chr(13) || chr(10), '')) as letters,
                    length(text) - length(translate(text, {_SYMBOLS}, '')) as symbols,
                    len(list_filter(lines, lambda x: right(x, 1) in ('.', '!', '?', ';', ':', '…', '。', '！', '？'))) as enders,
                    len(list_filter(words, lambda w: list_contains(known, trim(lower(w), {_SYMBOLS})))) as common
                from t, (select list(distinct word) as known from common_words))
            select doc_id, cast(nw as bigint) as n_words,
                cast(case when nw = 0 then 0 else 1000 * letters // nw end as bigint) as mean_len_m,
                cast(case when size = 0 then 0 else 1000 * symbols // size end as bigint) as symbols_m,
                cast(case when nl = 0 then 0 else 1000 * enders // nl end as bigint) as enders_m,
                cast(case when nw = 0 then 0 else 1000 * common // nw end as bigint) as common_m
            from n""",
        "p10_rules": f"""
            with {_STATS},
            n as (
                select doc_id, len(words) as nw, len(lines) as nl,
                    length(translate(text, ' ' || chr(9) || chr(13) || chr(10), '')) as letters,
                    len(regexp_extract_all(text, '#|[.][.][.]|…')) as marks,
                    len(list_filter(lines, lambda x: left(x, 1) in ('•', '-', '*', '‣', '◦'))) as bullets,
                    len(list_filter(lines, lambda x: right(x, 3) = '...' or right(x, 1) = '…')) as dotted,
                    len(list_filter(words, lambda w: regexp_matches(w, '[\\p{{L}}]'))) as alphabetic,
                    len(list_filter(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'],
                        lambda s: list_contains(list_transform(words, lambda w: trim(lower(w), {_SYMBOLS})), s))) as stops
                from t)
            select doc_id, list_filter([
                case when nw < 50 or nw > 100000 then 'words' end, case when letters < 3 * nw or letters > 10 * nw then 'word_length' end,
                case when 10 * marks > nw then 'symbols' end, case when 10 * bullets > 9 * nl then 'bullets' end,
                case when 10 * dotted > 3 * nl then 'ellipses' end, case when 10 * alphabetic < 8 * nw then 'alphabetic' end,
                case when stops < 2 then 'stop_words' end], lambda x: x is not null) as reasons
            from n""",
    }
    bullets = f"""
        with {_STATS}
        select doc_id, cast(case when len(lines) = 0 then 0 else 1000 * len(list_filter(lines, lambda x: left(x, 1) in ('•', '-', '*', '‣', '◦'))) // len(lines) end as bigint) as bullets_m
        from t"""
    sql["p10_quality"] = f"select * from ({sql['p10_found']}) join ({bullets}) using (doc_id) join ({sql['p10_rules']}) using (doc_id)"
    return sql
