"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paideon.llm import (
    bestfit, debruijn, decontaminate, exact_dedup, hyperminhash, importance, langid, licenses, prefix_trie, quality,
    quotes, simple8b, toxicity,
)
from paideon.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(tune(spark), folder)
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_exact_dedup", """
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
      doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window w as (partition by coalesce(text, ''))""")
def op2_exact_dedup(spark, folder):
    return exact_dedup.flags(table(spark, folder, "documents"))


@query("op4_hyperminhash", r"""
    with recursive d as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 2 then [w[1]]
        else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d),
    n as (select doc_id, count(*) as c from s group by 1),
    l as materialized (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id
      join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
      group by 1, 2, x.c, y.c having 100 * count(*) >= 80 * (x.c + y.c - count(*))),
    e as materialized (select a, b from l union all select b, a from l),
    r as (select doc_id as id, doc_id as root from d union select e.b, r.root from r join e on e.a = r.id),
    c as (select id, min(root) as component_id from r group by 1)
    select d.doc_id, coalesce(n.c, 0) as n_shingles, component_id, d.doc_id = component_id as kept
    from d left join n on n.doc_id = d.doc_id join c on c.id = d.doc_id""")
def op4_hyperminhash(spark, folder):
    return hyperminhash.groups(table(spark, folder, "documents"))


@query("op5_simple8b")
def op5_simple8b(spark, folder):
    return simple8b.round_trip(table(spark, folder, "documents"), vocabulary())


@query("op3_language")
def op3_language(spark, folder):
    return langid.predictions(table(spark, folder, "documents"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, folder):
    return bestfit.pack(table(spark, folder, "documents"), vocabulary())


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    return toxicity.flags(table(spark, folder, "documents"), table(spark, folder, "labels"))


_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


@query("op8_decontamination", f"""
    with d as (select doc_id, {_WORDS} as w from documents),
    b as (select item_id, {_WORDS} as w from benchmark),
    bw as (select distinct item_id, least(len(w), 13) as n,
        array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as k
      from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
    p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
    h as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k
      from p cross join (select distinct n from bw) where i + n - 1 <= len(w)),
    x as (select h.* from h where k in (select k from bw)),
    c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from x) group by 1),
    t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
      from (select distinct doc_id, cast(item_id as varchar) as s from x join bw using (k)) group by 1)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(items, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join c using (doc_id) left join t using (doc_id)""")
def op8_decontamination(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query("op10_debruijn", r"""
    with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents),
    p as materialized (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as h
      from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
    f as (select h, min(doc_id) as first from p group by 1),
    g as (select distinct doc_id, unnest(range(i, i + 13)) as j from p join f using (h) where first < doc_id),
    x as (select doc_id, list(j) as js, count(*) as n from g group by 1)
    select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
      sha256(coalesce(array_to_string(case when n is null then w
        else (select list(y.w order by y.j) from (select unnest(d.w) as w, unnest(range(1, len(d.w) + 1)) as j) y
              where not list_contains(x.js, y.j)) end, ' '), '')) as kept_sha256
    from d left join x on x.doc_id = d.doc_id""")
def op10_debruijn(spark, folder):
    return debruijn.without_repeats(table(spark, folder, "documents"))


@query("op1_quotation_linking", r"""
    with recursive m as (select row_number() over () as k, * from conversations),
    l as (select k, conv_id, turn, unnest(range(1, len(a) + 1)) as n, a from (
      select k, conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') as a from m)),
    r as (select k, conv_id, turn, n, length(regexp_replace(regexp_extract(a[n], '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) as level,
        regexp_replace(a[n], '^((?:[ \t]*>)+)[ \t]?', '') as content from l),
    t as (select *, trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+', ' ', 'g')) as norm from r),
    o as (select *, case when lag(level) over w = level and lag(norm) over w <> '' and norm <> '' then 0 else 1 end as opens
      from t window w as (partition by k order by n)),
    g as (select *, sum(opens) over (partition by k order by n) as place from o),
    p as materialized (select k, conv_id, turn, level, place, string_agg(content, chr(10) order by n) as body,
        string_agg(norm, ' ' order by n) as norm from g where norm <> '' group by 1, 2, 3, 4, 5),
    f as (select conv_id, norm, min(turn) as origin from p where level = 0 group by 1, 2),
    q as (select p.k, p.conv_id, p.turn, p.level, f.origin from p join f using (conv_id, norm) where p.level > 0 and origin < p.turn),
    e as (select k, conv_id, turn, count(*) as n_linked, max(origin) filter (level = least_level) as reply_to from (
      select *, min(level) over (partition by k) as least_level from q) group by 1, 2, 3),
    u as (select conv_id, turn, max(reply_to) as up from e group by 1, 2),
    c as (select conv_id, turn, up, 1 as depth from u union all
      select c.conv_id, c.turn, u.up, depth + 1 from c join u on u.conv_id = c.conv_id and u.turn = c.up),
    z as (select conv_id, turn, max(depth) as depth, min(up) as root from c group by 1, 2),
    b as (select k, coalesce(string_agg(body, chr(10) || chr(10) order by place) filter (level = 0), '') as body,
        count(*) filter (level > 0) as n_quotes from p group by 1)
    select m.conv_id, m.turn, m.role, coalesce(b.body, '') as body, e.reply_to, coalesce(z.root, m.turn) as thread_root,
      coalesce(z.depth, 0) as depth, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked
    from m left join b using (k) left join e using (k) left join z on z.conv_id = m.conv_id and z.turn = m.turn""")
def op1_quotation_linking(spark, folder):
    return quotes.reply_threads(table(spark, folder, "conversations"))


def _license_sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)
    shingles = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
    return f"""
    with d as (select doc_id, {_WORDS} as w from documents),
    t as (select name, list_distinct({shingles}) as g from (select name, {_WORDS} as w from (values {values}) v(name, text)) x),
    c as (select name, g, cast(pow(2, ceil(log2(len(g)))) as bigint) as c from t),
    ts as (select name, c, len(g) as n, unnest(g) as s from c),
    p as (select doc_id, unnest({shingles}) as s, unnest(range(0, len(w) - 4)) as i from d where len(w) >= 5),
    h as (select distinct doc_id, name, n, s, unnest([i // c, greatest(i // c - 1, 0)]) as window_no from p join ts using (s)),
    k as (select doc_id, name, count(distinct s) / max(n) as share from h group by doc_id, name, window_no),
    m as (select doc_id, name, max(share) as share from k where share >= 0.8 group by 1, 2),
    r as (select doc_id, count(*) as n, string_agg(name, ',' order by name) as names, max(share) as share from m group by 1)
    select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_licenses, coalesce(names, '') as licenses,
      coalesce(share, 0.0) as containment from d left join r using (doc_id)"""


@query("op9_license_scan", _license_sql())
def op9_license_scan(spark, folder):
    return licenses.report(table(spark, folder, "documents"))


@query("op13_importance")
def op13_importance(spark, folder):
    return importance.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


_CRC_TABLE = """select list_transform(range(256), lambda t: list_reduce(list_prepend(t, range(8)),
        lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_of"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text, byte by byte, beside one row of _CRC_TABLE."""
    data = f"list_transform(range(strlen({text})), lambda j: ('0x' || hex({text})[2 * j + 1:2 * j + 2])::bigint)"
    step = "xor(crc_of[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, b: {step}), 4294967295)"


def _quality_sql() -> str:
    m = quality.BUCKETS
    return rf"""
    with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    v as (select x, {_crc32('x')} as c from (select distinct unnest(w) as x from d) y, ({_CRC_TABLE}) z),
    o as (select k, i, c from (select k, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d) y join v using (x)),
    h as materialized (select k, doc_id, coalesce(list(c order by i) filter (c is not null), []) as h
      from d left join o using (k) group by 1, 2),
    g as materialized (select k, doc_id, unnest(list_concat(list_transform(h, lambda x: x % {m}),
        list_transform(range(1, len(h)), lambda i: (h[i] * {quality.PAIR_FACTOR} + h[i + 1]) % {m}))) as bucket from h),
    good as (select doc_id from labels where doc_id is not null group by 1 having min(quality) = 1 and max(quality) = 1),
    s as (select bucket, count(*) as s from g group by 1),
    t as (select bucket, count(*) as t from g where doc_id in (select doc_id from good) group by 1),
    n as (select (select sum(s) from s) as s_all, (select coalesce(sum(t), 0) from t) as t_all),
    gain as (select bucket, case when t_all = 0 then 0 else
        floor(1000 * ln((coalesce(t, 0) + 1) * cast(s_all + {m} as double) / ((s + 1) * cast(t_all + {m} as double)))) end as gain
      from s left join t using (bucket) cross join n),
    y as (select k, cast(sum(gain) as bigint) as weight, count(*) as n_grams from g join gain using (bucket) group by 1),
    p as (select k, len(w) as n, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8),
    q as (select k, i, md5(array_to_string(w[i:i + 7], ' ')) as e from p),
    r as (select k, unnest(range(i, i + 8)) as j from (select k, i, count(*) over (partition by k, e) as c from q) x where c > 1),
    u as (select k, count(distinct j) as n_repeat from r group by 1),
    l as (select k, count(*) - count(distinct line) as n_dup from (
        select k, unnest(string_split(text, chr(10))) as line from d) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
    a as (select d.k, d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(text) - length(translate(text, '{quality.SYMBOLS}', '')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines,
        coalesce(n_repeat, 0) as n_repeat_words, coalesce(n_grams, 0) as n_grams, coalesce(weight, 0) as weight
      from d left join u using (k) left join l using (k) left join y using (k)),
    b as (select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words as base_failed from a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams, weight, base_failed,
      not base_failed and weight >= {quality.LEAST_MEAN_GAIN} * n_grams as kept from b"""


@query("op12_quality", _quality_sql())
def op12_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.report(docs, quality.trusted_documents(docs, table(spark, folder, "labels"))).drop("text_hash")


@query("op11_prefix_trie", rf"""
    with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
        md5(coalesce(role, '')) || md5(coalesce(text, '')) as v, length(coalesce(text, '')) as size from conversations where conv_id is not null),
    c as (select conv_id, conv_id - conv_id % 100 as base, {_crc32('s')} % 6 as h
      from (select distinct conv_id, cast(conv_id as varchar) as s from t) x, ({_CRC_TABLE}) y),
    o as (select c.conv_id, t.pos, t.v, t.size from c join t on t.conv_id = c.base and t.pos < c.h),
    n as (select conv_id, count(*) as n from o group by 1),
    r as (select * from o union all select t.conv_id, t.pos - h + coalesce(n, 0), v, size
      from t join c using (conv_id) left join n using (conv_id) where t.pos >= h),
    p as materialized (select c.conv_id, 0 as depth, '' as id, 0::bigint as size from c union all
      select p.conv_id, depth + 1, md5(id || v), r.size from p join r on r.conv_id = p.conv_id and r.pos = p.depth),
    e as (select conv_id, max(depth) as depth from p group by 1),
    w as (select p.*, lag(id) over (partition by conv_id order by p.depth) as up, p.depth = e.depth as ends from p join e using (conv_id)),
    d as materialized (select depth, id, any_value(up) as up, any_value(size) as size, min(conv_id) as low, count(*) as n,
        string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as ends from w group by 1, 2),
    k as (select depth - 1 as depth, up as id, count(*) as kids from d where depth > 0 group by 1, 2),
    f as (select d.*, coalesce(kids, 0) as kids from d left join k on k.depth = d.depth and k.id = d.id),
    a as (select p.depth, p.id, sum((f.kids = 0)::int) as leaves, sum((f.n - 1) * f.size) as saved
      from f join p on p.conv_id = f.low and p.depth <= f.depth group by 1, 2)
    select f.low as conv_id, f.depth, u.low as parent_conv_id, f.n as n_convs, f.kids as n_children, a.leaves::bigint as n_leaves,
      a.saved::bigint as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
    from f join a on a.depth = f.depth and a.id = f.id left join d u on u.depth = f.depth - 1 and u.id = f.up""")
def op11_prefix_trie(spark, folder):
    return prefix_trie.rebuilt_trie(table(spark, folder, "conversations"))
