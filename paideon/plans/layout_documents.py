"""Queries over positioned text: fragments, columns, lines, tables, structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.operators import columns, fragments as fr, lines as ln, margins, paragraphs as par, tree
from paideon.operators.classify import classify, merge_overlines
from paideon.plans import structure as st
from paideon.plans.registry import CHECK_VIEWS, query
from paideon.session import stage

# --- checking steps ------------------------------------------------------------------

_NUMBERED = (r"(?i)^((chapitre|chapter|partie|part|section|module|annexe|appendix|unit[ée]?|unit)\s+\d+\b"
             r"|\d+(\.\d+)*[.)]?\s+\S|[IVXLCDM]{1,6}[.)]\s+\S)")
_PAGE_NUMBER = (r"(?i)^(\d{1,4}$|[-–—•·]\s*\d{1,4}\s*[-–—•·]?$|p(age)?\.?\s*\d{1,4}\b"
                r"|\d{1,4}\s*(/|sur|of|\|)\s*\d{1,4}$)")
_ITEM = r"^\s*[-–—•·*▪◦‣]\s+\S|^\s*(\d{1,3}|[a-zA-Z])[.)]\s+\S"
_STRUCTURAL = ("introduction définition definition objectifs objectives principe principles fonctionnement applications "
               "exemple example avantages limites limitations conclusion synthèse summary méthodologie methodology "
               "architecture résultats results overview prérequis prerequisites références references annexe appendix").split()
_DANGLING = ("le la les un une des du de au aux et ou mais donc car ni que qui dans pour avec sur sous par chez vers sans "
             "entre a an the of in on at to for with from by and or but if as into than when while which").split()


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


CHECK_VIEWS.update({
    "xc_lines": """
        select doc_id, page_no, row_number() over (partition by doc_id, page_no order by y desc) - 1 as line_no,
          trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, x, y, font_size, bold from fragments""",
    "xc_body": """
        select doc_id, arg_min(size, (-weight, first_seen)) as body_size from (
          select doc_id, font_size as size, sum(greatest(length(text), 1)) as weight,
            min(page_no * 1000000 + line_no) as first_seen from xc_lines group by 1, 2) s group by 1""",
    "xc_bands": """
        select c.doc_id, c.edge, c.band, count(distinct page_no) as touched, any_value(n.pages) as pages from xc_margin c
        join (select doc_id, count(*) as pages from layout_pages group by 1) n on n.doc_id = c.doc_id
        group by 1, 2, 3 having count(distinct page_no) >= greatest(3, floor(any_value(n.pages) * 0.5))""",
    "xc_margin": """
        select *, case when 792 - y <= 792 * 0.08 then 'HEADER' else 'FOOTER' end as edge,
          cast(round_even((case when 792 - y <= 792 * 0.08 then 792 - y else y end) / 3, 0) as int) as band,
          lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g')) as form
        from xc_lines where y between 0 and 792 and length(text) <= 120 and (792 - y <= 792 * 0.08 or y <= 792 * 0.08)""",
    "xc_marks": f"""
        select m.*, case when regexp_matches(text, '{_PAGE_NUMBER}') then 'PAGE_NUMBER' else m.edge end as boilerplate
        from xc_margin m join xc_bands b on b.doc_id = m.doc_id and b.edge = m.edge and b.band = m.band
        join xc_body o on o.doc_id = m.doc_id
        where regexp_matches(text, '{_PAGE_NUMBER}') or m.font_size < o.body_size * 0.95
          or (select count(*) from xc_margin r where r.doc_id = m.doc_id and r.edge = m.edge and r.band = m.band
            and r.form = m.form) >= greatest(3, floor(b.pages * 0.5))""",
    "xc_leading": """
        select doc_id, median(gap) as gap_median from (select doc_id, font_size,
            y - lead(y) over (partition by doc_id, page_no order by line_no) as gap from xc_lines) g
        where gap > 0 and gap < 6 * greatest(font_size, 1) group by 1""",
    "xc_content": f"""
        select l.*, coalesce(d.gap_median, 0) as gap_median, regexp_matches(l.text, '{_ITEM}') as is_item,
          lag(l.page_no) over w as p_page, lag(l.y) over w as p_y, lag(l.font_size) over w as p_size,
          lag(l.bold) over w as p_bold, lag(l.text) over w as p_text
        from xc_lines l left join xc_leading d on d.doc_id = l.doc_id
        where not exists (select 1 from xc_marks m where m.doc_id = l.doc_id and m.page_no = l.page_no
          and m.line_no = l.line_no)
        window w as (partition by l.doc_id order by l.page_no, l.line_no)""",
    "xc_numbered": """
        select *, sum(case when p_page is null or is_item or bold <> p_bold
            or abs(font_size - p_size) > greatest(font_size, p_size, 1) * 0.2
            or case when p_page = page_no
              then p_y - y > greatest(gap_median, greatest(font_size, p_size, 1) * 1.15) * 1.5
              else regexp_matches(p_text, '[.!?:»…]$') end then 1 else 0 end)
            over (partition by doc_id order by page_no, line_no) as par_no
        from xc_content""",
    "xc_par": """
        select n.doc_id, n.par_no, arg_min(n.page_no, n.page_no * 1000000 + n.line_no) as page_no,
          arg_min(n.line_no, n.page_no * 1000000 + n.line_no) as line_no,
          string_agg(n.text, ' ' order by n.page_no, n.line_no) as text, count(*) as line_count,
          max(n.page_no) as page_end, any_value(m.font_size) as font_size,
          sum(case when n.bold then length(n.text) else 0 end)::double / sum(length(n.text)) as bold_ratio
        from xc_numbered n join (select doc_id, par_no, median(font_size) as font_size from (
            select doc_id, par_no, font_size, unnest(range(greatest(length(text), 1))) as u from xc_numbered) e
          group by 1, 2) m on m.doc_id = n.doc_id and m.par_no = n.par_no
        group by 1, 2""",
    "xc_score": f"""
        select p.*, b.body_size, (case when r >= 1.35 then 45 when r >= 1.15 then 35 when r >= 1.05 then 20
              when r < 0.9 then -15 else 0 end)
          + (case when bold_ratio > 0.6 then 20 else 0 end)
          + (case when len(words) > 0 and len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len(words) >= 0.6
              then 10 else 0 end)
          + (case when regexp_matches(text, '{_NUMBERED}') then 25 else 0 end)
          + (case when not regexp_matches(text, '[.!?…:;]$') then 10 else 0 end)
          + (case when length(text) <= 60 then 10 when length(text) > 120 then -25 else 0 end)
          + (case when regexp_extract(lower(text), '^([^\\s:,.]*)', 1) in {_list(_STRUCTURAL)} then 10 else 0 end)
          + (case when line_count > 3 then -15 else 0 end)
          + (case when lower(regexp_extract_all(text, '[A-Za-zÀ-ÿ'']+')[-1]) in {_list(_DANGLING)} then -25 else 0 end)
            as score
        from (select q.*, q.font_size / b.body_size as r,
            list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), lambda w: length(w) > 2) as words
          from xc_par q join xc_body b on b.doc_id = q.doc_id) p join xc_body b on b.doc_id = p.doc_id""",
    "xc_type": """
        select *, case
            when regexp_matches(text, '(?i)^(figure|fig\\.?|tableau|table|listing|exemple|example|schema|schéma)\\s*\\d+')
              then 'CAPTION'
            when regexp_matches(text, '^\\s*[-–—•·*▪◦‣]\\s+\\S') then 'LIST_ITEM'
            when line_count = 1 and length(text) <= 80 and regexp_matches(text,
              '[=≈≠≤≥±×÷∑∏∫√∈∉⊂⊃∪∩→←⇒⇔∂∇∞]|[⁰-⁹²³¹]|\\^\\s*\\d')
              and length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) < 0.5 then 'FORMULA'
            when regexp_matches(text, '^\\s*(\\d{1,3}|[a-zA-Z])[.)]\\s+\\S') and score < 70 then 'LIST_ITEM'
            when score >= 50 then 'HEADING' else 'PARAGRAPH' end as type
        from xc_score""",
    "xc_element": """
        select *, sum(case when type = 'HEADING' or prev is null or prev = 'HEADING' or kind <> prev_kind then 1 else 0 end)
            over (partition by doc_id order by par_no) as element_no,
          sum(case when type = 'HEADING' then 1 else 0 end) over (partition by doc_id order by par_no) as heading_no
        from (select *, lag(type) over (partition by doc_id order by par_no) as prev,
            lag(kind) over (partition by doc_id order by par_no) as prev_kind
          from (select *, case type when 'LIST_ITEM' then 'LIST' when 'CAPTION' then 'CAPTION' when 'FORMULA' then 'FORMULA'
            when 'HEADING' then 'H' else 'TEXT' end as kind from xc_type) k) e""",
    "xc_block": """
        select doc_id, element_no, any_value(kind) as kind, any_value(heading_no) as heading_no,
          string_agg(text, chr(10) || chr(10) order by par_no) as text, min(page_no) as page_start,
          max(page_end) as page_end from xc_element where kind <> 'H' group by 1, 2""",
    "xc_heading": """
        select doc_id, heading_no, text, font_size, page_no as page_start, page_end,
          least(4, greatest(dense_rank() over (partition by doc_id order by font_size desc),
            case when regexp_extract(text, '^(\\d+(\\.\\d+)*)[.)]?\\s+\\S', 1) = '' then 0
              else len(string_split(regexp_extract(text, '^(\\d+(\\.\\d+)*)[.)]?\\s+\\S', 1), '.')) end)) as wanted
        from xc_element where type = 'HEADING'""",
    "xc_section": """
        select *, (select max(u.heading_no) from xc_level u where u.doc_id = l.doc_id and u.heading_no < l.heading_no
          and u.level = l.level - 1) as parent_no from xc_level l""",
    "xc_level": """
        select *, least(heading_no, heading_no + min(wanted - heading_no) over (partition by doc_id order by heading_no))
          as level from xc_heading""",
})

# --- queries -------------------------------------------------------------------------


def _lines(t):
    return ln.lines_of(t.fragments)[0]


def _marked(t):
    return st.marked_lines(t.fragments, t.layout_pages)


def _paragraphs(t):
    lines = _marked(t)[2]
    return par.group_paragraphs(lines, par.median_leading(lines)), lines


def _structure(t):
    return st.structure_documents(t.fragments, t.layout_pages)


@query("draw_call_fragments", """
  select doc_id, page_no, x, case when seq = 0 then 720.0 else y end as y, font_size, font_name, bold, italic, mono, text
  from fragments""")
def draw_call_fragments(t):
    return fr.fragments_of(t.draw_calls).select(
        "doc_id", "page_no", "x", "y", "font_size", "font_name", "bold", "italic", "mono", "text")


@query("composed_positions", "select doc_id, page_no, seq, case when seq = 0 then 0.0 else y end as y, font_size from fragments")
def composed_positions(t):
    calls = fr.positioned_calls(t.draw_calls)
    return calls.filter("text <> ''").select(
        "doc_id", "page_no", F.floor((F.col("seq") - 1) / 2).cast("int").alias("seq"), "y", "font_size")


@query("fragment_widths", "select doc_id, page_no, seq, length(text) * font_size * 0.5 as width from fragments")
def fragment_widths(t):
    return fr.with_width(t.fragments).select("doc_id", "page_no", "seq", "width")


CHECK_VIEWS.update({
    "xg_area": """
        select *, length(text) * font_size * 0.5 as width, length(trim(text)) as chars from column_fragments""",
    "xg_narrow": """
        select *, width < (a_end - a_start) * 0.55 as narrow from (select *,
          min(x) over (partition by doc_id, page_no) as a_start, max(x + width) over (partition by doc_id, page_no) as a_end,
          count(*) over (partition by doc_id, page_no) as n from xg_area) w""",
    "xg_gutter": """
        select doc_id, page_no, far as g_start, x as g_end from (select *,
            max(x + width) over (partition by doc_id, page_no order by x, x + width
              rows between unbounded preceding and 1 preceding) as far from xg_narrow where narrow) s
        where x > far and x - far >= greatest(11 * 1.2, 12)""",
    "xg_page": """
        select doc_id, page_no, any_value(n) as n, any_value(a_start) as a_start, any_value(a_end) as a_end,
          sum(case when narrow then 1 else 0 end) as n_narrow, sum(case when narrow then chars else 0 end) as chars
        from xg_narrow group by 1, 2""",
    "xg_band": """
        select doc_id, page_no, band, count(*) as members, sum(chars) as chars, count(distinct y) as rows,
          median(width) as typical, max(width) as widest, min(y) as low, max(y) as high
        from (select f.*, (select count(*) from xg_gutter g where g.doc_id = f.doc_id and g.page_no = f.page_no
            and g.g_end <= f.x) as band from xg_narrow f where narrow) b group by 1, 2, 3""",
    "xg_ok": """
        select p.doc_id, p.page_no, g.n + 1 as column_count from xg_page p
        join (select doc_id, page_no, count(*) as n, min(g_start) as g_start, max(g_end) as g_end from xg_gutter
          group by 1, 2) g on g.doc_id = p.doc_id and g.page_no = p.page_no
        where p.n >= 6 and p.n_narrow >= 6 and g.n = 1 and g_start - a_start >= (a_end - a_start) * 0.15
          and a_end - g_end >= (a_end - a_start) * 0.15
          and not exists (select 1 from xg_band b where b.doc_id = p.doc_id and b.page_no = p.page_no
            and (b.members < 3 or b.chars < p.chars * 0.15 or b.rows < 6 or b.typical < b.widest * 0.45))
          and (select min(high) - max(low) >= 0.5 * min(high - low) or min(high - low) <= 0 from xg_band b
            where b.doc_id = p.doc_id and b.page_no = p.page_no)""",
})


@query("column_gutters", """
  select p.doc_id, p.page_no, coalesce(string_agg(cast(cast(g.g_start * 2 as bigint) as varchar) || '-'
    || cast(cast(g.g_end * 2 as bigint) as varchar), '|' order by g.g_start), '') as gutters
  from xg_page p left join xg_gutter g on g.doc_id = p.doc_id and g.page_no = p.page_no group by 1, 2""")
def column_gutters(t):
    rows = columns.gutters(fr.with_width(t.column_fragments))
    edge = F.transform("gutters", lambda g: F.concat_ws(
        "-", (g["start"] * 2).cast("long").cast("string"), (g["end"] * 2).cast("long").cast("string")))
    return rows.select("doc_id", "page_no", F.array_join(edge, "|").alias("gutters"))


@query("column_layout", """
  select p.doc_id, p.page_no, cast(coalesce(o.column_count, 1) as int) as column_count from xg_page p
  left join xg_ok o on o.doc_id = p.doc_id and o.page_no = p.page_no""")
def column_layout(t):
    return columns.column_layout(fr.with_width(t.column_fragments)).select("doc_id", "page_no", "column_count")


@query("column_reading_order", """
  select f.doc_id, f.page_no, f.seq, row_number() over (partition by f.doc_id, f.page_no
    order by case when o.column_count is null then 0 else f.seq % 2 end, f.y desc, f.x) as place
  from column_fragments f left join xg_ok o on o.doc_id = f.doc_id and o.page_no = f.page_no
  where not exists (select 1 from xg_gutter g where g.doc_id = f.doc_id and g.page_no = f.page_no
    and o.column_count is not null and f.x < g.g_start and f.x + length(f.text) * 5.5 > g.g_end)""")
def column_reading_order(t):
    from pyspark.sql import Window

    measured = fr.with_width(t.column_fragments)
    ordered = columns.reading_order(measured, columns.column_layout(measured))
    within = Window.partitionBy("doc_id", "page_no").orderBy("rank", F.col("y").desc(), "x")
    return ordered.filter("column >= 0").select("doc_id", "page_no", "seq", F.row_number().over(within).alias("place"))


@query("visual_lines", "select doc_id, page_no, line_no, text, x, y, font_size, cast(bold as double) as bold_ratio from xc_lines")
def visual_lines(t):
    return _lines(t).select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text", "x", "y",
                            "font_size", "bold_ratio")


@query("table_lines", """
  select doc_id, cast(row_no as bigint) as row_no, c0 || ' ' || c1 || ' ' || c2 as text, 3 as cells from table_rows""")
def table_lines(t):
    rows = ln.lines_of(t.table_fragments)[0]
    return rows.select("doc_id", ((700 - F.col("y")) / 20).cast("long").alias("row_no"), "text",
                       F.size("cells").alias("cells"))


@query("body_size", "select doc_id, body_size from xc_body")
def body_size(t):
    return ln.body_size(_lines(t))


@query("margin_marks", "select doc_id, page_no, line_no, boilerplate from xc_marks")
def margin_marks(t):
    return _marked(t)[2].filter("boilerplate is not null").select(
        "doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "boilerplate")


@query("margin_report", """
  select m.doc_id, m.edge, m.band, count(*) as marked, m.edge || ' à ' || cast(m.band * 3 as varchar) || 'pt du bord sur '
    || any_value(b.touched) || '/' || any_value(b.pages) || ' pages (' || count(*) || ' lignes)' as text
  from xc_marks m join xc_bands b on b.doc_id = m.doc_id and b.edge = m.edge and b.band = m.band group by 1, 2, 3""")
def margin_report(t):
    _, _, lines, bands, _ = _marked(t)
    return margins.margin_report(lines, bands).select("doc_id", "edge", "band", "marked", "text")


@query("accepted_tables", """
  select doc_id, sum(case when bold then 0 else 1 end)::bigint as rows, max(case when bold then 1 else 0 end) = 1 as headed
  from table_rows group by 1 having count(*) >= 3""")
def accepted_tables(t):
    tables = st.marked_lines(t.table_fragments, t.table_pages)[4]
    return tables.select("doc_id", F.size("rows").cast("long").alias("rows"), F.col("headers").isNotNull().alias("headed"))


@query("median_leading", 'select doc_id, gap_median as "leading" from xc_leading')
def median_leading(t):
    return par.median_leading(_lines(t))


@query("layout_paragraphs", "select doc_id, page_no, line_no, text, line_count, font_size, page_end from xc_par")
def layout_paragraphs(t):
    return _paragraphs(t)[0].select(
        "doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text",
        F.col("line_count").cast("long").alias("line_count"), "font_size", "page_end")


@query("heading_scores", """
  select doc_id, page_no, line_no, type, case when type in ('HEADING', 'PARAGRAPH') then score else 0 end as score
  from xc_type""")
def heading_scores(t):
    rows, lines = _paragraphs(t)
    typed = classify(rows, ln.body_size(lines), lines)
    score = F.when(F.col("type").isin("HEADING", "PARAGRAPH"), F.col("score")).otherwise(0)
    return typed.select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "type",
                        score.cast("long").alias("score"))


@query("formula_lines", """
  select doc_id, page_no, line_no from formula_source where length(text) between 1 and 80
    and regexp_matches(text, '[=≈≠≤≥±×÷∑∏∫√∈∉⊂⊃∪∩→←⇒⇔∂∇∞]|[⁰-⁹²³¹]|\\^\\s*\\d')
    and length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) < 0.5""")
def formula_lines(t):
    from paideon.operators.classify import formula_confidence

    rows = t.formula_source.withColumn("line_count", F.lit(1))
    return rows.filter(formula_confidence(F.col("text")).isNotNull()).select("doc_id", "page_no", "line_no")


@query("normalized_text", """
  select doc_id, trim(regexp_replace(nfc_normalize(translate(text, chr(160) || chr(8239), '  ')), '[ \\t]+', ' ', 'g')) as text
  from documents""")
def normalized_text(t):
    return t.documents.select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("overline_merge", "select doc_id, page_no, line_no, text from xc_type")
def overline_merge(t):
    rows, lines = _paragraphs(t)
    merged = merge_overlines(stage(classify(rows, ln.body_size(lines), lines), "paragraphs", fr.DEALT))
    return merged.select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text")


@query("content_blocks", "select doc_id, element_no, kind, heading_no, text, page_start, page_end from xc_block")
def content_blocks(t):
    return _structure(t).blocks.select("doc_id", "element_no", "kind", "heading_no", "text", "page_start", "page_end")


@query("heading_levels", "select doc_id, heading_no, wanted from xc_heading")
def heading_levels(t):
    headings = _structure(t).elements.filter("kind is null")
    return tree.heading_levels(headings).select("doc_id", "heading_no", F.col("wanted").cast("long").alias("wanted"))


@query("section_tree", """
  select s.doc_id, s.heading_no, s.parent_no, s.level, s.text as title,
    least(s.page_start, b.page_start) as page_start, greatest(s.page_end, b.page_end) as page_end
  from xc_section s left join (select doc_id, heading_no, min(page_start) as page_start, max(page_end) as page_end
    from xc_block group by 1, 2) b on b.doc_id = s.doc_id and b.heading_no = s.heading_no
  union all select doc_id, 0, null, 1, 'Introduction', min(page_start), max(page_end) from xc_block
    where heading_no = 0 group by 1""")
def section_tree(t):
    return _structure(t).sections.select("doc_id", "heading_no", "parent_no", F.col("level").cast("long").alias("level"),
                                         "title", "page_start", "page_end")


@query("section_paths", """
  with placed as (select doc_id, heading_no, parent_no, level, row_number() over (partition by doc_id, parent_no
      order by heading_no) - 1 as position from (select doc_id, heading_no, parent_no, level from xc_section
      union all select distinct doc_id, 0, null, 1 from xc_block where heading_no = 0) s),
    recursive_path as (select p.doc_id, p.heading_no, case p.level
      when 1 then cast(p.position as varchar)
      when 2 then q.position || '.' || p.position
      when 3 then r.position || '.' || q.position || '.' || p.position
      else v.position || '.' || r.position || '.' || q.position || '.' || p.position end as path
      from placed p left join placed q on q.doc_id = p.doc_id and q.heading_no = p.parent_no
      left join placed r on r.doc_id = q.doc_id and r.heading_no = q.parent_no
      left join placed v on v.doc_id = r.doc_id and v.heading_no = r.parent_no)
  select * from recursive_path""")
def section_paths(t):
    rows = tree.sort_paths(_structure(t).sections)
    path = F.array_join(F.transform("path", lambda p: p.cast("string")), ".")
    return rows.select("doc_id", "heading_no", path.alias("path"))


@query("section_block_totals", """
  select s.doc_id, s.heading_no, (select count(*) from xc_block b where b.doc_id = s.doc_id and b.heading_no >= s.heading_no
      and b.heading_no < coalesce((select min(n.heading_no) from xc_level n where n.doc_id = s.doc_id
        and n.heading_no > s.heading_no and n.level <= s.level), 9999999)) as blocks
  from (select doc_id, heading_no, level from xc_level union all select distinct doc_id, 0, 99 from xc_block
    where heading_no = 0) s where s.heading_no > 0
  union all select doc_id, 0, count(*) from xc_block where heading_no = 0 group by 1""")
def section_block_totals(t):
    result = _structure(t)
    return tree.block_totals(result.sections, result.blocks)


@query("quality_report", """
  select p.doc_id, p.pages, coalesce(m.n, 0) as boilerplate_removed, coalesce(e.paragraphs, 0) as paragraphs,
    coalesce(e.headings, 0) as headings, coalesce(b.blocks, 0) as blocks, coalesce(b.lists, 0) as lists
  from (select doc_id, count(*) as pages from layout_pages group by 1) p
  left join (select doc_id, count(*) as n from xc_marks group by 1) m on m.doc_id = p.doc_id
  left join (select doc_id, count(*) as paragraphs, sum(case when type = 'HEADING' then 1 else 0 end)::bigint as headings
    from xc_type group by 1) e on e.doc_id = p.doc_id
  left join (select doc_id, count(*) as blocks, sum(case when kind = 'LIST' then 1 else 0 end)::bigint as lists
    from xc_block group by 1) b on b.doc_id = p.doc_id""")
def quality_report(t):
    return _structure(t).report().select("doc_id", "pages", "boilerplate_removed", "paragraphs", "headings", "blocks", "lists")


@query("document_anomalies", """
  select doc_id, 'AMBIGUOUS_HEADING' as kind, count(*) as n from xc_type where type = 'HEADING' and score < 70 group by 1
  union all select doc_id, 'OVERSIZED_BLOCK', count(*) from xc_block where length(text) > 6000 group by 1
  union all select doc_id, 'NO_HEADINGS', 1 from xc_type group by 1 having sum(case when type = 'HEADING' then 1 else 0 end) = 0""")
def document_anomalies(t):
    return _structure(t).anomalies().groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("stored_blocks", """
  select doc_id, heading_no, element_no - min(element_no) over (partition by doc_id, heading_no) as position, kind, text
  from xc_block""")
def stored_blocks(t):
    return st.document_tables(_structure(t))[1].select("doc_id", "heading_no", "position", "kind", "text")


@query("document_preview", """
  select b.doc_id, b.element_no, coalesce(s.text, 'Introduction') as title, b.kind, substring(b.text, 1, 160) as text
  from xc_block b left join xc_heading s on s.doc_id = b.doc_id and s.heading_no = b.heading_no""")
def document_preview(t):
    result = _structure(t)
    rows = st.preview(result).select("doc_id", "path", "title", "position", "kind", "text")
    # The element number puts the preview rows next to the checking rows.
    keys = tree.block_positions(result.blocks).join(
        tree.sort_paths(result.sections).select("doc_id", "heading_no", "path"), ["doc_id", "heading_no"]
    ).select("doc_id", "path", "position", "element_no")
    return rows.join(keys, ["doc_id", "path", "position"]).select("doc_id", "element_no", "title", "kind", "text")


@query("corpus_blocks", """
  select b.doc_id, d.source || '_' || d.doc_id || '-cours.pdf' as source_file, coalesce(s.text, 'Introduction') as
    section_title, b.kind, b.text, b.page_start, b.page_end from xc_block b join documents d on d.doc_id = b.doc_id
  left join xc_heading s on s.doc_id = b.doc_id and s.heading_no = b.heading_no""")
def corpus_blocks(t):
    files = t.imported_documents.withColumnRenamed("document_id", "doc_id")
    return st.corpus_blocks(files, _structure(t)).drop("element_no")


@query("import_outcome", """
  select doc_id, lang = 'en' as create_course, doc_id % 7 <> 3 as has_tree, lang = 'en' or doc_id % 7 <> 3 as imported
  from documents""")
def import_outcome(t):
    # Every seventh document has a fragment without position.
    lost = (F.col("doc_id") % 7 == 3) & (F.col("seq") == 0)
    fragments = t.fragments.withColumn("x", F.when(~lost, F.col("x")))
    files = t.documents.select("doc_id", (F.col("lang") == "en").alias("create_course"))
    imported, failed = st.route_documents(files, fragments)
    return imported.select("doc_id", "create_course", "has_tree", F.lit(True).alias("imported")).unionByName(
        failed.select("doc_id", "create_course", F.lit(False).alias("has_tree"), F.lit(False).alias("imported")))
