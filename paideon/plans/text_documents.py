"""Queries over page text: lines, boilerplate, headings, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.operators import textchunk as tc
from paideon.plans.registry import CHECK_VIEWS, query

_PAGE_NUMBER = r"(?i)^(\d{1,4}$|[-–—]\s*\d{1,4}\s*[-–—]$|p(age)?\.?\s*\d{1,4}\b|\d{1,4}\s*(/|sur|of|\|)\s*\d{1,4}$)"
_NUMBERED = (r"(?i)^((chapitre|partie|section|module|annexe)\s+\d+\b|\d+(\.\d+)*[.\)]?\s+\S|[IVXLCDM]{1,6}[.\)]\s+\S)")
_LEADING = (r"(?i)^(le|la|les|un|une|des|de|du|et|ou|mais|donc|car|ni|que|qui|dans|pour|avec|sur|sous|par|the|a|an|and|or|"
            r"but|of|in|on|for|with)([^\p{L}\p{N}_]|$)")
_FOOTNOTE = r"(?i)^\d+(\.\d+)*[.\)]?\s+(voir\b|cf\.|source\s*:)"
_URL = r"(?i)(https?://|www\.\w|\b\w[\w-]*\.(com|org|net|fr|io|edu)\b)"

CHECK_VIEWS.update({
    "chk_margin": """
        select *, text <> '' and (rk <= band or rk > n - band) as in_margin,
          lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as exact_form,
          regexp_replace(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), '\\d+', '#', 'g') as digit_form,
          regexp_matches(text, '{pn}') as is_pn
        from (select *, sum(case when text <> '' then 1 else 0 end) over (partition by doc_id, page_no order by line_no) as rk,
            sum(case when text <> '' then 1 else 0 end) over (partition by doc_id, page_no) as n,
            case when sum(case when text <> '' then 1 else 0 end) over (partition by doc_id, page_no) > 4 then 2 else 1 end
              as band from page_lines) x""".replace("{pn}", _PAGE_NUMBER),
    "chk_pages": "select doc_id, count(distinct page_no) as pages from page_lines group by 1",
    "chk_forms": """
        select f.doc_id, f.kind, f.form, count(distinct page_no) as n from (
          select doc_id, page_no, 'exact' as kind, exact_form as form from chk_margin where in_margin and length(text) <= 120
          union all select doc_id, page_no, 'digits', digit_form from chk_margin
            where in_margin and length(text) <= 120 and is_pn) f
        join chk_pages p on p.doc_id = f.doc_id group by f.doc_id, f.kind, f.form, p.pages
        having count(distinct page_no) >= greatest(3, floor(p.pages * 0.25))""",
    "chk_flag": """
        select m.*, in_margin and (exists (select 1 from chk_forms f where f.doc_id = m.doc_id and f.kind = 'exact'
            and f.form = m.exact_form) or (is_pn and exists (select 1 from chk_forms f where f.doc_id = m.doc_id
            and f.kind = 'digits' and f.form = m.digit_form))) as boilerplate from chk_margin m""",
    "chk_list": """
        select doc_id, page_no, line_no from (select *, lag(num) over w as prv, lead(num) over w as nxt from (
            select *, case when regexp_matches(text, '^\\d{1,3}[.)]\\s+\\S')
              then cast(regexp_extract(text, '^(\\d{1,3})', 1) as int) end as num from page_lines where text <> '') v
          window w as (partition by doc_id, page_no order by line_no)) y
        where num = prv + 1 or nxt = num + 1""",
    "chk_isolated": """
        select f.*, l.line_no is not null as in_list,
          not boilerplate and text <> '' and coalesce(sum(case when not boilerplate and text <> '' then 1 else 0 end)
            over (partition by f.doc_id, f.page_no order by f.line_no rows between unbounded preceding and 1 preceding), 0)
            = 0 as first_visible,
          coalesce(last_value(case when not boilerplate then text = '' end ignore nulls)
            over (partition by f.doc_id, f.page_no order by f.line_no rows between unbounded preceding and 1 preceding), true)
            as blank_above
        from chk_flag f left join chk_list l on l.doc_id = f.doc_id and l.page_no = f.page_no and l.line_no = f.line_no""",
    "chk_heading": """
        select *, first_visible or blank_above as isolated, not boilerplate and not in_list and text <> ''
          and length(text) <= 90 and case when regexp_matches(text, '{num}')
            then not (regexp_matches(text, '{foot}') or regexp_matches(text, '{url}'))
            else (length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 3 and text = upper(text))
              or ((first_visible or blank_above) and length(text) <= 70 and not regexp_matches(text, '[.!?…]$')
                and not regexp_matches(text, '{lead}') and regexp_matches(text, '^\\p{Lu}')) end as heading
        from chk_isolated""".replace("{num}", _NUMBERED).replace("{foot}", _FOOTNOTE).replace("{url}", _URL)
    .replace("{lead}", _LEADING),
    "chk_section": """
        select doc_id, page_no, line_no, text, heading,
          sum(case when heading then 1 else 0 end) over w as section_no,
          sum(case when heading or text = '' then 1 else 0 end) over w as paragraph_no
        from chk_heading where not boilerplate window w as (partition by doc_id order by page_no, line_no)""",
    "chk_body": """
        select p.doc_id, p.section_no, coalesce(h.text, 'Introduction') as title, p.body from (
          select doc_id, section_no, string_agg(body, chr(10) || chr(10) order by paragraph_no) as body from (
            select doc_id, section_no, paragraph_no, string_agg(text, ' ' order by page_no, line_no) as body
            from chk_section where not heading and text <> '' group by 1, 2, 3) q group by 1, 2) p
        left join chk_section h on h.doc_id = p.doc_id and h.section_no = p.section_no and h.heading""",
})


def _classified(t):
    return tc.classify_lines(tc.page_lines(t.document_pages), t.document_pages)


@query("page_lines", "select doc_id, page_no, line_no, text from page_lines")
def page_lines(t):
    return tc.page_lines(t.document_pages)


@query("normal_forms", """
  select doc_id, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as exact_form,
    regexp_replace(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), '\\d+', '#', 'g') as digit_form from documents""")
def normal_forms(t):
    text = F.col("text")
    return t.documents.select("doc_id", tx.norm_exact(text).alias("exact_form"), tx.norm_digits(text).alias("digit_form"))


@query("page_number_lines", f"""
  select doc_id, page_no, line_no from page_lines where regexp_matches(text, '{_PAGE_NUMBER}')""")
def page_number_lines(t):
    return t.page_lines.filter(tx.is_page_number(F.col("text"))).select("doc_id", "page_no", "line_no")


@query("footnote_lines", f"""
  select doc_id, page_no, line_no from page_lines where regexp_matches(text, '{_FOOTNOTE}') or regexp_matches(text, '{_URL}')""")
def footnote_lines(t):
    return t.page_lines.filter(tx.is_footnote(F.col("text"))).select("doc_id", "page_no", "line_no")


@query("margin_lines", "select doc_id, page_no, line_no from chk_margin where in_margin")
def margin_lines(t):
    return tc.margin_flag(tc.with_chunk(t.page_lines)).filter("in_margin").select("doc_id", "page_no", "line_no")


@query("boilerplate_forms", "select doc_id, kind, form, n from chk_forms")
def boilerplate_forms(t):
    return tc.boilerplate_forms(tc.margin_flag(tc.with_chunk(t.page_lines)))


@query("boilerplate_lines", "select doc_id, page_no, line_no from chk_flag where boilerplate")
def boilerplate_lines(t):
    marked = tc.margin_flag(tc.with_chunk(t.page_lines))
    flagged = tc.boilerplate_flag(marked, tc.boilerplate_forms(marked))
    return flagged.filter("boilerplate").select("doc_id", "page_no", "line_no")


@query("ordered_list_lines", f"select * from ({CHECK_VIEWS['chk_list'].replace('page_lines', 'numbered_lines')}) x")
def ordered_list_lines(t):
    return tc.ordered_list_flag(tc.with_chunk(t.numbered_lines)).filter("in_list").select("doc_id", "page_no", "line_no")


@query("isolated_lines", "select doc_id, page_no, line_no from chk_isolated where first_visible or blank_above")
def isolated_lines(t):
    return _classified(t).filter("isolated").select("doc_id", "page_no", "line_no")


@query("heading_lines", "select doc_id, page_no, line_no, text from chk_heading where heading")
def heading_lines(t):
    return _classified(t).filter("heading").select("doc_id", "page_no", "line_no", "text")


@query("line_sections", "select doc_id, page_no, line_no, section_no, paragraph_no from chk_section")
def line_sections(t):
    return tc.assign_sections(_classified(t)).select("doc_id", "page_no", "line_no", "section_no", "paragraph_no")


@query("text_paragraphs", """
  select doc_id, section_no, paragraph_no, string_agg(text, ' ' order by page_no, line_no) as text
  from chk_section where not heading and text <> '' group by 1, 2, 3""")
def text_paragraphs(t):
    return tc.paragraphs(tc.assign_sections(_classified(t)))


@query("section_bodies", "select doc_id, section_no, title, body from chk_body")
def section_bodies(t):
    return tc.chunk_pages(tc.page_lines(t.document_pages), t.document_pages)


@query("import_summary", """
  select d.doc_id, d.n as page_count, d.empty_pages, b.summary,
    case when d.empty_pages = d.n then 'Aucun texte n''a pu être extrait — ce PDF est probablement scanné (image sans couche '
      || 'de texte). Une leçon vide a été créée ; l''OCR n''est pas encore pris en charge.'
      when d.empty_pages > 0 then d.empty_pages || ' page(s) sur ' || d.n || ' sans texte extractible, ignorée(s).' end as warning
  from (select doc_id, count(*) as n,
      sum(case when trim(text) = '' then 1 else 0 end)::bigint as empty_pages from (select doc_id, case when doc_id % 5 = 1 or (doc_id % 5 = 2 and page_no = 1) then '' else text end as text
      from document_pages) p group by 1) d
  left join (select doc_id, arg_min(substring(body, 1, 300), section_no) as summary from chk_body group by 1) b
    on b.doc_id = d.doc_id""")
def import_summary(t):
    files = t.imported_documents.withColumnRenamed("document_id", "doc_id")
    blank = (F.col("doc_id") % 5 == 1) | ((F.col("doc_id") % 5 == 2) & (F.col("page_no") == 1))
    pages = t.document_pages.withColumn("text", F.when(blank, "").otherwise(F.col("text")))
    bodies = tc.chunk_pages(tc.page_lines(t.document_pages), t.document_pages)
    return tc.import_summary(files, pages, bodies).select("doc_id", "page_count", "empty_pages", "summary", "warning")


@query("file_titles", """
  select doc_id, upper(source[1]) || lower(source[2:]) || ' ' || doc_id || ' Cours' as title from documents""")
def file_titles(t):
    return t.imported_documents.select(
        F.col("document_id").alias("doc_id"), tx.title_from_file_name(F.col("source_file")).alias("title"))
