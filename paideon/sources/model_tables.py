"""Model tables (users, lessons, attempts, ...) as views of the driver tables.

Every view is one SQL text that runs in Spark and in the checking engine alike;
where the two dialects differ the entry is a (spark, duckdb) pair. A view may use
any other view or driver table; only what it needs is put before it as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_CONTENT_STATUS = "case when {0} % 10 = 0 then 'DRAFT' when {0} % 10 = 1 then 'ARCHIVED' else 'PUBLISHED' end"

VIEWS: dict[str, str | tuple[str, str]] = {
    # --- people -------------------------------------------------------------
    "users": """
        select c_custkey as user_id, 'F' || cast(c_custkey % 7 as string) as first_name,
          c_mktsegment as last_name, lower(c_name) || '@x.test' as email,
          case when c_custkey % 50 = 0 then 'SUPER_ADMIN' when c_custkey % 50 = 1 then 'ADMIN'
            else 'LEARNER' end as role,
          case when c_acctbal < 0 then 'SUSPENDED' else 'ACTIVE' end as status,
          make_timestamp(2024, cast(1 + c_custkey % 12 as int), cast(1 + c_custkey % 28 as int), 8, 0, 0)
            as created_at
        from customer""",
    "user_profiles": """
        select c_custkey as user_id, c_mktsegment as profile_type_id, c_nationkey as weekly_hours,
          true as onboarding_done from customer where c_acctbal > 0""",
    "user_goals": "select distinct o_custkey as user_id, o_orderpriority as goal_id from orders",
    "user_profile_skills": """
        select distinct o_custkey as user_id, o_orderkey % 25 as skill_id from orders""",
    # --- catalogue ----------------------------------------------------------
    "schools": "select cast(r_regionkey as bigint) as school_id, r_name as name from region",
    "skills": """
        select cast(n_nationkey as bigint) as skill_id, cast(n_regionkey as bigint) as school_id,
          n_name as name from nation""",
    "courses": f"""
        select s_suppkey as course_id, cast(s_nationkey % 5 as bigint) as school_id, s_name as title,
          'N' || cast(1 + s_suppkey % 4 as string) as level, {_CONTENT_STATUS.format('s_suppkey')} as status
        from supplier""",
    "lessons": """
        select p_partkey as lesson_id, p_partkey % (select count(*) from supplier) as course_id,
          case when p_partkey % 13 = 0 then null else p_partkey % 25 end as skill_id, p_name as title,
          'N' || cast(1 + p_size % 4 as string) as level, p_size as duration_min, p_size as position,
          case when p_size % 9 = 0 then 'DRAFT' else 'PUBLISHED' end as status from part""",
    "lesson_objectives": """
        select l_partkey as lesson_id, l_linenumber as position, max(l_returnflag) as label
        from lineitem group by l_partkey, l_linenumber""",
    "lesson_sections": """
        select l_partkey as lesson_id, l_linenumber as position,
          'S' || cast(l_linenumber as string) as title, max(l_linestatus) as body
        from lineitem group by l_partkey, l_linenumber""",
    "pathways": f"""
        select cast(n_nationkey as bigint) as pathway_id, n_name as title,
          {_CONTENT_STATUS.format('n_nationkey')} as status from nation""",
    "pathway_courses": """
        select cast(s_nationkey as bigint) as pathway_id, s_suppkey as course_id, s_suppkey as position
        from supplier""",
    "resources": f"""
        select p_partkey as resource_id, p_name as title, p_brand as type,
          {_CONTENT_STATUS.format('p_partkey')} as status from part""",
    "resource_courses": "select distinct l_partkey as resource_id, l_suppkey as course_id from lineitem",
    "labs": f"""
        select p_partkey as lab_id, p_name as title, cast(p_size % 5 as bigint) as school_id,
          'N' || cast(1 + p_size % 4 as string) as level, {_CONTENT_STATUS.format('p_partkey')} as status
        from part""",
    "lab_modes": "select distinct l_partkey as lab_id, l_returnflag as mode from lineitem",
    "lab_skills": "select distinct l_partkey as lab_id, l_suppkey % 25 as skill_id from lineitem",
    "glossary": """
        select p_name as term, max(p_type) as term_en, max(p_brand) as definition from part group by p_name""",
    # --- questions and quizzes ----------------------------------------------
    "questions": """
        select p_partkey as question_id, case when p_partkey % 13 = 0 then null else p_partkey % 25 end as skill_id,
          1 + p_size % 5 as difficulty, p_name as question_text, p_brand as explanation, p_size % 4 as correct
        from part""",
    "question_options": """
        select p_partkey * 10 as option_id, p_partkey as question_id, 0 as position, p_type as option_text,
          p_size % 4 = 0 as is_correct from part
        union all select p_partkey * 10 + 1, p_partkey, 1, p_brand, p_size % 4 = 1 from part
        union all select p_partkey * 10 + 2, p_partkey, 2, p_name, p_size % 4 = 2 from part""",
    "quizzes": """
        select cast(n_nationkey as bigint) as quiz_id, 'Pratique ' || n_name as title, 'PRACTICE' as kind,
          cast(n_nationkey as bigint) as skill_id, cast(null as bigint) as lesson_id,
          cast(null as bigint) as course_id, case when n_nationkey % 2 = 0 then 40 else 60 end as pass_threshold,
          3 + n_nationkey % 5 as n_questions,
          case when n_nationkey % 12 = 11 then 'DRAFT' else 'PUBLISHED' end as status from nation
        union all select 1000 + s_suppkey, 'Final ' || s_name, 'FINAL', null, null, s_suppkey, 50, 5, 'PUBLISHED'
          from supplier
        union all select 1000000000 + p_partkey, 'Validation ' || p_name, 'VALIDATION', null, p_partkey, null,
          50, 4, 'PUBLISHED' from part""",
    "final_quizzes": "select * from quizzes where kind = 'FINAL'",
    "quiz_questions": (
        """select quiz_id, k as question_no, k - 1 as position from quizzes
           lateral view explode(sequence(1, n_questions)) n as k""",
        """select quiz_id, cast(k as int) as question_no, cast(k - 1 as int) as position from
           (select quiz_id, unnest(generate_series(1, n_questions)) as k from quizzes) q""",
    ),
    "practice_questions": """
        select skill_id as quiz_id, question_id, rn - 1 as position from (
          select skill_id, question_id, row_number() over (partition by skill_id order by question_id) as rn
          from questions where skill_id is not null) r where rn <= 10""",
    "answer_key": """
        select k as question_no, k * 10 as correct_option_id, 'E' || cast(k as string) as explanation
        from (select distinct l_linenumber as k from lineitem) t""",
    # --- learner facts ------------------------------------------------------
    "submitted_attempts": """
        select o_orderkey as attempt_id, o_custkey as user_id,
          case when o_orderkey % 4 = 0 then 1000 + 3 * (o_orderkey % 3) else o_orderkey % 25 end as quiz_id,
          o_orderdate as started_at from orders""",
    "submitted_answers": """
        select l_orderkey as attempt_id, l_linenumber as question_no,
          l_linenumber * 10 + case when l_quantity <= 40 then 0 else 1 + l_partkey % 3 end as selected_option_id,
          row_number() over (partition by l_orderkey
            order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber) as submit_seq
        from lineitem""",
    "quiz_attempts": """
        select o_orderkey as attempt_id, o_custkey as user_id,
          case when o_orderkey % 4 = 0 then 1000 + 3 * (o_orderkey % 3) else o_orderkey % 25 end as quiz_id,
          cast(floor(o_totalprice) as bigint) % 101 as score,
          cast(floor(o_totalprice) as bigint) % 101 >= 50 as passed, o_orderdate as started_at from orders""",
    "lesson_events": """
        select user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as lesson_id, event_type, ts
        from events where event_type in ('view', 'purchase')""",
    "user_lesson_progress": """
        select user_id, lesson_id,
          case when max(case when event_type = 'purchase' then 1 else 0 end) = 1 then 'COMPLETED'
            else 'IN_PROGRESS' end as status,
          max(case when event_type = 'purchase' then 100 else 50 end) as progress_pct,
          min(ts) as started_at, max(case when event_type = 'purchase' then ts end) as completed_at,
          max(ts) as updated_at
        from lesson_events group by user_id, lesson_id""",
    "user_skills": """
        select a.user_id, q.skill_id, least(count(*), 4) as mastery_level, max(a.started_at) as updated_at
        from quiz_attempts a join quizzes q on a.quiz_id = q.quiz_id
        where a.passed and q.skill_id is not null group by a.user_id, q.skill_id""",
    "lab_results": """
        select event_id as result_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as lab_id,
          'LIBRE' as mode, event_type = 'click' as completed, value as score, props as submission,
          case when event_type = 'click' then ts end as submitted_at
        from events where event_type in ('click', 'error')""",
    "portfolio_evidence": """
        select event_id as evidence_id, user_id, event_type as title, ts as created_at from events""",
    "evidence_skills": """
        select event_id as evidence_id, event_id % 25 as skill_id from events
        union select event_id, (event_id * 7) % 25 from events""",
    # --- certifications -----------------------------------------------------
    "certifications": """
        select cast(n_nationkey as bigint) as certification_id, n_name as title,
          case when n_nationkey % 10 = 1 then 'ARCHIVED' else 'PUBLISHED' end as status from nation""",
    "certification_requirements": """
        select requirement_id, certification_id, requirement_type,
          case when requirement_type = 'COURSE' then requirement_id end as course_id,
          case when requirement_type in ('LAB', 'FINAL_PROJECT') then requirement_id % 100 end as lab_id,
          case when requirement_type in ('SKILL', 'MIN_SCORE') and requirement_id % 13 <> 5
            then requirement_id % 25 end as skill_id,
          case when requirement_type = 'MIN_SCORE' and requirement_id % 7 <> 0
            then 10 + requirement_id % 60 end as min_score, description, position
        from (select s_suppkey as requirement_id, cast(s_nationkey as bigint) as certification_id,
            case when s_nationkey % 3 = 0 and s_suppkey % 2 = 0 then 'SKILL' when s_nationkey % 3 = 0 then 'MIN_SCORE'
              when s_suppkey % 6 = 0 then 'COURSE' when s_suppkey % 6 = 1 then 'LAB'
              when s_suppkey % 6 = 2 then 'SKILL' when s_suppkey % 6 = 3 then 'MIN_SCORE'
              when s_suppkey % 6 = 4 then 'EVIDENCE' else 'FINAL_PROJECT' end as requirement_type,
            s_name as description, s_suppkey as position from supplier) r""",
    # --- documents ----------------------------------------------------------
    "document_pages": (
        """select doc_id, source, page_no, array_join(concat(
             array('Support ' || source, cast(page_no + 1 as string) || '. Section ' || cast(page_no + 1 as string)),
             slice(body, 1, 3), array(''), slice(body, 4, 3), array(cast(page_no + 1 as string))), chr(10))
             || chr(10) as text
           from (select doc_id, source, page_no, slice(lines, page_no * 6 + 1, 6) as body
             from (select doc_id, source, split(text, chr(10)) as lines from documents) d
             lateral view explode(sequence(0, cast(floor((size(lines) - 1) / 6) as int))) p as page_no) b""",
        """select doc_id, source, page_no, array_to_string(list_concat(list_concat(list_concat(list_concat(
             ['Support ' || source, cast(page_no + 1 as varchar) || '. Section ' || cast(page_no + 1 as varchar)],
             body[1:3]), ['']), body[4:6]), [cast(page_no + 1 as varchar)]), chr(10)) || chr(10) as text
           from (select doc_id, source, cast(page_no as int) as page_no,
               lines[page_no * 6 + 1 : page_no * 6 + 6] as body
             from (select doc_id, source, lines,
                 unnest(generate_series(0, cast(floor((len(lines) - 1) / 6) as int))) as page_no
               from (select doc_id, source, string_split(text, chr(10)) as lines from documents) d) e) b""",
    ),
    "page_lines": (
        """select doc_id, page_no, line_no, trim(line) as text from document_pages
           lateral view posexplode(split(substring(text, 1, length(text) - 1), chr(10))) l as line_no, line""",
        """select doc_id, page_no, cast(line_no as int) as line_no, trim(line) as text
           from (select doc_id, page_no, generate_subscripts(a, 1) - 1 as line_no, unnest(a) as line
             from (select doc_id, page_no, string_split(substring(text, 1, length(text) - 1), chr(10)) as a
               from document_pages) p) l""",
    ),
    # Lines under numbers: consecutive ones, gaps, and lines without.
    "numbered_lines": """
        select doc_id, page_no, line_no, case when text = '' or line_no % 7 = 6 then text
            when doc_id % 3 = 0 then cast(line_no + 1 as string) || '. ' || text
            when doc_id % 3 = 1 then cast(line_no * 2 as string) || ') ' || text else text end as text
        from page_lines""",
    # Lines with a formula beside lines of the given text.
    "formula_source": """
        select doc_id, page_no, line_no, case when line_no % 4 = 1 then 'x' || cast(doc_id as string) || ' = ' ||
            cast(page_no * 3 as string) || ' + 2²' when line_no % 4 = 2 then text || ' = 4' else text end as text
        from page_lines""",
    "fragments": """
        select doc_id, page_no, line_no as seq, text, cast(72.0 as double) as x,
          cast(737 - 17 * line_no as double) as y,
          cast(case when line_no = 1 then 16 when line_no = 0 then 9
            when text = cast(page_no + 1 as string) then 9 else 11 end as double) as font_size,
          case when line_no = 1 then 'Helvetica-Bold' else 'Helvetica' end as font_name,
          line_no = 1 as bold, false as italic, false as mono
        from page_lines where text <> ''""",
    "layout_pages": """
        select distinct doc_id, page_no, cast(612 as double) as width, cast(792 as double) as height
        from page_lines""",
    # Positioning calls and text calls that draw `fragments`: size in the matrix on
    # visible line 1, an empty text matrix on line 0 (repaired) and from line 3 on
    # (set by the Td before it).
    "draw_calls": (
        """select doc_id, page_no, line_no * 2 as seq, 'Td' as kind, '' as text,
             array(1D, 0D, 0D, 1D, 0D, 0D) as tm, array(1D, 0D, 0D, 1D, 0D, 0D) as cm,
             array(72D, cast(737 - 17 * line_no as double)) as operands, '' as font_name, 1D as font_size
           from page_lines where line_no > 0
           union all select f.doc_id, f.page_no, f.seq * 2 + 1, 'text', f.text,
             case when f.seq = 1 then array(f.font_size, 0D, 0D, f.font_size, f.x, f.y)
               when f.seq = 2 then array(1D, 0D, 0D, 1D, f.x / 2, f.y / 2) else array(1D, 0D, 0D, 1D, 0D, 0D) end,
             case when f.seq = 2 then array(2D, 0D, 0D, 2D, 0D, 0D) else array(1D, 0D, 0D, 1D, 0D, 0D) end,
             cast(null as array<double>), '/ABCDEF+' || f.font_name,
             case when f.seq = 1 then 1D when f.seq = 2 then f.font_size / 2 else f.font_size end from fragments f""",
        "select 1",
    ),
    # One page per order: its lines as rows of three cells under a header row.
    "table_rows": """
        select l_orderkey as doc_id, row_number() over (partition by l_orderkey
            order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber) as row_no,
          l_returnflag || l_linestatus || '-' || cast(l_partkey as string) as c0,
          cast(cast(floor(l_quantity) as bigint) as string) as c1,
          cast(cast(floor(l_extendedprice) as bigint) as string) as c2, false as bold from lineitem
        union all select o_orderkey, 0, 'Article', 'Quantite', 'Prix', true from orders
          where o_orderpriority <> '1-URGENT'""",
    "table_fragments": (
        """select doc_id, 0 as page_no, row_no * 3 + k as seq, case k when 0 then c0 when 1 then c1 else c2 end as text,
             cast(case k when 0 then 72 when 1 then 200 else 330 end as double) as x,
             cast(700 - 20 * row_no as double) as y, cast(11 as double) as font_size, 'Helvetica' as font_name, bold,
             false as italic, false as mono
           from table_rows lateral view explode(array(0, 1, 2)) c as k""",
        """select doc_id, 0 as page_no, row_no * 3 as seq, c0 as text, cast(72 as double) as x,
             cast(700 - 20 * row_no as double) as y, cast(11 as double) as font_size, 'Helvetica' as font_name, bold,
             false as italic, false as mono from table_rows
           union all select doc_id, 0, row_no * 3 + 1, c1, cast(200 as double), cast(700 - 20 * row_no as double),
             cast(11 as double), 'Helvetica', bold, false, false from table_rows
           union all select doc_id, 0, row_no * 3 + 2, c2, cast(330 as double), cast(700 - 20 * row_no as double),
             cast(11 as double), 'Helvetica', bold, false, false from table_rows""",
    ),
    "table_pages": """
        select o_orderkey as doc_id, 0 as page_no, cast(612 as double) as width, cast(792 as double) as height
        from orders""",
    # Document words in two columns of five words a row, forty rows to the page.
    "column_fragments": (
        """select doc_id, cast(floor(k / 80) as int) as page_no, k % 80 as seq, text,
             cast(case when k % 2 = 0 then 72 else 380 end as double) as x,
             cast(740 - 17 * floor(k % 80 / 2) as double) as y, 11D as font_size, 'Helvetica' as font_name,
             false as bold, false as italic, false as mono
           from (select doc_id, k, array_join(slice(w, k * 5 + 1, 5), ' ') as text
             from (select doc_id, split(regexp_replace(text, '[ ' || chr(10) || ']+', ' '), ' ') as w from documents) d
             lateral view explode(sequence(0, cast(floor((size(w) - 1) / 5) as int))) s as k) f
           where trim(text) <> ''""",
        """select doc_id, cast(floor(k / 80) as int) as page_no, cast(k % 80 as int) as seq, text,
             cast(case when k % 2 = 0 then 72 else 380 end as double) as x,
             cast(740 - 17 * floor(k % 80 / 2) as double) as y, 11::double as font_size
           from (select doc_id, k, array_to_string(w[k * 5 + 1 : k * 5 + 5], ' ') as text
             from (select doc_id, w, unnest(generate_series(0, cast(floor((len(w) - 1) / 5) as int))) as k
               from (select doc_id, string_split(regexp_replace(text, '[ ' || chr(10) || ']+', ' ', 'g'), ' ') as w
                 from documents) d) e) f
           where trim(text) <> ''""",
    ),
    "imported_documents": """
        select doc_id as document_id, doc_id % (select count(*) from part) as lesson_id,
          source || '_' || cast(doc_id as string) || '-cours.pdf' as source_file, n_chars as page_count,
          lang as created_at from documents""",
}

_NAME = re.compile(r"[a-z_]+")


def _needs(text: str, known: set[str]) -> list[str]:
    return [w for w in dict.fromkeys(_NAME.findall(text)) if w in known]


def with_views(body: str, engine: str, extra: dict[str, str] | None = None) -> str:
    """Put the views used by `body`, and those they use, before it as CTEs."""
    pick = 0 if engine == "spark" else 1
    texts = {n: (v if isinstance(v, str) else v[pick]) for n, v in VIEWS.items()} | (extra or {})
    order: list[str] = []

    def visit(text: str, self_name: str | None = None) -> None:
        for name in _needs(text, set(texts)):
            if name != self_name and name not in order:
                visit(texts[name], name)
                order.append(name)

    visit(body)
    if not order:
        return body
    # The checking engine repeats a CTE for every use unless told otherwise.
    how = "as" if engine == "spark" else "as materialized"
    heads = ", ".join(f"{n} {how} ({texts[n]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {heads}, {body[5:]}"
    return f"with {heads} {body}"


class ModelTables:
    """The driver tables and model views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def sql(self, body: str) -> DataFrame:
        files = {n: f"select * from parquet.`{self.folder}/{n}.parquet`" for n in DRIVER_TABLES}
        return self.spark.sql(with_views(body, "spark", files))
