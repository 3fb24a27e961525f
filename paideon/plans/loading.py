"""Queries over the loader: catalogue scan, upserts, edges and generated children."""

from __future__ import annotations

from pyspark.sql import functions as F

from paideon.operators import merge
from paideon.operators.slugs import assign_slugs
from paideon.plans.registry import query
from paideon.session import stage
from paideon.sources import catalogue as src

# Catalogue documents with one lesson and one question per part, as JSON text.
_DOCUMENTS = """
  select to_json(named_struct(
    'lessons', array(named_struct('id', cast(p_partkey as string), 'courseId', cast(p_partkey % 50 as string),
       'title', p_name, 'duration', p_size,
       'objectives', array(p_type, p_brand),
       'depth', named_struct('essential', named_struct('title', p_type),
         'mathematics', case when p_size % 2 = 0 then named_struct('body', p_brand) end))),
    'questions', array(named_struct('id', cast(p_partkey as string), 'skillId', cast(p_partkey % 25 as string),
       'difficulty', 1 + p_size % 5, 'question', p_name, 'options', array(p_type, p_brand, p_name),
       'correct', case when p_size % 4 < 3 then p_size % 4 end)),
    'analytics', p_retailprice)) as doc from part"""


def _catalogue(t):
    return src.parse_catalogue(t.sql(_DOCUMENTS), "doc")


@query("catalogue_scan", """
  select cast(p_partkey as varchar) as lesson_id, p_name as title, p_size as duration, p_type || '|' || p_brand as objectives
  from part""")
def catalogue_scan(t):
    return _catalogue(t)["lessons"].select(
        F.col("id").alias("lesson_id"), "title", "duration", F.array_join("objectives", "|").alias("objectives"))


@query("depth_levels", """
  select cast(p_partkey as varchar) as lesson_id, 'ESSENTIAL' as depth_key, 'Essentiel' as label, p_type as title,
    '' as body from part
  union all select cast(p_partkey as varchar), 'MATHEMATICS', 'Mathématiques', 'Mathématiques', p_brand from part
    where p_size % 2 = 0""")
def depth_levels(t):
    return src.depth_levels(_catalogue(t)["lessons"]).withColumnRenamed("id", "lesson_id")


@query("question_option_rows", """
  select cast(question_id as varchar) as question_id, position, option_text, is_correct from question_options""")
def question_option_rows(t):
    return src.question_options(_catalogue(t)["questions"]).withColumnRenamed("id", "question_id")


@query("upsert_users", """
  with batch as (select o_custkey + case when o_orderkey % 50 = 0 then 1000000000 else 0 end as c_custkey,
      arg_max(o_orderpriority, o_orderkey) as seg,
      arg_max(struct_pack(v := case when o_orderstatus = 'F' then null else o_totalprice end), o_orderkey).v as bal
    from orders group by 1)
  select coalesce(c.c_custkey, b.c_custkey) as c_custkey, c.c_name,
    case when b.c_custkey is not null then b.seg else c.c_mktsegment end as c_mktsegment,
    case when b.c_custkey is not null then b.bal else c.c_acctbal end as c_acctbal
  from customer c full outer join batch b on b.c_custkey = c.c_custkey""")
def upsert_users(t):
    batch = t.sql("""select o_custkey + case when o_orderkey % 50 = 0 then 1000000000 else 0 end as c_custkey,
        o_orderpriority as c_mktsegment, case when o_orderstatus = 'F' then null else o_totalprice end as c_acctbal,
        o_orderkey as seq from orders""")
    return merge.upsert(t.customer, batch, "c_custkey", ["c_mktsegment", "c_acctbal"], "seq").select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("insert_lessons_once", """
  select p_partkey, p_name from part
  union all select distinct l_partkey + 1000000000, 'new' from lineitem where l_returnflag = 'R'""")
def insert_lessons_once(t):
    batch = t.sql("""select distinct l_partkey + case when l_returnflag = 'R' then 1000000000 else 0 end as p_partkey,
        'new' as p_name from lineitem""")
    return merge.insert_once(t.part.select("p_partkey", "p_name"), batch, "p_partkey")


@query("insert_absent_edges", """
  with stored as (select distinct s_nationkey as pathway_id, s_suppkey as course_id, s_suppkey as position from supplier),
    listed as (select n_nationkey as pathway_id, n_nationkey as course_id, 0 as pos from nation
      union all select n_nationkey, n_regionkey, 1 from nation union all select n_nationkey, n_nationkey * 2, 2 from nation)
  select * from stored union all
  select pathway_id, course_id, min(pos) from listed l where not exists (select 1 from stored s
    where s.pathway_id = l.pathway_id and s.course_id = l.course_id) group by 1, 2""")
def insert_absent_edges(t):
    stored = t.sql("select s_nationkey as pathway_id, s_suppkey as course_id, s_suppkey as position from supplier")
    parents = t.sql("""select n_nationkey as pathway_id,
        array(cast(n_nationkey as bigint), cast(n_regionkey as bigint), cast(n_nationkey * 2 as bigint)) as courses
        from nation""")
    return merge.edges_insert_absent(stored, parents, "pathway_id", "courses", "course_id", "position")


@query("replace_options", """
  select question_id, position, option_text from question_options where question_id not in
    (select question_id from questions where difficulty = 2)
  union all select question_id, 0, question_text from questions where difficulty = 2
  union all select question_id, 1, explanation from questions where difficulty = 2""")
def replace_options(t):
    batch = t.questions.filter("difficulty = 2").withColumn("options", F.array("question_text", "explanation"))
    fresh = merge.explode_children(batch, "question_id", "options", "option_text")
    stored = t.question_options.select("question_id", "position", "option_text")
    return merge.replace_children(stored, batch, fresh, "question_id")


@query("drop_retired", "select p_partkey, p_brand from part where p_brand not in ('Brand#1', 'Brand#2')")
def drop_retired(t):
    return merge.drop_retired(t.part, "p_brand", ["Brand#1", "Brand#2"]).select("p_partkey", "p_brand")


_LISTED = """
  select s_suppkey as seq, 0 as pos, cast(s_suppkey % 40 as varchar) as lesson_id from supplier
  union all select s_suppkey, 1, cast(s_suppkey * 7 % 60 as varchar) from supplier
  union all select s_suppkey, 2, cast(s_suppkey * 2 % 90 as varchar) from supplier"""


@query("lesson_positions", f"""
  select lesson_id, arg_max(pos, seq * 10 + pos) as position from ({_LISTED}) l group by 1""")
def lesson_positions(t):
    courses = t.sql("""select s_suppkey as seq, array(cast(s_suppkey % 40 as string), cast(s_suppkey * 7 % 60 as string),
        cast(s_suppkey * 2 % 90 as string)) as lessons from supplier""")
    return src.lesson_positions(courses)


@query("lessons_to_load", f"""
  select cast(p_partkey as varchar) as lesson_id, cast(coalesce(pos.position, 0) as integer) as position from part
  left join (select lesson_id, arg_max(pos, seq * 10 + pos) as position from ({_LISTED}) l group by 1) pos
    on pos.lesson_id = cast(p_partkey as varchar)""")
def lessons_to_load(t):
    courses = t.sql("""select s_suppkey as seq, array(cast(s_suppkey % 40 as string), cast(s_suppkey * 7 % 60 as string),
        cast(s_suppkey * 2 % 90 as string)) as lessons from supplier""")
    return src.lessons_to_load(_catalogue(t)["lessons"], courses).select("lesson_id", "position")


@query("practice_quizzes", """
  select s.skill_id as quiz_id, 'Quiz de pratique — ' || s.name as title, 70 as pass_threshold from skills s
  where s.skill_id in (select skill_id from questions where difficulty = 1)""")
def practice_quizzes(t):
    batch = t.questions.filter("difficulty = 1")
    return src.build_practice_quizzes(batch, t.questions, t.skills)[0].select("quiz_id", "title", "pass_threshold")


@query("practice_quiz_questions", """
  select quiz_id, question_id, position from practice_questions
  where quiz_id in (select skill_id from questions where difficulty = 1)""")
def practice_quiz_questions(t):
    return src.build_practice_quizzes(t.questions.filter("difficulty = 1"), t.questions, t.skills)[1]


@query("batch_skills", "select distinct skill_id from questions where skill_id is not null")
def batch_skills(t):
    return src.batch_skills(t.questions)


@query("infer_requirements", """
  select p_partkey, case when p_size % 3 = 0 then 'MIN_SCORE' else 'EVIDENCE' end as requirement_type,
    case when p_size % 3 = 0 then p_size end as min_score from part""")
def infer_requirements(t):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Quiz ≥ "), "p_size", F.lit(" % de "), "p_type")).otherwise(F.col("p_type"))
    return t.part.select("p_partkey", src.infer_requirement(text).alias("r")).select("p_partkey", "r.*")


@query("knowledge_edges", """
  select 'depends_on' as kind, n_nationkey as node_id, n_regionkey as target from nation
  union all select 'used_in', n_nationkey, n_nationkey * 100 from nation
    where n_nationkey * 100 in (select p_partkey from part)""")
def knowledge_edges(t):
    nodes = t.sql("""select n_nationkey as id, array(n_regionkey, n_regionkey) as dependsOn,
        array(n_nationkey * 100) as usedIn, array(n_nationkey) as demos, array(n_nationkey) as labs,
        array(n_name) as applications from nation""")
    edges = src.knowledge_edges(nodes, t.lessons)
    return edges["depends_on"].select(
        F.lit("depends_on").alias("kind"), "node_id", F.col("depends_on_node_id").alias("target")
    ).unionByName(edges["used_in"].select(
        F.lit("used_in").alias("kind"), "node_id", F.col("lesson_id").cast("int").alias("target")))


@query("upsert_glossary", """
  with batch as (select case when p_size % 2 = 0 then p_name else p_brand end as term,
      arg_max(p_type, p_partkey) as term_en, arg_max(p_name, p_partkey) as definition from part group by 1)
  select coalesce(g.term, b.term) as term, coalesce(b.term_en, g.term_en) as term_en,
    coalesce(b.definition, g.definition) as definition from glossary g full outer join batch b on b.term = g.term""")
def upsert_glossary(t):
    batch = t.sql("""select case when p_size % 2 = 0 then p_name else p_brand end as term, p_type as term_en,
        p_name as definition, p_partkey as seq from part""")
    return merge.upsert_glossary(t.glossary, batch)


@query("assign_slugs", """
  with items as (select p_partkey as seq, lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g')) as base from part),
    ranked as (select seq, base, row_number() over (partition by base order by seq) as r from items),
    taken as (select distinct lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g')) as base, p_size as slot from part
      where p_size <> 1),
    slots as (select base, slot, row_number() over (partition by base order by slot) as r from (
      select b.base, cast(g.slot as bigint) as slot from (select base, count(*) as n from items group by 1) b,
        lateral (select unnest(generate_series(1, b.n + 60)) as slot) g) s
      where not exists (select 1 from taken t where t.base = s.base and t.slot = s.slot))
  select ranked.seq, case when slot = 1 then ranked.base else ranked.base || '-' || slot end as id
  from ranked join slots on slots.base = ranked.base and slots.r = ranked.r""")
def slugs(t):
    stored = t.sql("""select distinct concat(lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-')), '-', p_size) as id
        from part where p_size <> 1""")
    titles = t.sql("select p_partkey as seq, p_name as title from part")
    return assign_slugs(stored, titles).select("seq", "id")


# Catalogue documents with every kind of root array, one per row of the given tables: no
# array grows with a table, and parsing and loading run over the partitions of the texts.
_WHOLE = """
  select to_json(named_struct(
    'schools', array(named_struct('id', cast(r_regionkey as string), 'name', r_name)),
    'pathways', array(named_struct('id', cast(r_regionkey as string), 'title', r_name,
       'courses', array('rag', cast(r_regionkey as string), 'ml'))),
    'goals', array(named_struct('id', cast(r_regionkey as string), 'label', r_name)))) as doc from region
  union all select to_json(named_struct(
    'skills', array(named_struct('id', cast(n_nationkey as string), 'schoolId', cast(n_regionkey as string), 'name', n_name)),
    'labs', array(named_struct('id', cast(n_nationkey as string), 'title', n_name,
       'skills', array(cast(n_nationkey as string)), 'modes', array('LIBRE', 'LIBRE'))),
    'certifications', array(named_struct('id', cast(n_nationkey as string), 'title', n_name,
       'requirements', array('Quiz ' || n_nationkey || ' %', 'Projet'))),
    'knowledgeGraph', array(named_struct('id', cast(n_nationkey as string), 'title', n_name,
       'dependsOn', array(cast(n_regionkey as string)), 'usedIn', array(cast(n_nationkey as string), 'gone'),
       'applications', array(n_name, n_name))))) from nation
  union all select to_json(named_struct(
    'courses', array(named_struct('id', case when s_suppkey % 10 = 3 then 'rag' else cast(s_suppkey as string) end,
       'schoolId', cast(s_nationkey % 5 as string), 'title', s_name, 'lessons', array(cast(s_suppkey as string)))))) from supplier
  union all select to_json(named_struct(
    'lessons', array(named_struct('id', cast(p_partkey as string), 'courseId', cast(p_partkey % 5 as string),
       'title', p_name, 'objectives', array(p_type), 'sections', array(named_struct('title', p_brand, 'body', p_name)))),
    'questions', array(named_struct('id', cast(p_partkey as string), 'skillId', cast(p_partkey % 25 as string),
       'question', p_name, 'options', array(p_type, p_brand), 'correct', 1)))) from part"""


@query("catalogue_load", """
  select 'courses' as part, cast(s_suppkey as varchar) as key, s_name || '/PUBLISHED' as value from supplier where s_suppkey % 10 <> 3
  union all select 'labs', cast(n_nationkey as varchar), n_name || '/ARCHIVED' from nation
  union all select 'goals', cast(r_regionkey as varchar), r_name from region
  union all select 'lessons', cast(p_partkey as varchar), p_name || '/0/PUBLISHED' from part
  union all select 'lesson_objectives', cast(p_partkey as varchar), p_type from part
  union all select 'lesson_sections', cast(p_partkey as varchar), p_brand || '/' || p_name from part
  union all select 'pathway_courses', cast(r_regionkey as varchar), cast(r_regionkey as varchar) || '/1' from region
  union all select 'lab_modes', cast(n_nationkey as varchar), 'LIBRE' from nation
  union all select 'lab_skills', cast(n_nationkey as varchar), cast(n_nationkey as varchar) from nation
  union all select 'node_depends_on', cast(n_nationkey as varchar), cast(n_regionkey as varchar) from nation
  union all select 'node_used_in', cast(n_nationkey as varchar), cast(n_nationkey as varchar) from nation
    where n_nationkey in (select p_partkey from part)
  union all select 'node_applications', cast(n_nationkey as varchar), n_name from nation
  union all select 'node_applications', cast(n_nationkey as varchar), n_name from nation
  union all select 'certification_requirements', cast(n_nationkey as varchar), 'MIN_SCORE/' || n_nationkey from nation
  union all select 'certification_requirements', cast(n_nationkey as varchar), 'EVIDENCE' from nation
  union all select 'question_options', cast(p_partkey as varchar), '0/false' from part
  union all select 'question_options', cast(p_partkey as varchar), '1/true' from part
  union all select 'quizzes', cast(n_nationkey as varchar), 'Quiz de pratique — ' || n_name from nation
    where n_nationkey in (select p_partkey % 25 from part)
  union all select 'quiz_questions', cast(p_partkey % 25 as varchar), cast(p_partkey as varchar) from (select p_partkey,
    row_number() over (partition by p_partkey % 25 order by cast(p_partkey as varchar)) as r from part) q where r <= 10""")
def catalogue_load(t):
    # Parsed once: every part reads its array from the stage table.
    parsed = t.sql(_WHOLE).select(F.from_json("doc", src.CATALOGUE_SCHEMA).alias("d")).select("d.*")
    out = src.load_all({}, src.explode_catalogue(stage(parsed, "catalogue")))

    def rows(name, key, *columns):
        return out[name].select(F.lit(name).alias("part"), F.col(key).alias("key"),
                                F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("value"))

    listed = [
        rows("courses", "id", "title", "status"), rows("labs", "id", "title", "status"), rows("goals", "id", "label"),
        rows("lessons", "lesson_id", "title", "position", "status"), rows("lesson_objectives", "lesson_id", "label"),
        rows("lesson_sections", "lesson_id", "title", "body"), rows("pathway_courses", "pathway_id", "course_id", "position"),
        rows("lab_modes", "lab_id", "mode"), rows("lab_skills", "lab_id", "skill_id"),
        rows("node_depends_on", "node_id", "depends_on_node_id"), rows("node_used_in", "node_id", "lesson_id"),
        rows("node_applications", "node_id", "label"),
        rows("certification_requirements", "certification_id", "requirement_type", "min_score"),
        rows("question_options", "id", "position", "is_correct"), rows("quizzes", "quiz_id", "title"),
        rows("quiz_questions", "quiz_id", "question_id")]
    whole = listed[0]
    for one in listed[1:]:
        whole = whole.unionByName(one)
    return whole
