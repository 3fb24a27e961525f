"""Queries over catalogue, progress, grading, eligibility and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paideon.functions.nesting import all_pages, page
from paideon.operators import audits, catalogue as cat, eligibility as elig, grading, progress as prog
from paideon.operators.search import search_many
from paideon.plans.registry import joined, micros, query

# --- flagship ----------------------------------------------------------------


@query("learner_summary", """
  select u.user_id, u.email, coalesce(p.n, 0) as lessons_completed, coalesce(q.n, 0) as quiz_attempts,
    coalesce(q.passed, 0) as quizzes_passed, q.avg_score as average_score, coalesce(l.n, 0) as labs_completed,
    epoch_us(p.last_at) as last_activity_us,
    (select count(*) from lessons where status = 'PUBLISHED') as total_lessons
  from users u
  left join (select user_id, sum(case when status = 'COMPLETED' then 1 else 0 end)::bigint as n,
      max(updated_at) as last_at from user_lesson_progress group by 1) p on p.user_id = u.user_id
  left join (select user_id, count(*) as n, sum(case when passed then 1 else 0 end)::bigint as passed,
      avg(score) as avg_score from quiz_attempts group by 1) q on q.user_id = u.user_id
  left join (select user_id, count(*) as n from lab_results where completed group by 1) l on l.user_id = u.user_id
  where u.role = 'LEARNER'""")
def learner_summary(t):
    rows = prog.learner_summary(t.users, t.user_lesson_progress, t.quiz_attempts, t.lab_results, t.lessons)
    return rows.select("user_id", "email", "lessons_completed", "quiz_attempts", "quizzes_passed", "average_score",
                       "labs_completed", micros("last_activity_at").alias("last_activity_us"), "total_lessons")


@query("learner_summary_page", """
  select user_id, email from (select user_id, email, created_at from users where role = 'LEARNER'
    and (email ilike '%9@x%' or first_name ilike '%9@x%' or last_name ilike '%9@x%'))
  order by created_at desc nulls first, user_id limit 20 offset 20""")
def learner_summary_page(t):
    found = cat.search_people(cat.learners(t.users), "9@x")
    return page(found, [F.col("created_at").desc_nulls_first(), "user_id"], 20, 20).select("user_id", "email")


@query("learner_listing_pages", """
  select user_id, (n - 1) // 20 as page_no, (n - 1) % 20 as place_on_page from (
    select user_id, row_number() over (order by created_at desc nulls first, user_id) as n from users where role = 'LEARNER') x""")
def learner_listing_pages(t):
    listed = all_pages(cat.learners(t.users), [F.col("created_at").desc_nulls_first(), F.col("user_id")], 20)
    return listed.select("user_id", "page_no", "place_on_page")


# --- catalogue reads -----------------------------------------------------------


@query("published_courses", """
  select course_id, title, level from courses where status = 'PUBLISHED' and level = 'N2'""")
def published_courses(t):
    return cat.filter_eq(cat.published(t.courses), level="N2", school_id=None).select("course_id", "title", "level")


@query("people_search", """
  select user_id, email from users where email ilike '%er#0000_1%' or first_name ilike '%er#0000_1%'
    or last_name ilike '%er#0000_1%'""")
def people_search(t):
    return cat.search_people(t.users, "ER#0000_1").select("user_id", "email")


_SEARCHES = """(select distinct substr(n_name, 1, 4) as pattern from nation union select substr(s_name, 14, 5) from supplier
  union select lower(substr(c_mktsegment, 1, 2)) from customer)"""


@query("people_search_many", f"""
  select distinct s.pattern, u.user_id from users u join {_SEARCHES} s on s.pattern <> '' and (
    contains(lower(u.email), lower(s.pattern)) or contains(lower(u.first_name), lower(s.pattern))
    or contains(lower(u.last_name), lower(s.pattern)))""")
def people_search_many(t):
    searches = t.sql(f"select pattern from {_SEARCHES} s")
    return search_many(t.users, "user_id", ["email", "first_name", "last_name"], searches)


@query("people_by_email", """
  select u.user_id, u.email from users u join customer c on lower(c.c_name || '@X.TEST') = lower(u.email)""")
def people_by_email(t):
    spelled = t.customer.select(F.lower(F.concat("c_name", F.lit("@X.TEST"))).alias("email"))
    return cat.in_keys(t.users, spelled, "email").select("user_id", "email")


@query("email_equality", "select user_id from users where lower(email) = 'customer#000000042@x.test'")
def email_equality(t):
    return cat.email_is(t.users, "CUSTOMER#000000042@X.TEST").select("user_id")


@query("progress_of_learners", """
  select user_id, lesson_id, status from user_lesson_progress
  where user_id in (select user_id from users where role = 'LEARNER')""")
def progress_of_learners(t):
    return cat.in_keys(t.user_lesson_progress, cat.learners(t.users).select("user_id"), "user_id").select(
        "user_id", "lesson_id", "status")


@query("lessons_with_skill", "select lesson_id, skill_id from lessons where skill_id is not null")
def lessons_with_skill(t):
    return cat.with_skill(t.lessons).select("lesson_id", "skill_id")


@query("lesson_summaries", """
  select lesson_id, course_id, title, level, duration_min, position from lessons where status = 'PUBLISHED'""")
def lesson_summaries(t):
    return cat.lesson_summary(cat.published(t.lessons))


@query("lessons_in_course_order", "select course_id, position, lesson_id from lessons")
def lessons_in_course_order(t):
    return t.lessons.select("course_id", "position", "lesson_id").orderBy("course_id", "position", "lesson_id")


@query("promote_staff", """
  select user_id, case when role = 'ADMIN' then 'SUPER_ADMIN' else role end as role from users""")
def promote_staff(t):
    return cat.promote_roles(t.users).select("user_id", "role")


@query("course_resources", """
  select rc.course_id, r.resource_id, r.title, r.type from resources r
  join resource_courses rc on rc.resource_id = r.resource_id where r.status = 'PUBLISHED'""")
def course_resources(t):
    return cat.course_resources(t.resources, t.resource_courses)


@query("pathway_detail", """
  select p.pathway_id, p.title, coalesce(string_agg(cast(pc.course_id as varchar), '|' order by pc.position), '') as courses
  from pathways p left join (select pc.* from pathway_courses pc join courses c on c.course_id = pc.course_id
    where c.status = 'PUBLISHED') pc on pc.pathway_id = p.pathway_id
  where p.status = 'PUBLISHED' group by 1, 2""")
def pathway_detail(t):
    rows = cat.pathway_detail(t.pathways, t.pathway_courses, t.courses)
    return rows.select("pathway_id", "title", joined("courses", "course_id").alias("courses"))


_ASSEMBLY = """
  select pq.quiz_id, pq.position, q.question_id, {cols} coalesce(string_agg(o.option_text, '|' order by o.position), '')
    as options from practice_questions pq join quizzes z on z.quiz_id = pq.quiz_id
  join questions q on q.question_id = pq.question_id
  left join question_options o on o.question_id = q.question_id
  group by {group}"""


@query("quiz_assembly", _ASSEMBLY.format(
    cols="q.question_text, q.explanation, sum(case when o.is_correct then 1 else 0 end)::bigint as n_correct,",
    group="1, 2, 3, 4, 5"))
def quiz_assembly(t):
    rows = cat.quiz_assembly(t.quizzes, t.practice_questions, t.questions, t.question_options)
    right = F.size(F.filter("options", lambda o: o["is_correct"])).cast("long")
    return rows.select("quiz_id", "position", "question_id", "question_text", "explanation",
                       right.alias("n_correct"), joined("options", "option_text").alias("options"))


@query("quiz_public", _ASSEMBLY.format(cols="q.question_text,", group="1, 2, 3, 4"))
def quiz_public(t):
    rows = cat.quiz_public(cat.quiz_assembly(t.quizzes, t.practice_questions, t.questions, t.question_options))
    return rows.select("quiz_id", "position", "question_id", "question_text",
                       joined("options", "option_text").alias("options"))


@query("correct_options", """
  select o.question_id, min(o.option_id) as correct_option_id, q.explanation from question_options o
  join questions q on q.question_id = o.question_id where o.is_correct group by 1, 3 having count(*) = 1""")
def correct_options(t):
    return cat.answer_key(t.question_options, t.questions)[0]


@query("course_detail", """
  select c.course_id, c.title, l.lessons, coalesce(r.n, 0) as resources, z.quiz_id as final_quiz_id from courses c
  left join (select course_id, string_agg(cast(lesson_id as varchar), '|' order by position, lesson_id) as lessons
    from lessons where status = 'PUBLISHED' group by 1) l on l.course_id = c.course_id
  left join (select course_id, count(*) as n from resource_courses rc join resources r
    on r.resource_id = rc.resource_id where r.status = 'PUBLISHED' group by 1) r on r.course_id = c.course_id
  left join (select course_id, min(quiz_id) as quiz_id from final_quizzes group by 1) z on z.course_id = c.course_id
  where c.status = 'PUBLISHED'""")
def course_detail(t):
    rows = cat.course_detail(t.courses, t.lessons, t.quizzes, t.resources, t.resource_courses)
    return rows.select("course_id", "title", joined("lessons", "lesson_id").alias("lessons"),
                       F.size("resources").cast("long").alias("resources"), "final_quiz_id")


@query("lesson_detail", """
  select l.lesson_id, coalesce(o.labels, '') as objectives, coalesce(s.titles, '') as sections,
    1000000000 + l.lesson_id as validation_quiz_id,
    l.lesson_id in (select lesson_id from imported_documents) as has_document
  from lessons l
  left join (select lesson_id, string_agg(label, '|' order by position) as labels from lesson_objectives group by 1) o
    on o.lesson_id = l.lesson_id
  left join (select lesson_id, string_agg(title, '|' order by position) as titles from lesson_sections group by 1) s
    on s.lesson_id = l.lesson_id
  where l.status = 'PUBLISHED'""")
def lesson_detail(t):
    depths = t.sql("""select p_partkey as lesson_id, 'ESSENTIAL' as depth_key, 'Essentiel' as label,
        p_name as title, p_type as body from part""")
    rows = cat.lesson_detail(t.lessons, t.lesson_objectives, t.lesson_sections, depths, t.quizzes,
                             t.imported_documents)
    return rows.select("lesson_id", joined("objectives", "label").alias("objectives"),
                       joined("sections", "title").alias("sections"), "validation_quiz_id", "has_document")


@query("lab_detail", """
  select l.lab_id, coalesce((select string_agg(mode, '|' order by mode) from lab_modes m where m.lab_id = l.lab_id), '')
    as modes, coalesce((select string_agg(cast(skill_id as varchar), '|' order by skill_id) from lab_skills s
      where s.lab_id = l.lab_id), '') as skills
  from labs l where l.status = 'PUBLISHED'""")
def lab_detail(t):
    rows = cat.lab_detail(t.labs, t.lab_modes, t.lab_skills)
    return rows.select("lab_id", joined("modes", "mode").alias("modes"), joined("skills", "skill_id").alias("skills"))


_COURSE_QUIZZES = """
  select distinct c.course_id, z.quiz_id, z.title as quiz_title from courses c
  join (select quiz_id, title, course_id from quizzes where status = 'PUBLISHED' and course_id is not null
    union all select z.quiz_id, z.title, l.course_id from quizzes z join lessons l on l.lesson_id = z.lesson_id
      where z.status = 'PUBLISHED' and l.status = 'PUBLISHED'
    union all select z.quiz_id, z.title, l.course_id from quizzes z join lessons l on l.skill_id = z.skill_id
      where z.status = 'PUBLISHED' and l.status = 'PUBLISHED' and z.kind = 'PRACTICE') z on z.course_id = c.course_id
  where c.status = 'PUBLISHED'"""


@query("course_quizzes", _COURSE_QUIZZES)
def course_quizzes(t):
    return cat.course_quizzes(t.courses, t.lessons, t.quizzes)


@query("certification_detail", """
  select c.certification_id, c.title, coalesce(string_agg(r.requirement_type, '|' order by r.position, r.requirement_id), '')
    as requirements from certifications c left join certification_requirements r
  on r.certification_id = c.certification_id where c.status = 'PUBLISHED' group by 1, 2""")
def certification_detail(t):
    rows = cat.certification_detail(t.certifications, t.certification_requirements)
    return rows.select("certification_id", "title", joined("requirements", "requirement_type").alias("requirements"))


@query("results_on_published_labs", """
  select result_id, lab_id from lab_results where lab_id in (select lab_id from labs where status = 'PUBLISHED')""")
def results_on_published_labs(t):
    return cat.exists_published(t.lab_results, t.labs, "lab_id").select("result_id", "lab_id")


@query("lesson_document", """
  select lesson_id, document_id, source_file from (select *, row_number() over (partition by lesson_id
    order by created_at, document_id) as rn from imported_documents) d where rn = 1""")
def lesson_document(t):
    return cat.lesson_document(t.imported_documents).select("lesson_id", "document_id", "source_file")


# --- histories -------------------------------------------------------------------


@query("user_progress", """
  select p.user_id, p.lesson_id, l.title as lesson_title, l.course_id, p.status, epoch_us(p.updated_at) as updated_us
  from user_lesson_progress p join lessons l on l.lesson_id = p.lesson_id""")
def user_progress(t):
    rows = prog.user_progress(t.user_lesson_progress, t.lessons)
    return rows.select("user_id", "lesson_id", "lesson_title", "course_id", "status",
                       micros("updated_at").alias("updated_us"))


@query("user_skills", """
  select m.user_id, m.skill_id, s.name as skill_name, s.school_id, cast(m.mastery_level as bigint) as mastery_level
  from user_skills m join skills s on s.skill_id = m.skill_id""")
def user_skills(t):
    rows = prog.user_skills(t.user_skills, t.skills)
    return rows.select("user_id", "skill_id", "skill_name", "school_id",
                       F.col("mastery_level").cast("long").alias("mastery_level"))


@query("quiz_history", """
  select a.user_id, a.attempt_id, z.title as quiz_title, a.score, a.passed, epoch_us(a.started_at) as started_us
  from quiz_attempts a
  join quizzes z on z.quiz_id = a.quiz_id""")
def quiz_history(t):
    rows = prog.quiz_history(t.quiz_attempts, t.quizzes)
    return rows.select("user_id", "attempt_id", "quiz_title", "score", "passed", micros("started_at").alias("started_us"))


@query("lab_history", """
  select r.user_id, r.result_id, l.title as lab_title, r.completed, epoch_us(r.submitted_at) as submitted_us
  from lab_results r join labs l on l.lab_id = r.lab_id""")
def lab_history(t):
    rows = prog.lab_history(t.lab_results, t.labs)
    return rows.select("user_id", "result_id", "lab_title", "completed", micros("submitted_at").alias("submitted_us"))


@query("portfolio", """
  select e.user_id, e.evidence_id, e.title, coalesce(s.skills, '') as skills from portfolio_evidence e
  left join (select evidence_id, string_agg(cast(skill_id as varchar), '|' order by skill_id) as skills
    from evidence_skills group by 1) s on s.evidence_id = e.evidence_id""")
def portfolio(t):
    rows = prog.portfolio(t.portfolio_evidence, t.evidence_skills)
    return rows.select("user_id", "evidence_id", "title", joined("skills", "skill_id").alias("skills"))


@query("profiles", """
  select u.user_id, p.profile_type_id, coalesce(p.onboarding_done, false) as onboarding_done,
    coalesce(g.goals, '') as goals, coalesce(s.skills, '') as skills from users u
  left join user_profiles p on p.user_id = u.user_id
  left join (select user_id, string_agg(goal_id, '|' order by goal_id) as goals from user_goals group by 1) g
    on g.user_id = u.user_id
  left join (select user_id, string_agg(cast(skill_id as varchar), '|' order by skill_id) as skills
    from user_profile_skills group by 1) s on s.user_id = u.user_id""")
def profiles(t):
    rows = prog.profiles(t.users, t.user_profiles, t.user_goals, t.user_profile_skills)
    return rows.select("user_id", "profile_type_id", "onboarding_done", joined("goals", "goal_id").alias("goals"),
                       joined("skills", "skill_id").alias("skills"))


@query("learner_detail", """
  select u.user_id, coalesce(p.lessons, '') as lessons, coalesce(q.quizzes, '') as quizzes,
    coalesce(r.labs, '') as labs from users u
  left join (select p.user_id, string_agg(cast(p.lesson_id as varchar), '|' order by p.updated_at desc, p.lesson_id)
    as lessons from user_lesson_progress p join lessons l on l.lesson_id = p.lesson_id group by 1) p
    on p.user_id = u.user_id
  left join (select a.user_id, string_agg(cast(a.attempt_id as varchar), '|' order by a.started_at desc, a.attempt_id)
    as quizzes from quiz_attempts a join quizzes z on z.quiz_id = a.quiz_id group by 1) q on q.user_id = u.user_id
  left join (select r.user_id, string_agg(cast(r.result_id as varchar), '|'
    order by r.submitted_at desc nulls first, r.result_id) as labs
    from lab_results r join labs l on l.lab_id = r.lab_id group by 1) r on r.user_id = u.user_id
  where u.role = 'LEARNER'""")
def learner_detail(t):
    rows = prog.learner_detail(t.users, t.user_lesson_progress, t.quiz_attempts, t.lab_results, t.lessons,
                               t.quizzes, t.labs)
    return rows.select("user_id", joined("lessons", "lesson_id").alias("lessons"),
                       joined("quizzes", "attempt_id").alias("quizzes"), joined("labs", "result_id").alias("labs"))


@query("learner_histories", """
  with h as (
    select p.user_id, 'lesson' as kind, -epoch_us(p.updated_at) as newest, cast(p.lesson_id as varchar) as item_id, l.title
      from user_lesson_progress p join lessons l on l.lesson_id = p.lesson_id
    union all select a.user_id, 'quiz', -epoch_us(a.started_at), cast(a.attempt_id as varchar), z.title
      from quiz_attempts a join quizzes z on z.quiz_id = a.quiz_id
    union all select r.user_id, 'lab', -epoch_us(r.submitted_at), cast(r.result_id as varchar), l.title
      from lab_results r join labs l on l.lab_id = r.lab_id)
  select h.* from h where user_id in (select user_id from users where role = 'LEARNER')""")
def learner_histories(t):
    rows = prog.learner_histories(t.users, t.user_lesson_progress, t.quiz_attempts, t.lab_results, t.lessons,
                                  t.quizzes, t.labs)
    return rows.select("user_id", "kind", "newest", F.col("item_id").cast("string").alias("item_id"), "title")


# --- per-user measures -----------------------------------------------------------


@query("published_lesson_total", "select count(*) as total_lessons from lessons where status = 'PUBLISHED'")
def published_lesson_total(t):
    return prog.total_published_lessons(t.lessons)


@query("listing_total", "select count(*) as total from users where role = 'LEARNER'")
def listing_total(t):
    return cat.learners(t.users).agg(F.count(F.lit(1)).alias("total"))


@query("lessons_completed", """
  select user_id, count(*) as lessons_completed from user_lesson_progress where status = 'COMPLETED' group by 1""")
def lessons_completed(t):
    return prog.lessons_completed(t.user_lesson_progress)


@query("quiz_stats", """
  select user_id, count(*) as quiz_attempts, sum(case when passed then 1 else 0 end)::bigint as quizzes_passed,
    avg(score) as average_score from quiz_attempts group by 1""")
def quiz_stats(t):
    return prog.quiz_stats(t.quiz_attempts)


@query("labs_completed", "select user_id, count(*) as labs_completed from lab_results where completed group by 1")
def labs_completed(t):
    return prog.labs_completed(t.lab_results)


@query("last_activity", """
  select user_id, epoch_us(max(updated_at)) as last_activity_us from user_lesson_progress group by 1""")
def last_activity(t):
    return prog.last_activity(t.user_lesson_progress).select(
        "user_id", micros("last_activity_at").alias("last_activity_us"))


@query("requirement_counts", """
  select c.certification_id, count(r.requirement_id) as requirements,
    count(r.skill_id) + count(r.course_id) + count(r.lab_id) as linked
  from certifications c left join certification_requirements r on r.certification_id = c.certification_id group by 1""")
def requirement_counts(t):
    return prog.requirement_counts(t.certifications, t.certification_requirements).select(
        "certification_id", "requirements", "linked")


@query("question_counts", """
  select z.quiz_id, count(q.question_id) as question_count from quizzes z
  left join practice_questions q on q.quiz_id = z.quiz_id group by 1""")
def question_counts(t):
    return prog.question_counts(t.quizzes, t.practice_questions).select("quiz_id", "question_count")


@query("course_completion", """
  with live as (select lesson_id, course_id from lessons where status = 'PUBLISHED')
  select p.user_id, l.course_id, count(*) as completed, n.total, count(*) = n.total as course_completed
  from user_lesson_progress p join live l on l.lesson_id = p.lesson_id
  join (select course_id, count(*) as total from live group by 1) n on n.course_id = l.course_id
  where p.status = 'COMPLETED' group by 1, 2, 4""".replace("with live as (select lesson_id, course_id from lessons "
  "where status = 'PUBLISHED')\n", "").replace(" live ", " (select lesson_id, course_id from lessons where status = 'PUBLISHED') "))
def course_completion(t):
    return prog.course_completion(t.user_lesson_progress, t.lessons)


@query("labs_done", "select distinct user_id, lab_id from lab_results where completed")
def labs_done(t):
    return prog.lab_done(t.lab_results)


@query("mastery_levels", """
  select p.user_id, p.skill_id, coalesce(cast(m.mastery_level as bigint), 0) as mastery_level
  from user_profile_skills p left join user_skills m on m.user_id = p.user_id and m.skill_id = p.skill_id""")
def mastery_levels(t):
    rows = prog.mastery_levels(t.user_profile_skills, t.user_skills)
    return rows.withColumn("mastery_level", F.col("mastery_level").cast("long"))


@query("best_quiz_score", "select user_id, quiz_id, max(score) as best_score from quiz_attempts group by 1, 2")
def best_quiz_score(t):
    return prog.best_quiz_score(t.quiz_attempts)


@query("best_skill_score", """
  select a.user_id, z.skill_id, max(a.score) as best_score from quiz_attempts a
  join quizzes z on z.quiz_id = a.quiz_id where z.skill_id is not null group by 1, 2""")
def best_skill_score(t):
    return prog.best_skill_score(t.quiz_attempts, t.quizzes)


@query("profile_stats", """
  select u.user_id, a.s as average_score, coalesce(m.n, 0) as skills_in_progress from users u
  left join (select user_id, cast(floor(avg(score) + 0.5) as bigint) as s from quiz_attempts group by 1) a
    on a.user_id = u.user_id
  left join (select user_id, count(*) as n from user_skills where mastery_level > 0 group by 1) m
    on m.user_id = u.user_id""")
def profile_stats(t):
    return prog.profile_stats(t.users, t.quiz_attempts, t.user_skills)


@query("dashboard", """
  select u.user_id, coalesce(p.n, 0) as lessons_completed from users u left join (select user_id, count(*) as n
    from user_lesson_progress where status = 'COMPLETED' group by 1) p on p.user_id = u.user_id""")
def dashboard(t):
    return prog.dashboard(t.users, t.user_lesson_progress)


@query("mastery_percent", """
  select user_id, skill_id, cast(mastery_level as double) / 4 * 100 as mastery_pct from user_skills""")
def mastery_percent(t):
    return prog.mastery_percent(t.user_skills).select("user_id", "skill_id", "mastery_pct")


_CERTIFICATES = """(select distinct user_id, quiz_id - 1000 as course_id from quiz_attempts
  where quiz_id >= 1000 and score >= 97)"""


@query("learner_stage", f"""
  select u.user_id, cast(case when c.user_id is not null then 7 when m.top >= 3 then 6 when m.top >= 2 then 5
    when l.user_id is not null then 4 when m.top >= 1 then 3 when p.n >= 2 then 2 when p.n >= 1 then 1 else 0 end
    as int) as stage from users u
  left join (select distinct user_id from {_CERTIFICATES} k) c on c.user_id = u.user_id
  left join (select user_id, max(mastery_level) as top from user_skills group by 1) m on m.user_id = u.user_id
  left join (select distinct user_id from lab_results) l on l.user_id = u.user_id
  left join (select user_id, count(*) as n from user_lesson_progress where status = 'COMPLETED' group by 1) p
    on p.user_id = u.user_id""")
def learner_stage(t):
    certificates = t.sql(f"select * from {_CERTIFICATES} c")
    return prog.learner_stage(t.users, t.user_lesson_progress, t.user_skills, t.lab_results, certificates)


# --- grading -----------------------------------------------------------------------

_CHECKED = """
  (with last as (select attempt_id, question_no, arg_max(selected_option_id, submit_seq) as picked
      from submitted_answers group by 1, 2),
    qk as (select q.quiz_id, q.question_no, k.correct_option_id from quiz_questions q
      left join answer_key k on k.question_no = q.question_no),
    sizes as (select quiz_id, count(*) as total from qk group by 1),
    marks as (select a.attempt_id, count(*) filter (where qk.quiz_id is null) as unknown,
        count(*) filter (where l.picked = qk.correct_option_id) as correct_count
      from last l join submitted_attempts a on a.attempt_id = l.attempt_id
      left join qk on qk.quiz_id = a.quiz_id and qk.question_no = l.question_no group by 1)
   select a.attempt_id, a.user_id, a.quiz_id, z.skill_id, m.correct_count, s.total as total_questions,
     case when m.attempt_id is null then 'NO_ANSWER' when z.quiz_id is null then 'QUIZ_NOT_FOUND'
       when m.unknown > 0 then 'UNKNOWN_QUESTION' end as reason,
     cast(round_even(100.0 * m.correct_count / s.total, 0) as bigint) as score, z.pass_threshold
   from submitted_attempts a left join marks m on m.attempt_id = a.attempt_id
   left join (select * from quizzes where status = 'PUBLISHED') z on z.quiz_id = a.quiz_id
   left join sizes s on s.quiz_id = a.quiz_id) checked"""


def _graded(t):
    return grading.grade_attempts(t.submitted_attempts, t.submitted_answers, t.quizzes, t.quiz_questions, t.answer_key)


@query("grade_attempts", f"""
  select attempt_id, user_id, quiz_id, correct_count, cast(total_questions as bigint) as total_questions, score,
    score >= pass_threshold as passed from {_CHECKED} where reason is null""")
def grade_attempts(t):
    return _graded(t)[0].select("attempt_id", "user_id", "quiz_id", "correct_count",
                                F.col("total_questions").cast("long").alias("total_questions"), "score", "passed")


@query("attempt_rejects", f"""
  select attempt_id, user_id, quiz_id, reason from {_CHECKED} where reason is not null""")
def attempt_rejects(t):
    return _graded(t)[1]


@query("last_answers", """
  select attempt_id, question_no, arg_max(selected_option_id, submit_seq) as selected_option_id
  from submitted_answers group by 1, 2""")
def last_answers(t):
    return grading.last_answer(t.submitted_answers)


@query("unknown_question_lists", """
  select attempt_id, string_agg(cast(question_no as varchar), '|' order by question_no) as unknown from (
    select distinct a.attempt_id, n.question_no from submitted_answers n
    join submitted_attempts a on a.attempt_id = n.attempt_id
    where not exists (select 1 from quiz_questions q where q.quiz_id = a.quiz_id and q.question_no = n.question_no)) u
  group by 1""")
def unknown_question_lists(t):
    rows = grading.unknown_question_lists(t.submitted_attempts, t.submitted_answers, t.quiz_questions)
    return rows.select("attempt_id", joined("unknown", "question_no").alias("unknown"))


@query("attempt_answers", f"""
  select c.attempt_id, q.question_no, l.picked as selected_option_id, k.correct_option_id, k.explanation,
    coalesce(l.picked = k.correct_option_id, false) as is_correct
  from {_CHECKED.replace(') checked', ') c')} join quiz_questions q on q.quiz_id = c.quiz_id
  left join answer_key k on k.question_no = q.question_no
  left join (select attempt_id, question_no, arg_max(selected_option_id, submit_seq) as picked
    from submitted_answers group by 1, 2) l on l.attempt_id = c.attempt_id and l.question_no = q.question_no
  where c.reason is null""")
def attempt_answers(t):
    rows = grading.attempt_answers(t.submitted_attempts, t.submitted_answers, t.quizzes, t.quiz_questions, t.answer_key)
    return rows.select("attempt_id", "question_no", "selected_option_id", "correct_option_id", "explanation",
                       "is_correct")


@query("bump_mastery", f"""
  select coalesce(m.user_id, g.user_id) as user_id, coalesce(m.skill_id, g.skill_id) as skill_id,
    cast(least(coalesce(m.mastery_level, 0) + coalesce(g.n, 0), 4) as bigint) as mastery_level
  from user_skills m full outer join (select user_id, skill_id, count(*) as n from {_CHECKED}
    where reason is null and score >= pass_threshold and skill_id is not null group by 1, 2) g
  on g.user_id = m.user_id and g.skill_id = m.skill_id""")
def bump_mastery(t):
    rows = grading.bump_mastery(t.user_skills, _graded(t)[0])
    return rows.withColumn("mastery_level", F.col("mastery_level").cast("long"))


@query("complete_lessons", """
  select coalesce(p.user_id, e.user_id) as user_id, coalesce(p.lesson_id, e.lesson_id) as lesson_id,
    case when e.user_id is not null then 'COMPLETED' else p.status end as status,
    epoch_us(coalesce(p.started_at, e.first_ts)) as started_us, epoch_us(coalesce(e.last_ts, p.completed_at)) as completed_us
  from user_lesson_progress p full outer join (select user_id, lesson_id, min(ts) as first_ts, max(ts) as last_ts
    from lesson_events where event_type = 'view' and lesson_id in
      (select lesson_id from lessons where status = 'PUBLISHED') group by 1, 2) e
  on e.user_id = p.user_id and e.lesson_id = p.lesson_id""")
def complete_lessons(t):
    done = grading.complete_lessons(t.user_lesson_progress, t.lesson_events.filter("event_type = 'view'"), t.lessons)
    return done.select("user_id", "lesson_id", "status", micros("started_at").alias("started_us"),
                       micros("completed_at").alias("completed_us"))


@query("submit_labs", """
  with c as (select r.*, case when l.id is null then 'LAB_NOT_FOUND'
      when r.score < 0 or r.score > 100 then 'SCORE_OUT_OF_RANGE' end as reason
    from lab_results r left join (select lab_id as id from labs where status = 'PUBLISHED') l on l.id = r.lab_id)
  select result_id, lab_id, completed, 'stored' as outcome from lab_results
  union all select result_id + 1000000000, lab_id, true, 'stored' from c where reason is null
  union all select result_id + 1000000000, lab_id, completed, reason from c where reason is not null""")
def submit_labs(t):
    again = t.lab_results.withColumn("result_id", F.col("result_id") + 1_000_000_000)
    stored, rejects = grading.submit_labs(t.lab_results, again, t.labs)
    columns = ["result_id", "lab_id", "completed"]
    return stored.select(*columns, F.lit("stored").alias("outcome")).unionByName(
        rejects.select(*columns, F.col("reason").alias("outcome")))


@query("append_evidence", """
  with e as (select evidence_id, skill_id from evidence_skills union all
      select case when event_id % 2 = 0 then event_id else event_id + 1000000000 end, (event_id * 3) % 25 from events)
  select distinct 'edge' as part, evidence_id, skill_id, cast(null as bigint) as copies from e
  union all select 'violation', evidence_id, skill_id, count(*) from e group by 2, 3 having count(*) > 1
  union all select 'evidence', evidence_id, null, null from portfolio_evidence
  union all select 'evidence', event_id + 1000000000, null, null from events where event_id % 2 = 1""")
def append_evidence(t):
    # Even events give further skills to stored evidence, odd ones are new evidence.
    edges = t.sql("""select case when event_id % 2 = 0 then event_id else event_id + 1000000000 end as evidence_id,
        (event_id * 3) % 25 as skill_id from events""")
    new = t.portfolio_evidence.filter("evidence_id % 2 = 1").withColumn("evidence_id", F.col("evidence_id") + 1_000_000_000)
    evidence, pairs, broken = grading.append_evidence(t.portfolio_evidence, t.evidence_skills, new, edges)
    none = F.lit(None).cast("long")
    return (pairs.select(F.lit("edge").alias("part"), "evidence_id", "skill_id", none.alias("copies"))
            .unionByName(broken.select(F.lit("violation").alias("part"), "evidence_id", "skill_id", "copies"))
            .unionByName(evidence.select(F.lit("evidence").alias("part"), "evidence_id", none.alias("skill_id"), none.alias("copies"))))


@query("upsert_profiles", """
  select 'goal' as part, user_id, goal_id as value from user_goals
    where user_id not in (select c_custkey from customer where c_acctbal > 5000)
  union all select 'goal', c_custkey, c_mktsegment from customer where c_acctbal > 5000
  union all select 'skill', user_id, cast(skill_id as varchar) from user_profile_skills
    where user_id not in (select c_custkey from customer where c_acctbal > 5000)
  union all select 'skill', c_custkey, cast(c_nationkey as varchar) from customer where c_acctbal > 5000
  union all select 'profile', user_id, profile_type_id || '/' || weekly_hours || '/' || onboarding_done from user_profiles
    where user_id not in (select c_custkey from customer where c_acctbal > 5000)
  union all select 'profile', c_custkey, c_mktsegment || '/' || c_nationkey || '/true' from customer where c_acctbal > 5000""")
def upsert_profiles(t):
    saves = t.sql("""select c_custkey as user_id, c_mktsegment as profile_type_id, c_nationkey as weekly_hours,
        c_custkey as seq from customer where c_acctbal > 5000""")
    goals = t.sql("select c_custkey as user_id, c_mktsegment as goal_id from customer where c_acctbal > 5000")
    skills = t.sql("select c_custkey as user_id, cast(c_nationkey as bigint) as skill_id from customer where c_acctbal > 5000")
    merged, kept_goals, kept_skills = grading.upsert_profiles(
        t.user_profiles, t.user_goals, t.user_profile_skills, saves, goals, skills, "seq")
    profile = F.concat_ws("/", "profile_type_id", "weekly_hours", "onboarding_done")
    return (kept_goals.select(F.lit("goal").alias("part"), "user_id", F.col("goal_id").alias("value"))
            .unionByName(kept_skills.select(F.lit("skill").alias("part"), "user_id", F.col("skill_id").cast("string").alias("value")))
            .unionByName(merged.select(F.lit("profile").alias("part"), "user_id", profile.alias("value"))))


# --- eligibility -------------------------------------------------------------------

_ELIGIBILITY = """
  (select b.user_id, w.course_id, count(*) as tried, n.quiz_count, count(*) = n.quiz_count as all_attempted,
     round_even(sum(b.best)::double / count(*), 1) as average_score
   from (select user_id, quiz_id, max(score) as best from quiz_attempts group by 1, 2) b
   join ({w}) w on w.quiz_id = b.quiz_id
   join (select course_id, count(*) as quiz_count from ({w}) w group by 1) n on n.course_id = w.course_id
   group by 1, 2, 4) e"""

@query("course_certificate_eligibility", f"""
  select user_id, course_id, tried, quiz_count, all_attempted, average_score,
    all_attempted and average_score >= 80 as eligible from {_ELIGIBILITY.format(w=_COURSE_QUIZZES)}""")
def course_certificate_eligibility(t):
    return elig.course_certificate_eligibility(t.courses, t.lessons, t.quizzes, t.quiz_attempts)


@query("issue_certificates", f"""
  select e.user_id, e.course_id, cast(round_even(average_score, 0) as bigint) as average_score
  from {_ELIGIBILITY.format(w=_COURSE_QUIZZES)} left join {_CERTIFICATES} c
    on c.user_id = e.user_id and c.course_id = e.course_id
  where all_attempted and average_score >= 80 and c.user_id is null""")
def issue_certificates(t):
    rows = elig.course_certificate_eligibility(t.courses, t.lessons, t.quizzes, t.quiz_attempts)
    return elig.issue_certificates(t.sql(f"select * from {_CERTIFICATES} c"), rows)


@query("certificate_refusals", f"""
  select e.user_id, e.course_id, case when not all_attempted then
    'Tous les quiz du cours doivent être tentés au moins une fois (reste : ' || (
      select string_agg(w.quiz_title, ', ' order by w.quiz_title, w.quiz_id) from ({_COURSE_QUIZZES}) w
      where w.course_id = e.course_id and not exists (select 1 from quiz_attempts a
        where a.user_id = e.user_id and a.quiz_id = w.quiz_id)) || ').'
    else 'Moyenne actuelle : ' || cast(average_score as varchar) || ' (seuil requis : 80).' end as reason
  from {_ELIGIBILITY.format(w=_COURSE_QUIZZES)} where not (all_attempted and average_score >= 80)""")
def certificate_refusals(t):
    rows = elig.course_certificate_eligibility(t.courses, t.lessons, t.quizzes, t.quiz_attempts, with_quizzes=True)
    wanted = cat.course_quizzes(t.courses, t.lessons, t.quizzes)
    return elig.certificate_refusals(rows, wanted, t.quiz_attempts).select("user_id", "course_id", "reason")


# Only the final quiz of a course counts here, so certificates are reached and refused on their average.
_FINAL_QUIZZES = f"select * from ({_COURSE_QUIZZES}) f where quiz_id in (select quiz_id from quizzes where kind = 'FINAL')"


@query("issue_final_certificates", f"""
  select e.user_id, e.course_id, cast(round_even(average_score, 0) as bigint) as average_score
  from {_ELIGIBILITY.format(w=_FINAL_QUIZZES)} left join {_CERTIFICATES} c
    on c.user_id = e.user_id and c.course_id = e.course_id
  where all_attempted and average_score >= 80 and c.user_id is null""")
def issue_final_certificates(t):
    rows = elig.course_certificate_eligibility(t.courses, t.lessons, t.final_quizzes, t.quiz_attempts)
    return elig.issue_certificates(t.sql(f"select * from {_CERTIFICATES} c"), rows)


@query("final_certificate_refusals", f"""
  select e.user_id, e.course_id, 'Moyenne actuelle : ' || cast(average_score as varchar) || ' (seuil requis : 80).' as reason
  from {_ELIGIBILITY.format(w=_FINAL_QUIZZES)} where average_score < 80""")
def final_certificate_refusals(t):
    rows = elig.course_certificate_eligibility(t.courses, t.lessons, t.final_quizzes, t.quiz_attempts, with_quizzes=True)
    wanted = cat.course_quizzes(t.courses, t.lessons, t.final_quizzes)
    return elig.certificate_refusals(rows, wanted, t.quiz_attempts).select("user_id", "course_id", "reason")


_SIGNALS = """
  (select p.user_id, r.certification_id, r.requirement_id, p.done = p.total as satisfied, cast(null as bigint) as measure
   from (select p.user_id, l.course_id, count(*) as done, max(n.total) as total from user_lesson_progress p
     join lessons l on l.lesson_id = p.lesson_id and l.status = 'PUBLISHED'
     join (select course_id, count(*) as total from lessons where status = 'PUBLISHED' group by 1) n
       on n.course_id = l.course_id
     where p.status = 'COMPLETED' group by 1, 2) p
   join certification_requirements r on r.requirement_type = 'COURSE' and r.course_id = p.course_id
   union all select distinct x.user_id, r.certification_id, r.requirement_id, true, cast(null as bigint)
   from lab_results x join certification_requirements r on r.requirement_type = 'LAB' and r.lab_id = x.lab_id
   where x.completed
   union all select m.user_id, r.certification_id, r.requirement_id, m.mastery_level >= 2, cast(m.mastery_level as bigint)
   from user_skills m join certification_requirements r on r.requirement_type = 'SKILL' and r.skill_id = m.skill_id
   union all select b.user_id, r.certification_id, r.requirement_id, b.best >= r.min_score, b.best
   from (select a.user_id, z.skill_id, max(a.score) as best from quiz_attempts a
     join quizzes z on z.quiz_id = a.quiz_id where z.skill_id is not null group by 1, 2) b
   join certification_requirements r on r.requirement_type = 'MIN_SCORE' and r.skill_id = b.skill_id
     and r.min_score is not null) s"""
_CHECKABLE = """((r.requirement_type = 'COURSE' and r.course_id is not null)
  or (r.requirement_type = 'LAB' and r.lab_id is not null) or (r.requirement_type = 'SKILL' and r.skill_id is not null)
  or (r.requirement_type = 'MIN_SCORE' and r.skill_id is not null and r.min_score is not null))"""


def _facts(t):
    return elig.requirement_facts(t.user_lesson_progress, t.lessons, t.lab_results, t.user_skills, t.quiz_attempts, t.quizzes)


@query("certification_eligibility", f"""
  select s.user_id, s.certification_id, sum(case when s.satisfied then 1 else 0 end)::bigint as met, n.requirements,
    n.to_review, sum(case when s.satisfied then 1 else 0 end) = n.requirements as eligible
  from {_SIGNALS} join (select r.certification_id, count(*) as requirements,
      sum(case when {_CHECKABLE} then 0 else 1 end)::bigint as to_review from certification_requirements r
    join certifications c on c.certification_id = r.certification_id and c.status = 'PUBLISHED' group by 1) n
  on n.certification_id = s.certification_id group by 1, 2, 4, 5""")
def certification_eligibility(t):
    return elig.certification_verdicts(t.certifications, t.certification_requirements, _facts(t))


@query("requirement_detail", f"""
  select p.user_id, p.certification_id, r.requirement_id,
    case when {_CHECKABLE} then coalesce(s.satisfied, false) end as satisfied,
    case when not {_CHECKABLE} then
        'Nécessite une revue manuelle (critère non structuré ou preuve à évaluer par un administrateur).'
      when r.requirement_type = 'COURSE' then 'Cours ''' || r.course_id || ''' '
        || case when s.satisfied then 'terminé.' else 'non terminé.' end
      when r.requirement_type = 'LAB' then 'Lab ''' || r.lab_id || ''' '
        || case when s.satisfied then 'complété.' else 'non complété.' end
      when r.requirement_type = 'SKILL' then 'Maîtrise de ''' || r.skill_id || ''' : ' || coalesce(s.measure, 0)
        || '/4 (seuil requis : 2/4).'
      else 'Meilleur score sur ''' || r.skill_id || ''' : ' || coalesce(cast(s.measure as varchar), 'aucune tentative')
        || ' (seuil requis : ' || r.min_score || ').' end as detail
  from (select distinct user_id, certification_id from {_SIGNALS}) p
  join certifications c on c.certification_id = p.certification_id and c.status = 'PUBLISHED'
  join certification_requirements r on r.certification_id = p.certification_id
  left join {_SIGNALS} on s.user_id = p.user_id and s.requirement_id = r.requirement_id""")
def requirement_detail(t):
    return elig.requirement_states(t.certifications, t.certification_requirements, _facts(t))


# --- audits ------------------------------------------------------------------------


@query("domain_violations", """
  select cast(result_id as varchar) as key, 'score range' as rule from lab_results where score < 0 or score > 100
  union all select cast(result_id as varchar), 'mode' from lab_results where mode not in ('LIBRE')""")
def domain_violations(t):
    return audits.violations(t.lab_results, "result_id", {
        "score range": audits.in_range("score", "lab_score"), "mode": F.col("mode").isin("LIBRE")})


@query("user_domain_violations", """
  select cast(user_id as varchar) as key, 'status' as rule from users where status not in ('ACTIVE', 'PENDING')
  union all select cast(user_id as varchar), 'role' from users where role not in ('LEARNER', 'ADMIN', 'SUPER_ADMIN')""")
def user_domain_violations(t):
    return audits.violations(t.users, "user_id", {
        "status": F.col("status").isin("ACTIVE", "PENDING"), "role": audits.in_enum("role", "role")})


@query("message_violations", """
  select cast(conv_id as varchar) as key, 'role' as rule from conversations where upper(role) not in ('USER', 'ASSISTANT')
  union all select cast(conv_id as varchar), 'empty' from conversations where length(text) < 1""")
def message_violations(t):
    rows = t.conversations.withColumn("role", F.upper("role"))
    return audits.violations(rows, "conv_id", {
        "role": audits.in_enum("role", "message_role"), "empty": F.length("text") >= 1})


@query("ri_violations", """
  select cast(event_id as varchar) as key, 'user_id' as rule from events
  where user_id is not null and user_id not in (select c_custkey from customer)
  union all select cast(attempt_id as varchar), 'quiz_id' from submitted_attempts
  where quiz_id is not null and quiz_id not in (select quiz_id from quizzes where status = 'PUBLISHED')
  union all select cast(n.attempt_id as varchar), 'question_no' from submitted_answers n
  where n.question_no is not null and n.question_no not in (select question_no from quiz_questions)""")
def ri_violations(t):
    live = t.quizzes.filter("status = 'PUBLISHED'")
    return (audits.ri_violations(t.events, t.customer, "user_id", "c_custkey", "event_id")
            .unionByName(audits.ri_violations(t.submitted_attempts, live, "quiz_id", "quiz_id", "attempt_id"))
            .unionByName(audits.ri_violations(t.submitted_answers, t.quiz_questions, "question_no", "question_no", "attempt_id")))


@query("quiz_violations", """
  select cast(quiz_id as varchar) as key, kind || ' needs ' || case kind when 'VALIDATION' then 'lesson_id'
    when 'FINAL' then 'course_id' else 'skill_id' end as rule
  from (select question_id as quiz_id, case correct when 0 then 'VALIDATION' when 1 then 'FINAL' else 'PRACTICE' end
    as kind, case when difficulty = 1 then question_id end as lesson_id, case when difficulty = 2 then question_id end
    as course_id, skill_id from questions) q
  where (kind = 'VALIDATION' and lesson_id is null) or (kind = 'FINAL' and course_id is null)
    or (kind = 'PRACTICE' and skill_id is null)""")
def quiz_violations(t):
    drafts = t.sql("""select question_id as quiz_id, case correct when 0 then 'VALIDATION' when 1 then 'FINAL'
        else 'PRACTICE' end as kind, case when difficulty = 1 then question_id end as lesson_id,
        case when difficulty = 2 then question_id end as course_id, skill_id from questions""")
    return audits.quiz_violations(drafts)


@query("question_violations", """
  select cast(q.question_id as varchar) as key, 'needs a correct option' as rule from questions q
  where not exists (select 1 from question_options o where o.question_id = q.question_id and o.is_correct)
  union all select cast(q.question_id as varchar), 'needs two options' from questions q
  where (select count(*) from question_options o where o.question_id = q.question_id) < 2""")
def question_violations(t):
    return audits.question_violations(t.questions, t.question_options)


@query("requirement_violations", """
  select cast(requirement_id as varchar) as key, 'MIN_SCORE needs min_score' as rule from certification_requirements
    where requirement_type = 'MIN_SCORE' and min_score is null
  union all select cast(requirement_id as varchar), requirement_type || ' needs skill_id' from certification_requirements
    where requirement_type in ('SKILL', 'MIN_SCORE') and skill_id is null
  union all select cast(requirement_id as varchar), 'COURSE needs course_id' from certification_requirements
    where requirement_type = 'COURSE' and course_id is null
  union all select cast(requirement_id as varchar), 'LAB needs lab_id' from certification_requirements
    where requirement_type = 'LAB' and lab_id is null""")
def requirement_violations(t):
    return audits.requirement_violations(t.certification_requirements)


@query("ambiguity_violations", """
  select cast(attempt_id as varchar) || '/' || cast(question_no as varchar) as key, 'one answer' as rule, count(*) as copies
    from submitted_answers group by attempt_id, question_no having count(*) > 1
  union all select cast(skill_id as varchar), 'one practice quiz', count(*) from quizzes
    where skill_id is not null group by skill_id having count(*) > 1
  union all select cast(question_id as varchar), 'one right option', count(*) from question_options
    where is_correct group by question_id having count(*) > 1
  union all select cast(course_id as varchar), 'one final quiz', count(*) from (select course_id from final_quizzes
    union all select course_id from final_quizzes where course_id % 6 = 0) f group by course_id having count(*) > 1""")
def ambiguity_violations(t):
    finals = t.final_quizzes.select("course_id")
    return (audits.ambiguity_violations(t.submitted_answers, ["attempt_id", "question_no"], "one answer")
            .unionByName(audits.ambiguity_violations(t.quizzes.filter("skill_id is not null"), ["skill_id"], "one practice quiz"))
            .unionByName(audits.ambiguity_violations(t.question_options.filter("is_correct"), ["question_id"], "one right option"))
            .unionByName(audits.ambiguity_violations(finals.unionByName(finals.filter("course_id % 6 = 0")), ["course_id"],
                                                     "one final quiz")))


@query("purge_users", """
  select 'attempts' as kind, count(*) as n from quiz_attempts a
    where a.user_id in (select user_id from users where status <> 'SUSPENDED')
      or a.user_id not in (select user_id from users)
  union all select 'answers', count(*) from submitted_answers n where n.attempt_id not in (select attempt_id
    from quiz_attempts where user_id in (select user_id from users where status = 'SUSPENDED'))""")
def purge_users(t):
    kept = audits.purge(
        {"users": t.users, "attempts": t.quiz_attempts, "answers": t.submitted_answers}, "users",
        t.users.filter("status = 'SUSPENDED'"), "user_id",
        [("attempts", "user_id", "attempt_id", "users"), ("answers", "attempt_id", "attempt_id", "attempts")])
    count = F.count(F.lit(1)).alias("n")
    return kept["attempts"].agg(count).select(F.lit("attempts").alias("kind"), "n").unionByName(
        kept["answers"].agg(count).select(F.lit("answers").alias("kind"), "n"))


@query("purge_lessons", """
  select document_id, case when l.status = 'PUBLISHED' then d.lesson_id end as lesson_id
  from imported_documents d join lessons l on l.lesson_id = d.lesson_id""")
def purge_lessons(t):
    gone = t.lessons.filter("status <> 'PUBLISHED'")
    kept = audits.purge({"lessons": t.lessons, "documents": t.imported_documents}, "lessons", gone, "lesson_id",
                        [], [("documents", "lesson_id", "lessons")])
    return kept["documents"].select("document_id", "lesson_id")


# A deep tree of sections (each under the section of a fifth of its number), blocks in sections, notes on blocks and pointers to sections.
_TREE = {
    "sections": "select p_partkey as section_id, case when p_partkey > 7 then cast(floor(p_partkey / 5) as bigint) end as parent_id from part",
    "blocks": "select l_orderkey * 10 + l_linenumber as block_id, l_partkey as section_id from lineitem",
    "notes": """select l_orderkey * 10 + l_linenumber as note_id, l_orderkey * 10 + case when l_linenumber > 1 then l_linenumber - 1 else 1 end
      as block_id from lineitem where l_returnflag = 'R'""",
    "pointers": "select o_orderkey as pointer_id, o_orderkey % 97 + 1 as section_id from orders",
}


@query("purge_section_trees", f"""
  with recursive sections as ({_TREE["sections"]}), blocks as ({_TREE["blocks"]}), notes as ({_TREE["notes"]}), pointers as ({_TREE["pointers"]}),
  gone as (select section_id from sections where section_id % 13 = 5
    union select s.section_id from sections s join gone g on s.parent_id = g.section_id)
  select 'section' as kind, section_id as id, parent_id as ref from sections where section_id not in (select section_id from gone)
  union all select 'block', block_id, section_id from blocks where section_id not in (select section_id from gone)
  union all select 'note', note_id, block_id from notes where block_id not in (
    select block_id from blocks where section_id in (select section_id from gone))
  union all select 'pointer', pointer_id, case when section_id in (select section_id from gone) then null else section_id end from pointers""")
def purge_section_trees(t):
    tables = {name: t.sql(sql) for name, sql in _TREE.items()}
    kept = audits.purge(
        tables, "sections", tables["sections"].filter("section_id % 13 = 5"), "section_id",
        [("sections", "parent_id", "section_id", "sections"), ("blocks", "section_id", "block_id", "sections"),
         ("notes", "block_id", "note_id", "blocks")], [("pointers", "section_id", "sections")])
    return (kept["sections"].selectExpr("'section' as kind", "section_id as id", "parent_id as ref")
            .unionByName(kept["blocks"].selectExpr("'block' as kind", "block_id as id", "section_id as ref"))
            .unionByName(kept["notes"].selectExpr("'note' as kind", "note_id as id", "block_id as ref"))
            .unionByName(kept["pointers"].selectExpr("'pointer' as kind", "pointer_id as id", "section_id as ref")))


@query("restricted_schools", """
  select distinct school_id from schools where school_id in (select school_id from courses)""")
def restricted_schools(t):
    return audits.restricted(t.schools, "school_id", t.courses, "school_id")
