"""Catalogue reads: filters, searches and detail views over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions.nesting import attach, nest

# Roles and states the rules test for.
LEARNER = "LEARNER"
PUBLISHED = "PUBLISHED"
STAFF_PROMOTION = {"ADMIN": "SUPER_ADMIN"}


def published(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == PUBLISHED)


def filter_eq(rows: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters, each applied only when its value is given and not empty."""
    for column, value in wanted.items():
        if value is not None and value != "":
            rows = rows.filter(F.col(column) == value)
    return rows


def search_people(people: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive LIKE on e-mail and names; `%` and `_` stay wildcards."""
    if not text:
        return people
    pattern = f"%{text}%"
    return people.filter(
        F.col("email").ilike(pattern) | F.col("first_name").ilike(pattern) | F.col("last_name").ilike(pattern)
    )


def email_is(people: DataFrame, email: str | Column) -> DataFrame:
    value = F.lit(email) if isinstance(email, str) else email
    return people.filter(F.lower("email") == F.lower(value))


def in_keys(rows: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `keys` (IN sub-query)."""
    return rows.join(keys, on, "left_semi")


def missing_keys(rows: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in `keys` (set difference)."""
    return rows.join(keys, on, "left_anti")


def learners(users: DataFrame) -> DataFrame:
    return users.filter(F.col("role") == LEARNER)


def promote_roles(users: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Bulk role change; pass the inverted mapping to undo it."""
    role = F.col("role")
    out = role
    for old, new in (mapping or STAFF_PROMOTION).items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return users.withColumn("role", out)


def with_skill(lessons: DataFrame) -> DataFrame:
    return lessons.filter(F.col("skill_id").isNotNull())


def root_sections(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("parent_id").isNull())


def lesson_summary(lessons: DataFrame) -> DataFrame:
    return lessons.select("lesson_id", "course_id", "title", "level", "duration_min", "position")


def course_resources(resources: DataFrame, edges: DataFrame) -> DataFrame:
    return published(resources).join(edges, "resource_id").select("course_id", "resource_id", "title", "type")


def pathway_detail(pathways: DataFrame, edges: DataFrame, courses: DataFrame) -> DataFrame:
    """Published pathways with their published courses in edge order."""
    steps = edges.join(
        published(courses).select("course_id", F.col("title").alias("course_title")), "course_id"
    )
    nested = nest(steps, ["pathway_id"], ["position", "course_id"], ["course_title"], "courses")
    return attach(published(pathways), "pathway_id", {"courses": nested})


def quiz_assembly(
    quizzes: DataFrame, quiz_questions: DataFrame, questions: DataFrame, options: DataFrame
) -> DataFrame:
    """One row per question of a quiz, in order, with its ordered options.

    Edges to questions that no longer exist drop out of the join.
    """
    nested = nest(
        options, ["question_id"], ["position", "option_id"], ["option_text", "is_correct"], "options"
    )
    rows = quizzes.select("quiz_id", "title").join(quiz_questions, "quiz_id").join(
        questions.select("question_id", "question_text", "explanation"), "question_id"
    )
    return attach(rows, "question_id", {"options": nested})


def quiz_public(assembly: DataFrame) -> DataFrame:
    """The assembly without anything that gives the answer away."""
    safe = F.transform(
        "options",
        lambda o: F.struct(o["position"].alias("position"), o["option_id"].alias("option_id"),
                           o["option_text"].alias("option_text")),
    )
    return assembly.drop("explanation").withColumn("options", safe)


def answer_key(options: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ambiguous): the single correct option of each question, and the
    questions with several, which must not be graded by picking one."""
    right = options.filter("is_correct").groupBy("question_id").agg(
        F.min("option_id").alias("correct_option_id"), F.count(F.lit(1)).alias("n_correct")
    )
    key = right.filter("n_correct = 1").drop("n_correct").join(
        questions.select("question_id", "explanation"), "question_id"
    )
    return key, right.filter("n_correct > 1").select("question_id", "n_correct")


def course_detail(
    courses: DataFrame, lessons: DataFrame, quizzes: DataFrame, resources: DataFrame, edges: DataFrame
) -> DataFrame:
    """Published courses with ordered published lessons, final quiz and bibliography."""
    lesson_list = nest(
        lesson_summary(published(lessons)), ["course_id"], ["position", "lesson_id"],
        ["title", "level", "duration_min"], "lessons",
    )
    reading = nest(course_resources(resources, edges), ["course_id"], ["title", "resource_id"], ["type"], "resources")
    final = (
        published(quizzes).filter("kind = 'FINAL'").groupBy("course_id").agg(F.min("quiz_id").alias("final_quiz_id"))
    )
    return attach(
        published(courses).join(final, "course_id", "left"), "course_id",
        {"lessons": lesson_list, "resources": reading},
    )


def lesson_detail(
    lessons: DataFrame, objectives: DataFrame, sections: DataFrame, depths: DataFrame,
    quizzes: DataFrame, documents: DataFrame,
) -> DataFrame:
    """Published lessons with objectives, sections, depth levels, quiz and document flag."""
    quiz = (
        published(quizzes).filter("kind = 'VALIDATION'").groupBy("lesson_id")
        .agg(F.min("quiz_id").alias("validation_quiz_id"))
    )
    has_document = documents.select("lesson_id").distinct().withColumn("has_document", F.lit(True))
    base = (
        published(lessons).join(quiz, "lesson_id", "left").join(has_document, "lesson_id", "left")
        .withColumn("has_document", F.coalesce("has_document", F.lit(False)))
    )
    return attach(base, "lesson_id", {
        "objectives": nest(objectives, ["lesson_id"], ["position"], ["label"], "objectives"),
        "sections": nest(sections, ["lesson_id"], ["position"], ["title", "body"], "sections"),
        "depths": nest(depths, ["lesson_id"], ["depth_key"], ["label", "title", "body"], "depths"),
    })


def lab_detail(labs: DataFrame, modes: DataFrame, skills: DataFrame) -> DataFrame:
    return attach(published(labs), "lab_id", {
        "modes": nest(modes.distinct(), ["lab_id"], ["mode"], [], "modes"),
        "skills": nest(skills.distinct(), ["lab_id"], ["skill_id"], [], "skills"),
    })


def course_quizzes(courses: DataFrame, lessons: DataFrame, quizzes: DataFrame) -> DataFrame:
    """(course_id, quiz_id, title) of every published quiz that counts for a course.

    Three equi joins and a union; one OR condition would need a nested loop.
    Lesson-skill pairs are reduced before they meet the quizzes.
    """
    quiz = published(quizzes).select(
        "quiz_id", F.col("title").alias("quiz_title"), "kind",
        F.col("course_id").alias("q_course"), F.col("lesson_id").alias("q_lesson"),
        F.col("skill_id").alias("q_skill"),
    )
    live = published(lessons)
    out = ["course_id", "quiz_id", "quiz_title"]
    direct = quiz.filter("q_course is not null").select(F.col("q_course").alias("course_id"), *out[1:])
    by_lesson = quiz.join(live, F.col("q_lesson") == F.col("lesson_id")).select(*out)
    taught = with_skill(live).select("course_id", "skill_id").distinct()
    by_skill = quiz.filter("kind = 'PRACTICE'").join(taught, F.col("q_skill") == F.col("skill_id")).select(*out)
    every = direct.unionByName(by_lesson).unionByName(by_skill).distinct()
    return every.join(published(courses).select("course_id"), "course_id", "left_semi")


def certification_detail(certifications: DataFrame, requirements: DataFrame) -> DataFrame:
    nested = nest(
        requirements, ["certification_id"], ["position", "requirement_id"],
        ["requirement_type", "description", "min_score"], "requirements",
    )
    return attach(published(certifications), "certification_id", {"requirements": nested})


def exists_published(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return rows.join(published(targets).select(key), key, "left_semi")


def lesson_document(documents: DataFrame) -> DataFrame:
    """The document of each lesson: the smallest (created_at, document_id)."""
    first = F.min_by(F.struct(*[c for c in documents.columns if c != "lesson_id"]),
                     F.struct("created_at", "document_id"))
    return (
        documents.filter("lesson_id is not null").groupBy("lesson_id").agg(first.alias("d"))
        .select("lesson_id", "d.*")
    )
