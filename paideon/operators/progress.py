"""Learner progress: histories, per-user measures and the summary mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paideon.functions.nesting import attach, nest
from paideon.operators.catalogue import learners, published

# Stage numbers of the learner ladder, highest first.
STAGE_CERTIFIED, STAGE_MASTERY_3, STAGE_MASTERY_2, STAGE_LAB = 7, 6, 5, 4
STAGE_MASTERY_1, STAGE_TWO_LESSONS, STAGE_ONE_LESSON, STAGE_START = 3, 2, 1, 0
MAX_MASTERY = 4


def user_progress(progress: DataFrame, lessons: DataFrame) -> DataFrame:
    names = lessons.select("lesson_id", F.col("title").alias("lesson_title"), "course_id")
    return progress.join(names, "lesson_id")


def user_skills(mastery: DataFrame, skills: DataFrame) -> DataFrame:
    return mastery.join(skills.select("skill_id", F.col("name").alias("skill_name"), "school_id"), "skill_id")


def quiz_history(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    return attempts.join(quizzes.select("quiz_id", F.col("title").alias("quiz_title")), "quiz_id")


def lab_history(results: DataFrame, labs: DataFrame | None = None) -> DataFrame:
    """Lab results, with the lab title when `labs` is given (staff view)."""
    if labs is None:
        return results
    return results.join(labs.select("lab_id", F.col("title").alias("lab_title")), "lab_id")


def portfolio(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    nested = nest(edges.distinct(), ["evidence_id"], ["skill_id"], [], "skills")
    return attach(evidence, "evidence_id", {"skills": nested})


def profiles(users: DataFrame, details: DataFrame, goals: DataFrame, skills: DataFrame) -> DataFrame:
    """Every user; without a profile the fields are NULL, the lists empty, done is false."""
    base = users.select("user_id").join(details, "user_id", "left").withColumn(
        "onboarding_done", F.coalesce("onboarding_done", F.lit(False))
    )
    return attach(base, "user_id", {
        "goals": nest(goals, ["user_id"], ["goal_id"], [], "goals"),
        "skills": nest(skills, ["user_id"], ["skill_id"], [], "skills"),
    })


def total_published_lessons(lessons: DataFrame) -> DataFrame:
    return published(lessons).agg(F.count(F.lit(1)).alias("total_lessons"))


def lessons_completed(progress: DataFrame) -> DataFrame:
    return (
        progress.filter("status = 'COMPLETED'").groupBy("user_id").agg(F.count(F.lit(1)).alias("lessons_completed"))
    )


def quiz_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("quiz_attempts"),
        F.count_if("passed").alias("quizzes_passed"),
        F.avg("score").alias("average_score"),
    )


def labs_completed(results: DataFrame) -> DataFrame:
    return results.filter("completed").groupBy("user_id").agg(F.count(F.lit(1)).alias("labs_completed"))


def last_activity(progress: DataFrame) -> DataFrame:
    return progress.groupBy("user_id").agg(F.max("updated_at").alias("last_activity_at"))


def lesson_measures(progress: DataFrame) -> DataFrame:
    """Completed lessons and last activity in one pass."""
    return progress.groupBy("user_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("lessons_completed"),
        F.max("updated_at").alias("last_activity_at"),
    )


def learner_summary(
    users: DataFrame, progress: DataFrame, attempts: DataFrame, results: DataFrame, lessons: DataFrame
) -> DataFrame:
    """One row per learner with lesson, quiz and lab measures.

    Each fact table is reduced to one row per user before it is joined, so the
    joins are one to one and no user is hot. The lesson total is one value and
    enters as a scalar sub-query.
    """
    total = total_published_lessons(lessons).scalar()
    zero = F.lit(0).cast("long")
    return (
        learners(users)
        .select("user_id", "first_name", "last_name", "email", "created_at")
        .join(lesson_measures(progress), "user_id", "left")
        .join(quiz_stats(attempts), "user_id", "left")
        .join(labs_completed(results), "user_id", "left")
        .withColumns({
            name: F.coalesce(name, zero)
            for name in ("lessons_completed", "quiz_attempts", "quizzes_passed", "labs_completed")
        })
        .withColumn("total_lessons", total)
    )


def learner_histories(
    users: DataFrame, progress: DataFrame, attempts: DataFrame, results: DataFrame,
    lessons: DataFrame, quizzes: DataFrame, labs: DataFrame,
) -> DataFrame:
    """The three histories of all learners as rows of any number per learner.

    `newest` and `item_id` order a kind within a learner, newest first and a missing time first.
    """
    def rows(history: DataFrame, kind: str, when: str, item: str, *fields: str) -> DataFrame:
        return history.select("user_id", F.lit(kind).alias("kind"), (-F.unix_micros(F.col(when).cast("timestamp"))).alias("newest"),
                              F.col(item).alias("item_id"), *fields)

    listed = rows(user_progress(progress, lessons), "lesson", "updated_at", "lesson_id", F.col("lesson_title").alias("title"), "status")
    for other in (
        rows(quiz_history(attempts, quizzes), "quiz", "started_at", "attempt_id", F.col("quiz_title").alias("title"), "score", "passed"),
        rows(lab_history(results, labs), "lab", "submitted_at", "result_id", F.col("lab_title").alias("title"), "completed"),
    ):
        listed = listed.unionByName(other, allowMissingColumns=True)
    return listed.join(learners(users).select("user_id"), "user_id", "left_semi")


def learner_detail(
    users: DataFrame, progress: DataFrame, attempts: DataFrame, results: DataFrame,
    lessons: DataFrame, quizzes: DataFrame, labs: DataFrame,
) -> DataFrame:
    """Learners with their three histories nested, newest first inside each.

    Each history of a learner is one array in one task; `learner_histories` has no such limit.
    """
    def newest(rows: DataFrame, when: str) -> DataFrame:
        # -1 * time sorts ascending as newest first; a missing time sorts first.
        return rows.withColumn("newest", -F.unix_micros(F.col(when).cast("timestamp")))

    lessons_done = newest(user_progress(progress, lessons), "updated_at")
    quizzes_done = newest(quiz_history(attempts, quizzes), "started_at")
    labs_done = newest(lab_history(results, labs), "submitted_at")
    return attach(learners(users).select("user_id", "email"), "user_id", {
        "lessons": nest(lessons_done, ["user_id"], ["newest", "lesson_id"], ["lesson_title", "status"], "lessons"),
        "quizzes": nest(quizzes_done, ["user_id"], ["newest", "attempt_id"], ["quiz_title", "score", "passed"],
                        "quizzes"),
        "labs": nest(labs_done, ["user_id"], ["newest", "result_id"], ["lab_title", "completed"], "labs"),
    })


def requirement_counts(certifications: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements and linked references; a requirement with two references counts twice."""
    counts = requirements.groupBy("certification_id").agg(
        F.count(F.lit(1)).alias("requirements"),
        (F.count("skill_id") + F.count("course_id") + F.count("lab_id")).alias("linked"),
    )
    return certifications.join(counts, "certification_id", "left").withColumns({
        "requirements": F.coalesce("requirements", F.lit(0)), "linked": F.coalesce("linked", F.lit(0)),
    })


def question_counts(quizzes: DataFrame, quiz_questions: DataFrame) -> DataFrame:
    counts = quiz_questions.groupBy("quiz_id").agg(F.count(F.lit(1)).alias("question_count"))
    return quizzes.join(counts, "quiz_id", "left").withColumn(
        "question_count", F.coalesce("question_count", F.lit(0))
    )


def course_completion(progress: DataFrame, lessons: DataFrame) -> DataFrame:
    """(user, course) with completed and total published lessons, and whether all are done.

    Pairs without a completed lesson are not listed: they are not completed.
    """
    live = published(lessons).select("lesson_id", "course_id")
    totals = live.groupBy("course_id").agg(F.count(F.lit(1)).alias("total"))
    done = (
        progress.filter("status = 'COMPLETED'").join(live, "lesson_id")
        .groupBy("user_id", "course_id").agg(F.count(F.lit(1)).alias("completed"))
    )
    return done.join(totals, "course_id").withColumn("course_completed", F.col("completed") == F.col("total"))


def lab_done(results: DataFrame) -> DataFrame:
    return results.filter("completed").select("user_id", "lab_id").distinct()


def mastery_levels(pairs: DataFrame, mastery: DataFrame) -> DataFrame:
    """Mastery of the given (user, skill) pairs, 0 where none is stored."""
    return pairs.join(mastery.select("user_id", "skill_id", "mastery_level"), ["user_id", "skill_id"], "left").withColumn(
        "mastery_level", F.coalesce("mastery_level", F.lit(0))
    )


def best_quiz_score(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("user_id", "quiz_id").agg(F.max("score").alias("best_score"))


def best_skill_score(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Best score per (user, skill) over every quiz of the skill, any kind or status.

    Attempts shrink to one row per (user, quiz) before the quiz lookup.
    """
    tied = quizzes.filter("skill_id is not null").select("quiz_id", "skill_id")
    return best_quiz_score(attempts).join(tied, "quiz_id").groupBy("user_id", "skill_id").agg(
        F.max("best_score").alias("best_score")
    )


def profile_stats(users: DataFrame, attempts: DataFrame, mastery: DataFrame) -> DataFrame:
    """Average score rounded half up and number of skills above level 0."""
    scores = attempts.groupBy("user_id").agg(F.floor(F.avg("score") + 0.5).alias("average_score"))
    skills = mastery.groupBy("user_id").agg(F.count_if(F.col("mastery_level") > 0).alias("skills_in_progress"))
    return (
        users.select("user_id").join(scores, "user_id", "left").join(skills, "user_id", "left")
        .withColumn("skills_in_progress", F.coalesce("skills_in_progress", F.lit(0)))
    )


def dashboard(users: DataFrame, progress: DataFrame) -> DataFrame:
    return users.select("user_id").join(lessons_completed(progress), "user_id", "left").withColumn(
        "lessons_completed", F.coalesce("lessons_completed", F.lit(0))
    )


def mastery_percent(mastery: DataFrame) -> DataFrame:
    return mastery.withColumn("mastery_pct", F.col("mastery_level") / MAX_MASTERY * 100)


def learner_stage(
    users: DataFrame, progress: DataFrame, mastery: DataFrame, results: DataFrame, certificates: DataFrame
) -> DataFrame:
    """Stage of each user on the ladder; the most advanced signal wins."""
    top = mastery.groupBy("user_id").agg(F.max("mastery_level").alias("top_mastery"))
    labs = results.select("user_id").distinct().withColumn("has_lab", F.lit(True))
    certified = certificates.select("user_id").distinct().withColumn("has_certificate", F.lit(True))
    level, done = F.coalesce("top_mastery", F.lit(0)), F.coalesce("lessons_completed", F.lit(0))
    stage = (
        F.when(F.col("has_certificate"), STAGE_CERTIFIED)
        .when(level >= 3, STAGE_MASTERY_3)
        .when(level >= 2, STAGE_MASTERY_2)
        .when(F.col("has_lab"), STAGE_LAB)
        .when(level >= 1, STAGE_MASTERY_1)
        .when(done >= 2, STAGE_TWO_LESSONS)
        .when(done >= 1, STAGE_ONE_LESSON)
        .otherwise(STAGE_START)
    )
    return (
        users.select("user_id")
        .join(certified, "user_id", "left").join(top, "user_id", "left")
        .join(labs, "user_id", "left").join(lessons_completed(progress), "user_id", "left")
        .select("user_id", stage.alias("stage"))
    )
