"""Grading of submitted quiz attempts and the state changes that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paideon.functions.nesting import nest
from paideon.functions.values import round_half_even
from paideon.operators.catalogue import published
from paideon.operators.merge import replace_children, upsert
from paideon.operators.progress import MAX_MASTERY


def last_answer(answers: DataFrame) -> DataFrame:
    """The answer that counts per (attempt, question): the last submitted one."""
    return answers.groupBy("attempt_id", "question_no").agg(
        F.max_by("selected_option_id", "submit_seq").alias("selected_option_id")
    )


def keyed_questions(quiz_questions: DataFrame, key: DataFrame) -> DataFrame:
    """Questions of each quiz with their single correct option, NULL where there is none."""
    return quiz_questions.join(
        key.select("question_no", "correct_option_id", "explanation"), "question_no", "left"
    ).select("quiz_id", "question_no", "correct_option_id", "explanation")


def unknown_answers(attempts: DataFrame, answers: DataFrame, quiz_questions: DataFrame) -> DataFrame:
    """Answers whose question is not part of the attempt's quiz."""
    given = answers.select("attempt_id", "question_no").distinct()
    return given.join(attempts.select("attempt_id", "quiz_id"), "attempt_id").join(
        quiz_questions.select("quiz_id", "question_no"), ["quiz_id", "question_no"], "left_anti"
    )


def quiz_sheets(quizzes: DataFrame, quiz_questions: DataFrame, key: DataFrame) -> DataFrame:
    """One row per published quiz with its questions and their correct options."""
    question = F.struct("question_no", "correct_option_id", "explanation")
    questions = keyed_questions(quiz_questions, key).groupBy("quiz_id").agg(F.collect_list(question).alias("questions"))
    return published(quizzes).select("quiz_id", "skill_id", "pass_threshold").join(questions, "quiz_id", "left")


def answer_lists(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Attempts with the list of their counting answers, NULL where nothing was answered.

    Answers are dealt by attempt once; the last one per question and the list are both
    taken from that.
    """
    given = last_answer(answers.repartition("attempt_id")).groupBy("attempt_id").agg(
        F.collect_list(F.struct("question_no", "selected_option_id")).alias("given"))
    return attempts.join(given, "attempt_id", "left")


def marked(listed: DataFrame, sheets: DataFrame) -> DataFrame:
    """Attempts beside their quiz sheet, with score and result or the reason of rejection.

    Every row is decided on its own, so this serves tables and streams alike.
    """
    none = F.array().cast(sheets.schema["questions"].dataType)
    rows = listed.join(sheets, "quiz_id", "left").withColumn("questions", F.coalesce("questions", none))
    asked = F.transform("questions", lambda q: q["question_no"])
    keys = F.filter("questions", lambda q: q["correct_option_id"].isNotNull())
    right = F.array_intersect(
        F.transform(keys, lambda q: F.struct(
            q["question_no"].alias("question_no"), q["correct_option_id"].alias("selected_option_id"))), "given")
    total = F.size("questions")
    reason = (
        F.when(F.coalesce(F.size("given"), F.lit(0)) <= 0, "NO_ANSWER")
        .when(F.col("pass_threshold").isNull(), "QUIZ_NOT_FOUND")
        .when(F.size(F.array_except(F.transform("given", lambda g: g["question_no"]), asked)) > 0, "UNKNOWN_QUESTION")
        .when(F.size(keys) < total, "NO_SINGLE_KEY")
    )
    score = F.when(total > 0, round_half_even(100 * F.col("correct_count") / total)).otherwise(F.lit(0).cast("long"))
    return (
        rows.withColumns({"reason": reason, "correct_count": F.size(right).cast("long"), "total_questions": total.cast("long")})
        .withColumn("score", F.when(F.col("reason").isNull(), score))
        .withColumn("passed", F.col("score") >= F.col("pass_threshold"))
    )


def check_attempts(
    attempts: DataFrame, answers: DataFrame, quizzes: DataFrame, quiz_questions: DataFrame, key: DataFrame
) -> DataFrame:
    """Every attempt with score and result, or the reason it is rejected."""
    return marked(answer_lists(attempts, answers), quiz_sheets(quizzes, quiz_questions, key)).select(
        "attempt_id", "user_id", "quiz_id", "skill_id", "started_at", "correct_count", "total_questions", "score", "passed",
        "reason")


def grade_attempts(
    attempts: DataFrame, answers: DataFrame, quizzes: DataFrame, quiz_questions: DataFrame, key: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(graded attempts, rejected attempts with reason)."""
    checked = check_attempts(attempts, answers, quizzes, quiz_questions, key)
    graded = checked.filter("reason is null").drop("reason")
    rejects = checked.filter("reason is not null").select("attempt_id", "user_id", "quiz_id", "reason")
    return graded, rejects


def unknown_question_lists(attempts: DataFrame, answers: DataFrame, quiz_questions: DataFrame) -> DataFrame:
    """Rejected attempts with the sorted ids of their unknown questions."""
    return nest(unknown_answers(attempts, answers, quiz_questions), ["attempt_id"], ["question_no"], [], "unknown")


def attempt_answers(
    attempts: DataFrame, answers: DataFrame, quizzes: DataFrame, quiz_questions: DataFrame, key: DataFrame
) -> DataFrame:
    """One row per question of each graded attempt, unanswered ones included."""
    graded = marked(answer_lists(attempts, answers), quiz_sheets(quizzes, quiz_questions, key)).filter("reason is null")
    rows = graded.select("attempt_id", F.map_from_entries("given").alias("given"), F.inline("questions"))
    picked = rows.withColumn("selected_option_id", F.try_element_at("given", F.col("question_no"))).drop("given")
    right = F.col("selected_option_id") == F.col("correct_option_id")
    return picked.withColumn("is_correct", F.coalesce(right, F.lit(False)))


def bump_mastery(mastery: DataFrame, graded: DataFrame) -> DataFrame:
    """Each pass on a quiz with a skill adds one level, up to the cap.

    Passes are only counted, so neither their order nor batching matters.
    """
    passes = graded.filter("passed and skill_id is not null").groupBy("user_id", "skill_id").agg(
        F.count(F.lit(1)).alias("passes")
    )
    level, n = F.coalesce("mastery_level", F.lit(0)), F.coalesce("passes", F.lit(0))
    return mastery.select("user_id", "skill_id", "mastery_level").join(
        passes, ["user_id", "skill_id"], "full_outer"
    ).select(
        "user_id", "skill_id",
        F.when(level >= MAX_MASTERY, level).otherwise(F.least(level + n, F.lit(MAX_MASTERY))).alias("mastery_level"),
    )


def complete_lessons(progress: DataFrame, events: DataFrame, lessons: DataFrame) -> DataFrame:
    """Completion events on published lessons merged into the progress table."""
    done = (
        events.join(published(lessons).select("lesson_id"), "lesson_id", "left_semi")
        .groupBy("user_id", "lesson_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    hit = F.col("last_ts").isNotNull()
    return progress.join(done, ["user_id", "lesson_id"], "full_outer").select(
        "user_id", "lesson_id",
        F.when(hit, "COMPLETED").otherwise(F.col("status")).alias("status"),
        F.when(hit, 100).otherwise(F.col("progress_pct")).alias("progress_pct"),
        F.coalesce("started_at", "first_ts").alias("started_at"),
        F.coalesce("last_ts", "completed_at").alias("completed_at"),
        F.coalesce("last_ts", "updated_at").alias("updated_at"),
    )


def check_labs(submissions: DataFrame, labs: DataFrame) -> DataFrame:
    """Submissions with a reject reason: unpublished lab or score outside 0-100."""
    live = published(labs).select("lab_id").withColumn("_live", F.lit(True))
    reason = F.when(F.col("_live").isNull(), "LAB_NOT_FOUND").when(
        (F.col("score") < 0) | (F.col("score") > 100), "SCORE_OUT_OF_RANGE"
    )
    return submissions.join(live, "lab_id", "left").withColumn("reason", reason).drop("_live")


def submit_labs(results: DataFrame, submissions: DataFrame, labs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results with the accepted submissions stored as completed, rejects)."""
    checked = check_labs(submissions, labs)
    stored = checked.filter("reason is null").drop("reason").withColumn("completed", F.lit(True))
    return results.unionByName(stored), checked.filter("reason is not null")


def upsert_profiles(
    details: DataFrame, goals: DataFrame, skills: DataFrame,
    saves: DataFrame, save_goals: DataFrame, save_skills: DataFrame, seq: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile saves: fields overwritten, onboarding done, goals and skills replaced."""
    merged = upsert(details, saves.withColumn("onboarding_done", F.lit(True)), "user_id",
                    ["profile_type_id", "weekly_hours", "onboarding_done"], seq)
    return (
        merged,
        replace_children(goals, saves, save_goals, "user_id"),
        replace_children(skills, saves, save_skills, "user_id"),
    )


def append_evidence(
    evidence: DataFrame, edges: DataFrame, new: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, edges, violations); a repeated (evidence, skill) pair is a violation."""
    pair = ["evidence_id", "skill_id"]
    every = edges.select(*pair).unionByName(new_edges.select(*pair))
    counted = every.groupBy(*pair).agg(F.count(F.lit(1)).alias("copies"))
    return (
        evidence.unionByName(new),
        counted.select(*pair),
        counted.filter("copies > 1"),
    )
