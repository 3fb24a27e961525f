"""Queries that run the learner streams over files of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paideon.operators import catalogue as cat, eligibility as elig
from paideon.operators.progress import best_quiz_score
from paideon.plans.learning import _CERTIFICATES, _CHECKED, _COURSE_QUIZZES, _ELIGIBILITY, _FINAL_QUIZZES
from paideon.plans.registry import micros, query
from paideon.session import stage, stage_root
from paideon.streaming import learner_streams as ls


def as_stream(rows: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Write rows as they are partitioned and read them back as a stream, at the caller's rate."""
    spark = rows.sparkSession
    path = f"{stage_root(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)


def run(writer, spark) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    spark = stream.sparkSession
    base = f"{stage_root(spark)}/stream-out-{uuid.uuid4().hex}"
    run(ls.write_batches(stream, f"{base}/data", f"{base}/checkpoint", mode), spark)
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def attempt_events(t) -> DataFrame:
    """Attempts with their answers in submit order, as one event each."""
    item = F.struct("submit_seq", "question_no", "selected_option_id")
    given = t.submitted_answers.groupBy("attempt_id").agg(F.array_sort(F.collect_list(item)).alias("answers"))
    return t.submitted_attempts.join(given, "attempt_id", "left")


def _graded(t) -> DataFrame:
    sheets = ls.quiz_sheets(t.quizzes, t.quiz_questions, t.answer_key)
    return ls.stream_grade(as_stream(attempt_events(t)), sheets)


@query("stream_grading", f"""
  select attempt_id, case when reason is null then score end as score,
    case when reason is null then score >= pass_threshold end as passed, reason from {_CHECKED}""")
def stream_grading(t):
    return collect_stream(_graded(t)).select("attempt_id", "score", "passed", "reason")


@query("stream_mastery", f"""
  select user_id, skill_id, least(count(*), 4) as mastery_level from {_CHECKED}
  where reason is null and score >= pass_threshold and skill_id is not null group by 1, 2""")
def stream_mastery(t):
    updates = collect_stream(ls.stream_mastery(_graded(t)), "update")
    return ls.merged_mastery(updates)


@query("stream_progress", """
  select coalesce(p.user_id, e.user_id) as user_id, coalesce(p.lesson_id, e.lesson_id) as lesson_id,
    case when e.user_id is not null then 'COMPLETED' else p.status end as status,
    epoch_us(coalesce(e.last_ts, p.completed_at)) as completed_us
  from user_lesson_progress p full outer join (select user_id, lesson_id, min(ts) as first_ts, max(ts) as last_ts
    from lesson_events where event_type = 'view' and lesson_id in
      (select lesson_id from lessons where status = 'PUBLISHED') group by 1, 2) e
  on e.user_id = p.user_id and e.lesson_id = p.lesson_id""")
def stream_progress(t):
    events = t.lesson_events.filter("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp"))
    updates = collect_stream(ls.stream_progress(as_stream(events), t.lessons), "update")
    rows = ls.merged_progress(t.user_lesson_progress, updates, t.lessons)
    return rows.select("user_id", "lesson_id", "status", micros("completed_at").alias("completed_us"))


@query("stream_certificates", f"""
  select user_id, course_id, cast(round_even(average_score, 0) as bigint) as average_score
  from {_ELIGIBILITY.format(w=_COURSE_QUIZZES)} where all_attempted and average_score >= 80""")
def stream_certificates(t):
    none = t.quiz_attempts.select("user_id", F.col("quiz_id").alias("course_id")).limit(0)
    return _issued_by_stream(t, t.quizzes, none)


def _issued_by_stream(t, quizzes: DataFrame, issued: DataFrame) -> DataFrame:
    groups = elig.course_groups(cat.course_quizzes(t.courses, t.lessons, quizzes), best_quiz_score(t.quiz_attempts))
    scores = stage(elig.group_scores(t.quiz_attempts, groups), "scores")
    # Every pair of a user and a group of courses arrives twice, in different batches; the stream makes its courses of it.
    events = as_stream(scores.unionByName(scores), 1)
    eligible = elig.group_eligibility(events, groups).drop("tried_quizzes")
    return collect_stream(ls.stream_certificates(eligible, issued)).select("user_id", "course_id", "average_score")


@query("stream_final_certificates", f"""
  select e.user_id, e.course_id, cast(round_even(average_score, 0) as bigint) as average_score
  from {_ELIGIBILITY.format(w=_FINAL_QUIZZES)} left join {_CERTIFICATES} c
    on c.user_id = e.user_id and c.course_id = e.course_id
  where all_attempted and average_score >= 80 and c.user_id is null""")
def stream_final_certificates(t):
    return _issued_by_stream(t, t.final_quizzes, stage(t.sql(f"select * from {_CERTIFICATES} c"), "issued"))
