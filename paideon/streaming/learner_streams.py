"""Learner actions as streams: grading, mastery, lesson completion, certificates.

Every stream gives what the batch operator gives on the same actions, in whatever
batches they arrive. Sinks write one folder per micro-batch and overwrite it on a
retry, so a repeated batch leaves nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from paideon.functions.fold import let
from paideon.operators.catalogue import published
from paideon.operators.eligibility import issue_certificates
from paideon.operators.grading import complete_lessons, marked, quiz_sheets
from paideon.operators.progress import MAX_MASTERY


def _counting(answers: Column) -> Column:
    """The last answer of each question in an event's answer list, NULL when there is none.

    Sorted by question, an answer is the last one if the next belongs to another question.
    """
    placed = F.sort_array(F.transform(answers, lambda a, i: F.struct(
        a["question_no"].alias("question_no"), i.alias("i"), a["selected_option_id"].alias("selected_option_id"))))

    def last_ones(given: Column) -> Column:
        last = F.filter(given, lambda a, i: ~F.coalesce(F.get(given, i + 1)["question_no"].eqNullSafe(a["question_no"]) & (i + 1 < F.size(given)), F.lit(False)))
        return F.transform(last, lambda a: F.struct(a["question_no"].alias("question_no"), a["selected_option_id"].alias("selected_option_id")))

    return F.when(F.size(answers) > 0, let(placed, last_ones))


def stream_grade(events: DataFrame, sheets: DataFrame) -> DataFrame:
    """Attempt events (with their answers) graded by a join with the static sheets.

    Rejected attempts carry a reason and no score.
    """
    listed = events.withColumn("given", _counting(F.col("answers"))).drop("answers")
    return marked(listed, sheets).select(
        "attempt_id", "user_id", "quiz_id", "skill_id", "started_at", "score", "passed", "reason")


def stream_mastery(graded: DataFrame) -> DataFrame:
    """Running mastery per (user, skill): passes counted, capped. For update mode."""
    return (
        graded.filter("passed and skill_id is not null").groupBy("user_id", "skill_id")
        .agg(F.least(F.count(F.lit(1)), F.lit(MAX_MASTERY)).alias("mastery_level"))
    )


def stream_progress(events: DataFrame, lessons: DataFrame) -> DataFrame:
    """First and last completion per (user, published lesson). For update mode."""
    return (
        events.join(published(lessons).select("lesson_id"), "lesson_id", "left_semi")
        .groupBy("user_id", "lesson_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Write each micro-batch to its own folder, replacing it when it is retried."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)


def merged_mastery(updates: DataFrame) -> DataFrame:
    """Latest state per (user, skill) of the update batches; levels only grow."""
    return updates.groupBy("user_id", "skill_id").agg(F.max("mastery_level").alias("mastery_level"))


def merged_progress(progress: DataFrame, updates: DataFrame, lessons: DataFrame) -> DataFrame:
    """Progress table with the completion updates applied, as the batch merge does.

    First and last times merge in any order and repetition, so the updates stay an
    append-only log between rewrites of the table.
    """
    ends = updates.select("user_id", "lesson_id", F.explode(F.array("first_ts", "last_ts")).alias("ts"))
    return complete_lessons(progress, ends, lessons)


def stream_certificates(eligible: DataFrame, issued: DataFrame) -> DataFrame:
    """Each newly eligible (user, course) once, over all batches. For append mode.

    `issued` holds the certificates at the start of the stream; pairs met since are keyed state of the
    query, so no batch reads what earlier batches wrote and a repeated event changes nothing.
    """
    return issue_certificates(issued, eligible).dropDuplicates(["user_id", "course_id"])
