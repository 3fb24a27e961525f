"""Constraint checks as violation tables, and cascading removal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.session import stage

# --- Fixed values: the enumerations of the schema ----------------------------
ENUMS = {
    "role": ("LEARNER", "ADMIN", "SUPER_ADMIN"),
    "account_status": ("ACTIVE", "SUSPENDED", "PENDING"),
    "content_status": ("DRAFT", "PUBLISHED", "ARCHIVED"),
    "quiz_kind": ("PRACTICE", "VALIDATION", "FINAL"),
    "requirement_type": ("COURSE", "MIN_SCORE", "LAB", "SKILL", "EVIDENCE", "FINAL_PROJECT"),
    "certification_status": ("IN_PROGRESS", "ELIGIBLE", "ISSUED", "REVOKED"),
    "progress_status": ("NOT_STARTED", "IN_PROGRESS", "COMPLETED"),
    "notification_type": ("NEW_ACTIVITY", "COURSE_COMPLETED", "QUIZ_PASSED", "CERTIFICATION_ISSUED",
                          "NEW_CONTENT", "FEEDBACK", "REMINDER"),
    "message_role": ("USER", "ASSISTANT"),
    "depth_key": ("ESSENTIAL", "TECHNICAL", "MATHEMATICS", "IMPLEMENTATION", "ARCHITECTURE", "GOVERNANCE"),
}
RANGES = {
    "section_level": (1, 4), "confidence": (0, 1), "difficulty": (1, 5), "pass_threshold": (0, 100),
    "min_score": (0, 100), "lab_score": (0, 100),
}
TITLE_LENGTH = (1, 200)
REQUIRED_REFERENCE = {"COURSE": "course_id", "LAB": "lab_id", "SKILL": "skill_id", "MIN_SCORE": "skill_id"}
QUIZ_REFERENCE = {"VALIDATION": "lesson_id", "FINAL": "course_id", "PRACTICE": "skill_id"}
# -----------------------------------------------------------------------------


def in_enum(column: str, enum: str) -> Column:
    return F.col(column).isin(*ENUMS[enum])


def in_range(column: str, rule: str) -> Column:
    low, high = RANGES[rule]
    return F.col(column).between(low, high)


def title_length_ok(column: str = "title") -> Column:
    return F.length(column).between(*TITLE_LENGTH)


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that is NULL counts as kept, as CHECK does.

    All rules are tested in one pass over the rows.
    """
    broken = F.array_compact(F.array(*[
        F.when(~rule, F.lit(name)) for name, rule in rules.items()
    ]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def ri_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    orphans = child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return orphans.select(F.col(key).cast("string").alias("key"), F.lit(fk).alias("rule"))


def ambiguity_violations(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that a one-row lookup would find more than once."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return counted.select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"),
                          F.lit(rule).alias("rule"), "copies")


def quiz_violations(quizzes: DataFrame) -> DataFrame:
    """Quizzes without the reference their kind demands."""
    return violations(quizzes, "quiz_id", {
        f"{kind} needs {column}": (F.col("kind") != kind) | F.col(column).isNotNull()
        for kind, column in QUIZ_REFERENCE.items()
    })


def question_violations(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions without a correct option or with fewer than two options."""
    counts = options.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_options"), F.count_if("is_correct").alias("n_correct")
    )
    every = questions.select("question_id").join(counts, "question_id", "left").fillna(0, ["n_options", "n_correct"])
    return violations(every, "question_id", {
        "needs a correct option": F.col("n_correct") > 0, "needs two options": F.col("n_options") >= 2,
    })


def requirement_violations(requirements: DataFrame) -> DataFrame:
    """Requirements without the reference or number their type demands."""
    kind = F.col("requirement_type")
    rules = {f"{name} needs {column}": (kind != name) | F.col(column).isNotNull()
             for name, column in REQUIRED_REFERENCE.items()}
    rules["MIN_SCORE needs min_score"] = (kind != "MIN_SCORE") | F.col("min_score").isNotNull()
    return violations(requirements, "requirement_id", rules)


def self_edges(edges: DataFrame, left: str, right: str) -> DataFrame:
    return edges.filter(F.col(left) == F.col(right))


def _descendants(rows: DataFrame, fk: str, own: str, gone: DataFrame) -> DataFrame:
    """`gone` keys (column `own`) and the keys of all rows below them, whatever the depth.

    Every round follows one level of references with a semi join and writes the keys it found.
    """
    dead = fresh = stage(gone.select(own).distinct(), "gone")
    while True:
        below = rows.join(fresh.select(F.col(own).alias(fk)), fk, "left_semi").select(own)
        fresh = stage(below.join(dead, own, "left_anti").distinct(), "gone")
        if fresh.isEmpty():
            return dead
        dead = dead.unionByName(fresh)


def purge(
    tables: Mapping[str, DataFrame], root: str, gone: DataFrame, key: str,
    cascades: Sequence[tuple[str, str, str, str]], set_null: Sequence[tuple[str, str, str]] = (),
) -> dict[str, DataFrame]:
    """Remove `gone` keys from `root` and everything that depends on them.

    cascades: (child table, foreign key, child's own key, parent table), parents first; a table
    that refers to itself (child and parent are the same) goes with all rows below, to any depth.
    set_null: (table, foreign key, parent table) references that are cleared instead.
    """
    from paideon.operators.merge import set_null_where_gone

    own_fk = {child: fk for child, fk, _, parent in cascades if child == parent}
    between = [c for c in cascades if c[0] != c[3]]

    def closed(name: str, own: str, keys: DataFrame) -> DataFrame:
        return _descendants(tables[name], own_fk[name], own, keys) if name in own_fk else keys

    out = dict(tables)
    dead = {root: closed(root, key, gone.select(key).distinct())}
    dead_key = {root: key}
    out[root] = tables[root].join(dead[root], key, "left_anti")
    for i, (child, fk, own, parent) in enumerate(between):
        gone_parents = dead[parent].select(F.col(dead_key[parent]).alias(fk))
        lost = tables[child].join(gone_parents, fk, "left_semi").select(own)
        out[child] = out[child].join(gone_parents, fk, "left_anti")
        dead[child] = (dead[child].unionByName(lost) if child in dead else lost).distinct()
        dead_key[child] = own
        if child not in [c[0] for c in between[i + 1:]]:  # all its parents have been seen
            dead[child] = closed(child, own, dead[child])
            if child in own_fk:
                out[child] = out[child].join(dead[child], own, "left_anti")
    for child, fk, parent in set_null:
        out[child] = set_null_where_gone(out[child], fk, dead[parent], dead_key[parent])
    return out


def restricted(gone: DataFrame, key: str, children: DataFrame, fk: str) -> DataFrame:
    """Keys that may not be removed because a RESTRICT reference still uses them."""
    return gone.select(key).join(children.select(F.col(fk).alias(key)), key, "left_semi")
