"""Catalogue JSON: schema, scan and the load of every root array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paideon.functions.text import PERCENT, whole_number
from paideon.operators.merge import (
    drop_retired, edges_insert_absent, explode_children, insert_once, replace_children, upsert, upsert_glossary,
)

# --- Fixed values ------------------------------------------------------------
RETIRED_COURSES = (
    "agent-engineering", "agents", "agents-panorama", "data", "data-architecture", "distributed-data",
    "global-governance", "governance", "iso42001", "llm-systems", "mlops", "systems-ai", "rag",
    "rag-engineering", "ml", "ml-advanced", "information-theory-ai", "math-ai",
)
RETIRED_LESSONS = (
    "agent-loop-tools", "agent-memory-planning", "agent-evaluation-governance", "data-quality-lineage",
)
DEPTH_LABELS = {
    "essential": "Essentiel",
    "technical": "Technique",
    "mathematics": "Mathématiques",
    "implementation": "Implémentation",
    "architecture": "Architecture",
    "governance": "Gouvernance & risques",
}
PRACTICE_TITLE = "Quiz de pratique — "
PRACTICE_THRESHOLD = 70
PRACTICE_SIZE = 10
# -----------------------------------------------------------------------------

_DEPTH = "struct<" + ",".join(f"{k}:struct<title:string,body:string>" for k in DEPTH_LABELS) + ">"

CATALOGUE_SCHEMA = f"""
    schools array<struct<id:string,name:string,short:string,color:string,description:string>>,
    skills array<struct<id:string,schoolId:string,name:string,description:string>>,
    pathways array<struct<id:string,title:string,profile:string,level:string,duration:string,color:string,
      description:string,courses:array<string>>>,
    courses array<struct<id:string,schoolId:string,title:string,level:string,duration:int,color:string,
      description:string,lessons:array<string>>>,
    lessons array<struct<id:string,courseId:string,skillId:string,demoId:string,title:string,level:string,
      duration:int,summary:string,example:string,objectives:array<string>,
      sections:array<struct<title:string,body:string>>,depth:{_DEPTH}>>,
    labs array<struct<id:string,title:string,schoolId:string,level:string,duration:int,color:string,
      description:string,skills:array<string>,modes:array<string>>>,
    demos array<struct<id:string,title:string,description:string>>,
    resources array<struct<id:string,title:string,type:string,publisher:string,year:int,level:string,
      tags:array<string>,description:string>>,
    glossary array<struct<term:string,en:string,definition:string>>,
    certifications array<struct<id:string,level:string,title:string,description:string,
      requirements:array<string>,threshold:int,color:string>>,
    profiles array<struct<id:string,name:string,description:string>>,
    goals array<struct<id:string,label:string>>,
    questions array<struct<id:string,domain:string,skillId:string,difficulty:int,question:string,
      options:array<string>,correct:int,explanation:string>>,
    knowledgeGraph array<struct<id:string,title:string,stage:string,formula:string,question:string,
      dependsOn:array<string>,usedIn:array<string>,demos:array<string>,labs:array<string>,
      applications:array<string>>>,
    questionBanks array<struct<id:string,title:string,description:string>>,
    frameworks struct<iso:array<struct<id:string,name:string,purpose:string>>,
      jurisdictions:array<struct<id:string,name:string,focus:string>>>
"""
ROOT_ARRAYS = (
    "schools skills pathways courses lessons labs demos resources glossary certifications profiles goals "
    "questions knowledgeGraph questionBanks"
).split()


def explode_catalogue(documents: DataFrame) -> dict[str, DataFrame]:
    """Root arrays of catalogue documents as tables; `seq` is the array index."""
    tables = {
        name: documents.select(F.posexplode(name).alias("seq", "e")).select("seq", "e.*") for name in ROOT_ARRAYS
    }
    for name in ("iso", "jurisdictions"):
        tables[name] = documents.select(F.posexplode(f"frameworks.{name}").alias("seq", "e")).select("seq", "e.*")
    return tables


def load_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read catalogue JSON with the declared schema; absent optional keys are NULL."""
    return explode_catalogue(spark.read.schema(CATALOGUE_SCHEMA).json(path, multiLine=True))


def parse_catalogue(texts: DataFrame, column: str) -> dict[str, DataFrame]:
    """The same from a column of JSON documents."""
    parsed = texts.select(F.from_json(column, CATALOGUE_SCHEMA).alias("d")).select("d.*")
    return explode_catalogue(parsed)


def lesson_positions(courses: DataFrame) -> DataFrame:
    """Index of each lesson in its course's list; a later course overwrites an earlier one."""
    listed = courses.select("seq", F.posexplode("lessons").alias("pos", "lesson_id"))
    return listed.groupBy("lesson_id").agg(F.max_by("pos", F.struct("seq", "pos")).alias("position"))


def lessons_to_load(lessons: DataFrame, courses: DataFrame) -> DataFrame:
    live = drop_retired(lessons, "id", RETIRED_LESSONS).withColumnRenamed("id", "lesson_id")
    return live.join(lesson_positions(courses), "lesson_id", "left").withColumn(
        "position", F.coalesce("position", F.lit(0))
    )


def depth_levels(lessons: DataFrame, key: str = "id") -> DataFrame:
    """Depth struct to rows; an absent or empty level gives no row."""
    levels = []
    for name, label in DEPTH_LABELS.items():
        field = F.col("depth")[name]
        levels.append(F.when(field["title"].isNotNull() | field["body"].isNotNull(), F.struct(
            F.lit(name.upper()).alias("depth_key"), F.lit(label).alias("label"),
            F.coalesce(field["title"], F.lit(label)).alias("title"),
            F.coalesce(field["body"], F.lit("")).alias("body"),
        )))
    return lessons.select(key, F.inline(F.array_compact(F.array(*levels))))


def question_options(questions: DataFrame, key: str = "id") -> DataFrame:
    """Options as rows; no row is right when the index is absent."""
    return questions.select(key, "correct", F.posexplode("options").alias("position", "option_text")).select(
        key, "position", "option_text", F.coalesce(F.col("position") == F.col("correct"), F.lit(False)).alias("is_correct")
    )


def batch_skills(questions: DataFrame, skill: str = "skill_id") -> DataFrame:
    """Distinct skills of a question batch, sorted."""
    return questions.filter(F.col(skill).isNotNull() & (F.col(skill).cast("string") != "")).select(skill).distinct().orderBy(skill)


def build_practice_quizzes(
    batch: DataFrame, questions: DataFrame, skills: DataFrame, size: int = PRACTICE_SIZE, stored: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(quizzes, quiz_questions): per skill of the batch the first questions by id.

    A skill that has a PRACTICE quiz among the stored ones keeps that quiz (the smallest id
    of several); the others take the id of the skill. Spark cuts each map task to the first rows per skill before the shuffle.
    """
    from pyspark.sql import Window

    wanted = skills.join(batch_skills(batch), "skill_id", "left_semi")
    own = F.col("skill_id")
    if stored is not None:
        known = stored.filter("kind = 'PRACTICE'").groupBy("skill_id").agg(F.min("quiz_id").alias("_known"))
        wanted, own = wanted.join(known, "skill_id", "left"), F.coalesce("_known", "skill_id")
    quizzes = wanted.select(
        own.alias("quiz_id"), F.concat(F.lit(PRACTICE_TITLE), "name").alias("title"),
        F.lit("PRACTICE").alias("kind"), "skill_id", F.lit(PRACTICE_THRESHOLD).alias("pass_threshold"),
        F.lit("PUBLISHED").alias("status"),
    )
    rank = F.row_number().over(Window.partitionBy("skill_id").orderBy("question_id"))
    top = (
        questions.filter("skill_id is not null").select("skill_id", "question_id").withColumn("rank", rank)
        .filter(F.col("rank") <= size)
    )
    edges = top.join(quizzes.select("skill_id", "quiz_id"), "skill_id").select(
        "quiz_id", "question_id", (F.col("rank") - 1).alias("position"))
    return quizzes, edges


def infer_requirement(text: Column) -> Column:
    """Struct (requirement_type, min_score) read from a free-text criterion."""
    number = F.regexp_extract(text, PERCENT, 1)
    found = number != ""
    return F.struct(
        F.when(found, "MIN_SCORE").otherwise("EVIDENCE").alias("requirement_type"),
        F.when(found, whole_number(number).try_cast("bigint")).alias("min_score"),
    )


def requirements_of(certifications: DataFrame) -> DataFrame:
    rows = explode_children(certifications, "id", "requirements", "description")
    return rows.withColumn("r", infer_requirement(F.col("description"))).select(
        F.col("id").alias("certification_id"), "position", "description", "r.requirement_type", "r.min_score"
    )


def knowledge_edges(nodes: DataFrame, lessons: DataFrame, key: str = "id", lesson_key: str = "lesson_id") -> dict[str, DataFrame]:
    """Edge tables of the graph; uses of lessons that do not exist are skipped."""
    def edge(array: str, child: str) -> DataFrame:
        return nodes.select(F.col(key).alias("node_id"), F.explode(array).alias(child)).distinct()

    return {
        "depends_on": edge("dependsOn", "depends_on_node_id"),
        "used_in": edge("usedIn", "lesson_id").join(
            lessons.select(F.col(lesson_key).alias("lesson_id")), "lesson_id", "left_semi"),
        "demos": edge("demos", "demo_id"),
        "labs": edge("labs", "lab_id"),
        "applications": explode_children(nodes.select(F.col(key).alias("node_id"), "applications"), "node_id",
                                         "applications", "label"),
    }


# Tables that are overwritten by id: columns, and the status every load sets.
ENTITIES = {
    "schools": (("name", "short", "color", "description"), None),
    "skills": (("schoolId", "name", "description"), None),
    "profiles": (("name", "description"), None),
    "goals": (("label",), None),
    "demos": (("title", "description", "component_key"), "PUBLISHED"),
    "pathways": (("title", "profile", "level", "duration", "color", "description"), "PUBLISHED"),
    "courses": (("schoolId", "title", "level", "duration", "color", "description"), "PUBLISHED"),
    "labs": (("schoolId", "title", "level", "duration", "color", "description"), "ARCHIVED"),
    "questionBanks": (("title", "description"), None),
    "questions": (("skillId", "domain", "difficulty", "question", "explanation"), "PUBLISHED"),
    "resources": (("title", "type", "publisher", "year", "level", "description"), "PUBLISHED"),
    "iso": (("name", "purpose"), None),
    "jurisdictions": (("name", "focus"), None),
    "knowledgeGraph": (("title", "stage", "formula", "question"), "PUBLISHED"),
    "certifications": (("title", "level", "description", "color", "threshold"), "PUBLISHED"),
}
# Pairs that are added once: root array, parent key, child array, child key, position column, children left out.
EDGES = {
    "pathway_courses": ("pathways", "pathway_id", "courses", "course_id", "position", RETIRED_COURSES),
    "lab_skills": ("labs", "lab_id", "skills", "skill_id", None, ()),
    "lab_modes": ("labs", "lab_id", "modes", "mode", None, ()),
    "resource_tags": ("resources", "resource_id", "tags", "tag", None, ()),
    "node_depends_on": ("knowledgeGraph", "node_id", "dependsOn", "depends_on_node_id", None, ()),
    "node_used_in": ("knowledgeGraph", "node_id", "usedIn", "lesson_id", None, ()),
    "node_demos": ("knowledgeGraph", "node_id", "demos", "demo_id", None, ()),
    "node_labs": ("knowledgeGraph", "node_id", "labs", "lab_id", None, ()),
}
LESSON = ("lesson_id", "courseId", "skillId", "demoId", "title", "level", "duration", "summary", "example", "position", "status")


def load_all(stored: dict[str, DataFrame], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge a catalogue into the stored tables, in the order their keys depend on.

    A table that is not stored yet starts empty; a second load of the same catalogue changes
    nothing.
    """
    t = tables | {
        "courses": drop_retired(tables["courses"], "id", RETIRED_COURSES),
        "questions": tables["questions"].withColumn("difficulty", F.coalesce("difficulty", F.lit(1))),
        "demos": tables["demos"].withColumn("component_key", F.col("id")),
    }
    out = dict(stored)

    def have(name: str, like: DataFrame) -> DataFrame:
        return stored[name] if name in stored else like.filter(F.lit(False))

    for name, (columns, status) in ENTITIES.items():
        batch = t[name].withColumn("status", F.lit(status)) if status else t[name]
        columns = [*columns, "status"] if status else list(columns)
        out[name] = upsert(have(name, batch.select("id", *columns)), batch, "id", columns, "seq")

    # Lessons and their children are written once and never touched again.
    listed = lessons_to_load(t["lessons"], tables["courses"]).withColumn("status", F.lit("PUBLISHED"))
    kept = [*LESSON[1:], "objectives", "sections", "depth"]
    once = listed.groupBy("lesson_id").agg(F.min_by(F.struct(*kept), "seq").alias("l")).select("lesson_id", "l.*")
    lessons = have("lessons", once.select(*LESSON))
    fresh = once.join(lessons.select("lesson_id"), "lesson_id", "left_anti")
    out["lessons"] = lessons.unionByName(fresh.select(*LESSON), allowMissingColumns=True)
    children = {
        "lesson_objectives": explode_children(fresh, "lesson_id", "objectives", "label"),
        "lesson_sections": fresh.select("lesson_id", F.posexplode("sections").alias("position", "s")).select(
            "lesson_id", "position", "s.title", "s.body"),
        "lesson_depths": depth_levels(fresh, "lesson_id"),
    }
    for name, rows in children.items():
        out[name] = have(name, rows).unionByName(rows)

    for name, (root, parent, array, child, position, skip) in EDGES.items():
        parents = t[root].select(F.col("id").alias(parent), array)
        if child == "lesson_id":  # uses of lessons that do not exist are left out
            known = out["lessons"].select("lesson_id")
            uses = parents.select(parent, F.explode(array).alias("lesson_id")).join(known, "lesson_id", "left_semi")
            parents = uses.select(parent, F.array("lesson_id").alias(array))
        like = parents.select(parent, F.lit("").alias(child), *([F.lit(0).alias(position)] if position else []))
        out[name] = edges_insert_absent(have(name, like), parents, parent, array, child, position, skip)

    def replaced(name: str, root: str, key: str, rows: DataFrame) -> None:
        out[name] = replace_children(have(name, rows), t[root].select(F.col("id").alias(key)), rows, key)

    replaced("question_options", "questions", "id", question_options(t["questions"]))
    replaced("certification_requirements", "certifications", "certification_id", requirements_of(t["certifications"]))
    applications = t["knowledgeGraph"].select(F.col("id").alias("node_id"), F.explode("applications").alias("label"))
    replaced("node_applications", "knowledgeGraph", "node_id", applications)
    glossary = t["glossary"].withColumnRenamed("en", "term_en").withColumn("status", F.lit("PUBLISHED"))
    terms = have("glossary", glossary.select("term", "term_en", "definition", "status"))
    out["glossary"] = upsert_glossary(terms, glossary).withColumn("status", F.coalesce("status", F.lit("PUBLISHED")))

    questions = out["questions"].select(F.col("id").alias("question_id"), F.col("skillId").alias("skill_id"))
    batch = t["questions"].select(F.col("skillId").alias("skill_id"))
    skills = out["skills"].select(F.col("id").alias("skill_id"), "name")
    quizzes, edges = build_practice_quizzes(batch, questions, skills, stored=stored.get("quizzes"))
    known = have("quizzes", quizzes)
    out["quizzes"] = insert_once(known, quizzes.select(*known.columns), "quiz_id")
    out["quiz_questions"] = replace_children(have("quiz_questions", edges), quizzes, edges, "quiz_id")
    return out
