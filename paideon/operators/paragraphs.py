"""Lines to paragraphs: breaks, joined text and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.functions.fold import fold_values, let
from paideon.functions.scan import ordered_scan, spread_facts
from paideon.functions.values import weighted_median
from paideon.operators.fragments import DEALT, PAGE
from paideon.session import stage

# --- Fixed values ------------------------------------------------------------
GAP_FACTOR, SIZE_CHANGE, INDENT, OWN_LEADING, MAX_GAP = 1.5, 0.20, 0.8, 1.15, 6
STYLE_SHARE = 0.6
FLOW_END = r"[.!?:»…]$"
# -----------------------------------------------------------------------------

_ORDER = ["page_no", "line_no"]


def median_leading(lines: DataFrame) -> DataFrame:
    """Median distance of neighbouring lines of a page, per document.

    Equal distances are counted before they are brought together.
    """
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    gap = F.col("y") - F.lead("y").over(page)
    gaps = lines.withColumn("gap", gap).filter(
        (F.col("gap") > 0) & (F.col("gap") < F.greatest("font_size", F.lit(1.0)) * MAX_GAP))
    counted = gaps.groupBy("doc_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id").agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("leading"))


def _changed(flag: str) -> Column:
    return (F.col(flag) > STYLE_SHARE) != (F.col("_prev")[flag] > STYLE_SHARE)


def hard_breaks(lines: DataFrame, leading: DataFrame) -> DataFrame:
    """Content lines with the breaks that depend on the line above alone.

    `hard`: a paragraph starts here whatever came before. `flow`: the line above is
    on the same page and column, so indents can be compared.
    """
    content = spread_facts(lines.filter("boilerplate is null"), leading, "doc_id", "chunk").withColumns({
        "is_item": tx.is_list_item(tx.strip(F.col("text"))), "leading": F.coalesce("leading", F.lit(0.0)),
    })
    seen = ordered_scan(content, ["doc_id"], _ORDER, F.col("chunk"), prevs={"_prev": F.struct(
        "page_no", "column", "y", "font_size", "mono_ratio", "bold_ratio", "table_no",
        tx.strip_end(F.col("text")).rlike(FLOW_END).alias("ends"))})
    prev = F.col("_prev")
    ref = F.greatest(prev["font_size"], F.col("font_size"), F.lit(1.0))
    flow = (prev["page_no"] == F.col("page_no")) & (
        (prev["column"] < 0) | (F.col("column") < 0) | (prev["column"] == F.col("column")))
    typographic = (
        F.col("table_no").isNotNull() | prev["table_no"].isNotNull()
        | (F.abs(F.col("font_size") - prev["font_size"]) > ref * SIZE_CHANGE)
        | F.col("is_item") | _changed("mono_ratio") | _changed("bold_ratio")
    )
    spaced = prev["y"] - F.col("y") > F.greatest("leading", ref * OWN_LEADING) * GAP_FACTOR
    return seen.withColumns({"flow": F.coalesce(flow, F.lit(False)), "reference": F.coalesce(ref, F.lit(1.0))}).withColumn(
        "hard", prev.isNull() | typographic | F.when(F.col("flow"), spaced).otherwise(prev["ends"]))


# --- Starts inside a run of lines without hard breaks ------------------------------------------------------------------
# An indent is measured against the left edge of the paragraph so far. A line either leaves that edge as it is or sets it to
# its own x, so what a piece of lines does to the edge is a short list of segments: where the edge may come in, whether it
# stays, what it becomes, and whether an item keeps open. Pieces are thus folded apart and then chained.

_EDGE = "struct<left:double,item:boolean>"
_CUT = "struct<v:double,after:int>"
_SEGMENT = f"struct<lo:{_CUT},hi:{_CUT},same:boolean,left:double,stays:boolean>"


def _edge(left: Column, item: Column) -> Column:
    return F.struct(left.cast("double").alias("left"), item.cast("boolean").alias("item"))


def _low(line: Column) -> Column:
    return line["x"] - line["reference"] * INDENT


def _high(line: Column) -> Column:
    return line["x"] + line["reference"] * INDENT


def opens(edge: Column, line: Column) -> Column:
    """A line starts a paragraph if it stands right of the edge, or, in a list item, left of it, by an indent."""
    return line["flow"] & ((edge["left"] < _low(line)) | (edge["item"] & (edge["left"] > _high(line))))


def next_edge(edge: Column, line: Column) -> Column:
    fresh = opens(edge, line)
    return _edge(F.when(fresh, line["x"]).otherwise(F.least(edge["left"], line["x"])),
                 F.when(fresh, line["is_item"]).otherwise(edge["item"]))


def line_flags(lines: Column, edge: Column) -> Column:
    """Which lines of a piece start a paragraph, given the edge before its first line."""
    return fold_values(lines, edge, next_edge, "boolean", opens)


def _cut(v: Column, after: int) -> Column:
    return F.struct(v.cast("double").alias("v"), F.lit(after).alias("after"))


def edge_function(lines: Column) -> Column:
    """What a piece of lines does to the edge that comes in."""
    infinite = F.lit(float("inf"))

    def step(segments: Column, line: Column) -> Column:
        low = _cut(F.when(line["flow"], _low(line)).otherwise(-infinite), 0)
        high = _cut(F.when(line["flow"], _high(line)).otherwise(infinite), 1)
        at = _cut(line["x"], 1)

        def part(s: Column, lo: Column, hi: Column, same: bool, stays: Column) -> Column:
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(same).alias("same"), line["x"].alias("left"), stays.alias("stays")).cast(_SEGMENT)

        def after(s: Column) -> Column:
            edge = _edge(s["left"], s["stays"])
            moved = F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.lit(False).alias("same"),
                             next_edge(edge, line)["left"].alias("left"), (s["stays"] & ~opens(edge, line)).alias("stays")).cast(_SEGMENT)
            no = F.lit(False)
            parts = F.array(
                part(s, s["lo"], F.least(s["hi"], low), False, no),
                part(s, F.greatest(s["lo"], low), F.least(s["hi"], at), True, s["stays"]),
                part(s, F.greatest(s["lo"], at), F.least(s["hi"], high), False, s["stays"]),
                part(s, F.greatest(s["lo"], high), s["hi"], False, no))
            return F.when(s["same"], F.filter(parts, lambda p: p["lo"] < p["hi"])).otherwise(F.array(moved))

        return F.flatten(F.transform(segments, after))

    whole = F.array(F.struct(_cut(-infinite, 0).alias("lo"), _cut(infinite, 1).alias("hi"), F.lit(True).alias("same"),
                             F.lit(0.0).alias("left"), F.lit(True).alias("stays")).cast(_SEGMENT))
    return F.aggregate(lines, whole, step)


def through(function: Column, edge: Column) -> Column:
    """The edge after a piece."""
    at = _cut(edge["left"], 0)
    s = F.get(F.filter(function, lambda s: (s["lo"] <= at) & (at < s["hi"])), F.lit(0))
    return _edge(F.when(s["same"], edge["left"]).otherwise(s["left"]), edge["item"] & s["stays"])


def _first_edge(line: Column) -> Column:
    return _edge(line["x"], line["is_item"])


def run_pieces(runs: DataFrame, item: Column) -> DataFrame:
    """doc_id, _run, chunk, _lines: the lines of a run in one chunk, whether they begin it and whether it goes on."""
    return runs.withColumn("_item", item).groupBy("doc_id", "_run", "chunk").agg(
        F.array_sort(F.collect_list("_item")).alias("_lines"),
        F.max_by(F.col("_next.chunk").isNotNull() & ~F.col("_next.hard") & (F.col("_next.chunk") != F.col("chunk")),
                 F.struct(*_ORDER)).alias("_more"),
    ).withColumn("_first", F.get("_lines", F.lit(0))["page_no"].eqNullSafe(F.col("_run.page_no"))
                 & F.get("_lines", F.lit(0))["line_no"].eqNullSafe(F.col("_run.line_no")))


def run_edges(pieces: DataFrame) -> DataFrame:
    """doc_id, _run, chunk, edge: the edge before each piece of the runs that cross chunks.

    One row per piece is chained over a run, whatever the number of lines in the pieces.
    """
    lines = F.col("_lines")
    first = F.get(lines, F.lit(0))
    acts = pieces.filter(~F.col("_first") | F.col("_more")).select(
        "doc_id", "_run", "chunk", _first_edge(first).alias("seed"),
        edge_function(F.when(F.col("_first"), F.slice(lines, 2, F.size(lines))).otherwise(lines)).alias("act"))
    chained = acts.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct("chunk", "seed", "act"))).alias("_acts"))
    edges = fold_values(F.col("_acts"), F.get("_acts", F.lit(0))["seed"], lambda edge, p: through(p["act"], edge), _EDGE, lambda edge, p: edge)
    return chained.select("doc_id", "_run", F.inline(F.arrays_zip(
        F.transform("_acts", lambda p: p["chunk"]).alias("chunk"), edges.alias("edge"))))


def paragraph_lines(runs: DataFrame, item: Column) -> DataFrame:
    """doc_id, chunk, lines of every paragraph; a run is folded piece by piece, never gathered.

    `runs` has the run of every line and `_next`, whether the line below starts a run and its chunk.
    """
    pieces = run_pieces(runs, item)
    edges = run_edges(run_pieces(runs, F.struct(*_ORDER, "x", "flow", "is_item", "reference"))).select(F.col("doc_id").alias("_d"), F.col("_run").alias("_r"), F.col("chunk").alias("_c"), "edge")
    known = pieces.join(edges, (F.col("doc_id") == F.col("_d")) & (F.col("_run") == F.col("_r")) & (F.col("chunk") == F.col("_c")), "left")
    lines = F.col("_lines")
    flags = F.when(F.col("_first"), F.concat(F.array(F.lit(True)), line_flags(
        F.slice(lines, 2, F.size(lines)), _first_edge(F.get(lines, F.lit(0)))))).otherwise(line_flags(lines, F.col("edge")))
    flagged = known.withColumn("_flags", flags)
    starts = F.filter(F.transform("_flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    # A piece that goes on with the paragraph of the piece before begins with a part without start.
    begins = F.when(F.get("_flags", F.lit(0)), starts).otherwise(F.concat(F.array(F.lit(0)), starts))
    marked = flagged.withColumn("_starts", begins)
    last = F.size("_starts") - 1

    def part(at: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_starts", i + 1), F.size("_lines"))
        return F.struct(i.alias("_i"), F.slice("_lines", at + 1, until - at).alias("lines"), F.get("_flags", at).alias("_opens"),
                        (F.col("_more") & (i == last)).alias("_open_end"))

    # Made and exploded at once, so that no filter below is pushed into the folds.
    # Written, as the folds below would run for whole paragraphs and again for those that cross a chunk.
    parts = stage(marked.select("doc_id", "_run", "chunk", F.inline(F.transform("_starts", part))), "parts", DEALT)
    whole = parts.filter("_opens and not _open_end").select("doc_id", "chunk", "lines")
    # Parts of paragraphs that cross a chunk: the last start above names the paragraph.
    above = Window.partitionBy("doc_id", "_run").orderBy("chunk", "_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = parts.filter("not _opens or _open_end").withColumn("_name", F.struct("chunk", "_i"))
    named = crossing.withColumn("_of", F.last(F.when(F.col("_opens"), F.col("_name")), ignorenulls=True).over(above))
    joined = named.groupBy("doc_id", "_run", "_of").agg(
        F.array_sort(F.collect_list(F.struct("_name", "lines"))).alias("_parts")).select(
        "doc_id", F.get("_parts", F.lit(0))["_name"]["chunk"].alias("chunk"),
        F.flatten(F.transform("_parts", lambda p: p["lines"])).alias("lines"))
    return whole.unionByName(joined.repartition(*DEALT))


def join_lines(texts: Column) -> Column:
    """Cleaned lines to running text; words cut by a hyphen are put together.

    Whether a line is joined to the text so far depends on the last three characters of that text, which are carried along;
    the text itself is put together once, from every line and the decision about the line after it.
    """
    hyphens = f"[{tx.HYPHENS}]"

    def bare(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, f"{tx.SOFT_HYPHEN}+$", ""), f"{hyphens}+$", "")

    def glued(tail: Column, text: Column) -> Column:
        return tail.endswith(tx.SOFT_HYPHEN) | (tail.rlike(rf"(?U)\w\w{hyphens}$") & text.rlike(r"^\p{Ll}"))

    def tail_after(tail: Column, text: Column) -> Column:
        return F.right(F.when(glued(tail, text), F.concat(bare(tail), text)).otherwise(F.concat(F.lit(" "), text)), F.lit(3))

    def put_together(lines: Column) -> Column:
        cuts = fold_values(lines, F.lit(""), tail_after, "boolean", glued)
        return let(cuts, lambda c: F.array_join(F.transform(lines, lambda t, i: F.concat(
            F.when((i == 0) | F.get(c, i), F.lit("")).otherwise(F.lit(" ")),
            F.when(F.coalesce(F.get(c, i + 1), F.lit(False)), bare(t)).otherwise(t))), ""))

    return let(F.filter(texts, lambda t: t != ""), put_together)


def _weighted_share(lines: Column, field: str) -> Column:
    total = F.aggregate(lines, F.lit(0), lambda a, l: a + l["chars"])
    hit = F.aggregate(lines, F.lit(0.0), lambda a, l: a + l["chars"] * l[field])
    return F.when(total > 0, hit / total).otherwise(0.0)


def measures(paragraphs: DataFrame) -> DataFrame:
    """Size, style shares and page span of paragraphs from their `lines`."""
    lines = F.col("lines")
    sizes = F.transform(lines, lambda l: F.struct(
        l["font_size"].alias("v"), F.greatest(l["chars"], F.lit(1)).cast("long").alias("w")))
    pages = F.transform(lines, lambda l: l["page_no"])
    first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    return paragraphs.withColumns({
        "font_size": weighted_median(sizes), "mono_ratio": _weighted_share(lines, "mono_ratio"),
        "bold_ratio": _weighted_share(lines, "bold_ratio"),
        "page_start": F.array_min(pages), "page_end": F.array_max(pages),
        "page_no": first["page_no"], "line_no": first["line_no"], "first_y": first["y"], "last_y": last["y"],
        "table_no": first["table_no"], "line_count": F.size(lines),
    })


def group_paragraphs(lines: DataFrame, leading: DataFrame) -> DataFrame:
    """Paragraphs of whole documents; a page break alone does not end one."""
    measured = ["x", "y", "font_size", "text", "mono_ratio", "bold_ratio", "table_no", "is_item", "flow", "reference"]
    # A Python step forgets how rows are dealt, so it comes last before they are written.
    clean = F.nullif(tx.normalize_text(F.col("text")), F.col("text")).alias("clean")
    broken = stage(hard_breaks(lines, leading).select(*PAGE, "line_no", *measured, "hard", clean), "breaks", DEALT)
    runs = ordered_scan(broken, ["doc_id"], _ORDER, F.col("chunk"),
                        lasts={"_run": F.when(F.col("hard"), F.struct(*_ORDER))},
                        nexts={"_next": F.struct("hard", "chunk")})
    item = F.struct(*_ORDER, *measured, "clean")
    own = paragraph_lines(runs, item)
    lines_ = F.col("lines")
    code = F.size(F.filter(lines_, lambda l: l["mono_ratio"] > STYLE_SHARE)) > F.size(lines_) / 2
    text = F.when(code, F.array_join(F.transform(lines_, lambda l: l["text"]), "\n")).otherwise(
        join_lines(F.transform(lines_, lambda l: F.coalesce(l["clean"], l["text"]))))
    # The text stands in the paragraph; of a line its length is enough from here on.
    slim = F.transform(lines_, lambda l: F.struct(
        *[l[n].alias(n) for n in (*_ORDER, "x", "y", "font_size")], F.length(l["text"]).alias("chars"),
        *[l[n].alias(n) for n in ("mono_ratio", "bold_ratio", "table_no")]))
    built = own.select("doc_id", "chunk", text.alias("text"), slim.alias("lines")).filter(F.col("text") != "")
    return measures(built)
