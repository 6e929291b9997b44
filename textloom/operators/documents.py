"""Documents line by line: diagrams, ASCII art, and book indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), line numbers from 1."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def labelled_diagrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, type, label, caption) of lines that name a figure, a diagram or an architecture diagram; without a caption the label is one."""
    out = None
    rows = lines(docs, key, text)
    for kind, pattern in (("figure", V.FIGURE), ("diagram", V.DIAGRAM), ("architecture", V.ARCHITECTURE)):
        label, caption = T.strip(F.regexp_extract("line", pattern, 1)), T.strip(F.regexp_extract("line", pattern, 2))
        part = rows.where(F.col("line").rlike(pattern)).select(key, "line_no", F.lit(kind).alias("type"), label.alias("label"), F.when(caption != "", caption).otherwise(label).alias("caption"))
        out = part if out is None else out.unionByName(part)
    return out


def art_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", density: float = V.ART_DENSITY) -> DataFrame:
    """(key, first_line, n_lines, caption): runs of two or more lines with box characters, by gaps and islands; the caption is the line before, or behind."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(docs, key, text).withColumn("art", T.box_density("line") >= density)
    rows = rows.withColumn("before", T.strip(F.lag("line").over(w))).withColumn("behind", T.strip(F.lead("line").over(w)))
    island = rows.where("art").withColumn("_g", F.col("line_no") - F.row_number().over(w))
    blocks = island.groupBy(key, "_g").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.min_by("before", "line_no").alias("_a"), F.max_by("behind", "line_no").alias("_b")).where("n_lines >= 2")
    named = lambda c: F.when((F.col(c) != "") & (T.box_density(c) < density), F.concat(F.lit("ASCII Diagram: "), F.col(c)))
    return blocks.select(key, "first_line", "n_lines", F.coalesce(named("_a"), named("_b"), F.lit("ASCII Diagram")).alias("caption"))


def context(docs: DataFrame, at: DataFrame, key: str = "doc_id", text: str = "text", line_no: str = "line_no", before: int = 3, after: int = 3) -> DataFrame:
    """at with context: the lines around each one's line."""
    arrays = docs.select(key, F.split(F.col(text), "\n").alias("_l"))
    first = F.greatest(F.col(line_no) - before, F.lit(1))
    last = F.least(F.col(line_no) + after, F.size("_l"))
    return at.join(arrays, key).withColumn("context", F.array_join(F.slice("_l", first, last - first + 1), "\n")).drop("_l")


def index_pages(pages: DataFrame, key: str, page: str, content: str) -> DataFrame:
    """Pages from the first that opens an index, up to and including the first page from the third on that opens another part."""
    head = F.lower(F.substring(content, 1, 100))
    starts = T.any_of([F.contains(head, F.lit(m)) for m in ("index\n", "index\r", "glossary\n", "glossary\r")])
    ends = T.any_of([F.contains(F.lower(F.substring(content, 1, 50)), F.lit(m)) for m in ("other books", "about the author", "colophon")])
    w = Window.partitionBy(key).orderBy(page)
    opened = pages.withColumn("_in", F.max(starts.cast("int")).over(w)).where("_in = 1")
    numbered = opened.withColumn("_n", F.row_number().over(w))
    stopped = F.coalesce(F.max((ends & (F.col("_n") > 2)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("_stop", stopped).where("_stop = 0").drop("_in", "_n", "_stop")


def index_entries(df: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """(keys, term, page) of index lines."""
    return df.select(*keys, T.index_entry(line).alias("_e")).where("_e is not null").select(*keys, F.col("_e.term").alias("term"), F.explode("_e.pages").alias("page"))


def in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, idx: str, last: bool = True, keys: list[str] | None = None, cell: int | None = None) -> DataFrame:
    """Each point with the interval that holds it, the last one by idx or the first; points in none go.

    With `cell`, intervals of any length are cut into cells of that many numbers, which makes the range join an
    equi-join: a point meets only intervals that touch its cell.
    """
    keys = keys or []
    inside = F.col(point).between(F.col(start), F.col(end))
    if cell is not None:
        of = lambda c: F.floor(F.col(c) / cell).cast("long")
        cut = intervals.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(of(start), of(end))))
        both = points.withColumn("_cell", of(point)).join(cut, [*keys, "_cell"]).where(inside).drop("_cell")
    else:
        both = points.join(intervals, [inside, *[points[k] == intervals[k] for k in keys]])
    order = F.desc(idx) if last else F.asc(idx)
    n = F.row_number().over(Window.partitionBy(*[c for c in points.columns]).orderBy(order))
    return both.withColumn("_n", n).where("_n = 1").drop("_n")
