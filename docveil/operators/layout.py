"""From glyphs to words, lines, blocks, reading order and paragraphs.

Words, ranges and paragraphs are window functions (gaps and islands); the greedy grouping
of words into lines and blocks depends on every step before it and runs as one Arrow
function per page. Pages are spread over the cluster; only rows of blocks are ordered by
document.
"""

from __future__ import annotations

from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Thresholds in units of font size, line height or points.
SAME_BASELINE, WORD_GAP, OVERLAP = 0.2, 0.3, -2.0
LINE_BASELINE, LINE_GAP = 0.4, 2.8
BLOCK_SPACING, COLUMN = 1.8, 50.0
HEADING, NO_FONT = 1.25, 10.0
BLANK = r"(?U)^[\s\x{00A0}]*$"
PAGE = ["doc", "page_no"]


def visible(letters: DataFrame) -> DataFrame:
    """Distinct letters that show: no null, blank or no-break values; duplicate (doc, page_no, seq) count once."""
    own = letters.where(F.col("value").isNotNull() & ~F.regexp_like("value", F.lit(BLANK)))
    # spread by page at once: every window and group from here on is within a page
    return own.repartition(*PAGE).dropDuplicates([*PAGE, "seq"])


def _starts(w) -> Column:
    """1 where a letter begins a word in the order of the window, else 0."""
    right = F.lag(F.col("bbox.x") + F.col("bbox.width")).over(w)
    gap = F.col("bbox.x") - right
    size = F.lag("font_size").over(w)
    apart = F.abs(F.col("baseline_y") - F.lag("baseline_y").over(w))
    joined = (apart < size * SAME_BASELINE) & (gap >= OVERLAP) & (gap < size * WORD_GAP)
    return F.when(joined, 0).otherwise(1)


def _union(order: list[Column]) -> list[Column]:
    """Aggregates of a word: union of boxes, font and baseline of the first letter, text in order."""
    x0, y0 = F.min("bbox.x"), F.min("bbox.y")
    x1, y1 = F.max(F.col("bbox.x") + F.col("bbox.width")), F.max(F.col("bbox.y") + F.col("bbox.height"))
    key = F.struct(*order)
    return [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("value").alias("v")))), lambda s: s["v"]), "").alias("text"),
        F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")).alias("bbox"),
        F.min_by("font_size", key).alias("font_size"),
        F.min_by("baseline_y", key).alias("baseline_y"),
    ]


def first_pass(letters: DataFrame) -> DataFrame:
    """Letters with ord1 and word1: their order and word in the pass that goes down the page in the order they were drawn."""
    w = W.partitionBy(*PAGE).orderBy(F.col("baseline_y").desc(), "seq")
    rows = visible(letters).withColumn("ord1", F.row_number().over(w)).withColumn("new", _starts(w))
    return rows.withColumn("word1", F.sum("new").over(w)).drop("new")


def first_words(marked: DataFrame) -> DataFrame:
    """Words of the first pass: letters from left to right, text trimmed; those of blanks alone are left out."""
    order = [F.col("bbox.x").alias("k_x"), F.col("ord1").alias("k_ord")]
    words = marked.groupBy(*PAGE, "word1").agg(*_union(order))
    words = words.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return words.where("text <> ''")


def _second_marks(letters: DataFrame) -> DataFrame:
    """Letters with ord2 and word_no of the second pass."""
    marked = first_pass(letters)
    # the leftmost letter of each word of the first pass; visible letters make no blank words
    head = F.min(F.struct(F.col("bbox.x").alias("x"), "ord1", F.col("baseline_y").alias("b"))).over(W.partitionBy(*PAGE, "word1"))
    rows = marked.withColumn("head", head).withColumn("head_b", F.col("head.b")).withColumn("head_x", F.col("head.x"))
    w = W.partitionBy(*PAGE).orderBy(F.col("baseline_y").desc(), F.col("bbox.x"), F.col("head_b").desc(), "head_x", "word1", "ord1")
    rows = rows.withColumn("ord2", F.row_number().over(w)).withColumn("new", _starts(w))
    return rows.withColumn("word_no", F.sum("new").over(w).cast("int"))


def word_sources(letters: DataFrame) -> DataFrame:
    """doc, page_no, word_no and letters: where in the content stream each of a word's letters stands."""
    return _second_marks(letters).groupBy(*PAGE, "word_no").agg(F.collect_list("src").alias("letters"))


def second_pass(letters: DataFrame) -> DataFrame:
    """Words as used from here on: doc, page_no, word_no, text, bbox, font_size, baseline_y, n_letters.

    Letters are ordered by baseline and place; ties by the words of the first pass.
    """
    return _second_marks(letters).groupBy(*PAGE, "word_no").agg(*_union([F.col("ord2").alias("k_ord")]), F.count("*").alias("n_letters"))


def global_font(letters: DataFrame) -> DataFrame:
    """doc and mean_font: the mean font size of the words of the first pass over the whole document."""
    return first_words(first_pass(letters)).groupBy("doc").agg(F.avg("font_size").alias("mean_font"))


GROUPED_ARROW = pa.schema([("doc", pa.string()), *((c, pa.int32()) for c in ("page_no", "word_no", "block_no", "line_no", "pos")), ("block_x", pa.float64()), ("block_baseline", pa.float64())])
GROUPED = "doc string, page_no int, word_no int, block_no int, line_no int, pos int, block_x double, block_baseline double"


def group_page(words: list[dict]) -> list[dict]:
    """Lines and blocks of one page, first fit from the top, and the blocks' reading order.

    words: dicts with word_no, x, y, width, height, font_size, baseline_y. Gives block_no
    (in reading order), line_no, pos for each. The order of columns is not transitive for
    chains of blocks between two columns; a stable sort defines it.
    """
    lines: list[dict] = []
    for w in sorted(words, key=lambda w: (-w["baseline_y"], w["word_no"])):
        for line in lines:
            if abs(w["baseline_y"] - line["baseline"]) < w["font_size"] * LINE_BASELINE and abs(w["x"] - line["right"]) < w["font_size"] * LINE_GAP:
                line["right"] = max(line["right"], w["x"] + w["width"])
                line["x"] = min(line["x"], w["x"])
                line["words"].append(w)
                break
        else:
            lines.append({"x": w["x"], "right": w["x"] + w["width"], "y": w["y"], "height": w["height"], "baseline": w["baseline_y"], "words": [w]})
    blocks: list[dict] = []
    for line in sorted(lines, key=lambda line: -line["baseline"]):
        line["words"].sort(key=lambda w: w["x"])
        for block in blocks:
            if abs(line["baseline"] - block["baseline"]) < line["height"] * BLOCK_SPACING and line["x"] < block["right"] and line["right"] > block["x"]:
                block["x"], block["right"] = min(block["x"], line["x"]), max(block["right"], line["right"])
                block["baseline"] = line["baseline"]
                block["lines"].append(line)
                break
        else:
            blocks.append({"x": line["x"], "right": line["right"], "baseline": line["baseline"], "lines": [line]})

    def compare(a: dict, b: dict) -> int:
        if abs(a["x"] - b["x"]) > COLUMN:
            return -1 if a["x"] < b["x"] else 1
        return (a["baseline"] < b["baseline"]) - (a["baseline"] > b["baseline"])

    blocks.sort(key=cmp_to_key(compare))
    return [
        {"word_no": w["word_no"], "block_no": b, "line_no": n, "pos": p, "block_x": block["x"], "block_baseline": block["baseline"]}
        for b, block in enumerate(blocks) for n, line in enumerate(block["lines"]) for p, w in enumerate(line["words"])
    ]


def blocks(words: DataFrame) -> DataFrame:
    """words with block_no, line_no and pos: their place in the reading order of their page."""
    flat = words.select(*PAGE, "word_no", "bbox.x", "bbox.y", "bbox.width", "bbox.height", "font_size", "baseline_y")

    def run(batches):
        page: list[dict] = []

        def done():
            placed = [{"doc": page[0]["doc"], "page_no": page[0]["page_no"], **r} for r in group_page(page)]
            return pa.RecordBatch.from_pylist(placed, schema=GROUPED_ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                if page and (page[0]["doc"], page[0]["page_no"]) != (r["doc"], r["page_no"]):
                    yield done()
                    page = []
                page.append(r)
        if page:
            yield done()

    placed = flat.repartition(*PAGE).sortWithinPartitions(*PAGE, "word_no").mapInArrow(run, GROUPED)
    return words.join(placed, [*PAGE, "word_no"])


def ranges(words: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """words with start_pos and end_pos in the text that joins the words of a unit with blanks."""
    w = W.partitionBy(*unit).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.char_length("text") + 1).over(w), F.lit(0)).cast("int")
    return words.withColumn("start_pos", before).withColumn("end_pos", (before + F.char_length("text")).cast("int"))


def segmented(block_rows: DataFrame) -> DataFrame:
    """Blocks (doc, block_ord, text, is_heading) with para_no from 0.

    A heading is a paragraph by itself; another block begins one after a heading or a
    block that ends with a full stop, colon or exclamation mark. Pages don't matter.
    """
    w = W.partitionBy("doc").orderBy("block_ord")
    closed = F.regexp_like(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(r"(?U)[.:!]\s*$"))
    begins = F.col("is_heading") | F.coalesce(F.lag("is_heading").over(w), F.lit(True)) | closed
    return block_rows.withColumn("para_no", (F.sum(F.when(begins, 1).otherwise(0)).over(w) - 1).cast("int"))


def paragraphs(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, paragraphs) of documents.

    words: doc, page_no, word_no, para_no, start_pos, end_pos, text, bbox, font_size,
    baseline_y. paragraphs: doc, para_no, text, is_heading, page_no (of its first block).
    """
    placed = blocks(second_pass(letters))
    unit = ["doc", "page_no", "block_no"]
    in_block = F.array_sort(F.collect_list(F.struct("line_no", "pos", "word_no", "text")))
    rows = placed.groupBy(*unit).agg(F.array_join(F.transform(in_block, lambda s: s["text"]), " ").alias("text"), F.avg("font_size").alias("font"))
    rows = rows.join(global_font(letters), "doc", "left")
    rows = rows.withColumn("is_heading", F.col("font") > F.coalesce("mean_font", F.lit(NO_FONT)) * HEADING)
    rows = rows.withColumn("block_ord", F.row_number().over(W.partitionBy("doc").orderBy("page_no", "block_no")))
    numbered = segmented(rows).select(*unit, "block_ord", "para_no", "is_heading", "text")
    out = placed.join(numbered.select(*unit, "block_ord", "para_no"), unit)
    out = ranges(out, ["doc", "para_no"], ["block_ord", "line_no", "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda s: s["text"]), " ")
    whole = numbered.groupBy("doc", "para_no").agg(text.alias("text"), F.max("is_heading").alias("is_heading"), F.min_by("page_no", "block_ord").alias("page_no"))
    return out.select("doc", "page_no", "word_no", "para_no", "block_ord", "line_no", "pos", "start_pos", "end_pos", "text", "bbox", "font_size", "baseline_y"), whole
