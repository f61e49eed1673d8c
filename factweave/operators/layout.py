"""Page layout over span, block and table rows: reading order, block classes, tables, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip
from factweave.functions.text import table_hints
from factweave.operators.ordered import carry_forward, positions
from factweave.session import write_through

PAGE = ["document_id", "page_number"]
SHELF = 1_000  # consecutive pages whose summaries meet in one task


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds reading_order (per page) to blocks with x0, y0, x1, y1 and page_width.

    Two columns need at least two blocks on either side of the middle; blocks across the
    middle come before the columns if they start above both, else after. Other pages are
    read in bands of six points.
    """
    middle = F.col("page_width") / 2
    side = F.when(F.col("x1") <= middle + V.COLUMN_SLACK, "left").when(F.col("x0") >= middle - V.COLUMN_SLACK, "right").otherwise("span")
    page = Window.partitionBy(*PAGE)
    sided = blocks.withColumn("side", side).withColumns(
        {
            "n_left": F.count(F.when(F.col("side") == "left", 1)).over(page),
            "n_right": F.count(F.when(F.col("side") == "right", 1)).over(page),
            "column_top": F.min(F.when(F.col("side") != "span", F.col("y0"))).over(page),
        }
    )
    two = (F.col("n_left") >= 2) & (F.col("n_right") >= 2)
    zone = F.when(F.col("side") == "left", 1).when(F.col("side") == "right", 2).when(F.col("y0") < F.col("column_top"), 0).otherwise(3)
    keyed = sided.withColumns(
        {
            "_zone": F.when(two, zone).otherwise(0),
            "_y": F.when(two, F.col("y0")).otherwise(F.bround(F.col("y0") / V.ROW_BAND) * V.ROW_BAND),
        }
    )
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_zone", "_y", "x0", "block_no"))
    return keyed.withColumn("reading_order", order).drop("side", "n_left", "n_right", "column_top", "_zone", "_y")


def median_sizes(spans: DataFrame) -> DataFrame:
    """Exact median font size of the visible spans of each page; 10 for pages without any."""
    visible = F.when(strip(F.col("text")) != "", F.col("size"))
    return spans.groupBy(*PAGE).agg(
        F.coalesce(F.median(visible), F.lit(V.DEFAULT_FONT_SIZE)).alias("median_size"),
        F.min_by(visible, F.when(visible.isNotNull(), F.struct("block_no", "line_no", "span_no"))).alias("first_size"))


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """Blocks with text, union box and class: heading over 1.2 medians, footnote below 0.85."""
    sized = spans.join(median_sizes(spans), PAGE)
    visible = strip(F.col("text")) != ""
    line = sized.groupBy(*PAGE, "block_no", "line_no", "median_size", "first_size").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("line"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.bool_or(visible & (F.col("size") > F.col("median_size") * V.HEADING_FACTOR)).alias("big"),
        F.bool_or(visible & (F.col("size") < F.col("median_size") * V.FOOTNOTE_FACTOR)).alias("small"),
    )
    shown = F.filter(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: strip(x["line"]) != "")
    block = line.groupBy(*PAGE, "block_no", "median_size", "first_size").agg(
        strip(F.array_join(F.transform(shown, lambda x: x["line"]), "\n")).alias("text"),
        *[F.round(F.min(c), 2).alias(c) for c in ("x0", "y0")], *[F.round(F.max(c), 2).alias(c) for c in ("x1", "y1")],
        F.bool_or("big").alias("big"), F.bool_or("small").alias("small"))
    return block.filter(F.col("text") != "").withColumns(
        {
            "chunk_type": F.when(F.col("big"), "heading").when(F.col("small"), "footnote").otherwise("paragraph"),
            "level": F.when(F.col("big"), F.when(F.col("median_size") * V.TOP_HEADING_FACTOR < F.col("first_size"), 1).otherwise(2)),
        }
    ).drop("big", "small")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that overlap no table box of their page."""
    boxes = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = blocks.alias("b")
    t = boxes.alias("t")
    overlap = (
        (F.col("b.x0") < F.col("t.t_x1")) & (F.col("t.t_x0") < F.col("b.x1"))
        & (F.col("b.y0") < F.col("t.t_y1")) & (F.col("t.t_y0") < F.col("b.y1")))
    same_page = (F.col("b.document_id") == F.col("t.document_id")) & (F.col("b.page_number") == F.col("t.page_number"))
    return b.join(t, same_page & overlap, "left_anti")


def with_heading(blocks: DataFrame) -> DataFrame:
    """Numbers the blocks of a document through its pages and carries the last heading forward.

    Both steps read their rows several times, so the blocks are written first: they are cut once."""
    title = F.when(F.col("chunk_type") == "heading", F.substring_index("text", "\n", 1))
    shelved = write_through(blocks.withColumns({"_title": title, "_shelf": F.floor(F.col("page_number") / SHELF)}), "blocks")
    order, segments = ["page_number", "reading_order"], ["_shelf", "page_number"]
    numbered = write_through(positions(shelved, ["document_id"], segments, order, "document_order"), "numbered-blocks")
    return carry_forward(numbered, ["document_id"], segments, order, "_title", "heading").drop("_title", "_shelf")


def table_markdown(headers: Column, rows: Column) -> Column:
    """A markdown table of a header array and an array of row arrays."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def table_cells(tables: DataFrame, key: list[str]) -> DataFrame:
    """(row, col, header, value) of every cell, the header row included as row 0."""
    grid = F.concat(F.array("headers"), "rows")
    cells = tables.select(*key, "headers", F.posexplode(grid).alias("row", "cells")).select(
        *key, "headers", "row", F.posexplode("cells").alias("col", "value"))
    return cells.select(*key, "row", "col", F.coalesce(F.get("headers", F.col("col")), F.lit("")).alias("header"),
                        strip(F.coalesce("value", F.lit(""))).alias("value"))


def with_hints(tables: DataFrame, context: str = "title") -> DataFrame:
    return tables.withColumn("_h", table_hints(F.col("headers"), F.col(context))).select(
        *tables.columns, F.col("_h.unit").alias("unit_hint"), F.col("_h.currency").alias("currency_hint"), F.col("_h.period").alias("period_hint"))


def structured_chunks(chunks: DataFrame, sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks with the ids of their section (by heading title) and table (by index on the page).

    If a title occurs twice on a page the last section wins.
    """
    section = sections.groupBy(*PAGE, "title").agg(F.max_by("section_id", "reading_order").alias("section_id"))
    with_section = chunks.join(section.withColumnRenamed("title", "heading"), [*PAGE, "heading"], "left")
    return with_section.join(tables.select(*PAGE, "table_index", "table_id"), [*PAGE, "table_index"], "left")


def structure_counts(pages: DataFrame, sections: DataFrame, tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Number of pages, sections, tables and chunks of every document."""
    parts = [df.select("document_id", F.lit(name).alias("part")) for name, df in
             [("pages", pages), ("sections", sections), ("tables", tables), ("chunks", chunks)]]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy("document_id").agg(
        *[F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}") for p in ("pages", "sections", "tables", "chunks")])
