"""Blocks are cut from their spans once, however often their order is read."""

from factweave.operators import layout


def test_blocks_are_read_from_a_written_table(spark):
    rows = [("d", p, b, 0, s, f"t{p}{b}{s}", 20.0 if b == 0 else 10.0, 0.0, 0.0, 1.0, 1.0) for p in (1, 2) for b in range(4) for s in range(3)]
    spans = spark.createDataFrame(rows, "document_id string, page_number int, block_no int, line_no int, span_no int, text string, "
                                        "size double, x0 double, y0 double, x1 double, y1 double")
    found = layout.with_heading(layout.blocks_of_spans(spans).withColumn("reading_order", layout.F.col("block_no")))
    assert found.inputFiles() and "median" not in found._jdf.queryExecution().optimizedPlan().toString().replace("median_size", "")
    got = [(r["document_order"], r["heading"]) for r in found.orderBy("document_order").collect()]
    assert got == [(i + 1, "t10" + "0t101t102" if i < 4 else "t20" + "0t201t202") for i in range(8)]
