from pathlib import Path

from pyspark.sql import functions as F

from factweave.operators import chunks, evidence, layout, lineage
from factweave.session import new_path
from factweave.sources import html, intake, sinks


def test_markdown_blocks(spark):
    body = "\n".join(["# Results", "Revenue rose.", "", "| a | b |", "| --- | --- |", "| 1 | 2 |", "", "Closing words", "## Notes", "", "end"])
    df = spark.createDataFrame([("d", body), ("e", "plain\n\n"), ("f", "")], "id string, body string")
    rows = chunks.markdown_blocks(df, "id", "body").orderBy("id", "reading_order").collect()
    assert [(r["id"], r["chunk_type"], r["text"], r["heading"]) for r in rows] == [
        ("d", "heading", "# Results", "Results"),
        ("d", "ocr_block", "Revenue rose.", "Results"),
        ("d", "table", "| a | b |\n| --- | --- |\n| 1 | 2 |", "Results"),
        ("d", "ocr_block", "Closing words", "Results"),
        ("d", "heading", "## Notes", "Notes"),
        ("d", "ocr_block", "end", "Notes"),
        ("e", "ocr_block", "plain", None),
    ]


def test_page_budget(spark):
    pages = spark.range(1, 66).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page_number"))
    counts = {r["route"]: r["count"] for r in chunks.within_budget(pages).groupBy("route").count().collect()}
    assert counts == {"scan": 60, "skipped": 5}


def test_failed_pages_keep_a_chunk(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "document_id string, page_number int")
    transcripts = spark.createDataFrame([("d", 1, "text", None), ("d", 2, None, "timeout")], "document_id string, page_number int, markdown string, error string")
    rows = chunks.transcribed_pages(pages, transcripts).orderBy("page_number").collect()
    assert [r["chunk_type"] for r in rows] == ["ocr", "needs_review", "needs_review"]
    assert rows[1]["text"].endswith("Page 2 could not be transcribed: timeout") and rows[2]["heading"] == "OCR Failed"


def chunk_rows(spark):
    rows = [("t", "table", "| 1 |", 9)] + [(f"n{i}", "paragraph", "words only", i) for i in range(4)] + [("x", "paragraph", "grew 5%", 5)]
    return spark.createDataFrame([("d", *r, None) for r in rows], "document_id string, chunk_id string, chunk_type string, text string, reading_order int, heading string")


def test_priorities_windows_and_routing(spark):
    placed = chunks.prioritised(chunk_rows(spark), narrative=3)
    order = [r["chunk_id"] for r in placed.orderBy("position").collect()]
    assert order == ["t", "x", "n0", "n1", "n2"]
    windows = chunks.windows(placed)
    rows = windows.orderBy("window").collect()
    assert [r["chunk_ids"] for r in rows] == [["t", "x"], ["n0", "n1"], ["n2"]]
    assert rows[2]["prompt"] == "--- CHUNK ID: n2 | Type: paragraph | Section: General ---\nwords only"
    facts = spark.createDataFrame([("d", 0, "t"), ("d", 0, "n0"), ("d", 0, None), ("d", 2, None), ("d", 2, "t")], "document_id string, window int, chunk_id string")
    assert sorted((r["window"], r["chunk_id"]) for r in chunks.route_facts(windows, facts).collect()) == [(0, "t"), (2, "n2"), (2, "n2")]


def test_evidence(spark):
    rows = spark.createDataFrame([("c1", "d2", 1, "paragraph", " same "), ("c2", "d1", 1, "paragraph", "same"), ("c3", "d1", 2, "paragraph", "same"), ("c4", "d1", None, "table", "")],
                                 "chunk_id string, document_id string, page_number int, chunk_type string, text string")
    sealed = evidence.chunk_evidence(rows)
    stored = evidence.distinct_evidence(sealed)
    assert sorted((r["document_id"], r["page"], r["evidence_type"], r["copies"]) for r in stored.collect()) == [
        ("d1", 1, "paragraph", 2), ("d1", 1, "table_cell", 1), ("d1", 2, "paragraph", 1)]
    assert evidence.integrity(stored).filter("not intact").count() == 0
    assert evidence.integrity(stored.withColumn("page", F.lit(7))).filter("intact").count() == 0
    facts = spark.createDataFrame([("f1", "c1"), ("f2", "c2"), ("f3", "unknown")], "fact_id string, chunk_id string")
    links = evidence.link_facts(facts, sealed)
    assert links.count() == 2 and evidence.link_facts(facts, sealed, links).count() == 0
    assert {r["document_id"] for r in evidence.evidence_chain(links, stored).collect()} == {"d1"}


def box(block, x0, y0, x1, y1):
    return ("d", 1, block, float(x0), float(y0), float(x1), float(y1), 600.0)


BOX_DDL = "document_id string, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, page_width double"


def test_reading_order(spark):
    two = [box(1, 10, 100, 280, 110), box(2, 10, 200, 280, 210), box(3, 320, 90, 590, 110), box(4, 320, 210, 590, 220), box(5, 10, 20, 590, 30), box(6, 10, 700, 590, 710)]
    order = layout.reading_order(spark.createDataFrame(two, BOX_DDL)).orderBy("reading_order").collect()
    assert [r["block_no"] for r in order] == [5, 1, 2, 3, 4, 6]
    one = [box(1, 300, 100, 590, 110), box(2, 10, 101, 280, 110), box(3, 10, 20, 590, 30)]
    order = layout.reading_order(spark.createDataFrame(one, BOX_DDL)).orderBy("reading_order").collect()
    assert [r["block_no"] for r in order] == [3, 2, 1]


def test_blocks_headings_and_tables(spark):
    span = lambda block, line, no, text, size, y: ("d", 1, block, line, no, text, size, 1.0, y, 9.004, y + 5)
    spans = [span(1, 1, 1, "Annual ", 20.0, 0.0), span(1, 1, 2, "report", 20.0, 0.0), span(2, 1, 1, "Revenue rose.", 10.0, 10.0),
             span(2, 2, 1, "Costs fell.", 10.0, 16.0), span(3, 1, 1, "see note", 8.0, 30.0), span(4, 1, 1, "  ", 30.0, 40.0), span(5, 1, 1, "more", 10.0, 50.0)]
    df = spark.createDataFrame(spans, "document_id string, page_number int, block_no int, line_no int, span_no int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    blocks = layout.with_heading(layout.blocks_of_spans(df).withColumn("reading_order", F.col("block_no"))).orderBy("block_no").collect()
    assert [(r["chunk_type"], r["text"], r["heading"]) for r in blocks] == [
        ("heading", "Annual report", "Annual report"), ("paragraph", "Revenue rose.\nCosts fell.", "Annual report"),
        ("footnote", "see note", "Annual report"), ("paragraph", "more", "Annual report")]
    assert (blocks[0]["level"], blocks[1]["level"]) == (1, None) and (blocks[1]["y0"], blocks[1]["y1"], blocks[1]["x1"]) == (10.0, 21.0, 9.0)
    tables = spark.createDataFrame([("d", 1, 0.0, 12.0, 5.0, 35.0), ("d", 2, 0.0, 0.0, 99.0, 99.0)], "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    outside = layout.outside_tables(layout.blocks_of_spans(df), tables)
    assert sorted(r["block_no"] for r in outside.collect()) == [1, 5]


def test_table_text_and_cells(spark):
    df = spark.createDataFrame([(1, ["Year", "Value"], [["2023", "7"], ["2024", None]])], "id int, headers array<string>, rows array<array<string>>")
    assert df.select(layout.table_markdown(F.col("headers"), F.col("rows")).alias("m")).collect()[0]["m"].split("\n")[:3] == [
        "| Year | Value |", "| --- | --- |", "| 2023 | 7 |"]
    cells = {(r["row"], r["col"]): (r["header"], r["value"]) for r in layout.table_cells(df, ["id"]).collect()}
    assert cells[(0, 1)] == ("Value", "Value") and cells[(2, 0)] == ("Year", "2024") and cells[(2, 1)] == ("Value", "")


def test_last_section_of_a_title_wins(spark):
    found = spark.createDataFrame([("d", 1, "c", "Notes", 0), ("d", 2, "e", "Notes", None)], "document_id string, page_number int, chunk_id string, heading string, table_index int")
    sections = spark.createDataFrame([("d", 1, "Notes", "s1", 1), ("d", 1, "Notes", "s2", 5)], "document_id string, page_number int, title string, section_id string, reading_order int")
    tables = spark.createDataFrame([("d", 1, 0, "t1")], "document_id string, page_number int, table_index int, table_id string")
    rows = {r["chunk_id"]: (r["section_id"], r["table_id"]) for r in layout.structured_chunks(found, sections, tables).collect()}
    assert rows == {"c": ("s2", "t1"), "e": (None, None)}


def test_intake(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 body")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 body")
    (tmp_path / "c.pdf").write_bytes(b"hello")
    files = intake.accepted(intake.read_files(spark, str(tmp_path)))
    verdicts = {r["path"][-5:]: r["reject_reason"] for r in files.collect()}
    assert verdicts["a.pdf"] is None and "missing %PDF" in verdicts["c.pdf"]
    blank = spark.createDataFrame([(b"",), (None,)], "content binary")
    assert {r["reject_reason"] for r in intake.accepted(blank).collect()} == {"Uploaded file is empty"}
    good = files.filter("reject_reason is null")
    originals = {r["path"][-5:]: r["duplicate_of"] and r["duplicate_of"][-5:] for r in intake.with_original(good, "path").collect()}
    assert originals == {"a.pdf": None, "b.pdf": "a.pdf"}
    assert intake.accepted(intake.read_files(spark, str(tmp_path)), limit=5).filter("reject_reason like 'File exceeds%'").count() == 2


def test_html_anchors(spark):
    page = '<a class="result__snippet x" href="http://a">One <b>two</b></a><a href="/skip">no</a><a class="result__snippet" href="http://b"> Three</a>'
    rows = html.anchors(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", limit=3).orderBy("position").collect()
    assert [(r["url"], r["snippet"]) for r in rows] == [("http://a", "One two"), ("http://b", "Three")]


def test_lineage(spark):
    audit = spark.createDataFrame([(1, "t1", "x", '{"fact_id":"F1"}', None), (2, "t2", "x", '{"chunk_id":"C1"}', "{}"), (3, "t3", "x", '{"document_id":"D1"}', '{"ids":["F1"]}'),
                                   (4, "t4", "x", "{}", '{"ids":["F12"]}'), (5, "t5", "x", None, None)], "audit_id int, at string, action string, target string, meta string")
    facts = spark.createDataFrame([("F1", "C1", "D1")], "fact_id string, chunk_id string, document_id string")
    assert [r["audit_id"] for r in lineage.lineage(audit, facts, "F[0-9]+").collect()] == [1, 2, 3]
    row = lineage.lineage_counts(audit, facts, "F[0-9]+").collect()[0]
    assert (row["n_fact"], row["n_chunk"], row["n_document"], row["n_mention"]) == (1, 1, 1, 1)
    assert [r["audit_id"] for r in lineage.recent(audit, 2).collect()] == [5, 4]


def test_upserts_and_csv(spark):
    stored = spark.createDataFrame([("a", "Old", "x"), ("b", None, "y")], "k string, legal string, kind string")
    batch = spark.createDataFrame([("a", None, "n1", 1), ("a", None, None, 2), ("b", "New", "n2", 3), ("c", "First", "n3", 4), ("c", None, "n4", 5)], "k string, legal string, kind string, seq int")
    rows = {r["k"]: (r["legal"], r["kind"]) for r in sinks.upsert(stored, batch, ["k"], "seq", ["legal"], ["kind"]).collect()}
    assert rows == {"a": ("Old", None), "b": ("New", "n2"), "c": ("First", "n4")}
    absent = {r["k"]: r["legal"] for r in sinks.insert_absent(stored, batch, ["k"], "seq").collect()}
    assert absent == {"a": "Old", "b": None, "c": "First"}
    path = new_path(spark, "csv")
    sinks.write_csv(spark.createDataFrame([(1, 'say "hi", ok', None)], "n int, t string, e string"), path, {"n": "No"})
    assert sorted({r["value"] for r in spark.read.text(path).collect()}) == ['"1","say ""hi"", ok",""', '"No","t","e"']
    log = new_path(spark, "audit")
    sinks.append_audit(sinks.audit_rows(stored, "k.seen", F.struct("k"), F.struct("kind")), log)
    assert spark.read.parquet(log).filter("action = 'k.seen'").count() == 2


def test_markdown_is_split_where_it_lies(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# \n#\n|a|\n\n|b|\n\ntext\n \n## H  x \n\nafter"), (3, "same key")], "id int, body string")
    rows = chunks.markdown_blocks(df, "id", "body")
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    assert [tuple(r)[1:] for r in rows.filter("text <> 'same key'").collect()] == [
        (1, "ocr_block", "# \n#", None), (2, "table", "|a|\n\n|b|", None), (3, "ocr_block", "text", None), (4, "heading", "## H  x", "H  x"), (5, "ocr_block", "after", "H  x")]


def test_keyed_table_rewrites_only_what_a_batch_touches(spark, tmp_path):
    path = f"{tmp_path}/names"
    table = sinks.KeyedTable(spark, f"file://{path}", "name", 8)
    table.write(spark.range(4000).selectExpr("concat('n', id) as name", "cast(id as string) as legal", "'old' as kind"))
    files = lambda: {f"{f.parent.name}/{f.name}" for f in Path(path).rglob("*.parquet")}
    before = files()
    incoming = spark.createDataFrame([("n7", None, "new", 1), ("fresh", "F", "new", 2), ("n7", "seven", None, 3)], "name string, legal string, kind string, seq int")
    table.upsert(incoming, "seq", keep_old=["legal"], overwrite=["kind"])
    kept = before & files()
    assert len(before) == 8 and 6 <= len(kept) < 8
    assert table.read().count() == 4001
    assert sorted(map(tuple, table.lookup("n7", "fresh", "n8", "gone").collect())) == [("fresh", "F", "new"), ("n7", "seven", None), ("n8", "8", "old")]


def test_a_lookup_does_not_scan(spark, tmp_path):
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/facts", "fact_id", 4)
    table.write(spark.range(60_000).selectExpr("concat('f', id) as fact_id", "id as value"))
    found = table.lookup("f77")
    assert [r.value for r in found.collect()] == [77]
    scan = found._jdf.queryExecution().executedPlan()
    while not scan.metrics().contains("filesSize"):
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1 and scan.metrics().apply("numOutputRows").value() <= 2 * sinks.PAGE_ROWS
