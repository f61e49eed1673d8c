import hashlib

import __spark_entry__ as entry


def test_the_first_document_is_not_late(spark, tmp_path):
    texts = ["a", "b", "a", "c", None]
    spark.createDataFrame(list(zip([0, 1, 2, 3, None], texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r[0] for r in entry.queries()["stream_dedup_watermark"](spark, str(tmp_path)).collect()]
    assert sorted(x or "" for x in found) == sorted({hashlib.sha256(t.encode()).hexdigest() if t is not None else "" for t in texts})
