import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with a column of a clashing name if asked."""

    def make(rows, extra=None):
        full = []
        for r in rows:
            doc_id, text, lang, source = (tuple(r) + (None, None))[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOC).repartition(3)
        for name in extra or []:
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture
def prose():
    """Deterministic word sequences over a small vocabulary."""
    import random

    def make(seed, n, words=400):
        rnd = random.Random(seed)
        return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))

    return make
