import os

from pyspark.sql import functions as F

from factweave import session
from factweave.llm import overlap


def test_every_pair_of_a_key_is_linked(spark, prose):
    """Forty pairs of near copies that have all their keys in common."""
    rows = []
    for pair in range(40):
        text = prose(pair, 100, 9000)
        rows += [(pair, text), (100 + pair, text + " more")]
    texts = spark.createDataFrame(rows, "key bigint, text string")
    sets = overlap.sketches(texts, overlap.WIDTH).select("key", "n", F.array(F.lit(7).cast("bigint")).alias("bands"), "sketch")
    found = overlap.near_pairs(sets, texts, overlap.WIDTH, overlap.SIMILARITY).distinct().collect()
    assert sorted(map(tuple, found)) == [(pair, 100 + pair) for pair in range(40)]


def test_working_tables_can_be_removed(spark):
    table = session.write_through(spark.range(100).groupBy("id").count(), "gone")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    session.remove_written(table)
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_language_sample_stays_on_the_executors(spark):
    """What the driver collects to fit does not grow with the sample, and rows in any order give one model."""
    import numpy as np
    from pyspark.sql import functions as F
    from factweave.llm import langid

    words = {"en": "the house of wind and rain", "de": "das haus von wind und regen", "fr": "la maison du vent et de la pluie"}
    rows = [(i, f"{words[lang]} {i} {'abcdefgh'[i % 8] * 5}", lang) for i in range(90) for lang in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes, cls = [], type(df)
    old = cls.collect

    def counted(self):
        got = old(self)
        sizes.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
        return got

    cls.collect = counted
    try:
        model = langid.fit(df, F.col("text"), F.col("lang"), F.col("doc_id"))
    finally:
        cls.collect = old
    assert max(sizes) <= len(words) * langid.CENTROIDS * langid.DIMENSIONS * 8
    again = langid.fit(df.repartition(7, "text"), F.col("text"), F.col("lang"), F.col("doc_id"))
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.idf, again.idf) and np.array_equal(model.least, again.least)
    assert model.predict(["the wind and the rain", "das haus und der regen", "123", None])[0] == ["en", "de", "und", "und"]
