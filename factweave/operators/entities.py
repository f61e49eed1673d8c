"""Fuzzy resolution of entity names.

Two names match if the similarity of their sorted words exceeds a ratio. Matches are found
without comparing all names. For two lengths the largest number of edits t that still exceeds the
ratio is known. The shorter text is cut into p > t pieces; every edit spoils one at most, so of
any t + 1 pieces one stands in the longer text, at nearly the same place. The t + 1 pieces that
stand in the fewest longer texts are taken (a word that all names begin with is none of them)
and meet in an equi join; a piece that is frequent all the same is joined in blocks. Candidates
whose letters alone differ by more than t are dropped before they are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip
from factweave.functions.similarity import token_sort_ratio
from factweave.operators.pairs import pair_across
from factweave.session import write_through

#: classes of letters whose numbers are compared
LETTER_CLASSES = 16


def _sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(F.lower(name)), r"\s+")), " ")


def _edits(short: Column, long: Column, ratio: float) -> Column:
    """Largest number of inserted or deleted characters with similarity still above `ratio`."""
    return (F.ceil(F.lit(1 - ratio / 100) * (short + long) - F.lit(1e-9)) - 1).cast("int")


def _letters(text: Column) -> Column:
    """How many letters of each class a text has."""
    kinds = F.transform(F.split(text, ""), lambda ch: F.pmod(F.ascii(ch), F.lit(LETTER_CLASSES)))
    return F.transform(F.sequence(F.lit(0), F.lit(LETTER_CLASSES - 1)), lambda k: F.size(F.filter(kinds, lambda x: x == k)))


def name_candidates(left: DataFrame, right: DataFrame | None = None, ratio: float = V.ENTITY_RATIO) -> DataFrame:
    """(left_name, right_name) of all names that can reach more than the ratio; both sides have a column `name`.

    Without `right` the names of `left` meet each other, each pair once, smaller name first.
    """
    growth = (200 - ratio) / ratio  # the longer text is at most this many times the shorter one

    def texts(df: DataFrame) -> DataFrame:
        sized = df.select("name").distinct().withColumn("t", _sorted_words(F.col("name"))).withColumn("n", F.length("t"))
        return write_through(sized.filter(F.col("n") > 0).withColumn("letters", _letters(F.col("t"))), "name-texts")

    def cut(df: DataFrame) -> DataFrame:
        """For two lengths n <= m: edits k, number of pieces p, and the piece numbers i."""
        edited = df.withColumn("k", _edits(F.col("n"), F.col("m"), ratio)).filter(F.col("k") >= F.col("m") - F.col("n"))
        pieces = edited.withColumn("p", F.greatest(F.col("k") + 1, F.least(2 * (F.col("k") + 1), F.expr("n div 3"))))
        each = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
        return each.selectExpr("*", "cast(i * n div p as int) as start", "cast((i + 1) * n div p - i * n div p as int) as size")

    def windows(df: DataFrame) -> DataFrame:
        """The longer side: its substrings where a piece of a shorter text could stand."""
        shortest = F.greatest(F.lit(1), F.ceil(F.col("n") / growth - 1e-9).cast("int"))
        sized = df.select("name", "t", "letters", F.col("n").alias("m"), F.explode(F.sequence(shortest, F.col("n"))).alias("n"))
        # m - n more insertions than deletions bound the shift to either side
        shifted = cut(sized).withColumn("at", F.expr("explode(sequence(greatest(0, start - (k - m + n) div 2), start + (k + m - n) div 2))"))
        return shifted.filter((F.col("at") + F.col("size") <= F.col("m")) & (F.col("size") > 0)).select(
            "name", "letters", "n", "m", "i", F.expr("substring(t, at + 1, size)").alias("piece")).distinct()

    keys = ["n", "m", "i", "piece"]

    def pieces(df: DataFrame, longer: DataFrame) -> DataFrame:
        """The shorter side: of each text and longer length the k + 1 pieces that are rarest on the longer side."""
        longest = F.floor(F.col("n") * growth + 1e-9).cast("int")
        each = cut(df.withColumn("m", F.explode(F.sequence(F.col("n"), longest)))).withColumn("piece", F.expr("substring(t, start + 1, size)"))
        often = longer.groupBy(*keys).agg(F.count(F.lit(1)).alias("often"))
        counted = each.filter(F.col("size") > 0).join(often, keys, "left").withColumn("often", F.coalesce("often", F.lit(0)))
        rarest = Window.partitionBy("name", "m").orderBy("often", "i")
        ranked = counted.withColumn("rank", F.row_number().over(rarest)).filter((F.col("rank") <= F.col("k") + 1) & (F.col("often") > 0))
        return write_through(ranked.select("name", "letters", "k", *keys), "name-pieces")

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        longer = write_through(windows(b), "name-windows")
        met = pair_across(pieces(a, longer), longer, keys)
        apart = F.aggregate(F.zip_with("a_letters", "b_letters", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        return met.filter(apart <= F.col("a_k")).select(F.col("a_name").alias("short"), F.col("b_name").alias("long"))

    if right is None:
        own = texts(left)
        found = meet(own, own).select(F.least("short", "long").alias("left_name"), F.greatest("short", "long").alias("right_name"))
    else:
        l, r = texts(left), texts(right)
        found = meet(l, r).select(F.col("short").alias("left_name"), F.col("long").alias("right_name")).union(
            meet(r, l).select(F.col("long").alias("left_name"), F.col("short").alias("right_name")))
    return found.filter(F.col("left_name") != F.col("right_name")).distinct()


def similar_names(left: DataFrame, right: DataFrame | None = None, ratio: float = V.ENTITY_RATIO) -> DataFrame:
    """(left_name, right_name, score) for every candidate with score > ratio."""
    scored = name_candidates(left, right, ratio).withColumn("score", token_sort_ratio(F.lower("left_name"), F.lower("right_name")))
    return scored.filter(F.col("score") > ratio)


def best_canonical(names: DataFrame, canonicals: DataFrame, ratio: float = V.ENTITY_RATIO) -> DataFrame:
    """name with the best matching stored canonical name, if any; ties go to the smallest."""
    best = similar_names(names, canonicals, ratio).groupBy("left_name").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("right_name").alias("canonical"))).alias("b")
    )
    same = canonicals.select(F.col("name"), F.col("name").alias("equal")).distinct()
    return (
        names.join(best, F.col("name") == F.col("left_name"), "left")
        .join(same, "name", "left")
        .select("name", F.coalesce("equal", "b.canonical").alias("canonical"))
    )


def canonical_names(names: DataFrame, ratio: float = V.ENTITY_RATIO, order: str | None = None) -> DataFrame:
    """Each name with its canonical name: names are taken in order and join the best earlier
    canonical name above the ratio, or become canonical themselves.

    `order` is the column that says when a name was first seen; without it names are taken in
    the fixed, well mixed order of their hash, which keeps the number of rounds small.

    The order dependence is resolved in rounds. A name all of whose earlier matches are known
    followers is canonical; a match of a canonical earlier name is a follower. Each round is a
    few joins over the match table, written to the shared folder. The first open name in order
    is settled in each round at the latest, so the loop ends, and it ends with no name open.
    """
    rank = F.min(order) if order else F.xxhash64("name")
    ordered = write_through(names.groupBy("name").agg(rank.alias("seen")), "names")
    seen = lambda side: ordered.select(F.col("name").alias(f"{side}_name"), F.col("seen").alias(f"{side}_seen"))
    matches = similar_names(ordered, None, ratio).join(seen("left"), "left_name").join(seen("right"), "right_name")
    left_later = F.struct("left_seen", "left_name") > F.struct("right_seen", "right_name")
    edges = write_through(
        matches.select(F.when(left_later, F.col("left_name")).otherwise(F.col("right_name")).alias("later"),
                       F.when(left_later, F.col("right_name")).otherwise(F.col("left_name")).alias("earlier"), "score"), "name-matches")
    state = write_through(ordered.select("name", F.lit("open").alias("role")), "name-roles")
    live = edges
    while True:
        open_names = state.filter(F.col("role") == "open").select("name")
        if open_names.isEmpty():
            break
        as_earlier, as_later = open_names.withColumnRenamed("name", "earlier"), open_names.withColumnRenamed("name", "later")
        # only matches between open names can still decide anything
        live = write_through(live.join(as_earlier, "earlier", "left_semi").join(as_later, "later", "left_semi").select("later", "earlier"), "open-matches")
        fresh = open_names.join(live.select(F.col("later").alias("name")), "name", "left_anti")
        led = live.join(fresh.withColumnRenamed("name", "earlier"), "earlier", "left_semi").select(F.col("later").alias("name")).distinct()
        marks = fresh.withColumn("new", F.lit("leader")).unionByName(led.withColumn("new", F.lit("follower")))
        state = write_through(
            state.join(marks, "name", "left").select("name", F.coalesce("new", "role").alias("role")), "name-roles")
    leaders = state.filter(F.col("role") == "leader").select(F.col("name").alias("earlier"))
    chosen = edges.join(leaders, "earlier", "left_semi").groupBy("later").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("earlier").alias("canonical"))).alias("b"))
    return state.join(chosen, F.col("name") == F.col("later"), "left").select(
        "name", F.when(F.col("role") == "leader", F.col("name")).otherwise(F.col("b.canonical")).alias("canonical"))


def known_canonicals(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct canonical names of the entity table; the alias table stands in while it is empty."""
    stored = entities.select(F.col("canonical_name").alias("name")).distinct()
    return aliases.select(F.col("canonical").alias("name")).distinct() if stored.isEmpty() else stored
