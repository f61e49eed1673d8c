"""The pair rules R1 to R5 as column expressions over a pair table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import compact, falsy_confidence, relative_delta, strip
from factweave.functions.similarity import token_sort_ratio
from factweave.operators.pairs import pair_across, pair_up

COMPARED = ["fact_id", "document_id", "norm_value", "norm_unit", "currency", "period", "scope", "confidence", "raw_value"]


def clean(column: Column) -> Column:
    return strip(F.coalesce(column, F.lit("")))


def said(raw_value: Column, quote: Column) -> Column:
    """The text of a claim as R5 compares it."""
    return F.lower(strip(F.coalesce(F.nullif(raw_value, F.lit("")), quote, F.lit(""))))


def _differ(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def _column(pairs: DataFrame, name: str) -> Column:
    return F.col(name) if name in pairs.columns else F.lit(None).cast("string")


def _rate(code: Column) -> Column:
    rates = F.create_map(*[x for k, v in V.FX_TO_USD.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(rates, code)


def _whole_word(words: list[str]) -> str:
    return r"(?U)\b(?:" + "|".join(sorted(words)) + r")\b"


def _bit(number: int) -> Column:
    return F.lit(1 << number).cast("long")


def _stance(text: Column, side: int) -> Column:
    """A bit for each opposed word set of which the text has a word of the side (0: negative, 1: positive)."""
    bits = [F.when(text.rlike(_whole_word(words[side])), _bit(i)).otherwise(F.lit(0).cast("long")) for i, words in enumerate(V.OPPOSITION)]
    found = bits[0]
    for bit in bits[1:]:
        found = found.bitwiseOR(bit)
    return found


def _postal(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\d{5,6}\b"), F.lit(0))


def _opposition(a: Column, b: Column, opposed: Column) -> Column:
    """'worda_vs_wordb' of the first opposed word set (a bit of `opposed`), else null."""
    found = []
    for i, (negative, positive) in enumerate(V.OPPOSITION):

        def first_word(text: Column) -> Column:
            hits = [F.when(text.rlike(_whole_word([w])), F.lit(w)) for w in sorted(negative + positive)]
            return F.coalesce(*hits)

        found.append(F.when(opposed.bitwiseAND(_bit(i)) != 0, F.concat_ws("_vs_", first_word(a), first_word(b))))
    return F.when(opposed != 0, F.coalesce(*found))


#: what the rules read of one fact alone, by name: from a function that gives the fact's columns
_OF_A_FACT = {
    "_c": lambda c: falsy_confidence(c("confidence")),
    "_p": lambda c: F.upper(clean(c("period"))),
    "_s": lambda c: F.lower(clean(c("scope"))),
    "_cu": lambda c: F.upper(clean(c("currency"))),
    "_u": lambda c: F.lower(clean(c("norm_unit"))),
    "_v": lambda c: c("norm_value").cast("double"),
    "_fx": lambda c: _rate(F.upper(clean(c("currency")))),
    "_t": lambda c: said(c("raw_value"), c("quote")),
    "_neg": lambda c: _stance(said(c("raw_value"), c("quote")), 0),
    "_pos": lambda c: _stance(said(c("raw_value"), c("quote")), 1),
    "_zip": lambda c: _postal(said(c("raw_value"), c("quote"))),
}
_OF_A_TEXT = ["_t", "_neg", "_pos", "_zip"]


def prepared(facts: DataFrame, with_text: bool = True) -> DataFrame:
    """Facts with all that the rules read of one fact alone, so that trimming, matching words and rates
    are worked out once a fact and not once a pair. `apply_rules` takes them off again."""
    names = [n for n in _OF_A_FACT if with_text or n not in _OF_A_TEXT]
    return facts.withColumns({n: _OF_A_FACT[n](lambda c: _column(facts, c)) for n in names})


def _own(pairs: DataFrame, side: str, name: str) -> Column:
    """What `prepared` gives of the fact of a side, worked out here if its facts were not prepared."""
    if f"{side}_{name}" in pairs.columns:
        return F.col(f"{side}_{name}")
    return _OF_A_FACT[name](lambda c: _column(pairs, f"{side}_{c}"))


def _stated(pairs: DataFrame) -> list[str]:
    """The columns of pairs without those of `prepared`."""
    more = {f"{side}_{name}" for side in "ab" for name in (*_OF_A_FACT, "_worded")}
    return [c for c in pairs.columns if c not in more]


def sides(pairs: DataFrame) -> DataFrame:
    """Adds what the rules read of both sides: cleaned axes, what differs (`_context`), and the
    values in comparable terms (`_xa`, `_xb`: by `_af`, `_bf`, `_rate`) with their `_delta`."""
    col = lambda name: _column(pairs, name)
    p = pairs.withColumns(
        {
            **{f"{name}{side}": _own(pairs, side, name) for name in ("_c", "_p", "_s", "_cu", "_u", "_v", "_fx") for side in "ab"},
            "_ea": F.lower(clean(col("a_entity_canon"))),
            "_eb": F.lower(clean(col("b_entity_canon"))),
        }
    )
    c = F.col
    both = c("_va").isNotNull() & c("_vb").isNotNull()
    money = both & _differ(c("_cua"), c("_cub"))
    rate = c("_fxb") / c("_fxa")
    units = both & (c("_ua") != c("_ub"))
    plain = ["count", "text", ""]
    b_fraction = units & (c("_ua") == "pct") & c("_ub").isin(plain) & c("_vb").between(0.0, 1.0)
    a_fraction = units & ~b_fraction & (c("_ub") == "pct") & c("_ua").isin(plain) & c("_va").between(0.0, 1.0)
    p = p.withColumns({"_both": both, "_money": money, "_rate": F.when(money, rate), "_bf": F.coalesce(b_fraction, F.lit(False)),
                       "_af": F.coalesce(a_fraction, F.lit(False)), "_units": units})
    p = p.withColumns(
        {
            "_low": (c("_ca") < V.LOW_CONFIDENCE) | (c("_cb") < V.LOW_CONFIDENCE),
            "_dp": _differ(c("_pa"), c("_pb")),
            "_ds": _differ(c("_sa"), c("_sb")),
            "_de": _differ(c("_ea"), c("_eb")),
            "_dc": c("_money") & c("_rate").isNull(),
            "_du": c("_units") & ~c("_bf") & ~c("_af") & (c("_ua") != "") & (c("_ub") != ""),
            "_xa": F.when(c("_af"), c("_va") * 100.0).otherwise(c("_va")),
            "_xb": F.when(c("_bf"), c("_vb") * 100.0).when(c("_rate").isNotNull(), c("_vb") * c("_rate")).otherwise(c("_vb")),
        }
    )
    return p.withColumns(
        {
            "_context": c("_dp") | c("_ds") | c("_de") | c("_dc") | c("_du"),
            "_delta": F.when(c("_both"), relative_delta(c("_xa"), c("_xb"))),
        }
    )


def apply_rules(pairs: DataFrame, with_text: bool = True, explain: bool = True) -> DataFrame:
    """Adds relation, rules (array), relation_confidence and, if asked, explanation.

    Numeric rules stay in generated code. `with_text=False` leaves pairs without two numbers
    unclassified (null) and needs no Python at all.
    """
    p, c = sides(pairs), F.col
    match = c("_delta") <= V.TOLERANCE
    if with_text:
        text = ~c("_low") & ~c("_context") & ~c("_both")
        own = lambda name: [F.when(text, _own(pairs, x, name)) for x in "ab"]
        (negative, other_negative), (positive, other_positive) = own("_neg"), own("_pos")
        opposed = negative.bitwiseAND(other_positive).bitwiseOR(positive.bitwiseAND(other_negative))
        p = p.withColumns(dict(zip(("_ta", "_tb"), own("_t"))))
        p = p.withColumns({"_opp": _opposition(c("_ta"), c("_tb"), opposed), "_equal": c("_ta") == c("_tb"),
                           "_place": F.coalesce(F.arrays_overlap(*own("_zip")), F.lit(False))})
        # only pairs that nothing else settles, and whose lengths allow a match, are scored
        sizes = [F.length("_ta"), F.length("_tb")]
        asked = c("_opp").isNull() & ~c("_equal") & (F.lit(200.0) * F.least(*sizes) > V.TEXT_MATCH_RATIO * (sizes[0] + sizes[1]))
        asked = asked if explain else asked & ~c("_place")
        p = p.withColumn("_scored", token_sort_ratio(F.when(asked, c("_ta")), F.when(asked, c("_tb"))))
        p = p.withColumns({
            "_sim": F.when(c("_equal"), 100.0).otherwise(c("_scored")),
            "_same": F.when(c("_ta").isNotNull(), c("_equal") | c("_place") | F.coalesce(c("_scored") > V.TEXT_MATCH_RATIO, F.lit(False)))})
    else:
        p = p.withColumns({"_opp": F.lit(None).cast("string"), "_same": F.lit(None).cast("boolean")})
        if explain:
            p = p.withColumns({"_ta": F.lit(None).cast("string"), "_tb": F.lit(None).cast("string"), "_sim": F.lit(None).cast("double")})

    relation = (
        F.when(c("_low"), "needs_review")
        .when(c("_context"), "contextual_variance")
        .when(c("_both"), F.when(match, "corroborates").otherwise("contradicts"))
        .when(c("_opp").isNotNull(), "contradicts")
        .when(c("_same"), "corroborates")
        .when(~c("_same"), "needs_review")
    )
    tag = lambda test, name: F.when(test, F.lit(name))
    compare = ~c("_context") & c("_both")
    talk = ~c("_context") & ~c("_both")
    rules = F.when(c("_low"), F.array(F.lit("R1:low_confidence"))).otherwise(
        F.array_compact(
            F.array(
                tag(c("_dp"), "R2:context_diff:period"),
                tag(c("_ds"), "R2:context_diff:scope"),
                tag(c("_de"), "R2:context_diff:entity"),
                tag(c("_dc"), "R2:context_diff:currency"),
                F.when(c("_rate").isNotNull(), F.concat(F.lit("R3:FX:"), c("_cub"), F.lit("->"), c("_cua"), F.lit("@"),
                                                        F.format_string("%.4f", c("_rate")))),
                tag(c("_af") | c("_bf"), "R3:fraction_to_pct"),
                tag(c("_du"), "R2:context_diff:unit"),
                tag(compare & match, "R4:tolerance_match"),
                tag(compare & ~match, "R4:value_mismatch"),
                F.when(talk & c("_opp").isNotNull(), F.concat(F.lit("R5:verb_opposition:"), c("_opp"))),
                tag(talk & c("_opp").isNull() & c("_same"), "R5:string_match"),
                tag(talk & c("_opp").isNull() & ~c("_same"), "R5:unmatched_text"),
            )
        )
    )
    out = {"relation": relation, "rules": rules, "relation_confidence": F.round(F.least("_ca", "_cb"), 2)}
    if explain:
        out["explanation"] = _explanation()
    # One generated row per pair: a later filter on the outcome then reads it as a column
    # instead of being rewritten into a copy of all the rule expressions below.
    outcome = F.explode(F.array(F.struct(*[value.alias(name) for name, value in out.items()]))).alias("_r")
    stated = _stated(pairs)
    return p.select(*stated, outcome).select(*stated, "_r.*")


def apply_rules_by_kind(pairs: DataFrame, with_text: bool = True, explain: bool = True) -> DataFrame:
    """`apply_rules` for pairs that cost little to make: those of two numbers don't pass Python.

    The pairs are made twice, once for either kind. Where facts tell whether their group has one
    without a number (`_worded`), only such groups are shuffled for pairs in words."""
    if not with_text:
        return apply_rules(pairs, False, explain)
    numbers = F.col("a_norm_value").isNotNull() & F.col("b_norm_value").isNotNull()
    words = ~numbers & F.col("a__worded") & F.col("b__worded") if "a__worded" in pairs.columns else ~numbers
    return apply_rules(pairs.filter(numbers), False, explain).unionByName(apply_rules(pairs.filter(words), True, explain))


def _explanation() -> Column:
    c = F.col
    two = lambda x: F.format_string("%.2f", c(x))
    low_a, low_b = c("_ca") < V.LOW_CONFIDENCE, c("_cb") < V.LOW_CONFIDENCE
    axis = lambda test, name, a, b: F.when(test, F.concat_ws(" ", F.lit(name), c(a), F.lit("vs"), c(b)))
    axes = F.concat_ws(
        "; ",
        axis(c("_dp"), "periods differ:", "_pa", "_pb"),
        axis(c("_ds"), "scopes differ:", "_sa", "_sb"),
        axis(c("_de"), "entities differ:", "_ea", "_eb"),
        axis(c("_dc"), "currencies differ without convertible FX rate:", "_cua", "_cub"),
        axis(c("_du"), "units differ:", "_ua", "_ub"),
    )
    values = F.concat(F.lit("("), compact(c("_xa")), F.lit(" vs "), compact(c("_xb")), F.lit(")"))
    shown = [F.concat(F.lit("'"), F.substring(c(t), 1, 40), F.lit("'")) for t in ("_ta", "_tb")]
    words = F.split(c("_opp"), "_vs_")
    return (
        F.when(low_a & low_b, F.concat(F.lit("Low confidence extraction on both sides (fact A: "), two("_ca"),
                                       F.lit(", fact B: "), two("_cb"), F.lit(")")))
        .when(low_a, F.concat(F.lit("Low confidence extraction on fact A ("), two("_ca"), F.lit(")")))
        .when(low_b, F.concat(F.lit("Low confidence extraction on fact B ("), two("_cb"), F.lit(")")))
        .when(c("_context"), F.concat(F.lit("Contextual variance: "), axes, F.lit("; values not compared")))
        .when(c("_delta") <= V.TOLERANCE, F.concat(F.lit("Values match within 1% tolerance after unit normalization "), values))
        .when(c("_both"), F.concat(F.lit("Contradiction: same entity, period, scope; values differ by "),
                                   F.format_string("%.1f", c("_delta") * 100),
                                   F.lit("%; no transformation explains the gap "), values))
        .when(c("_opp").isNotNull(), F.concat(F.lit("Direct opposition detected ('"), words[0], F.lit("' vs '"), words[1], F.lit("')")))
        .when(c("_same"), F.concat(F.lit("Non-numeric claims corroborate: matching text or address (similarity "),
                                   F.format_string("%.1f", c("_sim")), F.lit("%)")))
        .when(c("_ta").isNotNull(), F.concat(F.lit("Needs review: non-numeric claims differ without direct opposition ("),
                                             shown[0], F.lit(" vs "), shown[1], F.lit(")")))
    )


def relation_id(a: str, b: str) -> Column:
    """The repeatable id of a relation of two facts, in either order."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256)


def as_relations(ruled: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Classified pairs as relation rows with a repeatable id; `more` columns are carried."""
    return ruled.select(
        relation_id("a_fact_id", "b_fact_id").alias("relation_id"),
        F.col("a_fact_id").alias("fact_a"),
        F.col("b_fact_id").alias("fact_b"),
        "relation",
        *(["explanation"] if "explanation" in ruled.columns else []),
        F.col("rules").alias("rules_applied"),
        F.col("relation_confidence").alias("confidence"),
        *(more or []),
    )


# ── a ledger of relations without listing them ───────────────────────────────

def claims(facts: DataFrame, more_keys: list[str] | None = None) -> DataFrame:
    """Facts that say the same thing under the same entity and attribute, collapsed.

    n facts become one row with their number, so a value copied a billion times costs one row
    after the map-side part of the aggregation. Where a fact of the group has no number, texts
    are compared (R5), so there the text is part of what a fact says.
    """
    by = ["entity_canon", "attribute_canon"]
    keys = [*by, *(more_keys or []), "period_key", "scope", "currency", "norm_unit", "norm_value", "low", "raw_value"]
    column = lambda name: F.col(name) if name in facts.columns else F.lit(None).cast("string")
    wordy = facts.filter(F.col("norm_value").isNull()).select(*by).distinct().withColumn("_wordy", F.lit(True))
    return (
        facts.withColumn("_said", said(column("raw_value"), column("quote"))).join(wordy, by, "left").drop("raw_value")
        .withColumn("raw_value", F.when(F.col("_wordy"), F.col("_said"))).withColumns(
            {
                "period_key": F.upper(clean(F.col("period"))),
                "low": falsy_confidence(F.col("confidence")) < V.LOW_CONFIDENCE,
            }
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("members"), F.min("fact_id").alias("fact_id"))
    )


def relation_ledger(facts: DataFrame) -> DataFrame:
    """All fact pairs, accounted for without listing them.

    Rows: entity_canon, attribute_canon, a_fact_id, b_fact_id, relation, rules, n_pairs.
    Facts that say the same are one claim, named by its smallest fact id; claims that agree on
    the period (or lack one) meet in a join and carry the number of fact pairs they stand for.
    Pairs with a low-confidence side and pairs of two different periods need no comparison:
    they are counted by arithmetic on group sizes, one row per group with null ids.
    """
    by = ["entity_canon", "attribute_canon"]
    c = claims(facts.dropna(subset=by))
    n = F.col("members")
    choose2 = lambda x: x * (x - 1) / 2
    per_period = c.groupBy(*by, "period_key").agg(
        F.sum(n).alias("n"), F.sum(F.when(~F.col("low"), n).otherwise(0)).alias("ok")
    )
    dated = F.when(F.col("period_key") != "", F.col("ok")).otherwise(0)
    sizes = per_period.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum(dated).alias("dated"), F.sum(dated * dated).alias("squares")
    )
    none = F.lit(None).cast("string")
    counted = lambda relation, rule, pairs: F.struct(
        F.lit(relation).alias("relation"), F.array(F.lit(rule)).alias("rules"), pairs.alias("n_pairs"))
    arithmetic = sizes.select(
        *by,
        F.explode(
            F.array(
                counted("needs_review", "R1:low_confidence", choose2(F.col("n")) - choose2(F.col("ok"))),
                counted("contextual_variance", "R2:context_diff:period", (F.col("dated") * F.col("dated") - F.col("squares")) / 2),
            )
        ).alias("r"),
    ).select(*by, none.alias("a_fact_id"), none.alias("b_fact_id"), "r.*")
    sure = c.filter(~F.col("low")).withColumn("period", F.nullif("period_key", F.lit("")))
    same = pair_up(sure, [*by, "period_key"], with_self=True)
    mixed = pair_across(sure.filter(F.col("period_key") == ""), sure.filter(F.col("period_key") != ""), by)
    met = same.drop("period_key").unionByName(mixed.drop("a_period_key", "b_period_key"))
    weight = F.when(F.col("a_fact_id") == F.col("b_fact_id"), choose2(F.col("a_members"))).otherwise(
        F.col("a_members") * F.col("b_members")
    )
    compared = apply_rules(met, explain=False).select(
        *by, "a_fact_id", "b_fact_id", "relation", "rules", weight.alias("n_pairs"))
    return arithmetic.unionByName(compared).filter(F.col("n_pairs") > 0).withColumn("n_pairs", F.col("n_pairs").cast("long"))
