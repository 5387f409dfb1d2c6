"""Answers to questions about regions, a table of questions at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import constants as K
from perilgrid.functions.columns import js_number, lookup, risk_rank
from perilgrid.operators.board import latest_by_type
from perilgrid.operators.skew import skew_safe_join


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def intent(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(_mentions(q, K.SAFETY_WORDS), "safety_recommendation")
        .when(_mentions(q, K.PRECAUTION_WORDS), "precautionary_actions")
        .otherwise("risk_query")
    )


def hazard_mention(question: Column) -> Column:
    q = F.lower(question)
    return F.coalesce(*[F.when(q.contains(h), F.lit(h)) for h in K.HAZARDS])


def asked_regions(questions: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``region_id``: the one given with the question, else the least known
    region whose id occurs anywhere in the text.

    "Occurs in" is a substring test.  To keep it an equi-join, a text is cut before every
    place where an id may begin, which is where what all ids begin with stands (any place,
    if they have nothing in common).  The letters from there on are looked up by as many of
    them as the shortest id has, and what follows decides.  An id that many texts name
    is split over several tasks.  An empty id occurs nowhere.
    """
    known = regions.select(F.lower("region_id").alias("_id"), F.col("region_id").alias("_found")).filter("_id <> ''").distinct()
    low, high = F.min("_id").alias("low"), F.max("_id").alias("high")
    facts = known.agg(low, high, F.min(F.length("_id")).alias("least"), F.max(F.length("_id")).alias("most"))
    alike = F.expr("coalesce(array_max(filter(sequence(0, least), k -> left(low, k) = left(high, k))), 0)")
    begin = F.replace(F.expr("left(low, alike)"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    facts = facts.withColumn("alike", alike).withColumn("cut", F.concat(F.lit("(?=\\Q"), begin, F.lit("\\E)")))
    one = facts.select(F.struct("cut", "least", "most").alias("f")).scalar()
    open_ones = questions.filter(F.col("asked_region").isNull()).select(*keys, F.lower("question").alias("_q")).withColumn("_f", one)
    pieces = open_ones.withColumn("_pieces", F.split("_q", F.col("_f.cut"))).select(*keys, "_f", "_pieces", F.posexplode("_pieces").alias("_i", "_"))
    # a piece has a letter at least, so this many of them are as long as any id
    window = F.left(F.array_join(F.slice("_pieces", F.col("_i") + 1, F.col("_f.most")), ""), F.col("_f.most"))
    hits = pieces.select(*keys, window.alias("_near"), F.left(window, F.col("_f.least")).alias("_gram"))
    index = known.withColumn("_f", one).select("_id", "_found", F.left("_id", F.col("_f.least")).alias("_gram"))
    met = skew_safe_join(hits, index, ["_gram"]).filter(F.startswith("_near", "_id"))
    found = met.groupBy(*keys).agg(F.min("_found").alias("_found"))
    return questions.join(found, keys, "left").withColumn("region_id", F.coalesce("asked_region", "_found")).drop("_found")


def classify(questions: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with intent, region and hazard; without a region the intent is a request for one.

    Blank questions are refused, as nothing can be read from them.
    """
    real = questions.filter(F.trim(F.coalesce("question", F.lit(""))) != "")
    placed = asked_regions(real, regions, keys)
    return placed.withColumns(
        {
            "intent": F.when(F.col("region_id").isNull(), "location_clarification").otherwise(intent(F.col("question"))),
            "disaster_type": hazard_mention(F.col("question")),
        }
    )


def region_facts(predictions: DataFrame) -> DataFrame:
    """One row per region: its newest prediction per hazard, as a list of at most one entry each."""
    per = latest_by_type(predictions)
    return per.groupBy("region_id").agg(
        F.array_sort(
            F.collect_list(F.struct("disaster_type", "risk_level", "probability_pct", "time_to_impact_h"))
        ).alias("facts")
    )


def top_fact(facts: Column) -> Column:
    """Highest risk; the first one wins a tie, in order of hazard name."""
    worst = F.array_max(F.transform(facts, lambda f: risk_rank(f["risk_level"])))
    return F.element_at(F.filter(facts, lambda f: risk_rank(f["risk_level"]) == worst), 1)


def _risk_line(f: Column) -> Column:
    h = f["time_to_impact_h"]
    tti = F.when(
        h.isNotNull(),
        F.concat(F.lit(" Expected impact in approximately "), js_number(h), F.when(h == 1, " hour.").otherwise(" hours.")),
    ).otherwise("")
    return F.concat(
        f["disaster_type"], F.lit(" is "), f["risk_level"], F.lit(" ("), js_number(f["probability_pct"]),
        F.lit("% probability)."), tti,
    )


def answers(classified: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adds the answer text.  The region side has one row per region, so no
    question is multiplied; a region that many ask about is split."""
    df = skew_safe_join(classified, region_facts(predictions), ["region_id"], "left").withColumn("top", top_fact(F.col("facts")))
    hazard, top = F.col("disaster_type"), F.col("top")
    relevant = F.filter("facts", lambda f: hazard.isNull() | (f["disaster_type"] == hazard))
    listing = F.concat(
        F.lit("Current risk for "), "region_id", F.lit(": "), F.array_join(F.transform(relevant, _risk_line), " ")
    )
    none_of_type = F.concat(F.lit("I don't have current prediction data for "), hazard, F.lit(" in that region."))
    pct = js_number(top["probability_pct"])
    safety = (
        F.when(
            top["risk_level"] == "High",
            F.concat(F.lit("It is NOT safe. There is a "), top["disaster_type"], F.lit(" High risk alert ("), pct,
                     F.lit("%). Avoid travel and follow official guidance.")),
        )
        .when(
            top["risk_level"] == "Medium",
            F.concat(F.lit("Exercise caution. There is a "), top["disaster_type"], F.lit(" Medium risk ("), pct,
                     F.lit("%). Monitor official channels before travelling.")),
        )
        .otherwise(K.ANSWER_LOW)
    )
    precaution = F.when(
        top["risk_level"] == "High", lookup(top["disaster_type"], K.PRECAUTIONS, K.ANSWER_NO_ACTION)
    ).otherwise(K.ANSWER_NO_ACTION)
    text = (
        F.when(F.col("intent") == "location_clarification", K.ANSWER_NO_PLACE)
        .when(F.col("facts").isNull(), K.ANSWER_NO_DATA)
        .when(F.col("intent") == "risk_query", F.when(F.size(relevant) == 0, none_of_type).otherwise(listing))
        .when(F.col("intent") == "safety_recommendation", safety)
        .otherwise(precaution)
    )
    return df.withColumn("answer", text).drop("facts", "top")
