"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides are the accepted and the rejected examples.  Each side
gets a Markov model over characters with contexts of zero to ``order`` characters,
each order smoothed by the next shorter one (Witten-Bell weights).  The other
URLs are judged by the difference of the two log-likelihoods per character, held
against a threshold that was calibrated on examples the models have not seen.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and every subdomain of it.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_PAD = "\u0002"
_BIN = 0.01


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    tests = [
        F.when(
            ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path)),
            F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, r_host, r_path in longest_first
    ]
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of each url: the character after its ``order`` predecessors."""
    padded = F.concat(F.lit(_PAD * order), F.col("_url"))
    places = F.sequence(F.lit(1), F.char_length("_url"))
    pieces = F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))
    return urls.filter(F.char_length("_url") > 0).withColumn("_gram", F.explode(pieces))


def _log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """``_gram``, ``_ratio``: log10 of the accepted over the rejected model's probability.

    ``grams`` has ``_gram`` and the training counts ``_a`` and ``_r``, which are
    zero where a gram occurs in judged URLs only.
    """
    level = grams
    levels = [level]
    for _ in range(order):
        level = level.groupBy(F.expr("substring(_gram, 2)").alias("_gram")).agg(F.sum("_a").alias("_a"), F.sum("_r").alias("_r"))
        levels.append(level)
    below = None
    for level in reversed(levels):
        same = Window.partitionBy(F.expr("left(_gram, char_length(_gram) - 1)"))
        parts = ["_gram"]
        for side in ("_a", "_r"):
            level = level.withColumn(f"{side}n", F.sum(side).over(same)).withColumn(
                f"{side}t", F.sum((F.col(side) > 0).cast("long")).over(same)
            )
        if below is None:
            floor = 1.0 / (F.count(F.lit(1)).over(same) + 1)
            level = level.withColumn("_ap", floor).withColumn("_rp", floor)
        else:
            level = level.withColumn("_shorter", F.expr("substring(_gram, 2)")).join(
                below.withColumnRenamed("_gram", "_shorter"), "_shorter"
            )
        for side in ("_a", "_r"):
            total = F.col(f"{side}n") + F.col(f"{side}t")
            mixed = (F.col(side) + F.col(f"{side}t") * F.col(f"{side}p")) / total
            parts.append(F.when(total > 0, mixed).otherwise(F.col(f"{side}p")).alias(f"{side}p"))
        below = level.select(*parts)
    return below.select("_gram", (F.log10("_ap") - F.log10("_rp")).alias("_ratio"))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row with the score from which a URL is accepted.

    The least balanced error over the held-back examples, in bins of a
    hundredth; the threshold lies midway between two bins that occur, and ties go
    to the one nearest to zero.  The number of bins is bounded by the range of
    the scores, whatever the number of URLs.
    """
    bins = scored.groupBy(F.round(F.col("_score") / _BIN).cast("long").alias("bin")).agg(
        F.sum((F.col("_verdict") == "allow").cast("long")).alias("a"),
        F.sum((F.col("_verdict") == "block").cast("long")).alias("r"),
    )
    ordered = Window.orderBy("bin")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = F.coalesce(F.sum("a").over(before), F.lit(0)) / F.sum("a").over(everywhere)
    let_in = 1 - F.coalesce(F.sum("r").over(before), F.lit(0)) / F.sum("r").over(everywhere)
    cut = (F.col("bin") + F.coalesce(F.lag("bin").over(ordered), F.col("bin") - 1)) / 2 * _BIN
    errors = bins.select((lost + let_in).alias("error"), cut.alias("cut"))
    best = errors.agg(F.min(F.struct("error", F.abs("cut").alias("far"), "cut")).alias("b"))
    return best.select(F.coalesce("b.cut", F.lit(0.0)).alias("threshold"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 4, hold_back: int = 5
) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` for every row of ``pages``.

    ``score`` is the mean log10 ratio per character; it is 0 for an empty url.
    ``rule`` and the rule's verdict are null and the models' verdict is taken
    where no rule fits.  One in ``hold_back`` of the decided URLs, by a hash of
    the url, calibrates the threshold instead of training; without such URLs it
    is 0, and without any decided URLs every url is accepted.

    A null url has an empty host and path and counts as an empty string.  Rows
    with a null or repeated id are judged like any other, one row out per row
    in; equal URLs are judged once.  Only the two named columns are read.
    """
    rows = pages.select(F.col(id_col).alias(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    urls = rows.select("_url").distinct()
    fit = rule_of(host_of(F.col("_url")), path_of(F.col("_url")), rules)
    held = F.pmod(F.xxhash64("_url"), F.lit(hold_back)) == 0
    urls = urls.select("_url", fit.getField("verdict").alias("_verdict"), held.alias("_held"))
    grams = _grams(urls, order)
    learn = lambda verdict: F.sum((~F.col("_held") & F.coalesce(F.col("_verdict") == verdict, F.lit(False))).cast("long"))
    counts = grams.groupBy("_gram").agg(learn("allow").alias("_a"), learn("block").alias("_r"))
    scores = (
        grams.join(_log_ratios(counts, order), "_gram")
        .groupBy("_url")
        .agg(F.avg("_ratio").alias("_score"), F.first("_verdict").alias("_verdict"), F.first("_held").alias("_held"))
    )
    threshold = _threshold(scores.filter(F.col("_held") & F.col("_verdict").isNotNull())).scalar()
    score = F.coalesce(F.col("_score"), F.lit(0.0))
    by_model = F.when(score >= threshold, "allow").otherwise("block")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    fit = rule_of(host, path, rules)
    return rows.join(scores.select("_url", "_score"), "_url", "left").select(
        id_col,
        host.alias("host"),
        path.alias("path"),
        fit.getField("rule").alias("rule"),
        F.coalesce(fit.getField("verdict"), by_model).alias("verdict"),
        score.alias("score"),
    )
