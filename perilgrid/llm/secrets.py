"""Secret scan over a ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content.  The ledger
is a Parquet folder with one row per blob and rule version that has been scanned,
spans included, empty ones too.  A run scans only the pairs that the ledger lacks,
appends them, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those whose ``group``
    has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: In the order in which spans with equal starts are listed.
RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run of hex digits is matched whole, so short runs can be left out by the pattern itself
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,stop:int>>"


def read_ledger(spark, path: str, rules=RULES) -> DataFrame:
    """The rows for these rule versions; none if the ledger does not exist yet."""
    try:
        table = spark.read.schema(LEDGER).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], LEDGER)
    current = [f"{r.kind}:{r.version}" for r in rules]
    return table.filter(F.concat_ws(":", "kind", "version").isin(current)).dropDuplicates(["blob", "kind", "version"])


def _pieces(rule: Rule):
    """Lengths of the text before each match, of the match, and of the tested group."""
    pattern = F.lit(rule.pattern)
    size = lambda values: F.transform(values, F.char_length)
    return F.when(
        F.rlike("text", pattern),
        F.arrays_zip(
            size(F.regexp_extract_all("text", pattern, F.lit(0))).alias("match"),
            size(F.regexp_extract_all("text", pattern, F.lit(rule.group))).alias("tested"),
            size(F.split("text", pattern, -1)).alias("before"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blobs`` (``blob``, ``text``, ``wanted``: the rules to run, as kind:version)."""
    scans = [
        F.struct(
            F.lit(r.kind).alias("kind"),
            F.lit(r.version).alias("version"),
            F.lit(r.least).alias("least"),
            F.when(F.array_contains("wanted", f"{r.kind}:{r.version}"), _pieces(r)).alias("found"),
        )
        for r in rules
    ]
    by_rule = blobs.select("blob", "wanted", F.explode(F.array(*scans)).alias("s")).filter(
        F.array_contains("wanted", F.concat_ws(":", "s.kind", "s.version"))
    )
    hits = by_rule.select("blob", "s.kind", "s.version", "s.least", F.posexplode_outer("s.found").alias("at", "hit"))
    so_far = Window.partitionBy("blob", "kind", "version").orderBy("at")
    stop = F.sum(F.col("hit.before") + F.coalesce("hit.match", F.lit(0))).over(so_far).cast("int")
    spans = hits.withColumn("stop", stop).withColumn(
        "span",
        F.when(
            F.col("hit.tested") >= F.col("least"),
            F.struct((F.col("stop") - F.col("hit.match")).cast("int").alias("start"), F.col("stop").alias("stop")),
        ),
    )
    return spans.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules=RULES
) -> DataFrame:
    """``id``, one count ``n_<kind>`` per rule, ``base_sha256`` and ``spans`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` by start, then by the rules' order, joined
    with commas; positions are code points and the end is exclusive.
    ``ledger`` is the folder to read and to append to; without one a new folder
    under the shared scratch folder is used.

    A null text is an empty blob, without findings.  Rows with a null or
    repeated id give one row each.  An empty table gives none.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    contents = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    done = read_ledger(spark, ledger, rules).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    every = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    unseen = (
        contents.join(done, "blob", "left")
        .withColumn("wanted", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        .filter(F.size("wanted") > 0)
    )
    scan_blobs(unseen, rules).write.mode("append").parquet(ledger)

    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    found = read_ledger(spark, ledger, rules).filter(F.size("spans") > 0)
    entries = F.transform("spans", lambda s: F.struct(s.start.alias("start"), rank.alias("rank"), s.stop.alias("stop"), F.col("kind").alias("kind")))
    sizes = [F.coalesce(F.max(F.when(F.col("kind") == r.kind, F.size("spans"))), F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    joined = F.transform(
        F.array_sort(F.flatten(F.collect_list(entries))), lambda e: F.concat_ws(":", e.kind, e.start, e.stop)
    )
    findings = found.groupBy("blob").agg(*sizes, F.array_join(joined, ",").alias("spans"))
    paths = docs.select(F.col(id_col).alias(id_col), F.sha2(text, 256).alias("blob"))
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    spans = F.coalesce("spans", F.lit(""))
    return paths.join(findings, "blob", "left").select(id_col, *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
