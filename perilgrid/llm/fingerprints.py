"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches.

A text is cut into pieces, at line ends and after a number of characters that
depends on the size class of the text, and its distinct pieces are hashed.  With
``by_content``, texts of all sizes are cut by one rule: at line ends, after words that
end in one of certain characters, and 96 characters after the last cut.  Every
digest goes into three cells, each of which keeps a count, the XOR of its digests and
the XOR of their checks.  Two sketches subtract cell by cell; what they share cancels
out.  Peeling takes a cell that holds one digest, notes the digest, removes it from
its other cells, and goes on until nothing is left: what came out are the digests
that the two texts do not share.  If cells remain, a larger sketch is tried.

Cells come in pages of three parts, and a digest has one cell in each part of its
page.  Cells are rows, empty ones are left out, and peeling one part is one aggregate
that needs no shuffle.  Each try has more pages per digest than the one before.

Texts are shuffled once, to stand before their successors.  Digests are made after
that shuffle and subtracted in the same tasks; only those of pairs that need a larger
sketch are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.session import cut_lineage

#: Characters of a text below which pieces have so many characters at most.
PIECES = [(64, 4), (512, 24), (4096, 96), (32768, 384), (None, 1536)]
#: A piece of a text of any size: up to a line end or a word with such an end, or 96 characters.
CONTENT = "[^\\n]{0,95}?(?:[.!?。！？bcdfghjklmpqvwxyz][ \\t]+\\n*|\\n+)|[^\\n]{1,96}"
#: Parts of a page, and cells of a part.
_PARTS, _CELLS = 3, 64
#: Digests of both texts per page in the first try; halved from one try to the next.
_PER_PAGE = 32.0
_CHECK = 77
#: Characters of the texts that one task takes, and buckets of ids that go to it on average.
_CHARS_PER_TASK, _BUCKETS_PER_TASK = 1_000_000, 4
#: Digests of both texts of all pairs that one task takes in a further try.
_PER_TASK = 50_000
#: Parts peeled in one try, one after another; what is left after them counts as a failure.
_ROUNDS = 7


def digests(text: Column, by_content: bool = False) -> Column:
    """Hashes of the distinct pieces of a text."""
    if by_content:
        return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CONTENT), F.lit(0)), lambda p: F.xxhash64(p)))
    n, out = F.char_length(text), None
    for below, width in PIECES:
        cut = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{width}}}\n*|\n+"), F.lit(0))
        if below is None:
            out = cut if out is None else out.otherwise(cut)
        else:
            out = (F if out is None else out).when(n < below, cut)
    return F.array_distinct(F.transform(out, lambda p: F.xxhash64(p)))


def fingerprint(text: Column, found: Column) -> Column:
    """The text's hash, the number of its pieces, and the smallest sketch: two cells in each quarter."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))

    def cell(quarter: int, side: int) -> Column:
        own = F.filter(found, lambda d: F.shiftright(d, 8 + quarter).bitwiseAND(F.lit(1)) == side)
        return F.aggregate(
            own,
            zero,
            lambda a, d: F.struct(
                (a.n + 1).alias("n"), a.k.bitwiseXOR(d).alias("k"), a.c.bitwiseXOR(F.xxhash64(d, F.lit(_CHECK))).alias("c")
            ),
            lambda a: F.concat_ws(".", a.n.cast("string"), F.lower(F.hex(a.k)), F.lower(F.hex(a.c))),
        )

    cells = [cell(quarter, side) for quarter in range(4) for side in (0, 1)]
    return F.concat_ws("-", F.lower(F.hex(F.xxhash64(text))), F.size(found).cast("string"), *cells)


def _with_next(docs: DataFrame, id_col: str, text_col: str, by_content: bool) -> DataFrame:
    """Each row with its successor in descending order of the id; the last row's is the first row.

    Rows are dealt to buckets between quantiles of the id.  A bucket also gets a
    copy of the first row of the bucket that follows, so no row looks outside.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"))
    chars = rows.agg(F.sum(F.char_length("_text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // _CHARS_PER_TASK))
    wanted = _BUCKETS_PER_TASK * tasks
    shares = [k / wanted for k in range(1, wanted)]
    points = sorted(rows.agg(F.percentile_approx("_id", shares, 20 * wanted)).first()[0] or [])
    step = max(64, math.isqrt(wanted))
    below = lambda ps: F.size(F.filter(ps, lambda p: p <= F.col("_id")))
    listed = lambda ps: F.array(*[F.lit(p).cast("bigint") for p in ps]).cast("array<bigint>")
    coarse = below(listed(points[step - 1 :: step]))
    bucket = coarse * step + below(F.slice(listed(points), coarse * step + 1, step))
    rows = rows.withColumn("_bucket", F.when(F.col("_id").isNull(), -1).otherwise(bucket).cast("int"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    order = [F.desc_nulls_last("_id"), F.asc("_hash")]
    head = rows.groupBy("_bucket").agg(
        F.max_by(F.struct("_id", "_text", "_hash"), F.struct(F.col("_id").isNotNull(), "_id", -F.shiftright("_hash", 1), F.col("_hash"))).alias("h")
    )
    # one row per bucket: the first of the next bucket down, or of the top bucket after the last
    down = Window.orderBy(F.desc("_bucket"))
    top = F.first("_bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = rows.select("_bucket").distinct().select(F.col("_bucket").alias("_to"), F.coalesce(F.lead("_bucket").over(down), top).alias("_bucket"))
    ghosts = head.join(after, "_bucket").select("h._id", "h._text", F.col("_to").alias("_bucket"), "h._hash", F.lit(True).alias("_ghost"))
    both = rows.select("_id", "_text", "_bucket", "_hash", F.lit(False).alias("_ghost")).union(ghosts)
    in_bucket = Window.partitionBy("_bucket").orderBy("_ghost", *order)
    # a stated number of partitions is not coalesced: the rows grow many times over inside the tasks
    return (
        both.repartition(tasks, "_bucket")
        .withColumn("_found", digests(F.col("_text"), by_content))
        .withColumn("_next", F.lead("_text").over(in_bucket))
        .withColumn("_next_found", F.lead("_found").over(in_bucket))
        .withColumn("_at", F.row_number().over(in_bucket))
        .filter(~F.col("_ghost"))
    )


def _place(hashed: Column, first: Column, part: int) -> Column:
    """A digest's cell in a part of the page that begins with the part ``first``."""
    own = F.shiftright(hashed, 6 * part).bitwiseAND(F.lit(_CELLS - 1)).cast("int")
    return (first + part) * _CELLS + own


def _peel_part(cells: DataFrame, keys: list[str], turn: int, part: int) -> DataFrame:
    """Every digest that a cell of this part holds alone leaves all its cells.

    ``cells`` has ``i``, ``n``, ``k`` and ``c``; a row with ``i`` -1 counts the digests
    that came out.  A digest has one cell in a part, so it comes out once.  All groups
    contain ``keys``, so rows that are dealt by one of them stay where they are.
    """
    of = F.shiftright("i", 6)
    alone = (F.col("i") >= 0) & (F.abs("n") == 1) & (of % _PARTS == part) & (F.xxhash64("k", F.lit(_CHECK)) == F.col("c"))
    hashed = F.xxhash64("k", F.lit(turn))
    others = [_place(hashed, of - part, p) for p in range(_PARTS) if p != part]
    marked = cells.select(*keys, "i", "n", "k", "c", alone.alias("_alone"))
    to = F.when(F.col("_alone"), F.array(*others, F.lit(-1))).otherwise(F.array("i"))
    moved = marked.select(*keys, "_alone", "n", "k", "c", F.explode(to).alias("i"))
    counts = F.col("_alone") & (F.col("i") == -1)
    none = F.lit(0).cast("bigint")
    return _cell_sums(
        moved.select(
            *keys, "i", F.when(counts, 1).when(F.col("_alone"), -F.col("n")).otherwise(F.col("n")).alias("n"),
            F.when(counts, none).otherwise(F.col("k")).alias("k"), F.when(counts, none).otherwise(F.col("c")).alias("c"),
        ),
        keys,
    )


def _cell_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells from their contributions, less the empty ones."""
    sums = rows.groupBy(*keys, "i").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return sums.filter("n <> 0 or k <> 0 or c <> 0")


def subtract(pairs: DataFrame, keys: list[str], turn: int, per_page: float) -> DataFrame:
    """``keys``, ``found``, ``left`` for pairs of digest arrays ``a`` and ``b``.

    ``found`` is the number of digests that only one of the two has, if no cells are
    ``left``.  Pairs of sketches that are equal are not returned.
    """
    pages = F.ceil((F.size("a") + F.size("b")) / per_page).cast("bigint")
    held = pairs.select(*keys, pages.alias("_pages"), F.size("a").alias("_first"), F.posexplode(F.concat("a", "b")).alias("_place", "k"))
    hashed = F.xxhash64("k", F.lit(turn))
    signed = held.select(
        *keys, F.when(F.col("_place") < F.col("_first"), 1).otherwise(-1).alias("n"), "k", F.xxhash64("k", F.lit(_CHECK)).alias("c"),
        hashed.alias("_hashed"), (F.pmod(F.shiftright(hashed, 24), F.col("_pages")).cast("int") * _PARTS).alias("_page"),
    )
    places = [_place(F.col("_hashed"), F.col("_page"), p) for p in range(_PARTS)]
    cells = _cell_sums(signed.select(*keys, "n", "k", "c", F.explode(F.array(*places)).alias("i")), keys)
    for k in range(_ROUNDS):
        cells = _peel_part(cells, keys, turn, k % _PARTS)
    came = F.coalesce(F.sum(F.when(F.col("i") == -1, F.col("n"))), F.lit(0))
    return cells.groupBy(*keys).agg(came.alias("found"), F.count_if(F.col("i") >= 0).alias("left"))


def _tasks(pairs: DataFrame) -> int:
    """How many tasks subtract these pairs in a further try: as many as shuffles have, more if the digests call for it."""
    held = pairs.agg(F.sum(F.size("a") + F.size("b"))).first()[0] or 0
    return max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // _PER_TASK))


def _dealt_by_bucket(joined: DataFrame) -> DataFrame:
    """Writes a join whose sides are both dealt by the bucket, part of its key, and lets Spark leave them so: nothing is shuffled."""
    conf, name = joined.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(joined)
    finally:
        conf.set(name, before)


def _by_row(tried: DataFrame) -> DataFrame:
    """``found0``, ``left0``, ``found1``, ``left1``: what both pairs of a row gave, null if nothing."""
    one = lambda c, k: F.max(F.when(F.col("_pair") % 2 == k, F.col(c))).alias(f"{c}{k}")
    return tried.groupBy("_bucket", F.shiftright("_pair", 1).alias("_at")).agg(*[one(c, k) for k in (0, 1) for c in ("found", "left")])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_content: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has the last ``floor(n_chars / 3)`` code points replaced by the
    first as many (or all) of the next document in descending order of the id; the
    first follows the last.  A likeness is 1 less the share of digests that only
    one of the two texts has; two empty texts have 1.

    A null text is an empty one.  Null ids come last; rows that share an id are
    ordered by a hash of the text.  A single row is followed by itself.  An empty
    table gives no rows.  Other columns are not read.
    """
    rows = _with_next(docs, id_col, text_col, by_content)
    n = F.char_length("_text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(_text, char_length(_text) - cast(floor(char_length(_text) / 3) as int))"), F.substring(F.col("_next"), F.lit(1), tail))
    rows = rows.withColumn("_edited", edited).withColumn("_edited_found", digests(F.col("_edited"), by_content))
    keys = ["_bucket", "_pair"]

    def pairs_of(held: DataFrame, *more: str) -> DataFrame:
        """A row's text with its edited form (an even ``_pair``) and with the next text (an odd one)."""
        versions = F.array(*[F.struct(F.col("_found").alias("a"), F.col(c).alias("b")) for c in ("_edited_found", "_next_found")])
        pairs = held.select("_bucket", "_at", *more, F.posexplode(versions).alias("_which", "v"))
        return pairs.select("_bucket", (F.col("_at") * 2 + F.col("_which")).alias("_pair"), *more, "v.*")

    first = _by_row(subtract(pairs_of(rows), keys, 0, _PER_PAGE)).hint("shuffle_hash")
    failed = (F.coalesce("left0", F.lit(0)) > 0) | (F.coalesce("left1", F.lit(0)) > 0)
    table = _dealt_by_bucket(
        rows.join(first, ["_bucket", "_at"], "left").select(
            "_bucket",
            "_at",
            F.col("_id"),
            n.cast("bigint").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            fingerprint(F.col("_text"), F.col("_found")).alias("fingerprint"),
            fingerprint(F.col("_edited"), F.col("_edited_found")).alias("edited_fingerprint"),
            (F.size("_found") + F.size("_edited_found")).alias("size0"),
            (F.size("_found") + F.size("_next_found")).alias("size1"),
            *[F.coalesce(f"{c}{k}", F.lit(0)).alias(f"{c}{k}") for c in ("found", "left") for k in (0, 1)],
            F.when(failed, F.struct("_found", "_edited_found", "_next_found")).alias("_again"),
        )
    )
    out = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "size0", "size1", "found0", "found1"]
    again = table.filter("_again is not null")
    todo = pairs_of(again.select("_bucket", "_at", "left0", "left1", "_again.*"), "left0", "left1")
    todo = todo.filter(F.when(F.col("_pair") % 2 == 0, F.col("left0")).otherwise(F.col("left1")) > 0).select(*keys, "a", "b")
    done, turn, per_page = None, 1, _PER_PAGE / 2
    while not todo.isEmpty():
        tried = cut_lineage(subtract(todo.repartition(_tasks(todo), "_bucket"), keys, turn, per_page))
        solved = tried.filter("left = 0")
        done = solved if done is None else done.union(solved)
        todo, turn, per_page = todo.join(tried.filter("left > 0").select(*keys), keys, "left_semi"), turn + 1, per_page / 2
    rows = table.filter("_again is null").select(*out)
    if done is not None:
        later = _by_row(done).toDF("_bucket", "_at", "later0", "_0", "later1", "_1")
        now = {f"found{k}": F.when(F.col(f"left{k}") > 0, F.coalesce(f"later{k}", F.lit(0))).otherwise(F.col(f"found{k}")) for k in (0, 1)}
        rows = rows.union(again.join(later, ["_bucket", "_at"], "left").withColumns(now).select(*out))
    alike = lambda k: F.when(F.col(f"size{k}") == 0, 1.0).otherwise(1.0 - F.col(f"found{k}") / F.col(f"size{k}"))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        alike(0).alias("near_edited"),
        alike(1).alias("near_next"),
    )
