"""Similarity join of texts by Jaccard similarity of their word shingles.

Every set of shingles gets a parity sketch (see ``sketches``).  Sets that share a
sketch part in their size band become candidates; the folded sketches' Hamming
distance and the sizes throw out most, and what is left is verified on the whole
sets.  Only exact conditions decide, so no link is lost.

Copies are one node (the hash of the set), and groups of near copies are not
expanded: a first round links each node with one leader, a second one with the few
nodes of other components that it shares most keys with, and only pairs that lie
in different components even then are compared one by one.  Keys of many nodes are
not joined with themselves: there only nodes meet that share a rare shingle of
those by which each differs from the key's leader.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.llm.bits import bitmap, maybe
from perilgrid.llm.components import components
from perilgrid.llm.sketches import FOLDED_BITS, WIDE_BITS, WIDE_FROM, band_keys, folded
from perilgrid.llm.words import blocks, mix, shingle_sets
from perilgrid.session import cut_lineage, release

_PARTS = FOLDED_BITS // 64
_LONGS = pa.list_(pa.int64())
_HOT_IN_BLOCK, _HOT = 2, 8
_BLOCK = 4 << 20
#: Sets that a task remembers, so as not to sketch copies again.
_COPIES = 50_000
_CLOSEST = 3
#: Keys of more nodes than this are not expanded into pairs.
_CROWDED = 63


def _node(shingles: np.ndarray) -> int:
    """Hash of a set."""
    sums = np.array([np.add.reduce(shingles), np.bitwise_xor.reduce(mix(shingles)), len(shingles)], np.uint64)
    return int(mix(mix(sums[:1] ^ mix(sums[2:])) + sums[1:2])[0].astype(np.int64))


def _frequent(texts: DataFrame) -> np.ndarray:
    """Bitmap of shingles that many distinct sets hold.  It only orders sketch parts, so it may be rough."""

    def count(batches):
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                own = {_node(s): s for s in shingle_sets(part.column(part.schema.get_field_index("text"))) if len(s)}
                if own:
                    h, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
                    often = n >= _HOT_IN_BLOCK
                    yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

    seen = texts.select("text").mapInArrow(count, "h bigint, n bigint")
    return bitmap(seen.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= _HOT), "h", 24)


def _sketched(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Each text's id, text hash, set size and node; sketch and keys at the first copy in a task."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    kind = texts.schema["_id"].dataType.simpleString()

    def build(batches):
        hot, done = shared.value, set()
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                sizes, nodes, sketches, wide, keys = [], [], [], [], []
                for s in shingle_sets(part.column(2)):
                    node = _node(s) if len(s) else None
                    first = node is not None and node not in done
                    done.add(node)
                    if len(done) > _COPIES:
                        done.clear()
                    sizes.append(len(s))
                    nodes.append(node)
                    sketches.append(folded(s).view(np.int64) if first else None)
                    wide.append(folded(s, WIDE_BITS).view(np.int64) if first and len(s) > WIDE_FROM else None)
                    keys.append(band_keys(s, hot).view(np.int64) if first else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, _LONGS), pa.array(wide, _LONGS), pa.array(keys, _LONGS)],
                    ["_id", "hash", "n", "node", "sketch", "wide", "keys"],
                )

    return texts.mapInArrow(build, f"_id {kind}, hash bigint, n bigint, node bigint, sketch array<bigint>, wide array<bigint>, keys array<bigint>")


def _members(sketched: DataFrame, bits: int = 26) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of nodes that share a key: the table of all they have; ``node``, ``n``, ``hash`` and sketch columns; ``node``, ``n``, ``wide`` of
    the large ones; and their ``key``, ``node`` rows.

    A bitmap of keys that occur twice keeps the others out of the shuffle.
    """
    rows = sketched.filter("keys is not null")
    twice = rows.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1")
    shared = sketched.sparkSession.sparkContext.broadcast(bitmap(twice, "key", bits))

    def keep(batches):
        for batch in batches:
            lists = batch.column(5)
            keys, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), length)
            good = maybe(shared.value, keys.view(np.uint64))
            count = np.bincount(row[good], minlength=batch.num_rows)
            kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(keys[good]))
            some = pa.array(count > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], kept], batch.schema.names).filter(some)

    rows = rows.select("node", "n", "hash", "sketch", "wide", "keys")
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    nodes = cut_lineage(rows.mapInArrow(keep, kinds).dropDuplicates(["node"]))
    member = nodes.select("node", "n", F.explode("keys").alias("key"))
    common = member.groupBy("key").count().filter("count > 1")
    sketch = [F.col("sketch")[i].alias(f"s{i}") for i in range(_PARTS)]
    wide = nodes.filter("wide is not null").select("node", "n", "wide")
    return nodes, nodes.select("node", "n", "hash", *sketch), wide, cut_lineage(member.join(common.select("key"), "key"))


def _may_link(a: str, b: str) -> Column:
    """Bounds that every pair of similar sets keeps."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(_PARTS)), F.lit(0))
    return (4 * F.least(f"{a}.n", f"{b}.n") >= 3 * F.greatest(f"{a}.n", f"{b}.n")) & (7 * apart <= n)


def _near(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Leaves out pairs of large sets whose wide sketches lie too far apart."""
    x = wide.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    y = wide.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    each = F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(each, F.lit(0), lambda total, k: total + k)
    fits = F.coalesce(7 * apart <= F.col("na") + F.col("nb"), F.lit(True))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(fits).select(*pairs.columns)


def _leader_pairs(member: DataFrame, nodes: DataFrame, wide: DataFrame) -> DataFrame:
    """For each node the leader, the least member of a key, that it shares most keys with, two at least."""
    leaders = member.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"))
    met = member.join(leaders, "key").select("least.node", "least.n", F.col("node").alias("b"), F.col("n").alias("nb")).filter("node != b")
    met = met.filter(4 * F.least("n", "nb") >= 3 * F.greatest("n", "nb"))
    pairs = met.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    close = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node")).filter(_may_link("x", "y"))
    close = _near(close.select("a", "b", "times"), wide)
    return close.groupBy("b").agg(F.max(F.struct("times", "a")).alias("best")).select("best.a", "b")


def _split_keys(member: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``node``, ``n``, ``root`` of keys that lie in several components, and how ``many`` nodes the key has."""
    rooted = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many"))
    return rooted.join(split.filter("low != high").select("key", "many"), "key")


def _crowds(crowded: DataFrame) -> DataFrame:
    """``a``, ``node``, ``root``: the nodes of each key with its leader, which need not have the key itself.

    A key's first leader is the one of its nodes with most keys.  Near copies of one text are
    led by several of these, as each leaves out the keys of the parts it has changed; so that a
    node is compared with few, a key takes the leader that most of its nodes would choose, and
    a node chooses the one that leads most nodes.
    """
    most = crowded.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    first = crowded.join(most, "node").groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most"))
    first = cut_lineage(first.select("key", F.col("most.node").alias("a")))
    led = crowded.join(first, "key").select("a", "node").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("nodes"))
    offered = crowded.join(first.join(led, "a"), "key")
    chosen = offered.groupBy("node").agg(F.max(F.struct("nodes", "a")).alias("best"))
    votes = crowded.join(chosen, "node").groupBy("key", F.col("best.a").alias("a")).agg(F.count(F.lit(1)).alias("votes"))
    leaders = votes.groupBy("key").agg(F.max(F.struct("votes", "a")).alias("most"))
    crowd = cut_lineage(crowded.join(leaders, "key").select(F.col("most.a").alias("a"), "node", "root").distinct())
    release(first)
    return crowd


def _cross_pairs(split: DataFrame, nodes: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs of nodes that share two keys and lie in different components, within the bounds, and how many they share."""
    x, y = split.alias("x"), split.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    fits = 4 * F.least("x.n", "y.n") >= 3 * F.greatest("x.n", "y.n")
    met = x.join(y, meet & fits).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    met = met.filter("times > 1").join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node"))
    return _near(met.filter(_may_link("x", "y")).select("a", "b", "times"), wide)


def _crowd_pairs(crowd: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The same of ``a``, ``node``, ``root`` rows, nodes that share a crowded key, with the key's leader ``a``: no pair in reach of a link is left out.

    Let ``d`` be the number of shingles that a node's set and the leader's do not share.
    Nodes that link with the leader need no other link between them.  Of two others, with
    ``x`` not linked to it, the sets differ in ``dx + dy`` shingles less two for each that both
    differ in from the leader, so similar ones share at least ``(7 (dx + dy) - nx - ny) / 14``
    of these, and that is more than 0.  Put in one order, rarest first, the first one shared has
    at least as many places left in either list; copies that were changed at random share none so early.
    Whatever ``y`` is, ``dy`` is no less than what is shared and than ``|ny - na|``, so ``x`` shares at
    least ``(7 dx - nx - na) / 8`` with it.
    """
    sets = _sets(crowd.select("node").union(crowd.select("a")).distinct(), nodes, texts)
    lead = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    rows = crowd.filter("a != node").join(sets, "node").join(lead, "a")
    apart = F.concat(F.array_except("shingles", "of_a"), F.array_except("of_a", "shingles"))
    rows = rows.select("a", "node", "root", F.size("shingles").alias("n"), F.size("of_a").alias("na"), apart.alias("apart"))
    rows = cut_lineage(rows.withColumn("d", F.size("apart")).withColumn("outer", 7 * F.col("d") > F.col("n") + F.col("na")))
    each = rows.select("a", "node", "root", "n", "na", "d", "outer", F.explode("apart").alias("h"))
    often = each.groupBy("a", "h").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("a", "node").orderBy("times", "h")
    left = F.col("d") - F.row_number().over(order) + 1
    early = "if(outer, 8 * left >= 7 * d - n - na, 14 * left > 7 * d - n + na)"
    placed = cut_lineage(each.join(often, ["a", "h"]).withColumn("left", left).filter("times > 1").filter(early).drop("times"))
    x, y = placed.filter("outer").alias("x"), placed.filter("14 * left > 7 * d - n + na").alias("y")
    need = 7 * (F.col("x.d") + F.col("y.d")) - F.col("x.n") - F.col("y.n")
    meet = (F.col("x.a") == F.col("y.a")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root"))
    once = ~F.col("y.outer") | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, meet & once & (14 * F.least("x.left", "y.left") >= need))
    met = met.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    led = rows.filter("not outer").select("a", F.col("node").alias("b"), F.lit(1).cast("bigint").alias("times"))
    pairs = cut_lineage(met.union(led))
    release(sets, rows, placed)
    return pairs


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` that lie in different components."""
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    both = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _closest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` those that are among the best few of either node."""
    ends = pairs.select("a", "b", "times", F.explode(F.array("a", "b")).alias("node"))
    best = Window.partitionBy("node").orderBy(F.desc("times"), "a", "b")
    return ends.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= _CLOSEST).select("a", "b").distinct()


def _sets(ends: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``shingles``, the whole set, of the nodes in ``ends``."""
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(ends.join(nodes, "node"), "hash", 24))

    def take(batches):
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            some = batch.filter(pa.array(maybe(wanted.value, hashes)))
            for part in blocks(some, "text"):
                sets = [s for s in shingle_sets(part.column(2)) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], _LONGS)], ["node", "shingles"]
                )

    return cut_lineage(texts.mapInArrow(take, "node bigint, shingles array<bigint>").join(ends, "node").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, texts)
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = 7 * both >= 3 * (F.size("of_a") + F.size("of_b"))
    found = cut_lineage(pairs.join(y, "b").join(x, "a").filter(similar).select("a", "b"))
    release(sets)
    return found


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``text_hash`` for every row of ``docs``.

    Two texts link when 100 times the size of their sets' intersection is at least
    75 times that of their union; ``component_id`` is the least id reachable by
    links, the row's own included.  Texts without words, empty and null ones have an
    empty set, link with nothing and keep their own id, equal to each other or not.
    A text of fewer than five words is one shingle.  Rows that repeat an id are
    each judged by their own text.  A null id gets the least id of its group, and
    null if there is none.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sketched = cut_lineage(_sketched(texts, _frequent(texts)))
    table, nodes, wide, member = _members(sketched)
    pairs = cut_lineage(_leader_pairs(member, nodes, wide))
    links, tried = _verified(pairs, nodes, texts), pairs
    roots = components(links)
    split = cut_lineage(_split_keys(member, roots))
    crowded = F.col("many") > _CROWDED
    crowd = _crowds(split.filter(crowded))
    led = _crowd_pairs(crowd, nodes, texts)
    met = _cross_pairs(split.filter(~crowded).drop("many"), nodes, wide).union(led)
    met = cut_lineage(_apart(met.groupBy("a", "b").agg(F.sum("times").alias("times")), roots))
    release(split, crowd, led, member)
    done = [table, pairs, links, met]
    for closest_only in (True, False):
        apart = _apart(met, roots)
        pairs = (_closest(apart) if closest_only else apart.select("a", "b")).join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        new = _verified(pairs, nodes, texts)
        links, tried = links.union(new), tried.union(pairs)
        done += [pairs, new, roots]
        roots = components(links)
    release(*done)
    rows = sketched.join(roots, "node", "left").select("_id", "n", "hash", F.coalesce("root", "node").alias("root"))
    least = rows.filter("root is not null").groupBy("root").agg(F.min("_id").alias("least"))
    return rows.join(least, "root", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "_id").alias("component_id"), F.col("hash").alias("text_hash")
    )
