"""Near-duplicate groups of texts by b-bit MinHash.

Every set of four-word shingles gets 256 minima.  200 of them, five to a band, are its
40 keys: sets with a Jaccard similarity of 0.8 share no key in one of eight million
cases.  Of each minimum the lowest four bits are kept in a packed signature.  Two
signatures agree in a share ``J + (1 - J) / 16`` of the places, so counting the bits of
their XOR gives the similarity corrected for chance agreement; what lies five standard
deviations below the threshold is dropped, and the rest is confirmed on the full sets.

Copies are one node (the hash of the set), and groups are never written out as pairs:
each node is first linked with the member of its buckets that leads them and looks most
like it; then only buckets that still hold several components are compared inside,
tile by tile, first for the closest few of each node and then for all that is left.
That last look takes signatures of 1,024 places, so that texts which are nearly but not
quite similar to a whole group are told apart without comparing their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.llm.bits import bitmap, maybe
from perilgrid.llm.components import components
from perilgrid.llm.words import blocks, mix, shingle_sets
from perilgrid.session import cut_lineage

WIDTH, HASHES, BANDS, ROWS, BITS = 4, 256, 40, 5, 4
LONG = 1024
_U, _LONGS = np.uint64, pa.list_(pa.int64())
_rng = np.random.Generator(np.random.PCG64(41))
_FLIP = _rng.integers(0, 2**32, LONG, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, (LONG, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)
_PLACES = 0x1111111111111111
#: Places in which signatures of similar sets differ: 48 and 192 are expected at 0.8, these are five deviations more.
MOST_APART, MOST_APART_LONG = 80, 255
_BLOCK, _COPIES, _TILE, _CLOSEST = 2 << 20, 50_000, 1024, 3


# --- signatures -------------------------------------------------------------------


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """A row of minima for each set; the sets are not empty."""
    if not sets:
        return np.zeros((0, hashes), np.uint32)
    h = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((hashes, len(sets)), np.uint32)
    for j in range(hashes):
        v = (h ^ _FLIP[j]) * _TIMES[j, 0]
        v ^= v >> np.uint32(15)
        out[j] = np.minimum.reduceat(v * _TIMES[j, 1], starts)
    return out.T


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of each minimum, 16 to a word."""
    bits = (low & np.uint32(15)).astype(np.uint8)
    return np.ascontiguousarray(bits[:, ::2] | (bits[:, 1::2] << 4)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    band = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    return mix((band * _MIX).sum(2) + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places signatures differ (rows of words)."""
    d = (x ^ y).view(np.uint64)
    d = (d | (d >> _U(1)) | (d >> _U(2)) | (d >> _U(3))) & _U(_PLACES)
    return np.bitwise_count(d).sum(-1, dtype=np.int64)


def likeness(differ, hashes: int = HASHES):
    """Similarity that so many differing places stand for."""
    return 1 - differ / (hashes * (1 - 2.0**-BITS))


def _apart_column(x: str, y: str) -> Column:
    out = F.lit(0)
    for i in range(HASHES * BITS // 64):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(_PLACES))
        out = out + F.bit_count(d)
    return out


def _node(shingles: np.ndarray) -> int:
    """Hash of a set of sorted distinct hashes."""
    sums = np.array([np.add.reduce(shingles), np.bitwise_xor.reduce(mix(shingles)), len(shingles)], np.uint64)
    return int(mix(mix(sums[:1] ^ mix(sums[2:])) + sums[1:2])[0].astype(np.int64))


def _signed(texts: DataFrame) -> DataFrame:
    """Each row's id, text hash, set size and node; signature and keys with the first copies that a task sees."""
    kind = texts.schema["_id"].dataType.simpleString()

    def build(batches):
        done: set[int] = set()
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                sets = list(shingle_sets(part.column(2), WIDTH))
                nodes = [_node(s) if len(s) else None for s in sets]
                first = []
                for node in nodes:
                    first.append(node is not None and node not in done)
                    if first[-1]:
                        done.add(node)
                if len(done) > _COPIES:  # later copies are merged by their node
                    done.clear()
                low = minima([s for s, f in zip(sets, first) if f])
                row = iter(zip(packed(low), band_keys(low)))
                pairs = [next(row) if f else (None, None) for f in first]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
                    + [pa.array([p[k] for p in pairs], _LONGS) for k in (0, 1)],
                    ["_id", "hash", "n", "node", "sig", "keys"],
                )

    return texts.mapInArrow(build, f"_id {kind}, hash bigint, n bigint, node bigint, sig array<bigint>, keys array<bigint>")


# --- candidates -------------------------------------------------------------------


def _shared(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``lead`` (the least node), ``size`` for keys that several nodes have.

    One key is at most one in 40 of the rows, so the shuffle stays even.
    """
    member = nodes.select(F.explode("keys").alias("key"), "node").repartition("key")
    size = member.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return member.join(size, "key")


def _sizes_fit(x: str, y: str) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _leader_pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node that does not lead a bucket itself, the leader that looks most like it."""
    met = shared.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = met.join(x, "a").join(y, "b").filter(_sizes_fit("na", "nb")).select("a", "b", _apart_column("sa", "sb").alias("far"))
    return near.filter(F.col("far") <= MOST_APART).groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("best.a", "b")


def _compared(tiles: DataFrame, closest: int | None, most: int) -> DataFrame:
    """``a``, ``b``, ``far``: pairs within a tile that lie in different components and may be similar.

    A pair is put out in the first band only that it shares.  With ``closest``, a tile
    puts out the nearest few pairs of each node.
    """

    def few(a, b, far):
        ends, pair = np.concatenate((a, b)), np.tile(np.arange(len(a)), 2)
        by = np.lexsort((np.tile(far, 2), ends))
        run = ends[by]
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
        return np.unique(pair[by[place < closest]])

    def pairs(group, key, i, j, node, root, n, tile, sig, keys):
        """Of one tile; ``group`` is where its rows are."""
        left, right = (group, group) if i == j else (group[tile[group] == i], group[tile[group] == j])
        out = [], [], []
        for p in range(len(left)):
            x, ys = left[p], right[p + 1 :] if i == j else right
            ok = (root[ys] != root[x]) & (5 * np.minimum(n[ys], n[x]) >= 4 * np.maximum(n[ys], n[x]))
            ys = ys[ok]
            if not len(ys):
                continue
            far = apart(sig[ys], sig[x])
            ys, far = ys[far <= most], far[far <= most]
            if not len(ys):
                continue
            here = (keys[ys] == keys[x]).argmax(1)
            first = keys[ys, here] == key
            out[0].append(np.minimum(node[ys[first]], node[x]))
            out[1].append(np.maximum(node[ys[first]], node[x]))
            out[2].append(far[first])
        if not out[0]:
            return None
        a, b, far = (np.concatenate(o) for o in out)
        if closest and len(a):
            some = few(a, b, far)
            a, b, far = a[some], b[some], far[some]
        return a, b, far

    def whole(rows, last):
        """Pairs of all tiles but the last one, whose rows may not be complete."""
        key, i, j = (rows.column(k).to_numpy() for k in range(3))
        edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        stop = rows.num_rows if last else int(edge[-1])
        node, root, n, tile = (rows.column(k).to_numpy() for k in range(3, 7))
        sig, keys = (rows.column(k).flatten().to_numpy().reshape(rows.num_rows, -1) for k in (7, 8))
        found = []
        for a, b in zip(edge, np.append(edge[1:], rows.num_rows)):
            if a < stop and b - a > 1:
                got = pairs(np.arange(a, b), key[a], i[a], j[a], node, root, n, tile, sig, keys)
                if got is not None and len(got[0]):
                    found.append(got)
        return found, rows.slice(stop)

    def compare(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows < 2 * _TILE:
                continue
            found, held = whole(held, False)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["a", "b", "far"])
        if held is not None and held.num_rows:
            found, _ = whole(held, True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["a", "b", "far"])

    return tiles.mapInArrow(compare, "a bigint, b bigint, far bigint")


def _split_buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``node``, ``size``, ``root`` of the buckets that hold several components."""
    rooted = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return cut_lineage(rooted.join(split.select("key"), "key"))


def _cross_pairs(split: DataFrame, nodes: DataFrame, closest: int | None, most: int) -> DataFrame:
    """Pairs of nodes in different components that share a key and look similar.

    Members of a bucket are dealt to tiles of about a thousand by their node, and every two
    tiles meet in a group of their own, so no group grows with the bucket.
    """
    parts = F.ceil(F.col("size") / _TILE).cast("int")
    rows = split.withColumn("tile", F.pmod(F.xxhash64("node"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = rows.select("key", "node", "root", "tile", other.alias("o")).join(nodes.select("node", "n", "sig", "keys"), "node")
    tiles = rows.select("key", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "node", "root", "n", "tile", "sig", "keys")
    found = _compared(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), closest, most)
    if closest is None:
        return found.select("a", "b")
    ends = found.select("a", "b", "far", F.explode(F.array("a", "b")).alias("end"))
    best = Window.partitionBy("end").orderBy("far", "a", "b")
    return ends.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= closest).select("a", "b").distinct()


def _with_long(nodes: DataFrame, sets: DataFrame, split: DataFrame) -> DataFrame:
    """``nodes`` of ``split`` with long signatures."""

    def sign(batches):
        for batch in batches:
            lists = batch.column(1)
            room = np.cumsum(lists.value_lengths().to_numpy())
            a = 0
            while a < batch.num_rows:  # a bounded number of shingles at a time
                b = max(a + 1, int(np.searchsorted(room, (room[a - 1] if a else 0) + (_BLOCK >> 3), "right")))
                part = batch.slice(a, b - a)
                sets = [s.values.to_numpy().view(_U) for s in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(packed(minima(sets, LONG))), _LONGS)], ["node", "sig"])
                a = b

    wanted = split.select("node").distinct()
    long = sets.select("node", "shingles").join(wanted, "node", "left_semi").mapInArrow(sign, "node bigint, sig array<bigint>")
    return cut_lineage(nodes.drop("sig").join(long, "node"))


# --- confirmation -----------------------------------------------------------------


def _sets(texts: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of the nodes that have a bucket in common with another."""
    wanted = shared.select("node").distinct().join(nodes.select("node", "hash"), "node")
    some = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "hash", 24))

    def take(batches):
        done: set[int] = set()
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            new = [h not in done and not done.add(h) for h in hashes.tolist()]
            if len(done) > _COPIES:
                done.clear()
            rows = batch.filter(pa.array(maybe(some.value, hashes.view(np.uint64)) & np.array(new, bool)))
            for part in blocks(rows, "text", _BLOCK):
                sets = [s for s in shingle_sets(part.column(2), WIDTH) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], _LONGS)], ["node", "shingles"]
                )

    sets = texts.mapInArrow(take, "node bigint, shingles array<bigint>")
    return cut_lineage(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = 9 * both >= 4 * (F.size("of_a") + F.size("of_b"))
    return cut_lineage(pairs.join(y, "b").join(x, "a").filter(similar).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Two texts link when 100 times the size of their sets' intersection is at least 80
    times that of their union; ``component_id`` is the least id reachable by links, the
    row's own included, and ``kept`` says whether that is the row itself.  Texts without
    words, empty and null ones have an empty set, link with nothing and keep their own
    id.  A text of fewer than four words is one shingle.  Rows that repeat an id are each
    judged by their own text.  A null id gets the least id of its group, and null if
    there is none, which counts as kept.  Other columns are not read, and an empty
    table gives no rows.

    Every link is confirmed on full sets.  A pair at exactly 0.8 has no common bucket with
    a probability of 1.3e-7 and is dropped by its signatures with 2e-7; beyond 0.8
    both fall quickly.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    signed = cut_lineage(_signed(texts))
    nodes = cut_lineage(signed.filter("sig is not null").select("node", "n", "hash", "sig", "keys").dropDuplicates(["node"]))
    shared = cut_lineage(_shared(nodes))
    sets = _sets(texts, nodes, shared)
    tried = cut_lineage(_leader_pairs(shared, nodes))
    links = _confirmed(tried, sets)
    roots = components(links)
    for closest, most in ((_CLOSEST, MOST_APART), (None, MOST_APART_LONG)):
        split = _split_buckets(shared, roots)
        known = nodes if closest else _with_long(nodes, sets, split)
        pairs = cut_lineage(_cross_pairs(split, known, closest, most).join(tried, ["a", "b"], "left_anti"))
        tried, links = tried.union(pairs), links.union(_confirmed(pairs, sets))
        roots = components(links)
    rows = signed.select("_id", "n", "node").join(roots, "node", "left").select("_id", "n", F.coalesce("root", "node").alias("root"))
    least = rows.filter("root is not null").groupBy("root").agg(F.min("_id").alias("least"))
    own = F.coalesce("least", "_id")
    return rows.join(least, "root", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept")
    )
