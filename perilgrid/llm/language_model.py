"""Language-model scoring with an n-gram trie.

The model is a word pair model over all training texts,

    P(w | h) = s(h) * c(h, w) / c(h) + (1 - s(h)) * P(w),

where ``s`` grows with ``c(h)`` from ``rare_share`` to ``often_share``.  Pairs are
counted among the ``vocabulary`` most frequent words, and ``s`` is 0 after any other
word; with ``all_pairs``, among all words, and ``s`` is 0 only after words that the
training texts do not have.  P(w) is (1 - u) c(w)/N for known words and u for the one unknown word,
where u is the share of training tokens that occur once.

Texts are cut into batches.  A batch sends each shard the sorted words or pairs it
holds (Elias-Fano coded) and the documents they occur in.  A shard adds up the
training counts of its words and pairs, builds its part of the trie, looks the
batches' pairs up in it, and returns a sum per document.  Shards grow in number
with the corpus and hold hashed parts of it, so no word or pair makes one large.
Only the vocabulary, whose size is fixed, is sent to all tasks.

With ``all_pairs``, a pair with one word outside the vocabulary goes to the shard of
that word, which has the word's count.  A pair of two such words goes to the shard of
the first; what it found there is joined with the count of the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.llm.elias_fano import EliasFano, PairTrie, encode
from perilgrid.llm.words import blocks, mix, word_hashes
from perilgrid.session import cut_lineage, release

_U = np.uint64
_END = mix(np.array([0xE0D0], np.uint64))[0]
_NONE = 65535
_STEP = 1 / 4096
_ABOVE = 3.0
_SUMS = ["batch", "doc", "base", "n_known", "lm"]
_BATCH = 4 << 20
#: Texts to a batch at most, so that their places take two bytes.
_DOCS = 65_535
_SHARD_TOKENS = 3_000_000
_LEAST_SHARDS = 16
#: Kinds of pairs with words outside the vocabulary.
_RARE_SECOND, _RARE_FIRST, _RARE_BOTH = 3, 4, 5


def _tokens(texts: pa.Array):
    """Word hashes with an end after each text, and the tokens per text."""
    words, before = word_hashes(texts)
    return np.insert(words, before[1:], _END), np.diff(before) + 1


class _Stats:
    """Totals of the training tokens and the counts of the most frequent ones."""

    def __init__(self, n: int, v: int, once: int, words: np.ndarray, counts: np.ndarray, rare_share: float, often_share: float, often: float):
        self.n, self.v = n, v
        self.unknown = min(max(once, 1), max(n // 2, 1)) / (n + 1)
        self.words, self.counts = words, counts.astype(float)
        self.weights = rare_share, often_share, often
        self.share = self.share_of(self.counts)

    def share_of(self, c: np.ndarray) -> np.ndarray:
        rare_share, often_share, often = self.weights
        return rare_share + (often_share - rare_share) * c / (c + often)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def single(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.log10((1 - self.unknown) * np.maximum(c, 1) / max(self.n, 1)), np.log10(self.unknown))


def _train_flag(id_col: str, folds: int, held: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n``: training occurrences of each word; and a null word with the number of all tokens."""

    def count(batches):
        for batch in batches:
            for part in blocks(batch, "text", _BATCH):
                tokens, sizes = _tokens(part.column(2))
                train = ~part.column(1).to_numpy(zero_copy_only=False)
                word, n = np.unique(tokens[np.repeat(train, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *word.view(np.int64).tolist()], pa.int64()), pa.array(np.append(len(tokens), n))], ["word", "n"]
                )

    return texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _learn(texts: DataFrame, vocabulary: int, **shares) -> tuple[_Stats, int, DataFrame]:
    counts = cut_lineage(_word_counts(texts))
    known = counts.filter("word is not null")
    total = known.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    # the least count at which the vocabulary has room, to a fraction of a bit, so that no ranking of all words is needed
    level = F.floor(F.log2("n") * 16)
    levels = sorted((r.level, r["count"]) for r in known.groupBy(level.alias("level")).count().collect())
    room, least = vocabulary, None
    for at, size in reversed(levels):
        if size > room:
            break
        room, least = room - size, at
    kept = known.filter(level >= (least if least is not None else 1 << 20)).toArrow()
    words = kept["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    stats = _Stats(total.n or 0, total.v, total.once, words[order], kept["n"].to_numpy()[order], **shares)
    return stats, int(tokens), known


def _rows(batch: int, kind: int, shard: np.ndarray, key: np.ndarray, docs: np.ndarray, train: bytes, other: np.ndarray | None = None):
    """Splits sorted keys, of one or two parts (with the document of each occurrence), by shard."""
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        new = key[a + 1 : b] != key[a : b - 1]
        if other is not None:
            new |= other[a + 1 : b] != other[a : b - 1]
        first = np.flatnonzero(np.concatenate(([True], new)))
        starts = encode(first.astype(np.uint64))
        second = None if other is None else other[a:b][first].tobytes()
        yield batch, kind, int(shard[a]), encode(key[a:b][first]), second, starts, docs[a:b].tobytes(), train


def _spread(texts: DataFrame, stats: _Stats, shards: int, all_pairs: bool) -> DataFrame:
    """One row per text with what the vocabulary alone decides, and rows of words and pairs for the shards."""
    shared = texts.sparkSession.sparkContext.broadcast(stats)
    kind = texts.schema["_id"].dataType.simpleString()
    names = ["batch", "kind", "shard", "keys", "other", "starts", "docs", "train", "doc", "_id", "held", "n_tokens", "n_known", "base", "lm"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def spread(batches):
        s, serial = shared.value, TaskContext.get().partitionId() << 32
        for big in batches:
            for part in (p.slice(a, _DOCS) for p in blocks(big, "text", _BATCH) for a in range(0, p.num_rows, _DOCS)):
                serial += 1
                tokens, sizes = _tokens(part.column(2))
                n = part.num_rows
                doc = np.repeat(np.arange(n), sizes)
                at = np.minimum(np.searchsorted(s.words, tokens), max(len(s.words) - 1, 0))
                known = (s.words[at] == tokens) if len(s.words) else np.zeros(len(tokens), bool)
                wid = np.where(known, at, _NONE)
                prev = np.concatenate(([_NONE], wid[:-1]))
                start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                end = np.searchsorted(s.words, _END)
                prev[start] = end if end < len(s.words) and s.words[end] == _END else _NONE
                c = s.counts[at[known]] if known.any() else np.zeros(0)
                fill = lambda where, x: np.bincount(doc[where], x, n).astype(float)
                after = prev != _NONE
                lm = fill(known, s.single(c)) + (fill(after, np.log10(1 - s.share[prev[after]])) if after.any() else 0)
                kinds = [part.column(0), part.column(1), pa.array(sizes), pa.array(np.bincount(doc[known], minlength=n)), pa.array(fill(known, s.base(c))), pa.array(lm)]
                blank = [pa.nulls(n, t) for t in types[2:8]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, serial)), pa.array(np.zeros(n, np.int32)), *blank, pa.array(np.arange(n, dtype=np.int32)), *kinds], names)
                train = np.packbits(~part.column(1).to_numpy(zero_copy_only=False)).tobytes()
                rare, rare_doc = tokens[~known], doc[~known]
                order = np.argsort(rare, kind="stable")
                key = rare[order]
                rows = list(_rows(serial, 1, ((key >> _U(32)) * _U(shards)) >> _U(32), key, rare_doc[order].astype(np.uint16), train))
                both = after & known
                pair = (prev[both].astype(np.uint64) << _U(16)) | wid[both].astype(np.uint64)
                shard = ((mix(pair) >> _U(32)) * _U(shards)) >> _U(32)
                order = np.argsort((shard << _U(32)) | pair, kind="stable")
                rows += _rows(serial, 2, shard[order], pair[order], doc[both][order].astype(np.uint16), train)
                if all_pairs:
                    before = np.concatenate((tokens[:1], tokens[:-1]))
                    before[start] = _END
                    for kind, where, key, other in (
                        (_RARE_SECOND, after & ~known, tokens, prev.astype(np.uint16)),
                        (_RARE_FIRST, ~after & known, before, wid.astype(np.uint16)),
                        (_RARE_BOTH, ~after & ~known, before, tokens),
                    ):
                        order = np.flatnonzero(where)
                        order = order[np.lexsort((other[order], key[order]))]
                        shard = ((key[order] >> _U(32)) * _U(shards)) >> _U(32)
                        rows += _rows(serial, kind, shard, key[order], doc[order].astype(np.uint16), train, other[order])
                if rows:
                    m = len(rows)
                    cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(m, t or part.column(0).type) for t in types[8:]]], names)

    schema = (
        "batch bigint, kind int, shard int, keys binary, other binary, starts binary, docs binary, train binary, "
        f"doc int, _id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, lm double"
    )
    return texts.mapInArrow(spread, schema)


class _Part:
    """What one batch sent to a shard."""

    def __init__(self, row: dict):
        self.batch = row["batch"]
        keys = EliasFano(row["keys"])
        self.keys = keys.values(0, keys.n) if keys.n <= 1 << 15 else np.concatenate([keys.values(a, a + (1 << 15)) for a in range(0, keys.n, 1 << 15)])
        if row["other"] is not None:
            self.other = np.frombuffer(row["other"], np.uint64 if row["kind"] == _RARE_BOTH else np.uint16)
        self.docs = np.frombuffer(row["docs"], np.uint16)
        first = EliasFano(row["starts"])
        self.starts = np.concatenate([first.values(a, a + (1 << 15)) for a in range(0, first.n, 1 << 15)]).astype(np.int64)
        flags = np.unpackbits(np.frombuffer(row["train"], np.uint8))[self.docs]
        self.counts = np.add.reduceat(flags, self.starts, dtype=np.int64)
        self.times = np.diff(np.append(self.starts, len(self.docs)))


def _totals(parts: list[_Part]):
    """Sorted distinct keys of the training texts and their counts."""
    keys = np.concatenate([p.keys for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p.counts for p in parts]) if parts else np.zeros(0, np.int64)
    key, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, counts, len(key)).astype(np.int64)
    return key[total > 0], total[total > 0]


def _number(parts: list[_Part], seconds: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Replaces keys of two parts by one number; gives the distinct first parts and the numbers for each.

    Second parts are vocabulary ids, or places in ``seconds``.
    """
    firsts = np.unique(np.concatenate([p.keys for p in parts])) if parts else np.zeros(0, np.uint64)
    span = 1 << 16 if seconds is None else len(seconds) + 1
    for p in parts:
        second = p.other if seconds is None else np.searchsorted(seconds, p.other)
        p.keys = np.searchsorted(firsts, p.keys).astype(np.uint64) * _U(span) + second.astype(np.uint64)
    return firsts, span


def _score_shard(stats: _Stats, all_pairs: bool, table: pa.Table):
    out, wanting = {}, []

    def parts_of(kind: int) -> list[_Part]:
        rows = table.filter(pc.equal(table["kind"], kind)).select(["batch", "kind", "keys", "other", "starts", "docs", "train"])
        return [_Part(row) for batch in rows.to_batches(max_chunksize=1) for row in batch.to_pylist()]

    def add(part: _Part, base, known, lm):
        seen, place = np.unique(part.docs, return_inverse=True)
        per = lambda x: np.bincount(place, np.repeat(x, part.times), len(seen))
        out.setdefault(part.batch, []).append((seen, per(base), per(known), per(lm)))

    parts = parts_of(1)
    key, total = _totals(parts)

    def count(words):
        at = np.minimum(np.searchsorted(key, words), max(len(key) - 1, 0))
        return np.where(key[at] == words, total[at], 0) if len(key) else np.zeros(len(words), np.int64)

    for p in parts:
        c = count(p.keys)
        # a word is followed by another, or an end, as often as it occurs
        rest = np.where(c > 0, np.log10(1 - stats.share_of(c)), 0.0) if all_pairs else 0.0
        add(p, stats.base(c), c > 0, stats.single(c) + rest)

    def look(parts, span, value):
        """Each part with what a trie of the training pairs says of the part's pairs; all parts are looked up in one go."""
        if not parts:
            return
        keys, where = np.unique(np.concatenate([p.keys for p in parts]), return_inverse=True)
        times = np.bincount(where, np.concatenate([p.counts for p in parts]), len(keys)).astype(np.int64)
        found, times = keys[times > 0], times[times > 0]
        first, second = (found // _U(span)).astype(np.int64), (found % _U(span)).astype(np.int64)
        trie = PairTrie(first, second, value(first, second, times), span, _STEP)
        values, at = trie.lookup(keys // _U(span), keys % _U(span))[where], 0
        for p in parts:
            yield p, values[at : at + len(p.keys)]
            at += len(p.keys)

    def gains(parts, span, value):
        for p, gain in look(parts, span, value):
            zero = np.zeros(len(p.keys))
            add(p, zero, zero, gain)

    def gain(h_count, h_share, w_count):
        return lambda h, w, n: np.log10(1 + h_share(h) * n / h_count(h) / ((1 - h_share(h)) * 10 ** stats.single(w_count(w))))

    # one kind is in memory at a time
    often, share = stats.counts.__getitem__, stats.share.__getitem__
    parts = parts_of(2)
    gains(parts, 1 << 16, gain(often, share, often))
    if parts := parts_of(_RARE_SECOND):
        firsts, span = _number(parts, None)
        c = count(firsts)
        swapped = gain(often, share, c.__getitem__)
        gains(parts, span, lambda w, h, n: swapped(h, w, n))
    if parts := parts_of(_RARE_FIRST):
        firsts, span = _number(parts, None)
        d = count(firsts)
        gains(parts, span, gain(d.__getitem__, lambda h: stats.share_of(d[h]), often))
    if parts := parts_of(_RARE_BOTH):
        seconds = np.unique(np.concatenate([p.other for p in parts]))
        firsts, span = _number(parts, seconds)
        e = count(firsts)
        # above 0 for each pair that is there: the share is at most all, and a count at most its word's
        odds = lambda h, w, n: _ABOVE - np.log10(stats.share_of(e[h]) / (1 - stats.share_of(e[h])) * n / e[h])
        for p, value in look(parts, span, odds):
            there = np.repeat(value > 0, p.times)
            near = 10 ** (_ABOVE - np.repeat(value, p.times)[there])
            wanting.append((np.full(len(near), p.batch), p.docs[there], np.repeat(p.other, p.times)[there].view(np.int64), near))
    cols = [[] for _ in range(5)]
    for batch, parts in out.items():
        docs, *sums = (np.concatenate(x) for x in zip(*parts))
        seen, place = np.unique(docs, return_inverse=True)
        for col, x in zip(cols, [np.full(len(seen), batch), seen, *[np.bincount(place, x, len(seen)) for x in sums]]):
            col.append(x)
    join = lambda xs, t: np.concatenate([np.zeros(0, t), *xs]).astype(t)
    own = pa.table({c: join(x, t) for c, x, t in zip(_SUMS, cols, (np.int64, np.int32, float, np.int64, float))})
    own = own.append_column("word", pa.nulls(len(own), pa.int64())).append_column("near", pa.nulls(len(own), pa.float64()))
    if not wanting:
        return own
    batch, docs, word, near = (np.concatenate(x) for x in zip(*wanting))
    none = np.zeros(len(near))
    more = [batch.astype(np.int64), docs.astype(np.int32), none, none.astype(np.int64), none, word, near]
    return pa.concat_tables([own, pa.table(dict(zip(own.column_names, more)))])


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held: int = 1,
    vocabulary: int = 65_000,
    rare_share: float = 0.1,
    often_share: float = 0.6,
    often: float = 5_000.0,
    all_pairs: bool = False,
) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row.

    The model learns from rows whose crc32 of the id as text, modulo ``folds``, is
    not ``held``; a row with a null id is learnt from.  Tokens are the lower-cased
    words (A-Z) and one end; null and empty texts are one end.  The first word
    follows an end.  ``vocabulary`` has to be below 65,535; with ``all_pairs`` it only
    says which counts all tasks get, and does not change a score.  Repeated rows are
    counted and scored each.  An empty table gives no rows.  Other columns are
    not read.
    """
    if not 0 < vocabulary < _NONE:
        raise ValueError("the vocabulary has to be below 65,535")
    texts = docs.select(F.col(id_col).alias("_id"), _train_flag(id_col, folds, held).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stats, tokens, counts = _learn(texts, vocabulary, rare_share=rare_share, often_share=often_share, often=often)
    sent = cut_lineage(_spread(texts, stats, max(_LEAST_SHARDS, -(-tokens // _SHARD_TOKENS)), all_pairs), "zstd")
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    sums = (
        sent.filter("kind > 0")
        .groupBy("shard")
        .applyInArrow(lambda table: _score_shard(shared.value, all_pairs, table), "batch bigint, doc int, base double, n_known bigint, lm double, word bigint, near double")
    )
    sums = cut_lineage(sums, "zstd")
    own = cut_lineage(sent.filter("kind = 0"))
    release(sent)
    if all_pairs:
        single = F.col("n") * ((1 - stats.unknown) / max(stats.n, 1))
        rare = sums.filter("word is not null").join(counts, "word").withColumn("lm", F.log10(1 + F.col("near") / single))
        sums = sums.filter("word is null").select(*_SUMS).union(rare.select(*_SUMS))
    zero = F.lit(None)
    extra = sums.select("batch", "doc", zero.cast(texts.schema["_id"].dataType).alias("_id"), zero.cast("boolean").alias("held"), F.lit(0).cast("bigint").alias("n_tokens"), "n_known", "base", "lm")
    return (
        own.select(*extra.columns)
        .union(extra)
        .groupBy("batch", "doc")
        .agg(*[F.max(c).alias(c) for c in ("_id", "held")], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lm")])
        .select(
            F.col("_id").alias(id_col),
            F.col("held").alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(stats.n).cast("bigint").alias("train_tokens"),
            F.col("base").alias("base_score"),
            F.col("lm").alias("score"),
        )
    )
