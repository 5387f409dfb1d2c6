"""The registered corpus queries and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
CHECKS: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from perilgrid.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_url_filter(spark, sf_dir):
    from perilgrid.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


@_query
def op10_secret_scan(spark, sf_dir):
    from perilgrid.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    kinds = [
        ("assign", """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    ]
    ctes, unions = ["t as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents)"], []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        ctes.append(
            f"""{kind}_m as (select rid, unnest(range(1, len(m) + 1)) as i, m, v, p from (select rid,
            regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as v,
            string_split_regex(text, '{pattern}') as p from t where regexp_matches(text, '{pattern}')))"""
        )
        ctes.append(
            f"""{kind}_s as (select rid, {rank} as k, '{kind}' as kind, length(v[i]) as tested,
            sum(length(p[i]) + length(m[i])) over (partition by rid order by i) as stop, length(m[i]) as n from {kind}_m)"""
        )
        unions.append(f"select rid, k, kind, stop - n as start, stop from {kind}_s where tested >= {least}")
    return f"""with {", ".join(ctes)}, s as ({" union all ".join(unions)}),
    g as (select rid, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, k) as spans,
      count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
      count(*) filter (kind = 'hex') as n_hex from s group by rid)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (rid)"""


CHECKS["op10_secret_scan"] = _secret_sql()


@_query
def op5_line_dedup(spark, sf_dir):
    from perilgrid.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@_query
def op6_toxicity(spark, sf_dir):
    from perilgrid.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@_query
def op7_decontamination(spark, sf_dir):
    from perilgrid.llm.decontaminate import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from perilgrid.llm.pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op1_ngram_jaccard(spark, sf_dir):
    from perilgrid.llm.parity_join import similar_texts

    return similar_texts(_table(spark, sf_dir, "documents")).drop("text_hash")


@_query
def op9_language_model(spark, sf_dir):
    from perilgrid.llm.language_model import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), all_pairs=True)


@_query
def op8_fingerprints(spark, sf_dir):
    from perilgrid.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"), by_content=True)


@_query
def op11_bbit_minhash(spark, sf_dir):
    from perilgrid.llm.bbit_minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op12_collocations(spark, sf_dir):
    from perilgrid.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


@_query
def op13_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from perilgrid.llm.negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("embedding"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


_SHINGLES = """(select {key}, list_distinct(case when len(w) >= {width} then list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from (select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') as w from {table}))"""


def _link_sql(width: int, percent: int, more: str = "") -> str:
    return f"""with recursive sets as (select doc_id, len(s) as n, s from {_SHINGLES.format(key="doc_id", table="documents", width=width)}),
    each as (select doc_id, n, unnest(s) as x from sets),
    links as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reach as (select doc_id as id, doc_id as r from sets union select reach.id, links.b from reach join links on reach.r = links.a)
    select doc_id, any_value(n) as n_shingles, min(r) as component_id{more} from sets join reach on id = doc_id group by doc_id"""


CHECKS["op1_ngram_jaccard"] = _link_sql(5, 75)
CHECKS["op11_bbit_minhash"] = _link_sql(4, 80, ", doc_id = min(r) as kept")

CHECKS["op7_decontamination"] = f"""with items as (select item_id, len(s) as n, unnest(s) as x from {_SHINGLES.format(key="item_id", table="benchmark", width=5)}),
    docs as (select doc_id, unnest(s) as x from {_SHINGLES.format(key="doc_id", table="documents", width=5)})
    select doc_id, item_id, n::int as n_item, count(*)::int as n_shared, count(*) / n::double as containment
    from items join docs using (x) group by doc_id, item_id, n having 4 * count(*) >= 3 * n"""

CHECKS["op13_hard_negatives"] = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
      list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
      where label is not null and embedding is not null and list_count(embedding) = len(embedding)
        and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
    s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
    w as (select p.a, p.b, p.score as ps, s.b as n, s.score as ns from p join s on p.a = s.a and not s.same
      and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
    select a as anchor_id, b as positive_id, (row_number() over (partition by a, b order by ns desc, n))::int as rank,
      n as negative_id, ps as positive_score, ns as negative_score from w
    qualify row_number() over (partition by a, b order by ns desc, n) <= 5"""

CHECKS["op12_collocations"] = r"""with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
    total as (select lang, sum(len(w))::bigint as n from pieces group by lang),
    starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
    f as (select lang, w[i:i + k - 1] as p, count(*) as f from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w) group by all having count(*) >= 100),
    c as (select lang, p, f as a from f where len(p) > 1),
    inner_parts as (select lang, a, p[i:j] as p from (select *, unnest(range(1, len(p) + 1)) as i from c), (select unnest(range(1, 6)) as j)
      where j > i and j <= len(p) and j - i + 1 < len(p)),
    kept as (select c.* from c left join (select lang, p, max(a) as most from inner_parts group by all) x using (lang, p) where 100 * coalesce(most, 0) < 100 * a),
    cuts as (select lang, p, a, unnest(range(1, len(p))) as k from kept),
    scored as (select cuts.lang, cuts.p, a, x.f as l, y.f as r, n, k, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score from cuts
      join total on cuts.lang = total.lang join f x on x.lang = cuts.lang and x.p = cuts.p[:k] join f y on y.lang = cuts.lang and y.p = cuts.p[k + 1:]
      qualify row_number() over (partition by cuts.lang, cuts.p order by score, k) = 1),
    named as (select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score from scored)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from named
    qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""
