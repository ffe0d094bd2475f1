"""The numbered operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import attribution, counterfactual, hyperplane_tree, langid, masked_lm, mixing, packing, pivots, quality, repeats, reversed_search, simhash, trie_join
from emberframe.llm.common import table
from emberframe.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ids=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; n_near, for ids divisible by 50, from the permuted block tables over all of them."""
    prints = cut_lineage(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return simhash.count_near(prints, F.col("doc_id") % 50 == 0)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counterfactual.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_token_counts, op3_language_id, op4_packing, op5_substring_dedup, op6_lm_scoring, op7_simhash_dedup, op8_fingerprints,
        op9_topk_search, op10_quality, op11_toxicity, op12_lexical_search, op13_hard_negatives,
    )
}
SQL: dict[str, str] = {
    "op1_mixing": mixing.sql(),
    "op5_substring_dedup": r"""
        with texts as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ), places as materialized (
            select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from texts
        ), windows as (
            select doc_id, place as start, string_agg(word, ' ') over following as sequence, count(*) over following as n from places
            window following as (partition by doc_id order by place rows between current row and 19 following)
        ), ranked as (
            select doc_id, start, row_number() over (partition by sequence order by doc_id, start) as nth from windows where n = 20
        ), gone as (
            select distinct doc_id, unnest(generate_series(start, start + 19)) as place from ranked where nth > 1
        ), kept as (
            select p.doc_id, count(*) filter (g.place is not null) as n_removed,
                coalesce(string_agg(p.word, ' ' order by p.place) filter (g.place is null), '') as kept
            from places p left join gone g on p.doc_id = g.doc_id and p.place = g.place group by p.doc_id
        )
        select t.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from texts t left join kept k on t.doc_id = k.doc_id
    """,
    "op9_topk_search": """
        with usable as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
            where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from usable q join usable c on q.vec_id % 100 = 0 and c.r <> q.r and len(q.v) = len(c.v)
        ), ranked as (
            select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from scored
        )
        select * from ranked where rank <= 10
    """,
    "op12_lexical_search": reversed_search.SQL,
    "op13_hard_negatives": """
        with usable as (
            select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where embedding is not null and label is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.r, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score
            from usable a join usable c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.v) = len(c.v)
        ), positives as (
            select r, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, vec_id) as nth from scored where same
        ), negatives as (
            select p.*, n.vec_id as negative_id, n.score as negative_score, row_number() over (partition by p.r, nth order by n.score desc, n.vec_id) as rank
            from positives p join scored n on p.r = n.r and nth <= 5 and not n.same and 80 * positive_score <= 100 * n.score and n.score <= positive_score
        )
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 5
    """,
}
