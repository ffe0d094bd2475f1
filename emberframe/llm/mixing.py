"""Mixing sources to target weights, by iterative proportional fitting over DataFrames.

Documents fall into cells of source, language and topic. Cell weights are raked to the marginal targets in turn until tokens
times weight meet them, and each document is kept with its cell's calibrated probability by a hash of its id. Only aggregated
cells are iterated, each round from a table in the shared folder; sums are partial before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

#: Targets in proportion to a margin's tokens to this power: below 1 evens out large and small.
POWERS = {"source": 0.7, "lang": 0.85, "topic": 0.95}
ROUNDS = 8
SEED = "mix"
UNKNOWN = "unknown"
SPACE = " \t\n\u000b\f\r"


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A document's form as its topic: much of it digits, short lines, or prose."""
    text = F.coalesce(text, F.lit(""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(digits * 20 >= F.length(text), "numbers").when(breaks * 8 >= tokens, "lines").otherwise("prose")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row, as a table in the shared folder; null names are `unknown`."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in ("source", "lang")),
    ).withColumn("tokens", token_count(F.col("text")))
    return cut_lineage(named.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("tokens")).alias("topic"), "tokens"))


def default_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share): shares in proportion to tokens to a power."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("t").cast("double"), F.lit(power)).alias("size"))
    whole = sums.agg(F.sum("size")).first()[0] or 1.0
    return sums.select(margin, (F.col("size") / F.lit(whole)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (margins, t, w): weights such that the tokens t * w of each margin's values stand in its target shares.

    A value that a target leaves out gets weight 0. After the last round the last margin is met exactly, the others as nearly as
    the rounds allow.
    """
    total = cells.agg(F.sum("t")).first()[0] or 0
    names = [*targets, "t", "w"]
    cells = cells.withColumn("w", F.lit(1.0))
    for margin, target in targets.items():
        cells = cells.join(target.select(margin, F.col("share").alias(f"share_{margin}")), margin, "left")
    cells = cut_lineage(cells)
    columns = cells.columns
    for _ in range(rounds):
        for margin in targets:
            sums = cells.groupBy(margin).agg(F.sum(F.col("t") * F.col("w")).alias("held"))
            factor = F.when(F.col("held") > 0, F.coalesce(f"share_{margin}", F.lit(0.0)) * F.lit(float(total)) / F.col("held")).otherwise(0.0)
            cells = cells.join(sums, margin).withColumn("w", F.col("w") * factor).select(*columns)
        cells = cut_lineage(cells)
    return cells.select(*names)


def decide(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every row.

    Probabilities are the raked weights over the largest, so the expected tokens of those kept stand in the target shares and as
    many as possible stay. Documents without tokens (null, empty) have probability 0. A document is kept if a hash of seed and
    doc_id, evenly spread over [0, 1), is below its probability: the same in every run; rows of one doc_id share the draw. Null
    names of sources and languages count as `unknown`. An empty table gives no rows. Other columns are not looked at.
    """
    known = described(docs)
    cells = cut_lineage(known.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")))
    targets = targets or {m: default_targets(cells, m, power) for m, power in POWERS.items()}
    raked = rake(cells, targets, rounds)
    top = raked.agg(F.max("w")).first()[0] or 1.0
    chances = raked.select("source", "lang", "topic", (F.col("w") / F.lit(top)).alias("probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return known.join(chances, ["source", "lang", "topic"], "left").select(
        "doc_id", "source", "lang", "topic", "tokens", F.round(chance, 9).alias("probability"), (draw < chance).alias("kept")
    )


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents that the mix keeps; rows with null doc_id share one draw."""
    kept = decide(docs, targets).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def sql(rounds: int = ROUNDS) -> str:
    """The same for DuckDB, one nested query a step."""
    base = r"""
        select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, tokens,
            case when digits * 20 >= chars then 'numbers' when breaks * 8 >= tokens then 'lines' else 'prose' end as topic
        from (
            select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens, length(coalesce(text, '')) as chars,
                length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789', '')) as digits,
                length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) as breaks
            from documents
        )
    """
    cells = "select source, lang, topic, sum(tokens)::double as t, 1e0 as w from base where tokens > 0 group by all"
    shares = ", ".join(
        f"{m}_share as (select {m}, size / sum(size) over () as share from (select {m}, pow(sum(t), {power}) as size from cells group by {m}))"
        for m, power in POWERS.items()
    )
    step = "(select source, lang, topic, t, w, s1, s2, s3 from cells " + " ".join(f"join (select {m}, share as s{k} from {m}_share) using ({m})" for k, m in enumerate(POWERS, 1)) + ")"
    for _ in range(rounds):
        for k, margin in enumerate(POWERS, 1):
            step = f"(select * replace (w * s{k} * sum(t) over () / sum(t * w) over (partition by {margin}) as w) from {step})"
    return f"""
        with base as materialized ({base}), cells as materialized ({cells}), {shares},
        raked as (select source, lang, topic, w / max(w) over () as p from {step})
        select doc_id, source, lang, topic, tokens, round(case when tokens > 0 then coalesce(p, 0) else 0 end, 9) as probability,
            (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0) < (case when tokens > 0 then coalesce(p, 0) else 0 end) as kept
        from base left join raked using (source, lang, topic)
    """
