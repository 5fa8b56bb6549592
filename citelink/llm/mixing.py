"""Mixing of sources to target weights: equal-token blocks dealt by Sainte-Laguë quotients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of name, null last, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often, so no source's target exceeds so many times its size.
MOST_REPEATS = 3
#: Words of a block, and documents of a shard; a shard is the unit of seeded selection.
BLOCK_WORDS = 32
SHARD_DOCS = 2048
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): the whole size shared out by weight under the caps.

    Words per unit of weight rise until all is shared; a source stops at ``repeats`` times its size. In
    order of cap over weight, the sources that stop are a prefix, found with running sums. The windows here
    see one row for each source, never documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("bigint"))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(repeats))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    run = capped.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    left = F.col("total") - F.col("caps_before")
    stops = left * F.col("weight") >= F.col("cap") * F.col("weight_left")
    open_ = run.withColumn("stops", stops)
    share = F.first(F.when(~F.col("stops"), F.struct(left.alias("words"), F.col("weight_left").alias("by"))), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return open_.withColumn("share", share).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("share.words") / F.col("share.by")).alias("target"),
    )


def sainte_lague(votes: DataFrame, group: list[str], party: list[str], vote: str, seats: str, most: str) -> DataFrame:
    """Adds ``won``: the seats of each party when ``seats`` of its group go one by one to the highest vote / (2 * won + 1).

    All quotients but the last few of each party are sure to win, so only about four per party are listed and
    ranked, however many seats there are. No party gets more than ``most`` seats; a group hands out what its
    parties can hold. Ties go to the party first in order.
    """
    whole = Window.partitionBy(*group)
    v, h, cap = F.col(vote).cast("double"), F.col(seats).cast("double"), F.col(most).cast("double")
    by_ratio = Window.partitionBy(*group).orderBy(F.try_divide(cap, v).asc_nulls_last(), *(F.col(p).asc_nulls_last() for p in party))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.when(v > 0, cap)).over(before), F.lit(0.0))
    open_votes = F.sum(v).over(whole) - F.coalesce(F.sum(v).over(before), F.lit(0.0))
    n = F.count("*").over(whole).cast("double")

    def per_vote(total: Column) -> Column:
        """Seats per vote at which all parties, each up to its cap, hold ``total``; null if they cannot."""
        own = F.when((v > 0) & ((total - full) * v <= cap * open_votes), F.try_divide(total - full, open_votes))
        return F.first(own, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    # rounding moves each party by half a seat at most, so the true divisor lies between those of n / 2 seats less and more
    listed = votes.withColumns({"_low": per_vote(h - n / 2), "_high": per_vote(h + n / 2)})
    sure = F.greatest(F.lit(0), F.least(F.col(most), F.floor(v * F.col("_low") - 0.5) - 1)).cast("bigint")
    upper = F.least(F.col(most), F.coalesce(F.ceil(v * F.col("_high") + 0.5) + 1, F.col(most))).cast("bigint")
    zero = F.lit(0).cast("bigint")
    listed = listed.withColumns({"_sure": F.when(v > 0, F.coalesce(sure, F.col(most))).otherwise(zero), "_upper": F.when(v > 0, upper).otherwise(zero)})
    listed = listed.withColumn("_rest", F.col(seats) - F.sum("_sure").over(whole))
    turns = F.when(F.col("_upper") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_upper") - 1)).otherwise(F.array().cast("array<bigint>"))
    offers = listed.where("_upper > _sure").withColumn("_turn", F.explode(turns)).withColumn("_quotient", v / (2 * F.col("_turn") + 1))
    by_offer = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *(F.col(p).asc_nulls_last() for p in party), "_turn")
    won = offers.withColumn("_place", F.row_number().over(by_offer)).where(F.col("_place") <= F.col("_rest"))
    keys = [*group, *party]
    extra = won.groupBy(*keys).agg(F.count("*").alias("_extra"))
    renamed = extra.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_extra")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return listed.join(renamed, same, "left").withColumn("won", F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_sure", "_rest", "_upper", "_low", "_high", "_extra", *(f"_k_{k}" for k in keys))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A source's documents are dealt over shards of about ``shard_docs`` by a seeded hash. The source's target, in
    blocks of ``block`` words, is apportioned to its shards by Sainte-Laguë; so is the whole mix to the
    sources. A shard's documents in seeded order are a stream of words; its quota is as many whole passes
    over the stream as fit and then blocks from the stream's start, so a block may end inside a document and
    no document is taken more than ``repeats`` times. Only ids and counts are shuffled, never texts. A null text
    has no words; a null source is a source of its own, last in order; a source without words has target 0. Rows
    that repeat a doc_id are documents of their own; those that also share size and source share one place in the
    stream and take the same.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, repeats)
    total = Window.partitionBy()
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(total) / block).cast("bigint")).withColumn("_most", F.ceil(F.col("source_size") * repeats / block).cast("bigint"))
    dealt = sainte_lague(seats, [], ["source"], "target", "_seats", "_most").withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("int"))
    dealt = stored(dealt.select(F.col("source").alias("_source"), "source_size", "target", F.col("won").alias("quota"), "shards"), "quotas")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = sizes.join(dealt, sizes["source"].eqNullSafe(dealt["_source"])).drop("_source").withColumn("_key", key)
    placed = placed.withColumn("_shard", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") % F.col("shards")).cast("int"))
    by_shard = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("quota").alias("_seats"))
    by_shard = by_shard.withColumn("_most", F.ceil(F.col("_shard_size") * repeats / block).cast("bigint"))
    quotas = sainte_lague(by_shard, ["source"], ["_shard"], "_shard_size", "_seats", "_most").select(
        F.col("source").alias("_q_source"), F.col("_shard").alias("_q_shard"), "_shard_size", F.least(F.col("won") * block, F.col("_shard_size") * repeats).alias("_words")
    )
    both = placed.join(quotas, F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("_shard") == F.col("_q_shard")))
    stream = Window.partitionBy("source", "_shard").orderBy("_key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(stream)
    passes, rest = F.expr("if(_shard_size > 0, _words div _shard_size, 0)"), F.expr("if(_shard_size > 0, _words % _shard_size, 0)")
    again = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    return both.withColumn("_end", end).select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + again).cast("bigint").alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Words taken from each document by a mix of all sources at weights 1, 2, 3, repeating."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), weighed AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, CAST(3 * sum(size) AS BIGINT) AS cap, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes GROUP BY source
), run AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
    FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
    SELECT *, words_left * weight >= cap * weight_left AS stops FROM run
), share AS (
    SELECT CAST(words_left AS BIGINT) AS words, CAST(weight_left AS BIGINT) AS parts FROM judged WHERE NOT stops ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
    SELECT source, source_size, n, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (SELECT words FROM share) AS DOUBLE) / (SELECT parts FROM share) END AS target FROM judged
), seats AS (
    SELECT *, CAST(round(sum(target) OVER () / {BLOCK_WORDS}) AS BIGINT) AS seats, CAST(ceil(source_size * 3 / {BLOCK_WORDS}) AS BIGINT) AS most FROM targets
), offers AS (
    SELECT source, seats, target / (2 * turn + 1) AS quotient, turn FROM (SELECT *, unnest(range(0, most)) AS turn FROM seats WHERE target > 0)
), dealt AS (
    SELECT s.source, s.source_size, s.target, coalesce(o.won, 0) AS quota, CAST(ceil(s.n / {SHARD_DOCS}) AS BIGINT) AS shards
    FROM seats s LEFT JOIN (SELECT source, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, turn) AS place FROM offers) WHERE place <= seats GROUP BY source) o ON s.source IS NOT DISTINCT FROM o.source
), placed AS (
    SELECT z.*, d.source_size, d.target, d.quota, CAST('0x' || substr(z.k, 1, 8) AS BIGINT) % d.shards AS shard FROM sizes z JOIN dealt d ON z.source IS NOT DISTINCT FROM d.source
), by_shard AS (
    SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(quota) AS seats, CAST(ceil(sum(size) * 3 / {BLOCK_WORDS}) AS BIGINT) AS most FROM placed GROUP BY source, shard
), shard_offers AS (
    SELECT source, shard, seats, shard_size / (2 * turn + 1) AS quotient, turn FROM (SELECT *, unnest(range(0, most)) AS turn FROM by_shard WHERE shard_size > 0)
), shard_won AS (
    SELECT source, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, turn) AS place FROM shard_offers) WHERE place <= seats GROUP BY source, shard
), quotas AS (
    SELECT b.source, b.shard, b.shard_size, least(coalesce(w.won, 0) * {BLOCK_WORDS}, b.shard_size * 3) AS words FROM by_shard b LEFT JOIN shard_won w ON b.source IS NOT DISTINCT FROM w.source AND b.shard = w.shard
), stream AS (
    SELECT p.*, q.shard_size, q.words, sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.k, p.doc_id, p.size) AS stop FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words % shard_size - (stop - size))) ELSE 0 END AS BIGINT) AS taken
FROM stream
"""
