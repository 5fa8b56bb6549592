"""Merging of records of the same work from several sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelink.functions.normalize import normalize_doi, normalize_text, present
from citelink.sources.scratch import dropped, stored

_KINDS = {"title": "string", "authors": "array", "year": "number", "venue": "string", "doi": "string"}


def with_keys(works: DataFrame) -> DataFrame:
    """``works`` with ``norm_doi`` and ``norm_title``, computed once for each record."""
    return works.withColumns({"norm_doi": normalize_doi(F.col("doi")), "norm_title": normalize_text(F.col("title"))})


def group_key() -> Column:
    """A record's group: its DOI, else its title; null for a record with neither."""
    return F.when(F.col("norm_doi") != "", F.concat(F.lit("doi:"), "norm_doi")).when(F.col("norm_title") != "", F.concat(F.lit("title:"), "norm_title"))


def deduplicate_works(works: DataFrame, arrival: str = "arrival", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group of records: each field from the first arrival that has it, and the sorted ``sources``.

    Only first values and sets are aggregated, on the map side first, so a very common title does not gather its records
    anywhere. Records without DOI and title are left out. ``by`` keeps groups apart, such as those of different queries.
    """
    keyed = (works if {"norm_doi", "norm_title"} <= set(works.columns) else with_keys(works)).withColumn("work_key", group_key()).where("work_key is not null")
    first = [F.min_by(F.col(f), F.when(present(F.col(f), kind), F.col(arrival))).alias(f"_{f}") for f, kind in _KINDS.items()]
    merged = keyed.groupBy(*by, "work_key").agg(*first, F.min_by("source", arrival).alias("source"), F.min(arrival).alias(arrival), F.array_sort(F.collect_set("source")).alias("sources"))
    return with_keys(merged.select(*by, "work_key", *(F.col(f"_{f}").alias(f) for f in _KINDS), "source", "sources", arrival))


#: Parts of a works table that is kept between snapshots.
BUCKETS = 64
_STATE = ("work_key", *(f"first_{f}" for f in _KINDS), "first_source", "sources")


def work_states(records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """What is known of each work, in a form that can be merged: of every field its first value with its arrival, null where no record has it, and the set of sources."""
    keyed = with_keys(records).withColumn("work_key", group_key()).where("work_key is not null")
    first = [F.min(F.when(present(F.col(f), kind), F.struct(F.col(arrival).alias("arrival"), F.col(f).alias("value")))).alias(f"first_{f}") for f, kind in _KINDS.items()]
    return keyed.groupBy("work_key").agg(*first, F.min(F.struct(F.col(arrival).alias("arrival"), F.col("source").alias("value"))).alias("first_source"), F.array_sort(F.collect_set("source")).alias("sources"))


def merged_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The states of two disjoint sets of records as the states of all of them. The order of merging changes nothing."""
    both = one.select(*_STATE).unionByName(other.select(*_STATE))
    firsts = [F.min(c).alias(c) for c in _STATE if c.startswith("first_")]
    return both.groupBy("work_key").agg(*firsts, F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))


def works_of(states: DataFrame) -> DataFrame:
    """The works of these states, as ``deduplicate_works`` gives them."""
    fields = [F.col(f"first_{f}.value").alias(f) for f in _KINDS]
    return with_keys(states.select("work_key", *fields, F.col("first_source.value").alias("source"), "sources", F.col("first_source.arrival").alias("arrival")))


def update_works(records: DataFrame, path: str, arrival: str = "arrival", buckets: int = BUCKETS) -> DataFrame:
    """Merges records into the states kept at ``path`` (made if missing) and returns all works.

    States lie in buckets by work_key. Only buckets that the records touch are read and written again, from a table in the shared folder, so a lost task or
    executor never leaves a bucket half written; all others stay as they are. The same records again change nothing.
    """
    spark = records.sparkSession
    bucket = F.pmod(F.xxhash64("work_key"), F.lit(buckets)).cast("int")
    fresh = stored(work_states(records, arrival).withColumn("bucket", bucket), "states")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
    known = _kept_states(spark, path, fresh)
    now = merged_states(fresh, known.where(F.col("bucket").isin(touched))).withColumn("bucket", bucket) if touched else fresh
    ready = stored(now.repartition("bucket"), "merged")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    dropped(fresh, ready)
    return works_of(_kept_states(spark, path, ready))


def _kept_states(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The states at a path, none where nothing was written yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def sources_agreeing(sources: Column, source: Column) -> Column:
    """The distinct sources of a hit, sorted; its single source where the list is empty."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(sources, none)) > 0, F.array_sort(F.array_distinct(sources))).when(present(source, "string"), F.array(source)).otherwise(none)


def candidate_counts(pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "ref_no")) -> DataFrame:
    """Number of hits of each citation."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_candidates"))
