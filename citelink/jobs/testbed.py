"""Records and citations derived from the documents table, so that every job runs on data that grows with it.

Each function has its SQL counterpart in ``SQL``: the same formulas as common table expressions. Every record has a citation, and its
title is the whole first sentence of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SURNAMES = ("Abor", "Belin", "Corvo", "Dasel", "Emric", "Fano", "Gildo", "Harun", "Istel", "Jorva", "Kemp", "Lovan", "Mirel", "Nadov", "Orsan", "Pelik", "Quist", "Rando", "Selva", "Tovar")
SOURCES = ("Crossref", "OpenAlex", "DBLP", "Semantic Scholar", "PubMed")


def _author(doc: Column, m: int) -> Column:
    surname = F.element_at(F.array(*map(F.lit, SURNAMES)), ((doc * m) % len(SURNAMES) + 1).cast("int"))
    return F.concat(F.char(65 + (doc * m) % 26), F.lit(". "), surname)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each document whose first sentence makes a title of 12 characters or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    title = F.trim(F.regexp_extract("text", r"^[^.\n]*", 0))
    doc = F.col("doc_id")
    return docs.withColumn("title", title).where(F.length("title") >= 12).select(
        doc.alias("work_id"),
        "title",
        F.array(*(_author(doc, m) for m in (1, 3, 7))).alias("authors"),
        (1990 + doc % 34).cast("int").alias("year"),
        F.when(doc % 3 != 0, F.concat(F.lit("10.5555/d"), doc.cast("string"))).alias("doi"),
        F.concat(F.lit("Journal of "), F.col("source")).alias("venue"),
    )


def works_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as several sources have them, with fields missing here and there."""
    i = F.col("i")
    rows = base(spark, sf_dir).withColumn("i", F.explode(F.array(*map(F.lit, range(len(SOURCES)))))).where((F.col("work_id") + i) % 3 != 0)
    return rows.select(
        "work_id",
        "title",
        "authors",
        "doi",
        F.when((F.col("work_id") + i) % 7 != 1, F.col("year")).alias("year"),
        F.when((F.col("work_id") + i) % 5 != 1, F.col("venue")).alias("venue"),
        F.element_at(F.array(*map(F.lit, SOURCES)), i + 1).alias("source"),
        (F.col("work_id") * 10 + i).alias("arrival"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as parsed citations, ten in a document, each changed in one of eight ways."""
    doc, p = F.col("work_id"), F.col("work_id") % 8
    rows = base(spark, sf_dir).withColumn("p", p)
    return rows.select(
        F.expr("work_id div 10").alias("doc_id"),
        F.expr("int(work_id % 10) + 1").alias("ref_no"),
        "work_id",
        F.lit("citation").alias("original_reference"),
        F.when(p == 4, F.array_join(F.slice(F.split("title", " "), 1, 3), " ")).when(p == 7, F.regexp_replace("title", "^([^ ]*) ", "$1")).otherwise(F.col("title")).alias("title"),
        F.when(p == 5, F.array(*(_author(doc + 1, m) for m in (1, 3, 7)))).otherwise(F.col("authors")).alias("authors"),
        (F.col("year") + F.when(p == 2, 1).when(p == 3, 5).otherwise(0)).cast("int").alias("year"),
        "venue",
        F.when(p.isin(1, 7), None).when(p == 6, F.concat(F.lit("10.5555/x"), doc.cast("string"))).otherwise(F.col("doi")).alias("doi"),
    )


def plain_title(c: Column) -> Column:
    """A title of letters and single blanks, which every citation style can carry."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z ]", ""), " +", " "))


def citations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations written as text in four styles and one that no style fits, with the fields they were made of."""
    rows = base(spark, sf_dir).withColumn("t", F.concat(plain_title(F.col("title")), F.lit(" study"))).where("length(t) >= 18")
    rows = rows.withColumn("q", F.when((F.col("work_id") % 5 == 0) & (F.length("t") > 290), 1).otherwise(F.col("work_id") % 5))  # quotes hold 300 characters at most
    year = F.col("year").cast("string")
    last = F.transform("authors", lambda a: F.concat(F.substring(a, 4, 20), F.lit(", "), F.substring(a, 1, 2)))
    bare = F.transform("authors", lambda a: F.concat(F.substring(a, 4, 20), F.lit(" "), F.substring(a, 1, 1)))
    doi = F.coalesce(F.concat(F.lit(", doi: "), "doi"), F.lit(""))
    text = (
        F.when(F.col("q") == 0, F.concat(F.array_join("authors", ", "), F.lit(", “"), "t", F.lit(",” "), "venue", F.lit(", "), year, doi))
        .when(F.col("q") == 1, F.concat(F.array_join(last, ", "), F.lit(" ("), year, F.lit("). "), "t", F.lit(". "), "venue", doi))
        .when(F.col("q") == 2, F.concat(F.array_join(bare, ", "), F.lit(". "), "t", F.lit(". "), "venue", F.lit(". "), year, F.lit(";15(2):100-110"), doi))
        .when(F.col("q") == 3, F.concat(F.array_join("authors", ", "), F.lit(", "), "t", F.lit(", "), "venue", F.lit(", "), year, doi))
        .otherwise(F.concat(F.lower("t"), F.lit(" "), year))
    )
    return rows.select(F.expr("work_id div 10").alias("doc_id"), F.expr("int(work_id % 10) + 1").alias("ref_no"), "work_id", "q", "t", "authors", "year", "venue", "doi", text.alias("original_reference"))


def documents_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id, style, text): the document's own text, a reference section in one of three numbering styles, and an appendix."""
    cites = citations_text(spark, sf_dir).where("length(original_reference) > 25")
    lines = cites.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_no", "original_reference"))).alias("c")).where("size(c) >= 2").withColumn("style", F.col("doc_id") % 3)
    mark = F.when(F.col("style") == 0, F.concat(F.lit("["), F.lit("%d"), F.lit("] "))).when(F.col("style") == 1, F.lit("%d. ")).otherwise(F.lit("%d) "))
    numbered = F.transform("c", lambda x, i: F.concat(F.replace(mark, F.lit("%d"), (i + 1).cast("string")), x["original_reference"]))
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    lines = lines.join(own, "doc_id", "left")
    text = F.concat(F.coalesce("body", F.lit("")), F.lit("\nReferences to earlier work are below.\nReferences\n"), F.array_join(numbered, "\n"), F.lit("\nAppendix\nmore text that is not a citation"))
    return lines.select("doc_id", "style", text.alias("text"))


def verdicts(results: DataFrame) -> DataFrame:
    """Review answers to unresolved citations: approvals with a good, a bad and no choice, refusals, doubts, and none at all."""
    k = (F.col("doc_id") * 10 + F.col("ref_no")) % 6
    rows = results.where("status = 'PENDING_AI'").withColumn("k", k).where("k <> 4")
    status = F.when(F.col("k") == 2, "NOT VERIFIED").when(F.col("k") == 3, "UNCERTAIN").otherwise("VERIFIED")
    index = F.when(F.col("k") == 0, 1).when(F.col("k") == 1, 9).when(F.col("k") == 3, 2)
    return rows.select("doc_id", "ref_no", status.alias("status"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("metadata_conflicts"), F.lit("reviewed").alias("explanation"), index.cast("int").alias("selected_candidate_index"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of outside services, from the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tokens = F.floor(F.abs("value")).cast("bigint")
    return events.select(
        F.col("event_type").alias("chain"), F.concat(F.lit("provider"), (F.col("user_id") % 2).cast("string")).alias("provider"), tokens.alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(tokens + F.col("event_id") % 100).alias("total_tokens"),
    )


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as blocks of two-column pages, with their place in the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n = F.col("n")
    x0 = F.when(F.expr("n div 2") % 2 == 0, 10.0).otherwise(310.0)
    return docs.select("doc_id", F.expr("int(n div 4)").alias("page_no"), F.lit(600.0).alias("page_width"), n.alias("block_no"), x0.alias("x0"), (n % 2 * 20.0 + 5).alias("y0"), "text")


_NAMES = "[" + ", ".join(f"'{s}'" for s in SURNAMES) + "]"


def _sql_authors(doc: str) -> str:
    return "[" + ", ".join(f"chr(CAST(65 + ({doc}) * {m} % 26 AS INTEGER)) || '. ' || {_NAMES}[({doc}) * {m} % 20 + 1]" for m in (1, 3, 7)) + "]"


#: Common table expressions: base, works_raw, citations, citations_text.
SQL = f"""
base AS (
    SELECT doc_id AS work_id, title, {_sql_authors("doc_id")} AS authors, CAST(1990 + doc_id % 34 AS INTEGER) AS year,
           CASE WHEN doc_id % 3 <> 0 THEN '10.5555/d' || doc_id END AS doi, 'Journal of ' || source AS venue
    FROM (SELECT *, trim(regexp_extract(text, '^[^.\\n]*', 0)) AS title FROM documents) WHERE length(title) >= 12
), works_raw AS (
    SELECT work_id, title, authors, doi, CASE WHEN (work_id + i) % 7 <> 1 THEN year END AS year, CASE WHEN (work_id + i) % 5 <> 1 THEN venue END AS venue,
           ['Crossref', 'OpenAlex', 'DBLP', 'Semantic Scholar', 'PubMed'][i + 1] AS source, work_id * 10 + i AS arrival
    FROM base CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE (work_id + i) % 3 <> 0
), citations AS (
    SELECT work_id // 10 AS doc_id, CAST(work_id % 10 + 1 AS INTEGER) AS ref_no, work_id,
           CASE WHEN p = 4 THEN array_to_string(string_split(title, ' ')[1:3], ' ') WHEN p = 7 THEN regexp_replace(title, '^([^ ]*) ', '\\1') ELSE title END AS title,
           CASE WHEN p = 5 THEN {_sql_authors("work_id + 1")} ELSE authors END AS authors,
           CAST(year + CASE p WHEN 2 THEN 1 WHEN 3 THEN 5 ELSE 0 END AS INTEGER) AS year, venue,
           CASE WHEN p IN (1, 7) THEN NULL WHEN p = 6 THEN '10.5555/x' || work_id ELSE doi END AS doi
    FROM (SELECT *, work_id % 8 AS p FROM base)
), citations_text AS (
    SELECT work_id // 10 AS doc_id, CAST(work_id % 10 + 1 AS INTEGER) AS ref_no, work_id, CASE WHEN work_id % 5 = 0 AND length(t) > 290 THEN 1 ELSE work_id % 5 END AS q, t, authors, year, venue, doi
    FROM (SELECT *, trim(regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) || ' study' AS t FROM base) WHERE length(t) >= 18
)"""


def n2(c: str) -> str:
    """SQL for a canonical title."""
    mended = rf"regexp_replace(lower(coalesce({c}, '')), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    bare = rf"regexp_replace(regexp_replace({mended}, '<[^>]+>', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def n1(c: str) -> str:
    """SQL for a canonical DOI (ASCII)."""
    words = "'null','none','nan','n/a','na','unknown','undefined','-','--','?'"
    edges = "' .,;:()[]{}<>\"''' || chr(9) || chr(10) || chr(13)"
    inner = f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ({words}) THEN '' ELSE trim(coalesce({c}, '')) END"
    bare = rf"trim(regexp_replace(regexp_replace(regexp_replace({inner}, '(?i)^\s*(?:https?://)?(?:dx\.)?doi\.org/', ''), '(?i)^\s*doi\s*:\s*', ''), '\s+', '', 'g'), {edges})"
    return f"CASE WHEN lower({bare}) IN ({words}) THEN '' ELSE lower({bare}) END"
