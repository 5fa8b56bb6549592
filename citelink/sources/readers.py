"""Readers for snapshots of bibliographic sources: JSON records in, one row of common fields for each record out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelink.functions.normalize import normalize_doi

FIELDS = ("title", "authors", "doi", "year", "venue", "source")

_CROSSREF = "title array<string>, author array<struct<given:string,family:string>>, DOI string, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>"
_OPENALEX = "title string, display_name string, authorships array<struct<author:struct<display_name:string>>>, doi string, publication_year int, primary_location struct<source:struct<display_name:string>>"
_DBLP = "result struct<hits:struct<hit:string>>"
_DBLP_INFO = "array<struct<info:struct<title:string,authors:struct<author:string>,doi:string,year:string,venue:string>>>"
_SEMANTIC = "title string, authors array<struct<name:string>>, externalIds struct<DOI:string>, year int, venue string"
_PUBMED = "title string, authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>, pubdate string, fulljournalname string, source string"


def _works(title: Column, authors: Column, doi: Column, year: Column, venue: Column, source: str) -> list[Column]:
    none = F.array().cast("array<string>")
    return [title.alias("title"), F.coalesce(authors, none).alias("authors"), doi.alias("doi"), year.cast("int").alias("year"), venue.alias("venue"), F.lit(source).alias("source")]


#: What a record is that no reader can take.
BLANK, BROKEN = "no record", "not a record of this source"
_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt"}


def _record(record: str, schema: str) -> Column:
    """A JSON text as a struct of its fields, ``_corrupt`` the text itself where it isn't such a record."""
    return F.from_json(record, f"{schema}, _corrupt string", _CORRUPT)


def _parsed(df: DataFrame, schema: str, record: str) -> DataFrame:
    """Rows with a whole record; what is left out is in ``quarantine``."""
    kept = [c for c in df.columns if c != record]
    return df.select(*kept, _record(record, schema).alias("_r")).where("_r is not null and _r._corrupt is null")


def quarantine(parts: dict[str, DataFrame], record: str = "record") -> DataFrame:
    """(source, record, reason) of the records that the readers leave out, from each source's rows, by the source's name.

    Every row is read by its source's reader or is here: null and blank texts, and texts that aren't JSON of a record. Nothing of them goes on.
    """
    found = None
    for source, df in parts.items():
        text = F.col(record)
        blank = F.trim(F.coalesce(text, F.lit(""))) == ""
        broken = _record(record, SCHEMAS[source])["_corrupt"].isNotNull()
        rows = df.select(F.lit(source).alias("source"), text.alias("record"), F.when(blank, BLANK).when(broken, BROKEN).alias("reason")).where("reason is not null")
        found = rows if found is None else found.unionByName(rows)
    return found


#: The schema of each source's records.
SCHEMAS = {"Crossref": _CROSSREF, "OpenAlex": _OPENALEX, "DBLP": _DBLP, "Semantic Scholar": _SEMANTIC, "PubMed": _PUBMED}

_CITATION = "doc_id bigint, ref_no int, original_reference string, title string, authors array<string>, year string, venue string, doi string"


def read_citations(df: DataFrame, record: str = "record") -> DataFrame:
    """Parsed citations, one JSON text in each row, with ``error``: why a citation can't be processed, null if it can.

    A text that isn't such a record comes out with the text as its original reference and no other field; a year that isn't a whole number is null. Every row of the
    input is a row of the result, so that what can't be processed is reported and everything else goes on.
    """
    rows = df.select(F.col(record).alias("_text"), _record(record, _CITATION).alias("_r"))
    r = F.col("_r")
    broken = r.isNull() | r["_corrupt"].isNotNull()
    year = r["year"].try_cast("int")
    error = F.when(broken, "the record is not a citation").when(r["year"].isNotNull() & year.isNull(), F.concat(F.lit("the year is not a number: "), r["year"]))
    fields = [F.when(~broken, r[f]).alias(f) for f in ("doc_id", "ref_no")]
    fields.append(F.when(broken, F.col("_text")).otherwise(r["original_reference"]).alias("original_reference"))
    fields += [F.when(~broken, year if f == "year" else r[f]).alias(f) for f in ("title", "authors", "year", "venue", "doi")]
    return rows.select(*fields, error.alias("error"))


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_r" and not c.startswith("_h")]


def read_crossref(df: DataFrame, record: str = "record") -> DataFrame:
    """Crossref works, one JSON text in each row; other columns stay. Names are given and family name joined."""
    rows = _parsed(df, _CROSSREF, record)
    r = F.col("_r")
    names = F.transform(r["author"], lambda a: F.btrim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit("")))))
    year = F.try_element_at(F.try_element_at(r["issued"]["date-parts"], F.lit(1)), F.lit(1))
    title = F.coalesce(F.try_element_at(r["title"], F.lit(1)), F.lit(""))
    return rows.select(*_kept(rows), *_works(title, names, r["DOI"], year, F.try_element_at(r["container-title"], F.lit(1)), "Crossref"))


def read_openalex(df: DataFrame, record: str = "record") -> DataFrame:
    """OpenAlex works; DOIs come as URLs and are made canonical, authorships without an author are left out."""
    rows = _parsed(df, _OPENALEX, record)
    r = F.col("_r")
    names = F.transform(F.filter(r["authorships"], lambda a: a["author"].isNotNull()), lambda a: a["author"]["display_name"])
    doi = F.when(F.coalesce(r["doi"], F.lit("")) != "", normalize_doi(r["doi"])).otherwise(r["doi"])
    return rows.select(*_kept(rows), *_works(F.coalesce(F.nullif(r["title"], F.lit("")), r["display_name"]), names, doi, r["publication_year"], r["primary_location"]["source"]["display_name"], "OpenAlex"))


def read_dblp(df: DataFrame, record: str = "record") -> DataFrame:
    """DBLP search results, a row for each hit; a single hit or author may come without its list."""
    found = _parsed(df, _DBLP, record)
    hits = found.withColumn("_hit", F.explode(F.from_json(F.col("_r.result.hits.hit"), _DBLP_INFO))).withColumn("_r", F.col("_hit.info")).drop("_hit")
    r = F.col("_r")
    names = F.transform(F.from_json(r["authors"]["author"], "array<struct<text:string>>"), lambda a: F.coalesce(a["text"], F.lit("")))
    return hits.select(*_kept(hits), *_works(r["title"], names, r["doi"], r["year"].try_cast("int"), r["venue"], "DBLP"))


def read_semantic_scholar(df: DataFrame, record: str = "record") -> DataFrame:
    """Semantic Scholar papers."""
    rows = _parsed(df, _SEMANTIC, record)
    r = F.col("_r")
    return rows.select(*_kept(rows), *_works(r["title"], F.transform(r["authors"], lambda a: a["name"]), r["externalIds"]["DOI"], r["year"], r["venue"], "Semantic Scholar"))


def read_pubmed(df: DataFrame, record: str = "record") -> DataFrame:
    """PubMed summaries; the year is the first four digits of the date, the DOI the first identifier of that type."""
    rows = _parsed(df, _PUBMED, record)
    r = F.col("_r")
    doi = F.try_element_at(F.filter(r["articleids"], lambda x: x["idtype"] == "doi"), F.lit(1))["value"]
    year = F.regexp_extract(F.coalesce(r["pubdate"], F.lit("")), r"\d{4}", 0).try_cast("int")
    names = F.transform(r["authors"], lambda a: F.coalesce(a["name"], F.lit("")))
    return rows.select(*_kept(rows), *_works(r["title"], names, doi, year, F.coalesce(F.nullif(r["fulljournalname"], F.lit("")), r["source"]), "PubMed"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """One works table of all sources, by column name."""
    first, *rest = parts
    for other in rest:
        first = first.unionByName(other)
    return first


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON record a line, as text; a reader above picks its fields."""
    return spark.read.text(path).withColumnRenamed("value", "record")


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, text) of text files: whole documents, or citations one a line without blank ones."""
    rows = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows if whole else rows.withColumn("text", F.trim("text")).where("text <> ''")
