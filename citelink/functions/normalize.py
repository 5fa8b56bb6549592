"""Canonical forms of DOIs, titles and author names, and the subject domain of a citation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# DOI strings that stand for a missing DOI.
DOI_PLACEHOLDERS = ("null", "none", "nan", "n/a", "na", "unknown", "undefined", "-", "--", "?")
# Fixed value: punctuation around a DOI that is not part of it.
DOI_EDGES = " \t\r\n.,;:()[]{}<>\"'"
# Substrings that place a citation in a domain; the first list goes first.
CS_TERMS = (
    "machine learning", "deep learning", "artificial intelligence", "computer vision", "natural language processing", "nlp", "transformer", "neural network", "software", "database", "data mining",
    "information retrieval", "cybersecurity", "computer science", "algorithm", "large language model", "llm", "sql", "text-to-sql", "forensic",
)
BIO_TERMS = (
    "medicine", "medical", "clinical", "health", "healthcare", "cancer", "disease", "patient", "biology", "genomics", "genetic", "neuroscience", "pharmaceutical", "drug", "pathology", "epidemiology",
)
# Sources searched beyond the common ones, by domain.
EXTRA_SOURCES = {"cs": ("DBLP", "Semantic Scholar"), "biomedical": ("PubMed", "Semantic Scholar"), "general": ("Semantic Scholar",)}

_WORD = r"[\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition; text of ASCII only passes as it is."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, so that accents don't keep equal titles apart."""
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _blank_doi(c: Column) -> Column:
    return F.when(F.lower(c).isin(*DOI_PLACEHOLDERS), "").otherwise(c)


def normalize_doi(doi: Column) -> Column:
    """The bare lower-case DOI; empty for a null, an empty one or one of the placeholders."""
    c = _blank_doi(F.regexp_replace(nfkd(F.coalesce(doi, F.lit(""))), r"(?U)^\s+|\s+$", ""))
    c = F.regexp_replace(c, r"(?i)^\s*(?:https?://)?(?:dx\.)?doi\.org/", "")
    c = F.regexp_replace(c, r"(?iU)^\s*doi\s*:\s*", "")
    c = F.btrim(F.regexp_replace(c, r"(?U)\s+", ""), F.lit(DOI_EDGES))
    return F.lower(_blank_doi(c))


def normalize_text(text: Column) -> Column:
    """Lower case, hyphenated line breaks mended, tags gone, punctuation as blanks, blanks single; empty for null."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, rf"(?U)({_WORD})-\s+({_WORD})", "$1$2")
    c = F.regexp_replace(c, "<[^>]+>", "")
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize_author(name: Column) -> Column:
    """Lower case, without "et al.", accents, punctuation and repeated blanks; empty for null."""
    c = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\bet\s+al\.?\b", "")
    c = F.regexp_replace(folded(c), "[.,;:]", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def detect_domain(title: Column, venue: Column) -> Column:
    """cs, biomedical or general, by terms in title and venue."""
    text = normalize_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(venue, F.lit(""))))
    return F.when(text.rlike("|".join(CS_TERMS)), "cs").when(text.rlike("|".join(BIO_TERMS)), "biomedical").otherwise("general")


def extra_sources(domain: Column) -> Column:
    """The sources to search beyond the common ones, in order."""
    known = {k: F.array(*map(F.lit, v)) for k, v in EXTRA_SOURCES.items()}
    return F.when(domain == "cs", known["cs"]).when(domain == "biomedical", known["biomedical"]).otherwise(known["general"])


def present(c: Column, kind: str) -> Column:
    """Whether a value counts as given: not null, and not empty or zero."""
    if kind == "array":
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != (0 if kind == "number" else ""))
