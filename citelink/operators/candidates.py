"""Candidate works for citations: by DOI, by title, and by staged keyword searches over the works table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.functions.normalize import detect_domain, extra_sources, normalize_doi, normalize_text
from citelink.functions.similarity import author_similarity, nearly_identical
from citelink.operators.ranking import REF
from citelink.sources.scratch import dropped, stored

# Words left out of reduced queries, sources of DOI lookups, and how many hits each search takes.
STOPWORDS = ("a", "an", "the", "of", "for", "on", "at", "to", "in", "with", "without", "and", "or", "but", "by", "from", "into", "through")
DOI_SOURCES = ("Crossref", "OpenAlex", "Semantic Scholar")
TEXT_SOURCES = ("Crossref", "OpenAlex")
CAPS = {1: 50, 2: 50, 3: 50, 4: 30, 5: 30, 6: 20}
STRONG_TITLE, STRONG_AUTHORS = 95, 90
#: Postings of a block, about, and blocks of a part; a word's list is dealt over as many parts as it needs.
BLOCK_POSTINGS, PART_BLOCKS = 512, 64
#: Words are read for a first bound until their lists have so many times a search's cap.
SEED_CAPS = 2
#: Searches with more postings than this in all are dealt into cells; fewer read blocks by bounds.
FEW_POSTINGS = 2_000_000
#: Postings and searches of a cell, about. Documents go to a cell for each part of the searches, so that few searches in a cell mean many copies of the documents.
CELL_POSTINGS, CELL_SEARCHES, LEAST_SEARCHES = 6_000_000, 65_536, 1_024
#: Records on a side of a tile, about, and pairs of a task where records of one title are paired.
TILE, TASK_PAIRS = 1_024, 16_000_000
#: The same where the pairs of one lookup key are measured, which takes longer.
KEY_TILE = 128
#: Which sources' records are searched by which fields.
FIELDS = {"title": None, "phrase": ("Crossref",), "both": TEXT_SOURCES, "record": ("Crossref",)}


def lookup_keys(cites: DataFrame) -> DataFrame:
    """``cites`` with norm_doi, norm_title and ``lookup_key``: citations of one key share one search."""
    keyed = cites.withColumns({"norm_doi": normalize_doi(F.col("doi")), "norm_title": normalize_text(F.col("title"))})
    return keyed.withColumn("lookup_key", F.concat_ws("|", "norm_doi", "norm_title"))


def lookup_groups(keyed: DataFrame, keys: tuple[str, ...] = REF) -> DataFrame:
    """One row for each lookup key: the fields of its first citation, which does the searching, and how many share it."""
    fields = ("title", "authors", "year", "venue", "doi", "norm_doi", "norm_title")
    first = F.min_by(F.struct(*fields), F.struct(*keys))
    return keyed.groupBy("lookup_key").agg(first.alias("f"), F.count("*").alias("n_citations")).select("lookup_key", "n_citations", "f.*")


def doi_candidates(groups: DataFrame, works: DataFrame) -> DataFrame:
    """(lookup_key, work_key, stage, arrival) of works with the same DOI in a source that is asked for DOIs. Missing DOIs never meet."""
    known = works.where((F.col("norm_doi") != "") & F.arrays_overlap("sources", F.array(*map(F.lit, DOI_SOURCES)))).select("norm_doi", "work_key")
    return groups.where("norm_doi <> ''").select("lookup_key", "norm_doi").join(known, "norm_doi").select("lookup_key", "work_key", F.lit(0).alias("stage"), F.lit(0).cast("bigint").alias("arrival"))


def paired(left: DataFrame, right: DataFrame, by: str, left_key: tuple[str, ...], right_key: tuple[str, ...], tile: int | None = None) -> DataFrame:
    """Each row of ``left`` with each row of ``right`` of its ``by``; no other column is in both.

    Rows of a common ``by`` are dealt into parts of about ``tile`` (TILE) by their keys, and each two parts meet in a tile of their own, so that its pairs, however many,
    are the work of many tasks, of TASK_PAIRS each. All pairs are listed: they grow with the square of the copies.
    """
    tile = tile or TILE
    counts = left.groupBy(by).agg(F.count("*").alias("n")).join(right.groupBy(by).agg(F.count("*").alias("m")), by)
    counts = stored(counts.withColumns({"l": F.expr(f"n div {tile} + 1"), "r": F.expr(f"m div {tile} + 1")}), "counts")
    pairs = counts.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS + 1)
    tiled = F.broadcast(counts.where("l > 1 or r > 1").select(by, "l", "r"))  # a row for each ``tile`` records at most

    def dealt(df: DataFrame, key: tuple[str, ...], own: str, other: str) -> DataFrame:
        placed = df.join(tiled, by, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(*key), F.coalesce(own, F.lit(1))))
        placed = placed.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1)))
        return placed.drop("l", "r").repartition(tasks, by, "l_part", "r_part").sortWithinPartitions(by, "l_part", "r_part")

    return dealt(left, left_key, "l", "r").join(dealt(right, right_key, "r", "l"), [by, "l_part", "r_part"]).drop("l_part", "r_part")


def paired_by_title(left: DataFrame, right: DataFrame, left_key: tuple[str, ...], right_key: tuple[str, ...]) -> DataFrame:
    """The pairs of one norm_title, blank ones left out."""
    return paired(*(df.where("norm_title <> ''") for df in (left, right)), "norm_title", left_key, right_key)


def title_candidates(groups: DataFrame, works: DataFrame) -> DataFrame:
    """(lookup_key, work_key, stage, arrival) of works with the same canonical title."""
    pairs = paired_by_title(groups.select("lookup_key", "norm_title"), works.select("norm_title", "work_key"), ("lookup_key",), ("work_key",))
    return pairs.select("lookup_key", "work_key", F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("arrival"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _query(sources: tuple[str, ...] | Column, stage: int, texts: Column, fields: str = "title") -> Column:
    """An array of (source, place, stage, fields, text), one for each source and text."""
    names = F.array(*map(F.lit, sources)) if isinstance(sources, tuple) else sources
    return F.flatten(
        F.transform(
            names,
            lambda s, i: F.transform(
                texts, lambda t, j: F.struct(s.alias("source"), (i * 10 + j).cast("int").alias("place"), F.lit(stage).alias("stage"), F.lit(fields).alias("fields"), t.alias("text"))
            ),
        )
    )


def full_title(groups: DataFrame) -> Column:
    """The title as a phrase (as words, where it has two or fewer) and in whole records of the first source, and as words in the second."""
    asked = zip(TEXT_SOURCES[:1] * 2 + TEXT_SOURCES[1:], (0, 1, 10), (F.when(F.size(_words(F.col("norm_title"))) > 2, "phrase").otherwise("title"), F.lit("record"), F.lit("title")), strict=True)
    return F.array(*(F.struct(F.lit(s).alias("source"), F.lit(place).alias("place"), F.lit(1).alias("stage"), fields.alias("fields"), F.col("norm_title").alias("text")) for s, place, fields in asked))


def reduced_title(groups: DataFrame) -> Column:
    """The title without common and very short words, where that differs."""
    left = F.array_join(F.filter(_words(F.col("norm_title")), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 2)), " ")
    return _query(TEXT_SOURCES, 2, F.filter(F.array(left), lambda t: (t != "") & (t != F.col("norm_title"))))


def author_keywords(groups: DataFrame) -> Column:
    """The first author with the first three words of the title."""
    text = F.concat_ws(" ", normalize_text(F.element_at("authors", 1)), F.array_join(F.slice(_words(F.col("norm_title")), 1, 3), " "))
    return F.when(F.size("authors") > 0, _query(TEXT_SOURCES, 3, F.array(text), "both"))


def key_terms(groups: DataFrame) -> Column:
    """Pairs and triples of the first eight longer words: four neighbouring pairs; from five words on, first with last and both ends' triples."""
    terms = F.slice(F.filter(_words(F.col("norm_title")), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 4)), 1, 8)
    n = F.size(terms)
    pairs = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.least(n - 1, F.lit(4)), F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(terms, i), F.try_element_at(terms, i + 1))))
    ends = F.array(
        F.concat_ws(" ", F.try_element_at(terms, F.lit(1)), F.try_element_at(terms, F.lit(-1))), F.array_join(F.slice(terms, 1, 3), " "), F.array_join(F.slice(terms, F.greatest(n - 2, F.lit(1)), F.lit(3)), " ")
    )
    every = F.when(n >= 5, F.concat(pairs, ends)).otherwise(pairs)
    return F.when(n >= 3, _query(("Crossref",), 4, F.slice(F.array_distinct(every), 1, 8)))


def title_halves(groups: DataFrame) -> Column:
    """Both halves of a title of six words or more."""
    words = _words(F.col("norm_title"))
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    halves = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, n), " "))
    return F.when(n >= 6, _query(("Crossref",), 5, halves))


def domain_title(groups: DataFrame) -> Column:
    """The title in the further sources of its domain."""
    return _query(extra_sources(detect_domain(F.col("title"), F.col("venue"))), 6, F.array("norm_title"))


STAGES = {1: full_title, 2: reduced_title, 3: author_keywords, 4: key_terms, 5: title_halves, 6: domain_title}


def stage_queries(groups: DataFrame, stages: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(lookup_key, source, place, stage, fields, text): the searches of the chosen stages; none for a key without a title."""
    none = F.array().cast("array<struct<source:string,place:int,stage:int,fields:string,text:string>>")
    every = F.concat(*(F.coalesce(STAGES[s](groups), none) for s in stages))
    return groups.where("norm_title <> ''").select("lookup_key", F.explode(every).alias("q")).select("lookup_key", "q.*")


@dataclass(frozen=True)
class Index:
    """A search index over works, as tables in the shared folder. Works of one text are one document of it, whatever their number.

    ``docs`` (doc_no, source, fields, title, n): a text in a source's lists of some kind and how many works have it; numbers ascend with the first of their keys.
    ``members`` (doc_no, work_key, place): the first ``most`` works of each. ``words`` (token_no, source, fields, token, df, length, top, parts): a word's works,
    the length of its list, its highest impact, and the parts of its list. ``blocks`` (token_no, part, first, highest, posts): the lists, in blocks of postings
    (doc_no, impact) of about equal impact. ``forward`` (doc_no, source, fields, n, posts, works): the same by document, a map from words, and its members. ``work_key`` is of any type that has an order.
    """

    docs: DataFrame
    members: DataFrame
    words: DataFrame
    blocks: DataFrame
    forward: DataFrame
    most: int


def _pairs(words: Column) -> Column:
    """Neighbouring words of a column of words as tokens: the places of a phrase's words."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores, where few bytes of input mean much work; rows equal in ``by`` come one after another."""
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
    return dealt.sortWithinPartitions(*by) if by else dealt


def search_index(works: DataFrame, most: int = max(CAPS.values())) -> Index:
    """The index of works (work_key, norm_title, authors, sources and, if there, venue and year); ``most``: the highest cap of any search.

    A word's impact in a work is its rarity (in thousandths) by BM25: more for a word that comes again, less in a long record, in whole numbers so that sums
    are exact. Works of equal text have equal scores in every search, so a text is listed once, and counts as often as there are works of it.
    A list of any length is grouped by impact and by a salt, so that no task gets a common word's whole list.
    """
    other = [normalize_text(F.col(c).cast("string")) if c in works.columns else F.lit("") for c in ("venue", "year")]
    names = normalize_text(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "))
    keyed = works.select("work_key", "sources", F.coalesce("norm_title", F.lit("")).alias("title"), names.alias("names"), F.concat_ws(" ", *other).alias("more"))
    rest = {"title": F.lit(""), "phrase": F.lit(""), "both": F.col("names"), "record": F.concat_ws(" ", "names", "more")}
    kind = "struct<fields:string,rest:string,of:array<string>>"
    asked = F.array(*(F.struct(F.lit(f), rest[f], F.array(*map(F.lit, sources or ())).cast("array<string>")).cast(kind) for f, sources in FIELDS.items()))
    kinds = spread(keyed).select("work_key", "title", F.explode("sources").alias("source"), asked.alias("asked")).select("work_key", "title", "source", F.explode("asked").alias("k"))
    text = ("source", "fields", "title", "rest")
    kinds = stored(kinds.where("size(k.of) = 0 or array_contains(k.of, source)").select("work_key", "title", "source", "k.fields", "k.rest"), "kinds")
    texts = kinds.groupBy(*text).agg(F.min("work_key").alias("first_key"), F.count("*").alias("n")).repartitionByRange("first_key").sortWithinPartitions("first_key")
    docs = stored(texts.drop("first_key").withColumn("doc_no", F.monotonically_increasing_id()), "docs")
    placed = F.row_number().over(Window.partitionBy("doc_no").orderBy("work_key"))
    members = stored(kinds.join(docs.select("doc_no", *text), [*text]).select("doc_no", "work_key", placed.alias("place")).where(F.col("place") <= most), "members")
    words = _words(F.col("title"))
    tokens = F.when(F.col("fields") == "phrase", _pairs(words)).otherwise(F.concat(words, _words(F.col("rest"))))
    listed = docs.select("doc_no", "source", "fields", "n", tokens.alias("tokens")).withColumn("n_tokens", F.size("tokens")).where("n_tokens > 0")
    sizes = listed.groupBy("source", "fields").agg(F.sum("n").alias("n_works"), F.expr("greatest(1000 * sum(n * n_tokens) div sum(n), 1)").alias("mean"))
    flat = listed.withColumn("token", F.explode("tokens")).groupBy("doc_no", "source", "fields", "n", "n_tokens", "token").agg(F.count("*").alias("tf"))
    flat = stored(flat, "tokens")
    counts = flat.groupBy("source", "fields", "token").agg(F.sum("n").alias("df"), F.count("*").alias("length")).join(F.broadcast(sizes), ["source", "fields"])  # a row for each source and kind of field
    rarity = F.floor(1000 * F.log(1 + F.col("n_works") / F.col("df"))).cast("bigint")
    rare = stored(counts.withColumns({"rarity": rarity, "token_no": F.monotonically_increasing_id()}), "rarities")
    impact = F.expr("(rarity * tf * 2200) div (1000 * tf + 300 + 900000L * n_tokens div mean)")
    weighed = flat.join(rare, ["source", "fields", "token"]).select("doc_no", "source", "fields", "n", "token_no", "length", impact.alias("impact"))
    posts = F.map_from_entries(F.collect_list(F.struct("token_no", F.struct("impact", "length")))).alias("posts")
    of_doc = members.groupBy("doc_no").agg(F.array_sort(F.collect_list("work_key")).alias("works"))  # ``most`` at most
    forward = stored(weighed.groupBy("doc_no", "source", "fields").agg(F.first("n").alias("n"), posts).join(of_doc, "doc_no"), "forward")
    salts = F.expr(f"length div {BLOCK_POSTINGS} + 1")
    parts = F.expr(f"length div {BLOCK_POSTINGS * PART_BLOCKS} + 1")
    dealt = forward.select("doc_no", F.explode("posts").alias("token_no", "p")).select("doc_no", "token_no", "p.*").withColumn("salt", F.pmod(F.xxhash64("doc_no"), salts))
    dealt = dealt.withColumn("part", F.pmod(F.col("salt"), parts)).withColumn("band", F.floor(8 * F.log2(F.col("impact") + 1)))
    blocks = dealt.groupBy("token_no", "part", "salt", "band").agg(F.max("impact").alias("highest"), F.collect_list(F.struct("doc_no", "impact")).alias("posts"))
    blocks = stored(blocks.select("token_no", "part", (F.col("salt") == 0).alias("first"), "highest", "posts"), "blocks")
    tops = blocks.groupBy("token_no").agg(F.max("highest").alias("top"))
    words = stored(rare.join(tops, "token_no").select("token_no", "source", "fields", "token", "df", "length", "top", parts.alias("parts")), "words")
    dropped(kinds, flat, rare)
    return Index(docs.drop("rest"), members, words, blocks, forward, most)


def _read(terms: DataFrame, blocks: DataFrame, wanted: Column) -> DataFrame:
    """``terms`` with the postings (doc_no, impact) of the blocks that ``wanted`` asks for, part by part."""
    dealt = spread(terms).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.join(blocks, ["token_no", "part"]).where(wanted)
    return met.select(*terms.columns, F.explode("posts").alias("p")).select("*", "p.*").drop("p")


def _scored(pairs: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """``pairs`` (q_no, doc_no) with their exact score, from the documents' own words, and how many works have the document's text."""
    asked = terms.groupBy("q_no", "cap").agg(F.collect_list("token_no").alias("tokens"))
    score = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(F.try_element_at("posts", t)["impact"], F.lit(0)))
    return pairs.join(asked, "q_no").join(index.forward, "doc_no").select("q_no", "doc_no", "cap", "n", score.alias("score"))


def _first_works(works: DataFrame) -> DataFrame:
    """(q_no, work_key, score, hit_no): each query's best works of (q_no, work_key, cap, score), ties by work_key."""
    order = Window.partitionBy("q_no").orderBy(F.desc("score"), "work_key")
    return works.withColumn("hit_no", F.row_number().over(order)).where("hit_no <= cap").select("q_no", "work_key", "score", "hit_no")


def _best(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("q_no").orderBy(F.desc("score"), "doc_no")
    return scored.withColumn("hit_no", F.row_number().over(order)).where(F.col("hit_no") <= F.col("cap"))


def _best_works(scored: DataFrame, index: Index) -> DataFrame:
    """(q_no, work_key, cap, score): the works that can be among each query's best; of a text only as many as can."""
    above = F.coalesce(F.sum("n").over(Window.partitionBy("q_no").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = _best(scored).withColumn("left", F.col("cap") - above).where("left > 0")
    return open_.drop("hit_no").join(index.members, "doc_no").where("place <= left").select("q_no", "work_key", "cap", "score")


def _known_words(asked: DataFrame, index: Index) -> DataFrame:
    """A row for each query, phrases left out, and word of it that works have."""
    return asked.where("fields <> 'phrase'").select("q_no", "source", "fields", "cap", F.explode("tokens").alias("token")).join(index.words, ["source", "fields", "token"])


def query_terms(asked: DataFrame, index: Index) -> DataFrame:
    """A row for each query and word of it that works have: the words ascend by their highest impact from last to first.

    ``above``: the lists' lengths of the words before; ``rest``: the highest impacts of the words after, so that a work whose first word of the query
    this is scores its impact and ``rest`` at most.
    """
    terms = _known_words(asked, index)
    order = Window.partitionBy("q_no").orderBy(F.desc("top"), "token")
    above = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.coalesce(F.sum("top").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return terms.select("q_no", "cap", "token_no", "df", "length", "top", "parts", above.alias("above"), rest.alias("rest"))


def first_bounds(terms: DataFrame, index: Index) -> DataFrame:
    """(q_no, least): a score that a query's last hit reaches at least, 0 where too few works are met.

    Of a query's strongest words the first blocks of each impact are read, and the best texts so found are scored exactly; each counts for all of its works.
    """
    seeds = terms.where(F.col("above") < SEED_CAPS * F.col("cap")).withColumn("parts", F.lit(1).cast("bigint"))
    met = _read(seeds, index.blocks, F.col("first")).groupBy("q_no", "cap", "doc_no").agg(F.sum("impact").alias("score"))
    exact = _scored(_best(met).select("q_no", "doc_no"), terms, index)
    works = F.sum("n").over(Window.partitionBy("q_no").orderBy(F.desc("score"), "doc_no").rowsBetween(Window.unboundedPreceding, 0))
    return exact.withColumn("works", works).groupBy("q_no").agg(F.coalesce(F.max(F.when(F.col("works") >= F.col("cap"), F.col("score"))), F.lit(0)).alias("least"))


def postings_met(terms: DataFrame, bounds: DataFrame, index: Index) -> DataFrame:
    """(q_no, doc_no, seen, most): the documents that can be among a query's best, each once, with the least and the most that each can score.

    Of each word only those blocks are read, and of these only those postings met, whose impact with ``rest`` reaches the bound; a list no longer than all
    lists before it is read whole. A document without a posting among these has ``unseen`` of that word at most, so a document stays only if what is met
    and what may be unseen reach the bound together. What is met gives each query a better bound in turn: where the cap's last document is, by ``seen``.
    """
    bound = terms.join(bounds, "q_no", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    bound = bound.withColumn("from", F.when(F.col("length") <= F.col("above"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("least") - F.col("rest"))))
    bound = bound.withColumn("unseen", F.least("top", F.greatest(F.lit(0), F.col("from") - 1)))
    bound = bound.withColumn("open", F.sum("unseen").over(Window.partitionBy("q_no"))).select("q_no", "cap", "token_no", "parts", "least", "from", "unseen", "open")
    met = _read(bound, index.blocks, F.col("highest") >= F.col("from")).where(F.col("impact") >= F.col("from"))
    same = [F.max(c).alias(c) for c in ("cap", "least", "open")]
    docs = met.groupBy("q_no", "doc_no").agg(F.sum("impact").alias("seen"), F.sum("unseen").alias("known"), *same)
    docs = docs.withColumn("most", F.col("seen") + F.col("open") - F.col("known")).where("most >= least")
    by_query = Window.partitionBy("q_no")
    last = F.max(F.when(F.col("_n") == F.col("cap"), F.col("seen"))).over(by_query)
    ranked = docs.withColumn("_n", F.row_number().over(by_query.orderBy(F.desc("seen")))).withColumn("_last", last)
    return ranked.where("_last is null or most >= _last").select("q_no", "doc_no", "seen", "most")


_CELL = ("source", "fields", "of", "part")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


class _Cell:
    """The documents of a cell, by the lists of their words: rows ascend in a list."""

    def __init__(self, docs: pa.Table) -> None:
        docs = docs.sort_by("doc_no")
        self.doc_no = docs["doc_no"]
        tokens, rows = _lists(docs["tokens"])
        order = np.argsort(tokens, kind="stable")
        self.words, starts = np.unique(tokens[order], return_index=True)
        self.rows, self.impacts = rows[order], _lists(docs["impacts"])[0][order].astype("int64")
        self.tops = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.empty(0, "int64")
        self.starts, self.ends = starts.tolist(), [*starts[1:].tolist(), len(order)]
        self.sums, self.places = np.zeros(len(docs), "int64"), np.empty(len(docs), "int64")
        self.dense: dict[int, np.ndarray] = {}
        lists = docs["works"].combine_chunks()
        self.works, self.n, self.first = lists.flatten(), lists.value_lengths().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        self.rank = np.empty(len(self.works), "int64")
        self.rank[pc.sort_indices(self.works).to_numpy()] = np.arange(len(self.works))

    def _added(self, word: int, rows: np.ndarray) -> np.ndarray:
        """The impacts of a word in these rows, 0 where a row is not in its list. A common word's list is laid out by row once."""
        of, impacts = (x[self.starts[word] : self.ends[word]] for x in (self.rows, self.impacts))
        if 8 * len(of) > len(self.sums):
            if word not in self.dense:
                self.dense[word] = np.zeros(len(self.sums), "int64")
                self.dense[word][of] = impacts
            return self.dense[word][rows]
        at = np.minimum(np.searchsorted(of, rows), len(of) - 1)
        return np.where(of[at] == rows, impacts[at], 0)

    def best(self, words: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows, ascending, and scores: all that can be among a search's best, fewer than cap others being better, and their exact scores.

        Lists are added up from the strongest word down, until what the words left can give is less than the sum that ``cap`` rows have already: no row
        without a word so far is among the best then, and the others' words are looked up, where a row can still get there.
        """
        order = words[np.argsort(-self.tops[words], kind="stable")]
        rests = (self.tops[order].sum() - np.cumsum(self.tops[order])).tolist()
        words, lists, seen, check, met, left = order.tolist(), [], 0, 4 * cap, None, len(order)
        for i, word in enumerate(words):
            of = self.rows[self.starts[word] : self.ends[word]]
            self.sums[of] += self.impacts[self.starts[word] : self.ends[word]]
            lists.append(of)
            seen += len(of)
            if seen >= check and i + 1 < len(words):
                met = self._distinct(lists)
                if len(met) >= cap:
                    sums = self.sums[met]
                    last = np.partition(sums, len(met) - cap)[len(met) - cap]
                    if rests[i] < last:
                        left = i + 1
                        break
                check = 2 * seen
        every = self._distinct(lists) if left == len(words) else met
        rows = np.sort(every if left == len(words) else met[sums + rests[left - 1] >= last])
        score = self.sums[rows]
        self.sums[every] = 0
        for word in words[left:]:
            score = score + self._added(word, rows)
        return rows, score

    def _distinct(self, lists: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate([*lists, np.empty(0, "int64")])
        self.places[rows] = np.arange(len(rows))
        return rows[self.places[rows] == np.arange(len(rows))]

    def works_of(self, rows: np.ndarray, score: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows, places and scores of the best ``cap`` works of these rows, ties by work_key."""
        if len(rows) > cap:
            last = np.partition(score, len(rows) - cap)[len(rows) - cap]
            rows, score = rows[score >= last], score[score >= last]
        n = self.n[rows]
        place = np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.repeat(score, n)
        best = np.lexsort((self.rank[place], -score))[:cap]
        return np.repeat(rows, n)[best], place[best], score[best]


def _cell_hits(docs: pa.Table, searches: pa.Table) -> pa.Table:
    """The best works of a cell for each of its searches, by score and then by work_key, exact sums over the lists of the search's words."""
    cell = _Cell(docs)
    asked, of = _lists(searches["tokens"])
    place = np.minimum(np.searchsorted(cell.words, asked), max(len(cell.words) - 1, 0))
    known = cell.words[place] == asked if len(cell.words) else np.zeros(len(asked), bool)
    place, of = place[known], of[known]
    firsts, caps = np.searchsorted(of, np.arange(len(searches) + 1)).tolist(), searches["cap"].to_pylist()
    found = [cell.works_of(*cell.best(place[firsts[i] : firsts[i + 1]], cap), cap) for i, cap in enumerate(caps)]
    of = np.repeat(np.arange(len(caps)), [len(f[0]) for f in found])
    rows, works, score = (np.concatenate([*(f[k] for f in found), np.empty(0, "int64")]) for k in range(3))
    return pa.table({"q_no": searches["q_no"].take(pa.array(of)), "doc_no": cell.doc_no.take(pa.array(rows)), "work_key": cell.works.take(pa.array(works)), "cap": searches["cap"].take(pa.array(of)), "score": pa.array(score)})


def cell_parts(searches: DataFrame, index: Index) -> DataFrame:
    """(source, fields, of_parts, parts): the parts that documents and searches of a kind are dealt into. Searches have no more than it takes to keep all cores busy or a cell small."""
    kind = ("source", "fields")
    tasks = searches.sparkSession.sparkContext.defaultParallelism
    docs = index.forward.groupBy(*kind).agg(F.expr(f"sum(size(posts)) div {CELL_POSTINGS} + 1").alias("of_parts"))
    counts = searches.groupBy(*kind).agg(F.count("*").alias("n")).join(docs, [*kind])
    busy = F.least(F.expr(f"n div {LEAST_SEARCHES} + 1"), F.expr(f"{tasks} div of_parts"))
    return counts.select(*kind, "of_parts", F.greatest(F.expr(f"n div {CELL_SEARCHES} + 1"), busy).alias("parts"))


def cell_hits(asked: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """(q_no, doc_no, work_key, cap, score): each search's best works of every cell.

    Documents of one source and kind of field are dealt into parts of about CELL_POSTINGS postings, searches into parts of about CELL_SEARCHES; each two parts
    meet in one cell, whose size does not grow with the input. Lists of a search's words are added up, in arrays, the strongest words' first and common ones only where
    they can matter (see ``_Cell``), and a cell gives no more than the cap's works of a search, so postings are never rows of a shuffle.
    """
    kind = ("source", "fields")
    tokens = terms.groupBy("q_no", "cap").agg(F.collect_list("token_no").alias("tokens"))
    searches = stored(asked.select("q_no", *kind).join(tokens, "q_no"), "searches")
    parts = F.broadcast(cell_parts(searches, index))  # a row for each source and kind of field

    def dealt(df: DataFrame, number: str, own: str, other: str, own_parts: str, other_parts: str, *columns: Column | str) -> DataFrame:
        placed = df.join(parts, [*kind]).withColumn(own, F.pmod(F.xxhash64(number), own_parts)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_parts) - 1)))
        return placed.select(*_CELL, number, *columns).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *_CELL)

    docs = dealt(index.forward, "doc_no", "of", "part", "of_parts", "parts", "works", F.map_keys("posts").alias("tokens"), F.transform(F.map_values("posts"), lambda p: p["impact"]).alias("impacts"))
    dealt_searches = dealt(searches, "q_no", "part", "of", "parts", "of_parts", "cap", "tokens")
    found = f"q_no bigint, doc_no bigint, work_key {index.members.schema['work_key'].dataType.simpleString()}, cap int, score bigint"
    return docs.groupBy(*_CELL).cogroup(dealt_searches.groupBy(*_CELL)).applyInArrow(_cell_hits, found)


def phrase_hits(asked: DataFrame, index: Index) -> DataFrame:
    """(q_no, title): titles that hold a query's words one after another. The rarest two neighbours find them, the title confirms."""
    phrases = asked.where("fields = 'phrase'")
    pairs = phrases.select("q_no", "source", "fields", F.explode(F.array_distinct(_pairs(F.col("sequence")))).alias("token")).join(index.words, ["source", "fields", "token"], "left")
    order = Window.partitionBy("q_no").orderBy("df", "token")
    rarest = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1 and df is not null")  # no df: a pair that no title has
    found = _read(rarest.select("q_no", "token_no", "parts"), index.blocks, F.lit(True)).select("q_no", "doc_no")
    spaced = found.join(index.docs.select("doc_no", "title"), "doc_no").join(phrases.select("q_no", "text"), "q_no")
    return spaced.where(F.contains(F.concat(F.lit(" "), "title", F.lit(" ")), F.concat(F.lit(" "), "text", F.lit(" ")))).select("q_no", "title")


def search_topk(queries: DataFrame, works: DataFrame, caps: dict[int, int] | None = None, index: Index | None = None) -> DataFrame:
    """(lookup_key, source, place, stage, work_key, score, hit_no): the best works of each search, ties by work_key.

    A work scores the impacts of the query's words in it. Results are those of a search by all words. Equal searches are made once, and
    works of equal text are one document until the best texts are known. Many searches are dealt into cells and add up their words' lists in arrays (see
    ``cell_hits``); a search's hits are narrow rows until the searches' keys are joined, which are rows of searches, not of hits. Few searches read as little as they can: a first look at a query's
    strongest words gives a score that its last hit reaches at least. A work is then met by the first of its words in the query's order only if that word's impact
    with all that may follow reaches this score, so common words' lists are left alone, block by block. What is met, and with all that may be unseen reaches this score, is scored exactly
    from the works' own words. A phrase's works are found by its rarest neighbours and scored by its words. All is equi-joins and sums; nothing is collected. ``index``: of these works, if there is one already.
    """
    caps = caps or CAPS
    index = index or search_index(works, max(caps.values()))
    if index.most < max(caps.values()):
        raise ValueError(f"the index holds {index.most} works of a text, a search takes {max(caps.values())}")
    cap = F.coalesce(*(F.when(F.col("stage") == s, F.lit(k)) for s, k in caps.items()))
    search = ("source", "fields", "cap", "text")
    queries = stored(queries.withColumn("cap", cap), "queries")
    sequence = _words(F.col("text"))
    asked = spread(queries.select(*search).distinct()).select("*", F.array_distinct(sequence).alias("tokens"), sequence.alias("sequence")).withColumn("q_no", F.monotonically_increasing_id())
    asked = stored(asked, "asked")
    askers = stored(queries.join(asked.select("q_no", *search), [*search]).select("q_no", "lookup_key", "source", "place", "stage"), "askers")
    by_title = asked.where("fields = 'phrase'").withColumn("fields", F.lit("title"))
    in_phrase = phrase_hits(asked, index).join(by_title.select("q_no", "source", "fields"), "q_no").join(index.docs, ["source", "fields", "title"]).select("q_no", "doc_no")
    phrase_terms = _known_words(by_title, index).select("q_no", "cap", "token_no")
    words = stored(_known_words(asked, index).select("q_no", "cap", "token_no", "length"), "terms")
    if (words.agg(F.sum("length")).first()[0] or 0) > FEW_POSTINGS:
        found = cell_hits(asked, words, index).drop("doc_no").unionByName(_best_works(_scored(spread(in_phrase), phrase_terms, index), index))
    else:
        terms = stored(query_terms(asked, index), "terms")
        bounds = stored(first_bounds(terms, index), "bounds")
        met = stored(postings_met(terms, bounds, index), "met")
        every = terms.select("q_no", "cap", "token_no").unionByName(phrase_terms)
        sure = met.where("seen = most").join(asked.select("q_no", "cap"), "q_no").join(index.docs.select("doc_no", "n"), "doc_no").select("q_no", "doc_no", "cap", "n", F.col("seen").alias("score"))
        found = _best_works(sure.unionByName(_scored(spread(met.where("seen < most").select("q_no", "doc_no").unionByName(in_phrase)), every, index)), index)
    return _first_works(found).join(askers, "q_no").select("lookup_key", "source", "place", "stage", "work_key", "score", "hit_no")


def strong_matches(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``strong``: equal DOIs, or nearly equal titles (95) with very similar authors (90).

    Only titles of pairs without equal DOIs are measured, and these only where lengths, words and letters leave a match open; authors only where titles are close.
    """
    same = F.coalesce((F.col("norm_doi") != "") & (F.col("norm_doi") == F.col("w_norm_doi")), F.lit(False))
    mine, theirs = (F.when(~same, F.col(c)) for c in ("norm_title", "w_norm_title"))
    asked = pairs.withColumn("_close", nearly_identical(mine, theirs, STRONG_TITLE))
    authors = author_similarity(*(F.when(F.col("_close"), F.col(c)) for c in ("authors", "w_authors")))
    return asked.withColumn("strong", same | (F.col("_close") & (authors >= STRONG_AUTHORS))).drop("_close")


def with_works(hits: DataFrame, works: DataFrame) -> DataFrame:
    """Joins the fields of each hit's work, named w_..."""
    fields = ("title", "authors", "year", "venue", "doi", "source", "sources", "norm_doi", "norm_title")
    return hits.join(works.select("work_key", *(F.col(f).alias(f"w_{f}") for f in fields)), "work_key")


def _first_hits(hits: DataFrame) -> DataFrame:
    """Each (lookup_key, work_key) once, with its first stage and arrival."""
    return hits.groupBy("lookup_key", "work_key").agg(F.min(F.struct("stage", "arrival")).alias("f")).select("lookup_key", "work_key", "f.stage", "f.arrival")


def _searched(groups: DataFrame, works: DataFrame, stages: tuple[int, ...], caps: dict[int, int] | None, index: Index) -> DataFrame:
    found = search_topk(stage_queries(groups, stages), works, caps, index)
    arrival = (F.col("stage") * 1_000_000 + F.col("place") * 1_000 + F.col("hit_no")).cast("bigint")
    return found.select("lookup_key", "work_key", "stage", arrival.alias("arrival"))


@dataclass(frozen=True)
class Pools:
    """What is found for each lookup key, by numbers, so that rows of hits carry no texts. Works of a key's own title are not listed: copies of a title would be, with the square of their number.

    ``keys`` (key_no, lookup_key, and the key's fields). ``works``: all works with ``work_no``, which ascends with work_key. ``hits`` (key_no, work_no, stage, arrival): works by DOI, and works
    of other titles by search. ``titled`` (key_no, norm_title): the keys whose pool has every work of their title, too, at stage 1 and arrival 0.
    """

    keys: DataFrame
    works: DataFrame
    hits: DataFrame
    titled: DataFrame


def _strong_titles(open_: DataFrame, works: DataFrame) -> DataFrame:
    """(lookup_key) of keys with a strong match among the works of their title. Lists of authors that meet in a title are measured once, whatever the number of works and titles that have them."""
    given = open_.where("norm_title <> ''").select("lookup_key", "norm_title", "norm_doi", "authors")
    same = given.where("norm_doi <> ''").join(works.select("norm_title", "norm_doi").distinct(), ["norm_title", "norm_doi"], "left_semi").select("lookup_key")
    mine = given.where("authors is not null").select("norm_title", "authors").distinct()
    theirs = works.where("norm_title <> '' and authors is not null").select("norm_title", F.col("authors").alias("w_authors")).distinct()
    lists = stored(paired_by_title(mine, theirs, ("authors",), ("w_authors",)), "lists")
    close = stored(spread(lists.select("authors", "w_authors").distinct()).where(author_similarity("authors", "w_authors") >= STRONG_AUTHORS), "close")
    strong = lists.join(close, ["authors", "w_authors"], "left_semi").select("norm_title", "authors").distinct()
    return same.unionByName(given.join(strong, ["norm_title", "authors"], "left_semi").select("lookup_key")).distinct()


def candidate_pools(groups: DataFrame, works: DataFrame, caps: dict[int, int] | None = None, stages: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> Pools:
    """The hits of each key up to the stage of its first strong match.

    A confirmed DOI ends the search of a key. The others' full titles are searched; what has no strong match then goes through the
    later stages in one pass, and hits of stages after the first strong one are left out again. That gives
    the same pools as stage after stage, with two rounds of joins instead of six.
    """
    keys = stored(groups.withColumn("key_no", F.monotonically_increasing_id()), "keys")
    known = stored(works.repartitionByRange("work_key").sortWithinPartitions("work_key").withColumn("work_no", F.monotonically_increasing_id()), "known")
    own = keys.drop("lookup_key").withColumnRenamed("key_no", "lookup_key")
    numbered = known.drop("work_key").withColumnRenamed("work_no", "work_key")
    by_doi = stored(doi_candidates(own, numbered), "by_doi")
    open_ = stored(own.join(by_doi.select("lookup_key").distinct(), "lookup_key", "left_anti"), "open")
    titled = stored(open_.where("norm_title <> ''").join(numbered.select("norm_title").distinct(), "norm_title", "left_semi").select(F.col("lookup_key").alias("key_no"), "norm_title"), "titled")
    index = search_index(numbered, max((caps or CAPS).values()))
    asked, found = (("authors", "norm_doi", "norm_title"), ("work_key", "authors", "norm_doi", "norm_title"))

    def judged(hits: DataFrame) -> DataFrame:
        """``hits`` of other titles, with ``strong``."""
        pairs = spread(hits, "lookup_key").join(numbered.select("work_key", *(F.col(f).alias(f"w_{f}") for f in found[1:])), "work_key").join(open_.select("lookup_key", *asked), "lookup_key")
        return stored(strong_matches(pairs.where("norm_title <> w_norm_title")).select("lookup_key", "work_key", "stage", "arrival", "strong"), "judged")

    strong = _strong_titles(open_, numbered)
    hits = by_doi
    if 1 in stages:
        first = judged(_first_hits(_searched(open_, numbered, (1,), caps, index)))
        strong, hits = strong.unionByName(first.where("strong").select("lookup_key")).distinct(), hits.unionByName(first.drop("strong"))
    later = tuple(s for s in stages if s > 1)
    if later:
        left = stored(open_.join(strong, "lookup_key", "left_anti"), "left")
        fresh = _searched(left, numbered, later, caps, index)
        fresh = fresh.join(first.select("lookup_key", "work_key"), ["lookup_key", "work_key"], "left_anti") if 1 in stages else fresh
        second = judged(_first_hits(fresh))
        stop = second.where("strong").groupBy("lookup_key").agg(F.min("stage").alias("stop"))
        hits = hits.unionByName(second.join(stop, "lookup_key", "left").where("stop is null or stage <= stop").select("lookup_key", "work_key", "stage", "arrival"))
    return Pools(keys, known, hits.withColumnsRenamed({"lookup_key": "key_no", "work_key": "work_no"}), titled)


def pool_counts(pools: Pools) -> DataFrame:
    """(lookup_key, n_candidates, stage): the size of each key's pool and its first stage. Works of a title are counted, never listed for a key."""
    listed = pools.hits.groupBy("key_no").agg(F.count("*").alias("n"), F.min("stage").alias("stage"))
    by_title = pools.works.where("norm_title <> ''").groupBy("norm_title").agg(F.count("*").alias("n"))
    titled = pools.titled.join(by_title, "norm_title").select("key_no", "n", F.lit(1).alias("stage"))
    counts = listed.unionByName(titled).groupBy("key_no").agg(F.sum("n").alias("n_candidates"), F.min("stage").alias("stage"))
    return pools.keys.select("key_no", "lookup_key").join(counts, "key_no").drop("key_no")


def candidate_pool(groups: DataFrame, works: DataFrame, caps: dict[int, int] | None = None, stages: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(lookup_key, work_key, stage, arrival): the pools as pairs, those of one title listed, too."""
    pools = candidate_pools(groups, works, caps, stages)
    by_title = paired_by_title(pools.titled, pools.works.select("norm_title", "work_no"), ("key_no",), ("work_no",))
    every = pools.hits.unionByName(by_title.select("key_no", "work_no", F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("arrival")))
    return every.join(pools.works.select("work_no", "work_key"), "work_no").join(pools.keys.select("key_no", "lookup_key"), "key_no").select("lookup_key", "work_key", "stage", "arrival")


def generate_candidates(cites: DataFrame, works: DataFrame, caps: dict[int, int] | None = None, stages: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Pairs of each citation with every work in its lookup key's pool, the work's fields as w_..."""
    keyed = stored(lookup_keys(cites), "cites")
    pool = stored(candidate_pool(lookup_groups(keyed), works, caps, stages), "pool")
    return with_works(paired(keyed, pool, "lookup_key", REF, ("work_key",), KEY_TILE), works)
