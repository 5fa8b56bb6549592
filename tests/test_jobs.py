"""Whole jobs on the given tables and on small ones: each registered query against its SQL, and what SQL does not say."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citelink.functions.similarity import list_similarity
from citelink.jobs import testbed
from citelink.jobs.oracles import ORACLES
from citelink.jobs.queries import QUERIES, _paired, _works, judged_pairs
from citelink.jobs.verify import parse, verify, verify_documents
from citelink.operators import candidates, decision, extraction, judging, numbering, ranking, reports, review, works
from citelink.sources import readers, sinks
from citelink.streaming.requests import verify_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = plain(tuple(r[i] for i in at) for r in found.fetchall())
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_registered_names():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_verification_finds_the_changed_citations(spark):
    """Of the eight kinds of changes, unchanged citations are not refused, and none is verified against a conflicting DOI."""
    cites = testbed.citations(spark, SF)
    results = verify(cites, _works(spark, SF)).select("doc_id", "ref_no", "work_id", "status", "best_match", "n_hits").collect()
    assert len(results) == cites.count()
    for r in results:
        p = r["work_id"] % 8
        assert r["n_hits"] > 0
        if p == 6:
            assert r["status"] != "VERIFIED" or r["best_match"]["states"]["doi"] != "MISMATCH"
        if p == 0 and r["work_id"] % 3:
            assert r["status"] in ("VERIFIED", "UNCERTAIN", "PENDING_AI") and r["best_match"]["weighted_score"] == 100


def test_whole_citations_and_documents(spark):
    """Every record has a citation with its whole first sentence, and documents keep their own text as body."""
    records, cites = testbed.base(spark, SF), testbed.citations(spark, SF)
    assert cites.count() == records.count() and cites.select("doc_id", "ref_no").distinct().count() == records.count()
    assert cites.agg(F.max(F.length("title"))).first()[0] > 120
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("own"))
    docs = testbed.documents_with_references(spark, SF)
    assert docs.join(own, "doc_id").where("startswith(text, own)").count() == docs.count() > 0


def test_failed_citations_are_uncertain(spark):
    """A citation that could not be processed is uncertain, with the error named, whatever was found; others are as without the column."""
    cites, pairs = judged_pairs(spark, SF)
    plain_rows = {(r["doc_id"], r["ref_no"]): r["status"] for r in decision.route(decision.decide(cites, pairs)).collect()}
    broken = cites.withColumn("error", F.when(F.col("ref_no") == 1, F.lit("no answer")))
    results = decision.route(decision.decide(broken, pairs))
    for r in results.collect():
        if r["ref_no"] == 1:
            assert (r["status"], r["source"], r["best_match"], r["ranked"], r["sources_agreeing"]) == ("UNCERTAIN", decision.FAILED_SOURCE, None, None, [])
            assert r["explanation"].endswith("(not a content judgment): no answer")
        else:
            assert r["status"] == plain_rows[r["doc_id"], r["ref_no"]] and r["error"] is None
    n = cites.where("ref_no = 1").count()
    assert n > 0 and reports.status_summary(results).first()["errors"] == n


def test_job_goes_on_with_citations_that_cannot_be_processed(spark, searched):
    """Broken records and years come out as uncertain with their error; all other results are as without them."""
    cites, known = searched
    fields = F.struct(*(F.col(c).cast("string").alias(c) if c == "year" else F.col(c) for c in cites.columns))
    good = cites.select(F.to_json(fields).alias("record"))
    bad = spark.createDataFrame([("{not json",), ("",), (None,), ('{"doc_id":77,"ref_no":1,"original_reference":"x","title":"graph query","year":"soon"}',)], "record string")
    read = readers.read_citations(good.unionByName(bad))
    assert read.where("error is null").count() == cites.count() and read.count() == cites.count() + 4
    results = verify(read, known).collect()
    failed = [r for r in results if r["error"] is not None]
    assert {r["status"] for r in failed} == {"UNCERTAIN"} and len(failed) == 4 and all(r["n_hits"] == 0 for r in failed)
    assert sorted(r["error"] for r in failed)[-1] == "the year is not a number: soon"
    direct = {(r["doc_id"], r["ref_no"]): r["status"] for r in verify(cites, known).collect()}
    assert {(r["doc_id"], r["ref_no"]): r["status"] for r in results if r["error"] is None} == direct


def test_works_merged_in_steps_are_those_merged_at_once(spark, tmp_path):
    raw = testbed.works_raw(spark, SF).cache()
    want = sorted(map(repr, works.deduplicate_works(raw).collect()))
    path, columns = f"{tmp_path}/works", works.deduplicate_works(raw).columns
    for part in (1, 2, 0, 2):  # and some of them again
        got = works.update_works(raw.where(F.col("arrival") % 3 == part), path)
    assert sorted(map(repr, got.select(*columns).collect())) == want
    assert works.update_works(raw.limit(0), path).count() == len(want)
    one = raw.orderBy("arrival").limit(1)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    works.update_works(one, path)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert len({f.parent for f in before if f not in after}) == 1  # of all buckets, the one of that record alone was written


def test_batches_are_full_but_the_last(spark):
    rows = spark.range(0, 1003, 1, 7).select((F.col("id") * 37 % 1003 % 90).alias("doc_id"), F.col("id").cast("int").alias("ref_no"))
    batches = numbering.number_batches(rows, 10).collect()
    order = sorted(batches, key=lambda r: (r["doc_id"], r["ref_no"]))
    assert [r["batch"] for r in order] == [i // 10 for i in range(1003)]
    assert numbering.number_rows(rows.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, 1)], "doc_id long, ref_no int")
    assert sorted(r["row_no"] for r in numbering.number_rows(odd).collect()) == [0, 1, 2, 3]


def test_quarantine_and_readers_share_out_all_records(spark):
    whole = '{"title":["A"],"author":[],"DOI":"10.1/a"}'
    df = spark.createDataFrame([(whole,), (whole[:-1],), ("",), (None,), ("[1]",), ("nonsense",)], "record string")
    assert [r["title"] for r in readers.read_crossref(df).collect()] == ["A"]
    got = Counter((r["source"], r["reason"]) for r in readers.quarantine({"Crossref": df}).collect())
    assert got == {("Crossref", readers.BROKEN): 3, ("Crossref", readers.BLANK): 2}


def test_verdicts_that_leave_a_citation_open(spark):
    cites, pairs = judged_pairs(spark, SF)
    results = decision.route(decision.decide(cites, pairs))
    given = testbed.verdicts(results).withColumn("status", F.when(F.col("ref_no") % 2 == 0, F.lit("PENDING_AI")))
    got = review.apply_verdicts(results, given).join(given.select("doc_id", "ref_no"), ["doc_id", "ref_no"], "left_semi").collect()
    assert got and {(r["status"], r["source"], r["explanation"]) for r in got} == {("UNCERTAIN", "deterministic fallback", review.LEFT_OPEN)}


def test_texts_and_json_lines_are_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First line\n\n  second line \n")
    (tmp_path / "b.txt").write_text("only one")
    whole = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert whole == {"a.txt": "First line\n\n  second line \n", "b.txt": "only one"}
    lines = sorted(r["text"] for r in readers.read_texts(spark, str(tmp_path), whole=False).collect())
    assert lines == ["First line", "only one", "second line"]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "c.jsonl").write_text('{"title":"S","authors":[{"name":"N"}]}\n{"title":"T"}\n')
    got = readers.read_semantic_scholar(readers.read_json_lines(spark, str(tmp_path / "json"))).collect()
    assert sorted((r["title"], r["authors"]) for r in got) == [("S", ["N"]), ("T", [])]


def test_citation_without_hits_and_blank_one(spark):
    rows = [(1, 1, "x", "Zzzz qqqq xxxx wwww", ["Qqqx Zzzx"], 2000, None, None), (1, 2, "  ", None, [], None, None, None)]
    cites = spark.createDataFrame(rows, "doc_id long, ref_no int, original_reference string, title string, authors array<string>, year int, venue string, doi string")
    got = {r["ref_no"]: r for r in verify(cites, _works(spark, SF)).collect()}
    assert got[1]["status"] == "UNCERTAIN" and got[1]["explanation"] == decision.NO_HITS and got[1]["ranked"] is None
    assert got[2]["status"] == "NOT VERIFIED" and got[2]["source"] == "input validation"


def test_documents_to_verdicts(spark):
    results = verify_documents(testbed.documents_with_references(spark, SF), testbed.works_raw(spark, SF))
    known = extraction.extract_references(testbed.documents_with_references(spark, SF)).count()
    assert results.count() == known > 0
    assert results.where("status = 'VERIFIED' or status = 'UNCERTAIN' or status = 'PENDING_AI'").count() > known / 2


def test_merging_keeps_first_values(spark):
    rows = [("A title", [], "10.1/A", 0, None, "DBLP", 2), ("", ["X"], "https://doi.org/10.1/a", 2001, "V", "PubMed", 3), ("Other", ["Y"], "10.1/a", 2002, "W", "Crossref", 4), ("No doi!", ["Z"], None, 1, None, "DBLP", 1), ("no DOI", [], "n/a", 5, "Q", "DBLP", 0), ("", [], None, 1, "", "DBLP", 9)]
    df = spark.createDataFrame(rows, "title string, authors array<string>, doi string, year int, venue string, source string, arrival long")
    got = {r["work_key"]: r for r in works.deduplicate_works(df).collect()}
    first, second = got["doi:10.1/a"], got["title:no doi"]
    assert (first["title"], first["authors"], first["year"], first["venue"], first["sources"]) == ("A title", ["X"], 2001, "V", ["Crossref", "DBLP", "PubMed"])
    assert (second["title"], second["authors"], second["year"], second["sources"]) == ("no DOI", ["Z"], 5, ["DBLP"]) and len(got) == 2


def test_readers_take_odd_records(spark):
    def read(f, *records):
        return f(spark.createDataFrame([(r,) for r in records], "record string")).collect()

    got = read(readers.read_crossref, '{"DOI":"10.1/a"}', '{"title":["T","U"],"author":[{"family":"B"},{"given":"A","family":"C"}],"issued":{"date-parts":[[null]]}}', "not json")
    assert [(r["title"], r["authors"], r["year"]) for r in got[:2]] == [("", [], None), ("T", ["B", "A C"], None)]
    got = read(readers.read_openalex, '{"title":null,"display_name":"D","authorships":[{"author":null},{"author":{"display_name":"N"}}],"doi":"https://doi.org/10.1/B","primary_location":null}')
    assert (got[0]["title"], got[0]["authors"], got[0]["doi"], got[0]["venue"]) == ("D", ["N"], "10.1/b", None)
    got = read(readers.read_dblp, '{"result":{"hits":{"hit":{"info":{"title":"One","authors":{"author":{"text":"A"}},"year":"2001"}}}}}', '{"result":{"hits":{"hit":[{"info":{"title":"X"}},{"info":{"title":"Y","year":"n"}}]}}}', '{"result":{"hits":{}}}')
    assert [(r["title"], r["authors"], r["year"]) for r in got] == [("One", ["A"], 2001), ("X", [], None), ("Y", [], None)]
    got = read(readers.read_semantic_scholar, '{"title":"S","externalIds":null,"authors":[{"name":"N"}]}')
    assert (got[0]["doi"], got[0]["authors"]) == (None, ["N"])
    got = read(readers.read_pubmed, '{"title":"P","articleids":[{"idtype":"pubmed","value":"1"}],"pubdate":"Winter","source":"S"}', '{"title":"Q","articleids":[{"idtype":"doi","value":"10.1/q"}],"pubdate":"2011 Jan","fulljournalname":"F","source":"S"}')
    assert [(r["doi"], r["year"], r["venue"]) for r in got] == [(None, None, "S"), ("10.1/q", 2011, "F")]


ASKED = "lookup_key string, source string, place int, stage int, fields string, text string"
KNOWN = "work_key string, norm_title string, authors array<string>, sources array<string>"


def plain_impacts(known):
    """{(source, fields, word): {work_key: impact}} by BM25 in whole numbers, from dicts of works."""
    texts, lists = {}, {}
    for w in known:
        title, names = w["norm_title"].split(), " ".join(w["authors"]).replace(".", " ").lower().split()
        more = f"{w.get('venue') or ''} {w.get('year') or ''}".lower().split()
        for source in w["sources"]:
            for fields, words in (("title", title), ("both", title + names), ("record", title + names + more)):
                if words:
                    texts.setdefault((source, fields), {})[w["work_key"]] = words
    for kind, of in texts.items():
        mean = max(1000 * sum(map(len, of.values())) // len(of), 1)
        df = Counter(t for words in of.values() for t in set(words))
        for key, words in of.items():
            for t, tf in Counter(words).items():
                rarity = math.floor(1000 * math.log(1 + len(of) / df[t]))
                lists.setdefault((*kind, t), {})[key] = rarity * tf * 2200 // (1000 * tf + 300 + 900_000 * len(words) // mean)
    return lists


def plain_hits(lists, titles, source, fields, text, cap):
    """[(work_key, score)]: the best works of a search that reads every list."""
    scores = Counter()
    for t in set(text.split()):
        for k, impact in lists.get((source, "title" if fields == "phrase" else fields, t), {}).items():
            scores[k] += impact
    return sorted(((k, s) for k, s in scores.items() if fields != "phrase" or f" {text} " in f" {titles[k]} "), key=lambda x: (-x[1], x[0]))[:cap]


def many_works(n, seed=3):
    rng = random.Random(seed)
    pick = lambda n: rng.choices([f"c{i}" for i in range(6)] + [f"r{i}" for i in range(40)], [20] * 6 + [1] * 40, k=n)
    titles = {f"w{i:05}": " ".join(pick(rng.choice([4, 8, 12]))) for i in range(n)}
    asked = {f"q{i}": " ".join(pick(rng.choice([3, 6, 9]))) for i in range(30)} | {"common": "c0 c1 c2 c3 c4 c5", "odd": "none c1 r1 c2 c3 c4 c5", "nothing": "none at all"}
    return titles, asked


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("cap", [1, 5, 150])
def test_pruned_search_is_a_search_of_all_lists(spark, monkeypatch, block, cap):
    """Whatever the blocks and caps, hits and scores are those of a plain search by all words, phrases included."""
    monkeypatch.setattr(candidates, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(candidates, "PART_BLOCKS", 4)
    titles, asked = many_works(200)
    known = [{"work_key": k, "norm_title": t, "authors": ["A. Ito"], "sources": ["Crossref", "DBLP"]} for k, t in titles.items()]
    searches = [(f"{q}|{fields}", "Crossref", 0, 1, fields, t) for q, t in asked.items() for fields in ("title", "both", "record")]
    searches += [(f"{q}|phrase", "Crossref", 0, 1, "phrase", " ".join(t.split()[1:3])) for q, t in titles.items() if q < "w00040"] + [("none|phrase", "Crossref", 0, 1, "phrase", "c0 none c1"), ("empty|phrase", "Crossref", 0, 1, "phrase", "")]
    lists = plain_impacts(known)
    want = [(q, k, s, n) for q, source, _, _, fields, text in searches for n, (k, s) in enumerate(plain_hits(lists, titles, source, fields, text, cap), 1)]
    works_table = spark.createDataFrame([tuple(w.values()) for w in known], KNOWN)
    got = candidates.search_topk(spark.createDataFrame(searches, ASKED), works_table, {1: cap}).select("lookup_key", "work_key", "score", "hit_no").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("postings", "searches", "cap"), [(150, 7, 5), (150, 7, 1), (10**6, 10**6, 150), (40, 1000, 20)])
def test_search_in_cells_is_a_search_of_all_lists(spark, monkeypatch, postings, searches, cap):
    """However documents and searches are dealt into cells, hits and scores are those of a plain search by all words; copies count as often as there are works of them."""
    monkeypatch.setattr(candidates, "FEW_POSTINGS", 0)
    monkeypatch.setattr(candidates, "CELL_POSTINGS", postings)
    monkeypatch.setattr(candidates, "CELL_SEARCHES", searches)
    titles, asked = many_works(100)
    titles |= {f"x{i:03}": "r1 c1 r2 copied" for i in range(30)}
    known = [{"work_key": k, "norm_title": t, "authors": ["A. Ito"], "sources": ["Crossref", "DBLP"]} for k, t in titles.items()]
    wanted = [(f"{q}|{fields}", "Crossref", 0, 1, fields, t) for q, t in asked.items() for fields in ("title", "both", "record")]
    wanted += [("copies", "DBLP", 0, 1, "title", "r1 copied"), ("words|phrase", "Crossref", 0, 1, "phrase", "c1 r2 copied"), ("empty", "DBLP", 0, 1, "title", "")]
    lists = plain_impacts(known)
    want = [(q, k, s, n) for q, source, _, _, fields, text in wanted for n, (k, s) in enumerate(plain_hits(lists, titles, source, fields, text, cap), 1)]
    works_table = spark.createDataFrame([tuple(w.values()) for w in known], KNOWN)
    got = candidates.search_topk(spark.createDataFrame(wanted, ASKED), works_table, {1: cap}).select("lookup_key", "work_key", "score", "hit_no").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_searches_of_common_words_give_their_best_documents_only(spark):
    """A thousand searches of common words over a thousand texts: millions of postings are added up, and each cell gives no more than the cap's documents of a search."""
    titles = {f"w{i:04}": f"c0 c1 c2 c3 r{i % 50} s{i}" for i in range(1000)}
    index = candidates.search_index(spark.createDataFrame([(k, t, ["A"], ["DBLP"]) for k, t in titles.items()], KNOWN))
    rows = [(i, "DBLP", "title", f"c0 c1 c2 c3 r{i % 50} s{i}".split(), 3) for i in range(1000)]
    asked = spark.createDataFrame(rows, "q_no long, source string, fields string, tokens array<string>, cap int")
    terms = candidates.query_terms(asked, index)
    got = candidates.cell_hits(asked, terms, index).collect()
    assert terms.agg(F.sum("length")).first()[0] > 4_000_000 and len(got) == 3 * len(rows)
    first = {r["q_no"]: r["doc_no"] for r in sorted(got, key=lambda r: r["score"])}
    text = {r["doc_no"]: r["title"] for r in index.docs.where("source = 'DBLP' and fields = 'title'").collect()}
    assert all(text[d] == titles[f"w{q:04}"] for q, d in first.items())


def test_common_words_are_only_looked_up_where_they_matter(spark):
    """Twenty thousand texts of common words and a rare one: a search sums its rare words' lists, and of the common ones what its best documents need."""
    docs = {"doc_no": range(20_000), "works": [[i] for i in range(20_000)], "tokens": [[0, 1, 2, 3, 10 + i // 10] for i in range(20_000)], "impacts": [[2, 3, 4, 5, 9_000 + i % 10] for i in range(20_000)]}
    cell = candidates._Cell(pa.table({k: pa.array(list(v)) for k, v in docs.items()}))
    rows, score = cell.best(np.searchsorted(cell.words, [0, 1, 2, 3, 17]), 3)
    assert 3 <= len(rows) <= 10 and max(score) == 9_009 + 14 and not cell.sums.any()
    rows, places, score = cell.works_of(rows, score, 3)
    assert places.tolist() == [79, 78, 77] == rows.tolist() and score.tolist() == [9_023, 9_022, 9_021]


def test_documents_are_copied_for_cores_not_for_some_thousand_searches(spark):
    index = candidates.search_index(spark.createDataFrame([(f"w{i}", f"c{i % 7} r{i}", ["A"], ["DBLP"]) for i in range(50)], KNOWN))
    parts = {n: candidates.cell_parts(spark.range(n).selectExpr("'DBLP' source", "'title' fields"), index).first() for n in (10, 60_000, 600_000)}
    assert [parts[n]["parts"] for n in (10, 60_000, 600_000)] == [1, 4, 10] and {r["of_parts"] for r in parts.values()} == {1}


def test_pairs_of_one_title_are_the_work_of_many_tasks(spark, monkeypatch):
    """A million pairs of one title, and a few of others: all are listed, each once, and no task lists more than a third of them."""
    monkeypatch.setattr(candidates, "TILE", 50, raising=False)
    groups = spark.range(1003).select(F.concat(F.lit("k"), F.col("id")).alias("lookup_key"), F.when(F.col("id") < 1000, "t").when(F.col("id") == 1000, "u").when(F.col("id") == 1001, "").otherwise("v").alias("norm_title"))
    known = spark.range(1004).select(F.concat(F.lit("w"), F.col("id")).alias("work_key"), F.when(F.col("id") < 1000, "t").when(F.col("id") < 1002, "u").when(F.col("id") == 1002, "").otherwise("w").alias("norm_title"))
    pairs = candidates.title_candidates(groups, known).withColumn("task", F.spark_partition_id())
    rows = {r["task"]: (r["n"], r["keys"]) for r in pairs.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("lookup_key", "work_key").alias("keys")).collect()}
    assert sum(n for n, _ in rows.values()) == 1_000_002 == pairs.select("lookup_key", "work_key").distinct().count()
    assert max(n for n, _ in rows.values()) < 333_000 and all(n == k for n, k in rows.values())
    assert sorted(r["work_key"] for r in pairs.where("lookup_key in ('k1000', 'k1001', 'k1002')").collect()) == ["w1000", "w1001"]


def test_pairs_of_one_lookup_key_are_the_work_of_many_tasks(spark, monkeypatch):
    """Six hundred citations of one key and a thousand works of its title: no task gets more than a third of their pairs."""
    cites = spark.range(600).selectExpr("id doc_id", "1 ref_no", "'Query plans of graphs' title", "array('A. Ito') authors", "2000 year", "'V' venue", "cast(null as string) doi")
    known = spark.range(1000).selectExpr("concat('w', id) work_key", "'Query plans of graphs' title", "array('A. Ito') authors", "2000 year", "'V' venue", "concat('10.1/', id) doi", "'DBLP' source", "array('DBLP') sources", "id arrival", "concat('10.1/', id) norm_doi", "'query plans of graphs' norm_title")
    pairs = candidates.generate_candidates(cites, known, {1: 2}, (1,)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in pairs) == 600_000 and max(r["count"] for r in pairs) < 200_000


def test_pools_count_works_of_a_title_without_listing_them(spark):
    """Six hundred keys and a thousand works of one title: pools are counted, and nothing that is made has a row for each pair."""
    fields = ("'Query plans of graphs' title", "array('A. Ito') authors", "2000 year", "'V' venue")
    cites = spark.range(600).selectExpr("id doc_id", "1 ref_no", *fields, "concat('10.2/', id) doi")
    known = spark.range(1000).selectExpr("concat('w', id) work_key", *fields, "concat('10.1/', id) doi", "'DBLP' source", "array('DBLP') sources", "id arrival", "concat('10.1/', id) norm_doi", "'query plans of graphs' norm_title")
    groups = candidates.lookup_groups(candidates.lookup_keys(cites))
    pools = candidates.candidate_pools(groups, known, {s: 2 for s in range(1, 7)})
    got = candidates.pool_counts(pools).collect()
    assert len(got) == 600 and {(r["n_candidates"], r["stage"]) for r in got} == {(1000, 1)}
    assert pools.hits.count() + pools.titled.count() <= 600
    listed = candidates.candidate_pool(groups, known, {s: 2 for s in range(1, 7)})
    assert listed.count() == 600_000 == listed.select("lookup_key", "work_key").distinct().count()


def test_works_of_a_title_are_judged_in_arrays_as_pair_by_pair(spark):
    """Many works of few titles, with DOIs that match, differ in a hyphen or are missing, and odd authors, years and venues: results are those of all pairs as rows, places included."""
    rng = random.Random(5)
    names = [["A. Ito"], ["B. Ito", "C. Orlov"], ["C. Orlov"], ["D. Quill", "E. Tanner"], [], None]
    record = lambda i, doi: (f"{('Query plans of graphs', 'Short', 'Machine learning')[i % 3]}", rng.choice(names), rng.choice([None, 0, 1999, 2000, 2001, 2005]), rng.choice([None, "", "Letters", "Journal of Plans"]), doi)
    known = [(f"w{i:03}", *record(i, rng.choice([None, f"10.1/{i}"])), rng.choice(["DBLP", "PubMed"]), i) for i in range(90)]
    cites = [(i // 7, i % 7, f"c{i}", *record(i, rng.choice([None, f"10.1/{rng.randrange(90)}", f"10.-1/{rng.randrange(90)}", "10.9/x"]))) for i in range(60)]
    fields = "title string, authors array<string>, year int, venue string, doi string"
    cites = spark.createDataFrame(cites, f"doc_id long, ref_no int, original_reference string, {fields}")
    known = works.with_keys(spark.createDataFrame(known, f"work_key string, {fields}, source string, arrival long").withColumn("sources", F.array("source"))).cache()
    want = decision.route(decision.decide(cites, ranking.score_pairs(candidates.generate_candidates(cites, known, {1: 2}, (1,))))).collect()
    got = verify(cites, known, (1,), {1: 2}).select(*want[0].asDict()).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and max(r["best_match"]["rank"] for r in want if r["best_match"]) > 5


def test_pairs_of_one_title_never_become_rows(spark):
    """Six hundred citations and a thousand works of one title: some works of each citation are picked, the others counted."""
    keyed = candidates.lookup_keys(spark.range(600).selectExpr("id doc_id", "1 ref_no", "'Query plans of graphs' title", "array('A. Ito') authors", "cast(1990 + id % 30 as int) year", "'V' venue", "concat('10.2/', id) doi"))
    known = works.with_keys(spark.range(1000).selectExpr("concat('w', id) work_key", "'Query plans of graphs' title", "array('A. Ito') authors", "cast(1990 + id % 30 as int) year", "'V' venue", "if(id = 500, null, concat('10.1/', id)) doi"))
    picks = judging.title_picks(keyed, known).collect()
    assert len(picks) == 600 and all(r["n"] == 1000 == r["counts"][-1] and len(r["picked"]) == 6 and len(r["levels"]) == 3 for r in picks)


def test_common_words_lists_are_left_alone(spark):
    """With ten times the works, a search with rare words meets about as many postings of common words as before, not ten times as many."""
    met = []
    for n in (300, 3000):
        titles, _ = many_works(n)
        titles |= {f"x{i:03}": f"rare{i % 3} word{i % 3} c0 c1" for i in range(60)}
        index = candidates.search_index(spark.createDataFrame([(k, t, ["A"], ["Crossref"]) for k, t in titles.items()], KNOWN))
        asked = spark.createDataFrame([(i, "Crossref", "title", f"rare{i} word{i} c0 c1 c2 c3".split(), 10) for i in range(3)], "q_no long, source string, fields string, tokens array<string>, cap int")
        terms = candidates.query_terms(asked, index)
        rows = candidates.postings_met(terms, candidates.first_bounds(terms, index), index).count()
        met.append((rows, terms.agg(F.sum("df")).first()[0]))
    assert met[1][0] <= 1.5 * met[0][0] and met[1][1] > 5 * met[0][1] and met[1][0] < 0.1 * met[1][1]


def test_failed_batches_get_the_rules_verdict(spark):
    cites, pairs = judged_pairs(spark, SF)
    results = decision.route(decision.decide(cites, pairs)).withColumn("failed", F.lit(True))
    got = review.apply_verdicts(results, testbed.verdicts(results), failed="failed")
    assert got.where("status = 'PENDING_AI'").count() == 0
    assert got.where(F.col("source") == "AI verification").where(~F.col("explanation").startswith(review.UNAVAILABLE)).count() == 0
    assert got.where(F.col("source") == "AI verification").count() > 0


def test_only_so_many_hits_are_checked(spark):
    cites, pairs = judged_pairs(spark, SF)
    got = decision.decide(cites, pairs, max_checked=1).where("n_hits > 0").select("best_match.rank").distinct().collect()
    assert [r[0] for r in got] == [1]


def test_report_is_written_in_order(spark, tmp_path):
    cites, pairs = judged_pairs(spark, SF)
    results = decision.route(decision.decide(cites, pairs))
    sinks.write_report(results, f"{tmp_path}/report")
    back = spark.read.option("header", "true").csv(f"{tmp_path}/report")
    assert back.columns == ["doc_id", *sinks.REPORT_COLUMNS] and back.count() == results.count()


def test_stream_searches_a_key_once(spark, tmp_path):
    text = testbed.citations_text(spark, SF).select("doc_id", "ref_no", "original_reference").cache()
    known = _works(spark, SF)

    def run():
        query = verify_stream(spark, f"{tmp_path}/in", known, f"{tmp_path}/out", f"{tmp_path}/pools", f"{tmp_path}/state")
        query.awaitTermination()

    text.where("ref_no <= 5").write.json(f"{tmp_path}/in")
    run()
    before = spark.read.parquet(f"{tmp_path}/pools").count()
    text.write.mode("append").json(f"{tmp_path}/in")
    run()
    pools = spark.read.parquet(f"{tmp_path}/pools")
    assert pools.where("batch_id = 0").count() == before
    assert pools.groupBy("lookup_key").agg(F.count_distinct("batch_id").alias("n")).where("n > 1").count() == 0
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where("batch_id = 1").count() == text.count()
    direct = {(r["doc_id"], r["ref_no"]): r["status"] for r in verify(parse(text), known).collect()}
    assert {(r["doc_id"], r["ref_no"]): r["status"] for r in got.where("batch_id = 1").collect()} == direct


def plain_ratio(a, b):
    """The Indel ratio by the classic table."""
    if a == b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 100.0 * (1 - (len(a) + len(b) - 2 * row[-1]) / (len(a) + len(b)))


def plain_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    return max(plain_ratio(f"{shared} {p}".strip(), shared), plain_ratio(f"{shared} {q}".strip(), shared), plain_ratio(f"{shared} {p}".strip(), f"{shared} {q}".strip())) if shared else plain_ratio(p, q)


def in_order(s):
    return " ".join(sorted(s.split()))


def staged_plainly(groups, known, searches, caps):
    """{(lookup_key, work_key): (stage, arrival)}: stage after stage for each key, until one has a strong match."""
    lists = plain_impacts([w.asDict() for w in known.values()])
    titles = {k: w["norm_title"] for k, w in known.items()}
    pool = {}
    for g in groups:
        key = g["lookup_key"]
        by_doi = [k for k, w in known.items() if g["norm_doi"] and w["norm_doi"] == g["norm_doi"] and set(w["sources"]) & set(candidates.DOI_SOURCES)]
        seen = dict.fromkeys(by_doi, (0, 0))
        for stage in () if by_doi else range(1, 7):
            hits = {k: (1, 0) for k, w in known.items() if stage == 1 and g["norm_title"] and w["norm_title"] == g["norm_title"]}
            for q in searches.get((key, stage), []):
                for at, (k, _) in enumerate(plain_hits(lists, titles, q["source"], q["fields"], q["text"], caps[stage]), 1):
                    hits[k] = min(hits.get(k, (9, 0)), (stage, stage * 1_000_000 + q["place"] * 1_000 + at))
            fresh = {k: v for k, v in hits.items() if k not in seen}
            seen |= fresh
            if any(strong_plainly(g, known[k]) for k in fresh):
                break
        pool |= {(key, k): v for k, v in seen.items()}
    return pool


def strong_plainly(g, w):
    a, b = g["norm_title"], w["norm_title"]
    alike = bool(a and b) and max(plain_set_ratio(a, b), plain_ratio(a, b), plain_ratio(in_order(a), in_order(b))) >= 95
    return bool(g["norm_doi"]) and g["norm_doi"] == w["norm_doi"] or alike and list_similarity(g["authors"], w["authors"]) >= 90


def scored_plainly(c, w):
    """Rounded title score, weighted score and whether the DOIs are equal."""
    a, b = c["norm_title"], w["norm_title"]
    title = max(plain_ratio(in_order(a), in_order(b)), plain_ratio(a.replace(" ", ""), b.replace(" ", ""))) if a and b else 0.0
    year = 50.0 if c["year"] is None else {0: 100.0, 1: 75.0}.get(abs(c["year"] - w["year"]), 0.0)
    weighted = 0.5 * title + 0.35 * list_similarity(c["authors"], w["authors"]) + 0.15 * year
    short, long = sorted((a, b), key=len)
    if len(short) >= 8 and long.startswith(short):
        weighted = max(weighted, 90.0)
    same = bool(c["norm_doi"]) and c["norm_doi"] == w["norm_doi"]
    cut = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
    return cut(title), 100.0 if same else cut(weighted), same


@pytest.fixture(scope="module")
def searched(spark):
    """Citations that are found by DOI, by title, at later stages and not at all, and records that share many words."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("graph", "query", "on", "sorting", "stream", "the", "model", "cell") for b in ("", "ing", "ate", "s", "able")]
    names = [f"{x}. {y}" for x in "ABC" for y in ("Orlov", "Maddox", "Quill", "Tanner")]
    records, cites = [], []
    for i in range(60):
        title = " ".join(rng.sample(vocabulary, rng.choice([3, 5, 7, 9])))
        authors, doi, year = rng.sample(names, 3), f"10.1/r{i}" if i % 3 else None, 1990 + i % 30
        for s in rng.sample(list(readers_of()), rng.choice([1, 2, 3])):
            records.append((title, authors, doi, year, "Letters", s, len(records)))
        words = title.split()
        kind = i % 10
        said = {1: words[1:], 2: words[: len(words) // 2 + 1], 3: sorted(words), 4: rng.sample(vocabulary, 4), 5: words[:2] + rng.sample(vocabulary, 5), 6: []}.get(kind, words)
        cites.append((i // 7, i % 7 + 1, f"citation {i}", " ".join(said), rng.sample(names, 2) if kind in (0, 4) else authors, None if kind == 7 else year + kind % 3, "Letters", doi if kind in (8, 9) else "10.1/none" if kind == 3 else None))
    cites.append((99, 1, "again", cites[0][3], cites[0][4], 2000, None, None))
    known = works.deduplicate_works(spark.createDataFrame(records, "title string, authors array<string>, doi string, year int, venue string, source string, arrival long")).cache()
    return spark.createDataFrame(cites, "doc_id long, ref_no int, original_reference string, title string, authors array<string>, year int, venue string, doi string"), known


def readers_of():
    return ("Crossref", "OpenAlex", "DBLP", "Semantic Scholar", "PubMed")


@pytest.mark.parametrize("caps", [candidates.CAPS, dict.fromkeys(range(1, 7), 2)], ids=["given", "small"])
def test_pools_are_those_of_stage_after_stage(spark, searched, caps):
    cites, known = searched
    keyed = candidates.lookup_keys(cites)
    groups = candidates.lookup_groups(keyed).cache()
    by_key = {w["work_key"]: w for w in known.collect()}
    searches = {}
    for q in candidates.stage_queries(groups).collect():
        searches.setdefault((q["lookup_key"], q["stage"]), []).append(q)
    want = staged_plainly(groups.collect(), by_key, searches, caps)
    got = {(r["lookup_key"], r["work_key"]): (r["stage"], r["arrival"]) for r in candidates.candidate_pool(groups, known, caps).collect()}
    assert got == want and len({stage for stage, _ in want.values()}) >= 4
    pairs = candidates.generate_candidates(cites, known, caps)
    counts = Counter(key for key, _ in want)
    expected = {(c["doc_id"], c["ref_no"]): counts[c["lookup_key"]] for c in keyed.collect() if counts[c["lookup_key"]]}
    assert {(r["doc_id"], r["ref_no"]): r["n_candidates"] for r in works.candidate_counts(pairs).collect()} == expected


def test_verification_equals_plain_search_and_scores(spark, searched):
    """Hits, best scores and statuses without hits of the whole job are those of a plain search that scores pair by pair."""
    cites, known = searched
    groups = candidates.lookup_groups(candidates.lookup_keys(cites)).collect()
    by_key = {w["work_key"]: w for w in known.collect()}
    searches = {}
    for q in candidates.stage_queries(spark.createDataFrame(groups)).collect():
        searches.setdefault((q["lookup_key"], q["stage"]), []).append(q)
    pool = staged_plainly(groups, by_key, searches, candidates.CAPS)
    results = {(r["doc_id"], r["ref_no"]): r for r in verify(cites, known).collect()}
    assert len(results) == cites.count()
    for c in candidates.lookup_keys(cites).collect():
        scores = [scored_plainly(c, by_key[k]) for key, k in pool if key == c["lookup_key"]]
        own = [s for s in scores if s[0] >= 50 or s[2]] or scores
        r = results[c["doc_id"], c["ref_no"]]
        assert r["n_hits"] == len(own), c
        if own:
            assert r["ranked"][0]["weighted_score"] == pytest.approx(max(s[1] for s in own), abs=0.1), c
        else:
            assert (r["status"], r["explanation"]) == ("UNCERTAIN", decision.NO_HITS)


def test_works_of_one_text_are_one_document(spark):
    """Of 500 works of one title a search lists one document, and its hits are the first of them by key; equal searches of many keys are one."""
    known = spark.createDataFrame([(f"k{i:03}", "graph query plans", ["A. Ito"], ["DBLP"]) for i in range(500)] + [("a", "graph query", ["A. Ito"], ["DBLP"])], KNOWN)
    index = candidates.search_index(known)
    assert index.docs.where("fields = 'title'").count() == 2
    searches = [(f"q{i}", "DBLP", 0, 1, "title", "query plans") for i in range(30)]
    hits = candidates.search_topk(spark.createDataFrame(searches, ASKED), known, {1: 20}, index).collect()
    assert sorted((r["lookup_key"], r["hit_no"], r["work_key"]) for r in hits) == sorted((q[0], n + 1, f"k{n:03}") for q in searches for n in range(20))


def test_pairs_of_copies_are_counted_not_listed(spark):
    """Nine thousand million pairs of one title, by year and DOI, come from counts."""
    n = 30_000
    cites = spark.range(n).select(F.lit("t").alias("title"), (F.col("id") % 2).alias("year"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("10.1/a-"), F.col("id"))).otherwise("").alias("norm_doi"))
    known = spark.range(10 * n).select(F.lit("t").alias("title"), F.lit(7).alias("w_year"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.1/a"), F.col("id"))).otherwise("").alias("w_norm_doi"))
    got = {(r["year"], r["doi_state"]): r["n"] for r in _paired(cites, known, ("title",), ("year",), ("w_year",)).collect()}
    assert sum(got.values()) == 10 * n * n
    assert got[0, "MATCH"] == n // 6 and (1, "MATCH") not in got and got[0, "MISMATCH"] == n // 6 * 5 * n - n // 6
