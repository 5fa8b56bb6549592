"""Vectors, pages, pieces and the pipeline against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citelink.llm import embed_dup, html_text, mixing, pieces
from test_documents import brute_lines, shingles, union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_links(rows, cosine=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: [j for j in unit if j != i and i in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i, _ in rows}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile", [5, 1024])
def test_near_vectors(spark, kind, tile):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(300):
        v = centres[rng.integers(40)] * rng.choice([0.5, 3.0]) if i % 3 else rng.standard_normal(16)
        v = v + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2]) * np.linalg.norm(v) / 4
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + k, rows[4][1]) for k in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0] * 3), (2009, [2.0] * 3), (2010, [1.0, 0.0, 0.0]), (2011, [1.0]), (2007, [1e-30] * 16), (2008, [1e30] * 16)]
    short = rng.standard_normal((12, 5))
    rows += [(3000 + i, [float(np.float32(x)) for x in short[i % 12] + 0.05 * rng.standard_normal(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dup.near_vectors(df, tile=tile).collect()}
    assert got == brute_links(rows)


def test_near_vectors_of_an_empty_table(spark):
    assert embed_dup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embed_dup.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


@pytest.mark.parametrize("rows", [500, 50_000, 100_000_000, 10_000_000_000])
def test_caps_lose_no_pair_at_the_threshold(rows):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    code = embed_dup.Code(64, rows)
    keys = [set((r * code.filters + f).tolist()) for r, f in (code.decode(x), code.decode(y))]
    met = {k // code.filters for k in keys[0] & keys[1]}
    assert len(met) >= 1999
    assert sum(w.nbytes for parts in code.codes for w in parts) <= embed_dup.CODE_BYTES
    total = 0
    if rows > 1_000_000:
        return
    for parts in code.codes:
        scores = x[:5] @ parts[0]
        for w in parts[1:]:
            scores = (scores[:, :, None] + (x[:5] @ w)[:, None, :]).reshape(5, -1)
        total += (scores >= code.alpha).sum()
    assert len(code.decode(x[:5])[0]) == total


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words only", "plain words only"),
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; x</h1><p><b>First\n  line.<br><p>Second   &eacute;</article><footer>&copy;</footer>", "T & x\nFirst line.\nSecond é"),
    ('<div class="ad">Buy now, a very long advert text that goes on and on and on</div><div id="content"><p>Real text here.</p><p>More of it.</p></div>', "Real text here.\nMore of it."),
    ('<main><p>Text of the page</p><section class="comments"><p>I disagree with all of it, at length</p></section><aside>side</aside><form><input>send</form></main>', "Text of the page"),
    ('<article><p>a<script>var t="</p><p>";</script> b</p><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>', "a b\none\ntwo\nc\nd"),
    ("<article><!-- hidden <p>x</p> --><p>shown</p><style>p{}</style></article>", "shown"),
    ('<p title="a > b">kept</p>', "kept"),
    ("<p>" * 2000 + "deep", "deep"),
    ("<div>" * 2000 + "deep words", "deep words"),
    ("<<<>>> & &amp; &#65; &nbsp;x", "<<<>>> & & A x"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}
    assert html_text.extract_text(df.limit(0)).count() == 0


LINES = ["Title here", "This is the first paragraph of the article, long enough.", "And another one follows it, with more words."]
TITLE, BODY = f"<h1>{LINES[0]}</h1>", "".join(f"<p>{x}</p>" for x in LINES[1:])


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content no-sidebar">{TITLE}{BODY}</div>',
        f'<div id="page" class="layout with-sidebar">{TITLE}{BODY}</div>',
        f'<div class="legal">{TITLE}{BODY}</div>',
        f'<article><div class="entry-header">{TITLE}</div>{BODY}</article>',
        f'<div class="elementor-widget-text-editor">{TITLE}{BODY}</div><div class="sidebar">side</div>',
        f'<form id="aspnetForm">{TITLE}{BODY}</form>',
        f'<article>{TITLE}{BODY}</article><div class="userComments"><p>I do not agree.</p></div>',
        f'<article>{TITLE}{BODY}</article><div id="comments"><article class="comment-body">{"<p>I do not agree, and at length.</p>" * 20}</article></div>',
        f"<nav>Home, about<article>{TITLE}{BODY}</article>",
        f'<div class="content-sidebar-wrap"><div class="col">{TITLE}{BODY}</div><div class="sidebar-primary"><p>side text</p></div></div>',
    ],
)
def test_names_only_hint_at_surroundings(page):
    assert html_text.main_text(page) == "\n".join(LINES)


@pytest.mark.parametrize("piece", ["<a '", "<b>|</i>", "<i><div>|<b>|</i>", "<td>", "<a \">\" ", "<a ", "<a \"'>", "<object>", '<div class="ad">'])
def test_broken_pages_take_linear_time(piece):
    """Ten times the page takes about ten times as long, never a hundred."""
    import time

    def took(n):
        parts = piece.split("|")
        page = parts[0] * (n if len(parts) < 3 else 1) + "".join(x * n for x in parts[1:])
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    assert took(60_000) < 40 * max(took(6_000), 0.01)


def test_repeated_pages(spark):
    rows = [(1, "<p>one text</p>"), (1, "<p>one text</p>"), (None, "<p>two</p>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted(r["text"] for r in got) == ["one text", "one text", "two"]


def test_main_text_of_pages_without_names(spark):
    """Without classes, ids and tags that mean something, text density alone finds the article on nearly all pages."""
    import html

    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        blocks = re.sub(r"</?(?:p|h1)>", "\0", re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks.split("\0"))
        bare = re.sub(r"<(/?)(nav|header|footer|aside|article|main|section|form|button)\b[^>]*>", r"<\1div>", r["html"])
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|\S+?(?=[\s>]))", "", bare)
        right += html_text.main_text(bare) == "\n".join(x for x in lines if x)
        total += 1
    assert right >= 0.98 * total


def test_main_text_of_all_pages(spark):
    """On the given pages the article is marked up, so the right text is known."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(rows).collect()}
    for r in rows.collect():
        blocks = re.sub(r"</?(?:p|h1)>", "\0", re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks.split("\0"))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


TEXTS = [None, "", " ", "  two", "end ", "a▁b", "<s> </s> <unk>", "Ünï\n\n\tçödé 中文 😀", "x" * 3000, "中" * 700, "word " * 500, "\x00\x01\x7f", "the quick brown fox"]


def test_pieces_round_trip(spark):
    rows = [(i, t, "keep me") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    coded = pieces.encode(df)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()}
    assert back == dict(enumerate(TEXTS))
    one = {r["doc_id"]: r["pieces"] for r in coded.collect()}
    other = {r["doc_id"]: r["pieces"] for r in pieces.encode(df.repartition(7)).collect()}
    assert one == other and one[0] is None and one[1] == []
    assert {r["doc_id"]: r["pieces"] for r in pieces.encode(df, seed=1).collect()} != one
    assert pieces.digests(df).where("not lossless").count() == 0
    assert pieces.encode(df.limit(0)).count() == 0


def test_pieces_follow_the_lattice():
    """Sampled segmentations come as often as their weights say."""
    from collections import Counter
    from math import exp

    with open(pieces.MODEL_PATH, "rb") as f:
        p = pieces.Pieces(f.read())

    def ways(u):
        if not u:
            yield (), 0.0
        for k in range(1, len(u) + 1):
            if u[:k] in p.ids:
                for rest, w in ways(u[k:]):
                    yield (p.ids[u[:k]][0], *rest), w + p.ids[u[:k]][1]

    weights = {k: exp(w) for k, w in ways(" oranges")}
    n, total = 40_000, sum(weights.values())
    ids, cuts = p.encode(["oranges"] * n, np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]))
    assert set(seen) <= set(weights) and len(weights) > 10
    assert max(abs(seen[k] / n - w / total) for k, w in weights.items()) < 0.01


def vocabulary():
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.Pieces(f.read())


def test_long_units_are_cut_where_no_piece_crosses():
    p, rng = vocabulary(), random.Random(5)
    longest = max(map(len, p.ids))
    for letters in ("etaoin", "qxzkjv", "ab中文字é"):
        unit = "".join(rng.choice(letters) for _ in range(300))
        parts = p._parts(unit)
        cuts = set(np.cumsum([len(x) for x in parts])[:-1].tolist())
        crossed = {c for a in range(300) for b in range(a + 2, min(300, a + longest) + 1) if unit[a:b] in p.ids for c in range(a + 1, b)}
        assert "".join(parts) == unit and cuts == set(range(1, 300)) - crossed


def test_few_long_units_give_the_same_pieces(monkeypatch):
    """Going on character by character, where few units are left, draws what steps over arrays draw."""
    p, texts = vocabulary(), ["x" * 300, "ab" * 150, "-" * 70 + " word", "etaoinshrdlu" * 30]
    monkeypatch.setattr(pieces, "LONG_UNIT", 1 << 30)
    one = p.encode(texts, np.arange(4))
    monkeypatch.setattr(pieces, "FEW_UNITS", 0)
    other = p.encode(texts, np.arange(4))
    assert np.array_equal(one[0], other[0]) and np.array_equal(one[1], other[1])


def test_unspaced_texts_cost_little_more():
    import time

    p, rng = vocabulary(), random.Random(6)
    took = {}
    for name, text in {"spaced": "".join(rng.choice("etaoin    ") for _ in range(60_000)), "solid": "".join(rng.choice("etaoin") for _ in range(60_000)), "coded": "".join(rng.choice("ABCDEFqrstuv0123456789+/") for _ in range(60_000))}.items():
        began = time.process_time()
        ids, cuts = p.encode([text], np.array([3]))
        took[name] = time.process_time() - began
        assert p.decode(ids, cuts) == [text.encode()]
    assert max(took["solid"], took["coded"]) < 5 * took["spaced"] + 0.5


def test_pieces_are_the_vocabulary_of_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    with open(pieces.MODEL_PATH, "rb") as f:
        p = pieces.Pieces(f.read())
    texts = [t for t in TEXTS if t and "▁" not in t and "\x00" not in t]
    ids, cuts = p.encode(texts, np.arange(len(texts)))
    for t, a, b in zip(texts, cuts[:-1], cuts[1:]):
        assert model.decode(ids[a:b].tolist()) == t


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "to", "in", "that"]) + str(rng.randrange(50)) for _ in range(40)), "en", f"s{i % 4}", 0) for i in range(60)]
    line = "\nA line that very many of the documents share among them."
    rows = [(i, t + line if i % 2 else t, lang, s, n) for i, t, lang, s, n in rows] + [(60, rows[0][1], "en", "s0", 0), (61, None, "en", "s0", 0), (62, "", None, None, 0), (63, "123 456", "en", "s1", 0), (64, line[1:], "en", None, 0), (64, line[1:], "en", None, 0), (None, "the and of", None, "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "array(2) as pieces", "3 as bucket", "4 as size", "map('a', 1) as _drop", "5 as `odd.name`")
    for table in (docs, extra, extra.limit(0), docs.withColumn("text", F.lit(None).cast("string"))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, "")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == table.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            table = spark.read.parquet(f"{tmp_path}/{k}")
    first = corpus_pipeline.known_languages(spark, docs, "")
    assert first.where("doc_id in (61, 62, 63)").count() == 0 and first.count() == len(rows) - 3
    second = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert second.where("text like '%very many of the documents%'").select("doc_id").distinct().count() == 1
    third = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert third.where("doc_id = 60").count() == 0 and third.where("doc_id = 0").count() == 1


@pytest.mark.parametrize("lang", ["en", None])
def test_pipeline_equals_plain_stages(spark, tmp_path, lang):
    """The whole run against plain versions of its stages; how many words the mix takes is asked of the mix, on the plain third stage's rows."""
    rng = random.Random(4)
    line = "A line that very many of the documents share among them."
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 60))) + ("\n" + line if i % 2 else ""), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more", "s1") for i in range(0, 12, 2)] + [(200, None, "s0"), (201, "", "s0"), (202, "12 34", "s1"), (203, line, "s2")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, s in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    lines = brute_lines(left)
    left = [(i, lines[i][0], s) for i, _, s in left if not lines[i][2] or lines[i][0]]
    sets = {i: shingles(t) for i, t, _ in left}
    root = union_find([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    left = [r for r in left if root[r[0]] == r[0]]
    takes = mixing.mix(spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, s in left], schema)).collect()
    text, want = {i: t for i, t, _ in left}, []
    for r in takes:
        whole, rest = divmod(r["taken"], r["size"]) if r["taken"] else (0, 0)
        want += [(r["doc_id"], text[r["doc_id"]])] * whole
        want += [(r["doc_id"], re.match(r"(?:\s*\S+){%d}" % rest, text[r["doc_id"]])[0])] if rest else []
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "n_chars", "n_pieces").collect()
    assert want and sorted((r["doc_id"], r["text"]) for r in got) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) and r["n_pieces"] > 0 for r in got)


def test_pipeline_links_from_four_fifths(spark):
    """Of pairs with 80 of 100 shingles in common one document stays, of pairs with 79 of 100 both."""
    rows = []
    for k in range(20):
        text = [f"w{k}x{j}" for j in range(104)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: 84 - k % 2]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert got == {i for i, _ in rows if i % 4 != 1}


def test_pipeline_mixes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from citelink.llm import mixing

    taken = {r["source"]: r["n"] for r in corpus_pipeline.mixed_to_weights(spark, docs, "").groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(taken[s] == pytest.approx(t, rel=0.01) for s, t in targets.items())


def test_columns_with_clashing_names(spark):
    from citelink.llm import embed_dup, fingerprint, lang_id, line_dedup, mixing, near_dup, pii, suffix_dedup

    docs = spark.createDataFrame([(1, "the and of to", "en", "a", 0), (2, None, None, None, None)], DOCS)
    more = docs.selectExpr("*", *(f"1 as `{c}`" for c in ("_drop", "_n_lines", "_n_dropped", "lang_pred", "score", "_known", "_text", "_key", "size", "target", "taken", "n", "bucket", "a", "b", "id", "root", "rep", "key", "fp", "row", "spans", "pieces", "n_pieces", "_html", "kept", "component_id", "shard", "weight")))
    model = lang_id.fit_on_documents(docs)
    frames = [
        line_dedup.dedup_lines(more), lang_id.predict(more, model), near_dup.near_duplicates(more), mixing.mix(more), pii.find_personal_data(more), fingerprint.edited_fingerprints(more), suffix_dedup.without_repeats(more), pieces.encode(more),
        pieces.digests(more), html_text.extract_text(more.withColumnRenamed("text", "html")),
    ]
    assert all(f.count() == 2 for f in frames)
    assert all(len(set(f.columns)) == len(f.columns) for f in frames)
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 5, 6)], "vec_id long, embedding array<double>, rep int, copies int")
    assert embed_dup.near_vectors(vectors).count() == 1
