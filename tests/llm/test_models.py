"""Merkle manifest, language-model scores and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelink.llm import merkle, ngram_lm, runs

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string"
DOCS = [(i, f"Text {i} OF many" * (i % 7), "en", f"src{i % 3}", i, "x", None) for i in range(300)]
DOCS += [(1000 + i, "Lone", None, f"ü{i}", None, None, None) for i in range(20)]
DOCS += [(None, None, None, None, None, None, None), (None, "A", "de", None, 1, None, None), (7, "again", "en", "src1", 0, None, None), (7, "again", "en", "src1", 0, None, None), (5000, "Ä" * 70_000, "de", "", 70_000, None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))


def tree(nodes):
    """The top of a list of digests, and for each its siblings' digests from below and (before, after) at each level."""
    paths = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            owners.append([i for k in range(len(run)) for i in own[a + k]])
        nodes, own = above, owners
    return nodes[0], paths


def plain_manifest(docs):
    groups = {}
    for doc, text, lang, source, n, *_ in docs:
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf(doc, source, lang, n, text), doc, leaf(doc, source, lang, n, text and text.translate(AZ)) if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else None))
    if not docs:
        return []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: (rows := sorted(groups[s], key=lambda r: r[:3]), *tree([r[2] for r in rows])) for s in order}
    root, upper = tree([found[s][1] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        rows, subroot, paths = found[s]
        for (_, _, own, doc, other), path in zip(rows, paths, strict=True):
            h = other or own
            for before, after in path + above:
                h = sha(before + h + after)
            out.append((doc, own, subroot, root, sha("".join(b + a for b, a in path + above)), h, h == root))
    return out


def table(spark, folder, docs, schema=SCHEMA):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("docs", [DOCS, DOCS[:1], DOCS[:16], DOCS[:0], [(i, "T", "en", "one", 1, None, None) for i in range(257)]])
def test_manifest(spark, tmp_path, docs):
    got = [tuple(r) for r in merkle.op11_merkle(spark, table(spark, tmp_path / "d", docs)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(docs), key=repr)
    assert not docs or {r[6] for r in got} <= {True, False}


def plain_runs(x, words, periods):
    n, out = len(x), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i > start and i - start + q >= max(words, periods * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(700):
        n = rng.randint(0, 70)
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if rng.random() < 0.6 and n > 8:
            p, s = rng.randint(1, 9), rng.randrange(n)
            for i in range(s + p, min(n, s + p * rng.randint(2, 7) + rng.randrange(p))):
                x[i] = x[i - p]
        words = np.array(x, np.int64)
        assert runs.tandem_runs(words) == plain_runs(x, 0, 2)
        for least, periods in ((6, 4), (6, 2), (9, 3)):
            assert runs.long_runs(words, least, periods) == plain_runs(x, least, periods)


def test_runs_of_long_texts_take_linear_time():
    import time

    def took(n, p):
        x = np.array([*range(p)] * (n // p + 1))[:n]
        began = time.process_time()
        assert runs.long_runs(x) == [(0, n, p)]
        return time.process_time() - began

    for part in (1, 5):
        assert took(40_000, 40_000 // part if part > 1 else 1) < 40 * max(took(4_000, 4_000 // part if part > 1 else 1), 0.01)


TEXTS = [None, "", " \t\n", "a " * 6, "a " * 5, "go stop " * 4 + "go", "x y z " * 40 + "end " * 9, "A a A a A a A a", "one two three", "w\x0bw\x0cw w w w w", "lorem ipsum dolor " * 400, "é è " * 5]


def test_periodic_runs(spark, tmp_path):
    docs = [(i * 7 + j, t, "keep") for j in range(40) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "keep"), (3, "a b", "keep"), (3, "a b", "keep")]
    folder = table(spark, tmp_path / "d", docs, "doc_id long, text string, start string")
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, folder).collect()]
    want = []
    for doc, text, _ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words, 6, 4)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((doc, len(found), s, length, q, 1000 * length // q if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(spark.createDataFrame(docs[:3], "doc_id long, text string, start string").limit(0)).count() == 0
    assert runs.periodic_runs(spark.createDataFrame(docs[:3], "doc_id long, text string, other string")).columns[:3] == ["doc_id", "text", "other"]


LM_TEXTS = [None, "", "the cat sat on the mat", "The dog sat on the log", "the cat " * 300, "a" * 5000 + " b", "ü Ü ñ", "one\x0btwo\tthree\nfour"]
LM_DOCS = [(i, LM_TEXTS[i % 8] if i % 3 else f"the cat number {i} sat on {i % 5} mats", "old") for i in range(400)] + [(5, "again", "old"), (5, "again", "old"), (None, "no id", "old"), (None, None, "old")]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ)), None]


def plain_lm(learned, texts):
    one, two = Counter(), Counter()
    for t in learned:
        one.update(tokens(t))
        two.update(zip([None, *tokens(t)], tokens(t), strict=False))
    n, v = sum(one.values()), len(one)
    rough = ngram_lm.expected_counts()
    level = lambda c: rough[ngram_lm._levels_of(np.array([c]))[0]]
    out = []
    for t in texts:
        ws = tokens(t)
        total = 0.0
        for h, w in zip([None, *ws], ws, strict=False):
            history = level(one[h]) if h is not None else one[None]
            total += math.log10((min(level(two[h, w]), history) + ngram_lm.PRIOR * (level(one[w]) + 1) / (n + v + 1)) / (history + ngram_lm.PRIOR))
        out.append((len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), total))
    return out


def test_lm_scores(spark, tmp_path):
    folder = table(spark, tmp_path / "d", LM_DOCS, "doc_id long, text string, score string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in ngram_lm.op12_lm_scores(spark, folder).collect())
    held = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _, _ in LM_DOCS]
    rows = plain_lm([t for (_, t, _), h in zip(LM_DOCS, held, strict=True) if not h], [t for _, t, _ in LM_DOCS])
    want = sorted((doc is not None, doc or 0, *r, h) for (doc, _, _), r, h in zip(LM_DOCS, rows, held, strict=True))
    assert [(*r[:5], r[7]) for r in got] == [(*r[:5], r[7]) for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    near = [abs(a[6] - b[6]) <= 1e-9 * abs(b[6]) for a, b in zip(got, want, strict=True)]
    assert sum(near) > 0.9 * len(near)  # others hold an n-gram that the filter finds a level too high
    assert all(abs(a[6] - b[6]) <= 0.1 * abs(b[6]) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_in_rounds(spark, order, monkeypatch):
    """However few bytes of the filter are broadcast at a time, scores are the same."""
    monkeypatch.setattr(ngram_lm, "SEGMENT_TOKENS", 256)
    docs = spark.createDataFrame(LM_DOCS, "doc_id long, text string, n_tokens string").select("doc_id", "text", F.lit(1).alias("other"))
    model = ngram_lm.fit(docs, order)
    assert model.segments > 3
    once, often = (sorted(ngram_lm.score(docs, model, most).collect(), key=lambda r: (repr(r.doc_id), repr(r.text))) for most in (1 << 28, 10_000))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.score, r.other) for r in once] == [(r.doc_id, r.n_tokens, r.n_known, r.score, r.other) for r in often]
    assert [r.base_score for r in once] == pytest.approx([r.base_score for r in often])


def test_lm_without_texts(spark, tmp_path):
    empty = table(spark, tmp_path / "d", [], "doc_id long, text string")
    assert ngram_lm.op12_lm_scores(spark, empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = table(spark, tmp_path / "e", [(held, "Some words")], "doc_id long, text string")
    row = ngram_lm.op12_lm_scores(spark, only).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_counts_are_exact_up_to_four_and_near_beyond():
    rough = ngram_lm.expected_counts()
    for c in [*range(1, 200), 1000, 123_456_789]:
        level = ngram_lm._levels_of(np.array([c]))[0]
        assert rough[level] == c if c <= 4 else 0.85 < rough[level] / c < 1.2
