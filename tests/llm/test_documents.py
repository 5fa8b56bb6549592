"""The document operators against plain versions, with nulls, empty and repeated rows, ties and odd texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelink.llm import common, fingerprint, lang_id, line_dedup, mixing, near_dup, pii, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = "\x20\x09-\x0d"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(rng, n, of=60):
    return " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + rng.choice("aeiou") + str(rng.randrange(of)) for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(5)
    rows = [(0, None, "a"), (1, "", "a"), (2, "  \n ", None), (3, "Ünï çödé", "b"), (4, "one", "b"), (5, "ONE", "b")]
    base = [words(rng, 80) for _ in range(5)]
    for i in range(6, 90):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(999)}"
        t = " ".join(t[: rng.choice([80, 80, 78, 40])])
        rows.append((i, t.upper() if i % 7 == 0 else t.replace(" ", "\n" if i % 5 == 0 else " ", 3), rng.choice(["a", "b", "hot", None])))
    rows += [(100 + i, base[0], "hot") for i in range(20)]
    return rows


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "star": [(7, i) for i in range(50)] + [(3, 3)], "none": []}[shape]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = [e for e in edges if e[0] != e[1]]
    want = union_find(linked, {x for e in linked for x in e})
    assert got == want


def brute_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    common_lines = ["This line is shared by a number of documents, " + c for c in "abc"] + ["é" * 40, "é" * 39, "short"]
    rows = [(i, "\n".join(rng.choice([rng.choice(common_lines), words(rng, 9), "  " + rng.choice(common_lines).upper() + "\t", ""]) for _ in range(6)), None) for i in range(60)]
    rows += [(60, None, None), (61, "", None), (62, common_lines[0] + "\n" + common_lines[0], None)]
    docs = table(spark, rows)
    for bits in (None, 1 << 20):
        got = {r["doc_id"]: (r["text"] or "", r["_n_lines"], r["_n_dropped"]) for r in line_dedup.dedup_lines(docs, bits=bits).collect()}
        assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.dedup_lines(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("_n_dropped > 0").count() == 0


def shingles(text):
    w = re.findall(f"[^{WS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark, mixed_rows):
    sets = {i: shingles(t) for i, t, _ in mixed_rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find(pairs, sets)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(table(spark, mixed_rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert near_dup.near_duplicates(table(spark, mixed_rows[:3])).where("kept").count() == 3
    assert near_dup.near_duplicates(table(spark, mixed_rows).limit(0)).count() == 0


def test_near_duplicates_beyond_the_hub(spark):
    """A chain in which neighbours link and others don't: whatever the hub, the rest has to be found."""
    rng = random.Random(11)
    text, rows = words(rng, 120, 9999).split(" "), []
    for i in range(40):
        rows.append((i, " ".join(text), "s"))
        text[(i * 17) % 120] = f"new{i}"
    got = near_dup.near_duplicates(table(spark, rows)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


@pytest.mark.parametrize("tile", [2, 512])
def test_near_duplicates_in_tiles(spark, mixed_rows, tile):
    """Many small components in few buckets: what tiles find is what whole buckets hold."""
    rng = random.Random(21)
    rows = list(mixed_rows)
    for k in range(6):
        text = words(rng, 90, 9999).split(" ")
        for i in range(14):
            rows.append((1000 + 20 * k + i, " ".join(text), "s"))
            for _ in range(2):
                text[rng.randrange(90)] = f"n{k}x{i}"
    sets = {i: shingles(t) for i, t, _ in rows}
    want = union_find([(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], sets)
    got = near_dup.near_duplicates(table(spark, rows), tile=tile, tile_shingles=1 << 10).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_tiles_compare_whole_hashes():
    """Two shared shingles that agree in 32 bits of their hashes count twice: a pair at exactly 0.85 links."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    a[1] = a[0] + np.uint64(1 << 32)
    one, two = np.sort(a).tobytes(), np.sort(a[:85]).tobytes()
    batch = pa.RecordBatch.from_pydict({"bucket": [1, 1], "s": [0, 0], "t": [1, 1], "side": [0, 1], "doc_id": [7, 8], "label": [7, 8], "shingles": [one, two]})
    out = [row for b in near_dup._across(85)(iter([batch])) for row in b.to_pylist()]
    assert out == [{"a": 7, "b": 8}]
    assert not [row for b in near_dup._across(86)(iter([batch])) for row in b.to_pylist()]


def test_signatures_estimate_overlap():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    sig = near_dup.signatures([np.sort(near_dup.mixed(x)) for x in (a, b, a[:1], a[:0])], 512)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.1
    assert len(set(sig[2].tolist())) == 1 and not sig[3].any()


def spans_of(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else True, "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "", re.ASCII) if passes(k, m[0])]


def test_personal_data_seeds(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@@z.q", "a@b.c_d@e.f", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (743) 555-3824", "+1 2", "+49.89.1234567 ", "é€😀", "9" * 30, "word", "  ", "\n", ",", "5555555555554444"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randrange(12))), None) for i in range(150)]
    rows += [(150, None, None), (151, "1" * 20000, None), (152, "1 " * 20000 + "@", None), (153, "a@" + "b." * 20000 + "c", None), (154, "." * 5000 + "@a.b", None)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["seed"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert got == {i: spans_of(t) for i, t, _ in rows}
    assert pii.find_personal_data(table(spark, rows).limit(0)).count() == 0


def test_personal_data_learns_contexts(spark):
    """Addresses of another form after a word that seeds follow are found; numbers that fit no kind are not."""
    rng = random.Random(6)
    rows = [(i, f"{words(rng, 5)} mailbox user{i}@mail.example.org then {words(rng, 5)} room {rng.randrange(100, 999)}", None) for i in range(40)]
    rows += [(100, "some mailbox user77@localhost, then", None), (101, "in room 204 mailbox closed", None), (102, "some mailbox user77@mail.example.o_rg then", None), (103, "the mailbox 77 then", None)]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["seed"]) for s in r["spans"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert found[100] == [("email", 13, 29, False)] and found[101] == found[103] == []
    assert [s[3] for s in found[102]] == [True] and all(len(found[i]) == 1 for i in range(40))


def test_personal_data_contexts_of_any_length(spark):
    """Words of a thousand letters are contexts as whole words: one that differs in its last letter only is another. Far blanks between don't matter."""
    rng = random.Random(16)
    lead, other = "é" + "q" * 1000 + "x", "é" + "q" * 1000 + "y"
    rows = [(i, f"{words(rng, 4)} {lead}{' ' * rng.randrange(1, 300)}user{i}@mail.example.org then {words(rng, 4)}", None) for i in range(20)]
    rows += [(50, f"a {lead} user@localhost end", None), (51, f"a {other} user@localhost end", None), (52, "w" * 300_000 + " 7 " + "v" * 300_000, None)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["seed"]) for s in r["spans"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    at = len(f"a {lead} ")
    assert got[50] == [("email", at, at + 14, False)] and got[51] == got[52] == []


def test_personal_data_of_several_tokens(spark):
    """Spaced numbers without a + after words that spaced phones follow, and a context that is only learned from learned values."""
    rng = random.Random(8)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"{words(rng, 4)} please call +1 {number()} today {words(rng, 4)}", None) for i in range(30)]
    plain = [number() for _ in range(12)]
    rows += [(100 + i, f"please call {x} today, or not", None) for i, x in enumerate(plain)] + [(200 + i, f"extension {x} rings", None) for i, x in enumerate(plain)]
    fresh = number()
    rows += [(300, f"his extension {fresh} rings", None), (301, f"the ticket {number()} is old", None), (302, "please call 12 today", None)]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["seed"]) for s in r["spans"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert all(found[100 + i] == [("phone", 12, 12 + len(x), False)] for i, x in enumerate(plain))
    assert found[300] == [("phone", 14, 14 + len(fresh), False)] and found[301] == found[302] == []


def test_hidden_seeds_are_recovered(spark, monkeypatch):
    """With a fifth of the seeds hidden, contexts find most of them again, and little else."""
    rng, rows, hidden = random.Random(14), [], {}
    leads = ["write to", "mail", "contact us at", "reply to"]
    for i in range(300):
        value = f"n{i}@site{rng.randrange(9)}.example.org" if i % 5 else f"n{i}@site{rng.randrange(9)}"
        text = f"{words(rng, 6)} {rng.choice(leads)} {value} for {words(rng, 6)} at {rng.randrange(10, 99)} {rng.choice(['old', 'new'])}@{i % 7 if i % 3 else 'x'}"
        rows.append((i, text, None))
        if not i % 5:
            hidden[i] = (text.index(value), text.index(value) + len(value))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if not s["seed"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    right = sum(span in got[i] for i, span in hidden.items())
    told = sum(map(len, got.values()))
    assert right >= 0.9 * len(hidden) and right >= 0.9 * told


def test_fingerprints(spark):
    one, two = "alpha beta\ngamma delta epsilon\nzeta", "zeta\nalpha beta\ngamma delta epsilon"
    df = spark.createDataFrame([(one, two, "new line here", one + "\nnew line here", None)], "a string, b string, p string, c string, n string")
    fp = {c: fingerprint.fingerprint(F.col(c)) for c in df.columns}
    row = df.select(
        (fp["a"] == fp["b"]).alias("order"), (fingerprint.inserted(fp["a"], fp["p"]) == fp["c"]).alias("insert"), (fingerprint.deleted(fp["c"], fp["p"]) == fp["a"]).alias("delete"), (fp["a"] == fp["c"]).alias("differ"),
        fingerprint.as_text(fp["a"]).alias("text"), (fp["n"] == fingerprint.fingerprint(F.lit(""))).alias("null"),
    ).first()
    assert row["order"] and row["insert"] and row["delete"] and not row["differ"] and row["null"]
    assert re.fullmatch("[0-9a-f]+", row["text"])


def test_likeness_of_shifted_texts(spark):
    """A word less at the start of a line, tabs in place of blanks, and a line without blanks leave near copies alike."""
    rng = random.Random(2)
    line, other = words(rng, 400, 9999), words(rng, 400, 9999)
    solid, end = ("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n)) for n in (400, 100))
    tabs = line.replace(" ", "\t")
    pairs = [(line, line.split(" ", 1)[1]), (tabs, tabs.split("\t", 1)[1]), (solid, solid[1:]), (solid, solid[:300] + end), (line, other)]
    a, b = fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness(a, b, fingerprint.centred(a), fingerprint.centred(b))).collect()]
    assert min(got[:3]) > 0.95 and 0.5 < got[3] < 0.95 and got[4] < 0.5


def test_edited_fingerprints(spark, mixed_rows):
    rng = random.Random(8)
    rows = [(i * 3, t, s) for i, t, s in mixed_rows]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        assert got[i]["edited"] == t[: len(t) - cut] + after[:cut] and got[i]["n_chars"] == len(t)
        assert got[i]["next_fp"] == got[order[(k + 1) % len(order)][0]]["fp"]
    twice = fingerprint.edited_fingerprints(table(spark, [(1, "b b b b", None), (1, "a a a a", None), (2, "c c c c", None), (None, "d", None)])).collect()
    assert Counter(r["doc_id"] for r in twice) == {1: 2, 2: 1, None: 1}
    assert [r["edited"] for r in twice if r["doc_id"] == 2] == ["c c c a"]
    assert fingerprint.edited_fingerprints(table(spark, []).limit(0)).count() == 0
    assert fingerprint.edited_fingerprints(table(spark, [(9, "abcd", None)])).first()["edited"] == "abca"


def plain_fingerprint(text):
    """(sums of paragraph hashes, number of runs, set bits of the runs' hashes) in plain Python."""
    import xxhash

    def hash_of(parts, seed=42):
        for x in parts:
            seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(8, "little"), seed=seed)
        return seed

    sums, runs, bits = [0] * 4, 0, [0] * 64
    for paragraph in (text or "").split("\n"):
        for k, h in enumerate((hash_of([paragraph.encode()]), hash_of([b"2", paragraph.encode()]))):
            for j, part in enumerate((h & 0xFFFFFFFF, h >> 32)):
                sums[2 * k + j] = (sums[2 * k + j] + part) % 2**32
        units = re.findall(f"[^{WS}]+", paragraph)
        units = list(units[0]) if len(units) == 1 else units
        hashes = [hash_of([u.encode()]) for u in units]
        for i in range(max(1, len(hashes) - 7) if hashes else 0):
            h, runs = hash_of(hashes[i : i + 8]), runs + 1
            bits = [n + (h >> b & 1) for b, n in enumerate(bits)]
    return sums, runs, bits


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * n - runs for n in bits] for _, runs, bits in (a, b))
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y)) / norm)) if norm else 0.0


def test_fingerprint_query(spark, mixed_rows, tmp_path):
    """The registered query against plain sums and cosines, on odd texts and some of the given ones."""
    from citelink.llm.queries import QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").limit(40).collect()
    rows = [*mixed_rows, *((500 + i, r["text"], "g") for i, r in enumerate(given)), (900, " ".join(f"w{i}" for i in range(1000)), "g"), (901, "".join(chr(0x4E00 + i) for i in range(300)), "g")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprint"](spark, str(tmp_path)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        own, other, following = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, (sums, runs, bits) in ((r["fingerprint"], own), (r["edited_fingerprint"], other)):
            assert text == "".join(f"{x:08x}" for x in (*sums, runs)) + "".join(f"{bits[j] | bits[j + 32] << 32:016x}" for j in range(32))
        assert r["near_edited"] == pytest.approx(plain_likeness(own, other), abs=1e-9)
        assert r["near_next"] == pytest.approx(plain_likeness(own, following), abs=1e-9)


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_repeated_passages(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (45, 49, 50, 51, 60, 120, 300)]
    rows = []
    for i in range(70):
        parts = [rng.choice([*passages, "".join(rng.choice("xyzw ") for _ in range(rng.randrange(70)))]) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts), None))
    rows += [(70, None, None), (71, "", None), (72, "q" * 3000, None), (73, "q" * 49, None), (74, "q" * 200 + "r", None), (75, "ab" * 400, None), (76, "b" + "ab" * 200, None), (77, rows[5][1], None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    assert got == brute_repeats(rows)
    assert suffix_dedup.without_repeats(table(spark, rows).limit(0)).count() == 0
    same = suffix_dedup.without_repeats(table(spark, [(1, "k" * 80, None), (1, "k" * 80, None), (None, "k" * 80, None)])).collect()
    assert [r["n_removed"] for r in same] == [0, 0, 0]



def test_repeated_passages_of_hot_samples(spark, monkeypatch):
    """Samples that many texts hold, whose strings are dealt one by one: results are those of a plain version, and such samples occur."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(14)) for _ in range(3)]
    rows = []
    for i in range(1, 61):
        parts = [" ".join(word() for _ in range(12)), shared[i % 3], " ".join(word() for _ in range(12)), shared[(i * 7) % 3][i % 9 :], word()]
        rows.append((i, "".join(parts) if i % 2 else " é ".join(parts), None))
    rows += [(30, rows[2][1], None), (70, rows[2][1], None), (71, None, None), (72, "", None)]
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 3)
    lists = []
    keep = suffix_dedup._contexts
    monkeypatch.setattr(suffix_dedup, "_contexts", lambda shards, hot: lists.append(len(hot)) or keep(shards, hot))
    got = {}
    for r in suffix_dedup.without_repeats(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 1 << 30)
    cold = {}
    for r in suffix_dedup.without_repeats(table(spark, rows)).collect():
        cold.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    assert lists[0] > 10 and lists[1] == 0
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in cold.items()}
    single = [r for r in rows if r[0] != 30]
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 3)
    alone = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(table(spark, single)).collect()}
    assert alone == brute_repeats(single)


def test_samples_follow_content():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 50).astype(np.uint8)
    seen = set()
    for lead in (0, 7, 300):
        data = np.concatenate([rng.integers(97, 123, lead), passage, rng.integers(97, 123, 40)]).astype(np.uint8)
        row, place, first, last, h = suffix_dedup.samples(data, np.array([0, len(data)]))
        k = np.flatnonzero((first <= lead) & (last >= lead))
        assert len(k) == 1
        seen.add((int(place[k[0]]) - lead, int(h[k[0]])))
        assert sorted(x for a, b in zip(first, last) for x in range(a, b + 1)) == list(range(len(data) - 49))
    assert len(seen) == 1


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] >= repeats * sizes[s] * whole]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = repeats * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing(spark, mixed_rows):
    rows = mixed_rows + [(200 + i, words(random.Random(i), 30 + i), f"s{i % 7}") for i in range(60)]
    got = mixing.mix(table(spark, rows), block=8, shard_docs=16).collect()
    size = {i: len(re.findall(f"[^{WS}]+", t or "")) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    want, taken = brute_targets(dict(by_source)), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - t) <= 8 * 8 for s, t in want.items())
    again = mixing.mix(table(spark, rows[::-1]).repartition(3), block=8, shard_docs=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    rng = random.Random(seed)
    votes = [(f"p{i:02d}", rng.choice([0, 1, 5, 100, 1000]) * rng.randrange(1, 9), 40, 25) for i in range(rng.randrange(2, 9))]
    df = spark.createDataFrame(votes, "party string, vote long, seats long, most long")
    got = {r["party"]: r["won"] for r in mixing.sainte_lague(df, [], ["party"], "vote", "seats", "most").collect()}
    want = Counter()
    for _ in range(40):
        open_ = [(-v / (2 * want[p] + 1), p) for p, v, _, _ in votes if want[p] < 25 and v > 0]
        if open_:
            want[min(open_)[1]] += 1
    assert got == {p: want[p] for p, *_ in votes}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.fit_on_documents(docs)
    scored = lang_id.predict(docs, model).withColumn("held_out", lang_id.held_out()).collect()
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)
    odd = table(spark, [(1, None, None), (2, "", None), (3, "123 !? 456", None), (4, "the and of this", None)])
    assert [r["lang_pred"] for r in lang_id.predict(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert lang_id.fit(docs.limit(0)) is None and lang_id.predict(odd, None).where("lang_pred = 'und'").count() == 4
    assert lang_id.predict(docs.limit(0), model).count() == 0


def plain_languages(rows, ridge=lang_id.RIDGE):
    """Kernel ridge regression on all rows as landmarks, with sets of hashed n-grams in plain Python."""

    def grams(text):
        seen, last = [], None
        for x in text.encode():
            c = x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32
            if not (c == 32 and last == 32):
                seen.append(c)
            last = c
        out = set()
        for n in (1, 2, 3, 4):
            for i in range(len(seen) - n + 1):
                code = 0
                for c in seen[i : i + n]:
                    code = (code * 257 + c) & 0xFFFFFFFF
                out.add((n, (code * 0x9E3779B1 & 0xFFFFFFFF) >> 18))
        return out

    sets, langs = [grams(t) for t, _ in rows], sorted({lang for _, lang in rows})
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    root = vectors[:, values > 1e-9] / np.sqrt(values[values > 1e-9])
    phi = np.hstack([k @ root, np.ones((len(rows), 1))])
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    solved = np.linalg.solve(phi.T @ phi + np.eye(phi.shape[1]) * ridge * len(rows), phi.T @ y)

    def score(text):
        own = grams(text)
        s = np.append(np.array([len(own & b) / np.sqrt(max(len(own) * len(b), 1)) for b in sets]) @ root, 1.0) @ solved
        e = np.exp(4 * (s - s.max()))
        return langs[int(s.argmax())], 1 / e.sum()

    return score


def test_language_id_is_kernel_ridge_regression(spark):
    rng = random.Random(31)
    letters = {"aa": "abcde ", "bb": "cdefgé ", "cc": "xyzñ  a"}
    rows = [(i, "".join(rng.choice(letters[x]) for _ in range(rng.randrange(20, 200))) + "q", x) for i, x in enumerate(["aa", "bb", "cc"] * 12)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    score = plain_languages([(t, x) for _, t, x in rows])
    asked = [(100 + i, "".join(rng.choice("abcdefgxyzñé ") for _ in range(rng.randrange(1, 90))) + "b") for i in range(60)]
    for r in lang_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        lang, p = score(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p, abs=1e-4)


def test_every_language_is_learned(spark):
    """600 languages of two rows each, far more than landmarks for each of them."""
    def text(k, i):
        rng = random.Random(k)
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(12)]
        return " ".join(random.Random(i).sample(own, 10))

    rows = [(k * 4 + i, text(k, i), f"l{k:03}") for k in range(600) for i in range(3)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 600 and model.landmarks.shape[1] <= lang_id.MOST_LANDMARKS
    asked = spark.createDataFrame([(k, text(k, 9), f"l{k:03}") for k in range(600)], "doc_id long, text string, lang string")
    got = lang_id.predict(asked, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 500


def test_many_short_rows_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    class Shared:
        value = lang_id.Model(["en"], np.arange(4000), np.ones((4000, 64), np.float32), np.ones(64), np.zeros((65, 1)))

    batch = pa.RecordBatch.from_pydict({"text": [f"short text {i}" for i in range(10_000)], "_known": [True] * 10_000})
    tracemalloc.start()
    rows = sum(b.num_rows for b in lang_id._scored(Shared)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 100 << 20


def test_text_is_hashed_as_utf8(spark):
    assert hashlib.sha256("é".encode()).hexdigest() == spark.sql("select sha2(cast('é' as binary), 256)").first()[0]


def test_personal_data_finds_what_no_seed_matches(spark):
    """Numbers of a card's form after a word that seeds follow are found though their check sum fails; after another word they are not."""
    rng = random.Random(12)

    def card(good):
        while True:
            d = [rng.randrange(10) for _ in range(16)]
            if (sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0) == good:
                return "".join(map(str, d))

    rows = [(i, f"{words(rng, 4)} account {card(True)}, and {words(rng, 4)}", None) for i in range(40)]
    bad = card(False)
    rows += [(50, f"her account {bad}. End", None), (51, f"the parcel {bad}. End", None)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["seed"]) for s in r["spans"]] for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert got[50] == [("card", 12, 28, False)] and got[51] == []
    assert all(len(got[i]) == 1 and got[i][0][3] for i in range(40))
