"""Periodic runs of words, by tandem repeats in time linear in a text's repetitive parts (Gusfield and Stoye)."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citelink.llm.common import crc32_sql, lean, read_table, with_fields

#: A run counts from so many words and so many periods on.
LEAST_WORDS, LEAST_PERIODS = 6, 4
FIELDS = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


class SuffixTree:
    """The suffix tree of a list of small integers, with suffix links (built left to right) and, for each node, depth, parent, least leaf and leaf range."""

    def __init__(self, x: list[int]):
        self.x = x = [*x, -1]
        n = len(x)
        begin, end, link, kids, leaf = [0], [0], [0], [{}], [-1]

        def node(b: int, e: int, suffix: int) -> int:
            begin.append(b), end.append(e), link.append(0), kids.append({}), leaf.append(suffix)
            return len(begin) - 1

        at, edge, length, left, leaves = 0, 0, 0, 0, 0
        for i, c in enumerate(x):
            left += 1
            unlinked = 0
            while left:
                if not length:
                    edge = i
                child = kids[at].get(x[edge])
                if child is None:
                    kids[at][x[edge]] = node(i, n, leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked], unlinked = at, 0
                else:
                    size = end[child] - begin[child]
                    if length >= size:
                        edge, length, at = edge + size, length - size, child
                        continue
                    if x[begin[child] + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    middle = node(begin[child], begin[child] + length, -1)
                    kids[at][x[edge]] = middle
                    begin[child] += length
                    kids[middle] = {c: node(i, n, leaves), x[begin[child]]: child}
                    leaves += 1
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                left -= 1
                if at:
                    at = link[at]
                elif length:
                    length, edge = length - 1, i - left + 1
        self.link, self.kids = link, kids
        size = len(begin)
        self.depth, self.parent, self.order, self.first = [0] * size, [0] * size, [], [n] * size
        self.low, self.high, self.leaves = [0] * size, [0] * size, []
        stack = [0]
        while stack:  # parents before children
            v = stack.pop()
            self.order.append(v)
            self.low[v] = len(self.leaves)
            if leaf[v] >= 0:
                self.first[v] = leaf[v]
                self.leaves.append(leaf[v])
            for c in kids[v].values():
                self.parent[c], self.depth[c] = v, self.depth[v] + end[c] - begin[c]
                stack.append(c)
        for v in reversed(self.order):
            self.high[v] = max(self.high[v], self.low[v] + (leaf[v] >= 0))
            p = self.parent[v]
            self.first[p], self.high[p] = min(self.first[p], self.first[v]), max(self.high[p], self.high[v])

    def blocks(self) -> list[int]:
        """Where the Lempel-Ziv blocks start, and the length at the end: a block is the longest string that also starts further left, or one new word."""
        starts, i, n = [], 0, len(self.x) - 1
        while i < n:
            starts.append(i)
            depth, v = 0, self.kids[0][self.x[i]]
            while self.first[v] < i:
                depth = self.depth[v]
                v = self.kids[v][self.x[i + depth]]
            i += max(1, depth)
        return [*starts, n]

    def rotated(self, v: int, length: int) -> int:
        """The node at or just below the string of ``length`` words at ``v`` with its first word moved to its end; 0 if the text doesn't hold it."""
        x, kids, depth, i = self.x, self.kids, self.depth, self.first[v]
        u = self.parent[v]
        at = self.link[u]
        to = length - 1
        while depth[at] < to:
            child = kids[at][x[i + 1 + depth[at]]]
            if depth[child] > to:
                return child if x[self.first[child] + to] == x[i] else 0
            at = child
        return kids[at].get(x[i], 0)


class Extensions:
    """How far two places of a text agree, for whole arrays of places: names of all substrings of lengths 1, 2, 4, ..."""

    def __init__(self, x: np.ndarray):
        self.n, self.names = len(x), [x]
        while (half := 1 << len(self.names) - 1) * 2 <= self.n:
            last = self.names[-1].astype(np.int64)
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            values, names = np.unique(pairs, return_inverse=True)
            self.names.append(names)
            if len(values) == len(pairs):
                break

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, i < j."""
        done, n = np.zeros(len(i), np.int64), self.n
        for k in reversed(range(len(self.names))):
            step, names = 1 << k, self.names[k]
            here = np.flatnonzero(j + done + step <= n)
            done[here[names[i[here] + done[here]] == names[j[here] + done[here]]]] += step
        return done

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j, i < j."""
        done = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            step, names = 1 << k, self.names[k]
            here = np.flatnonzero(i - done - step >= 0)
            done[here[names[i[here] - done[here] - step] == names[j[here] - done[here] - step]]] += step
        return done


def covering_squares(ext: Extensions, blocks: list[int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover, by moving right one by one, the leftmost place of every square with halves up to ``longest``.

    A leftmost square is not inside a block. Either the block of its last word begins in its left half or at its centre, and is at least as long as a half;
    or that block begins inside its right half, and a half is at most as long as this block and the one before.
    """
    found_start, found_half = [], []
    edges = np.array(blocks)
    size = np.diff(edges)
    if len(size) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for right in (False, True):
        most = np.minimum(size[1:] + size[:-1] * right, longest)
        h = np.repeat(edges[1:-1], most)
        k = np.arange(len(h)) - np.repeat(np.cumsum(most) - most, most) + 1
        fits = h - k >= 0 if right else h + k <= ext.n
        h, k = h[fits], k[fits]
        i, j = (h - k, h) if right else (h, h + k)
        after, before = ext.forward(i, j), ext.backward(i, j)
        start = np.maximum(i - before, i - k + right)
        good = start <= np.minimum(i + after - k, i - 1)
        found_start.append(start[good])
        found_half.append(k[good])
    return np.concatenate(found_start), np.concatenate(found_half)


def vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> set[tuple[int, int]]:
    """All squares, as (node at or below, length): covering squares are marked in the tree, and suffix links lead from each to its rotations."""
    waiting = defaultdict(list)
    for s, k in sorted({*zip(start.tolist(), half.tolist(), strict=True)}):
        waiting[s].append(2 * k)
    known: set[tuple[int, int]] = set()
    for v in reversed(tree.order):  # children before parents: a square is marked on its way from its leaf up
        if not (lengths := waiting.get(tree.first[v])):
            continue
        above = tree.depth[tree.parent[v]]
        while lengths and lengths[-1] > above:
            square = v, lengths.pop()
            while square[0] and square not in known:
                known.add(square)
                square = tree.rotated(*square), square[1]
    return known


def tandem_runs(x: np.ndarray, periods: int = 2) -> list[Run]:
    """(start, length, period) of all maximal runs of at least ``periods`` (two or more) times their smallest period, by start and period."""
    n = len(x)
    if n < 2:
        return []
    tree, ext = SuffixTree(x.tolist()), Extensions(x)
    squares = [*vocabulary(tree, *covering_squares(ext, tree.blocks(), n // periods))]
    if not squares:
        return []
    nodes, half = np.array(squares).T
    half = half // 2
    place = np.array(tree.first)[nodes]
    whole, rest, prime = np.ones(len(half), bool), half.copy(), 2
    while len(at := np.flatnonzero(rest > 1)):  # halves that repeat a shorter string: of runs with a smaller period
        if prime * prime > rest.max():  # what is left is prime: of these, every word is the same
            part = half[at] // rest[at]
            whole[at[ext.forward(place[at], place[at] + part) >= half[at] - part]] = False
            break
        divided = at[rest[at] % prime == 0]
        part = half[divided] // prime
        whole[divided[ext.forward(place[divided], place[divided] + part) >= half[divided] - part]] = False
        while len(divided):
            rest[divided] //= prime
            divided = divided[rest[divided] % prime == 0]
        prime += 1
    leaves = np.array(tree.leaves)
    nodes, half = nodes[whole], half[whole]
    low, many = np.array(tree.low)[nodes], (np.array(tree.high) - np.array(tree.low))[nodes]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    keys = np.sort(np.repeat(half, many) * (n + 1) + leaves[np.repeat(low, many) + inside])
    first = np.flatnonzero(np.diff(keys, prepend=-9) != 1)
    count = np.diff(np.append(first, len(keys)))
    period, start = keys[first] // (n + 1), keys[first] % (n + 1)
    length = count - 1 + 2 * period
    good = length >= periods * period
    return sorted(zip(start[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def repetitive_parts(x: np.ndarray, words: int, periods: int) -> list[tuple[int, int]]:
    """Disjoint stretches outside which no run of ``words`` (at least 6) words and ``periods`` periods can lie, each run wholly inside one.

    In a run of period q every three words, but for the first q, come a second time within q words. For periods from
    2**(k-1) + 1 to 2**k a stretch has as many such triples one after another as the shortest such run.
    """
    n = len(x)
    triples = (x[:-2].astype(np.int64) * (int(x.max()) + 1) + x[1:-1]) * (int(x.max()) + 1) + x[2:]  # equal triples have equal codes, whatever overflows
    order = np.argsort(triples, kind="stable")
    same = triples[order[1:]] == triples[order[:-1]]
    gap = np.full(n - 2, n, np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    parts, reach = [], 1
    while (least := reach // 2 + 1) <= n // periods:
        near = np.flatnonzero(np.diff(np.concatenate([[False], gap <= reach, [False]])))
        a, b = near[::2], near[1::2]
        enough = b - a >= max(words, periods * least) - least - 2
        parts += zip((a[enough] - reach).tolist(), (b[enough] + 2).tolist(), strict=True)
        reach *= 2
    joined: list[list[int]] = []
    for a, b in sorted(parts):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([max(a, 0), b])
    return [(a, b) for a, b in joined]


def long_runs(x: np.ndarray, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All maximal runs of at least ``words`` (6 or more) words and ``periods`` (2 or more) times their smallest period, by start and period."""
    if len(x) < words:
        return []
    found = []
    for a, b in repetitive_parts(x, words, periods):
        found += [(a + s, length, q) for s, length, q in tandem_runs(np.unique(x[a:b], return_inverse=True)[1], periods) if length >= words]
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], h: int) -> list[bytes]:
    """The words, of which those from some place on are made to repeat with some period, both taken from a hash."""
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def describe(words: list[bytes], least_words: int, periods: int) -> tuple:
    """A text's row of FIELDS."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = long_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least_words, periods)
    kept = words
    if found:
        gone = np.zeros(len(words), bool)
        for s, length, q in found:
            gone[s + q : s + length] = True
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return len(words), len(found), s, length, q, 1000 * length // q if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS, edited: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with FIELDS: the runs of each text's words, and the text with every run cut to its first period.

    Words end at ASCII white space and are compared byte by byte. A run is a stretch of words with smallest period q and at least ``least_words`` words
    and ``periods`` periods that no neighbouring word extends. ``edited`` first repeats the tail of every text whose doc_id's hash asks for it.

    A null or empty text has no words and no runs; a text of any length is searched whole, and only its repetitive parts, joined where they touch, go
    through the search for squares. Of runs of equal length the first, then that of the smallest period, is described. Repeated rows are rows of
    their own; a null doc_id is never edited; an empty table gives an empty one; columns already named as those added are replaced, all others stay.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    docs = docs.drop(*names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text"))
            rows = []
            for doc, text in zip(ids.to_pylist(), texts.cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                h = zlib.crc32(str(doc).encode()) if edited and doc is not None and words else 1
                rows.append(describe(words if h % 10 else repeated_tail(words, h), least_words, periods))
            columns = [[*c] for c in zip(*rows, strict=True)] or [[] for _ in names]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs, FIELDS))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods in every whole text, the tails of some texts made periodic first."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs(docs, edited=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


OP13_SQL = f"""
WITH given AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, {crc32_sql("doc_id::VARCHAR")}::BIGINT AS h FROM documents
), sized AS (
    SELECT *, len(words) AS n, coalesce(h % 10 = 0, false) AND len(words) > 0 AS tail, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM given
), sourced AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized
), numbered AS (
    SELECT *, unnest(range(n)) AS i FROM sourced
), edited AS (
    SELECT row_no, n, i, words[CASE WHEN tail AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM numbered
), equal_words AS (
    SELECT x.row_no, x.i, y.i - x.i AS q FROM edited x JOIN edited y ON x.row_no = y.row_no AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * {LEAST_PERIODS} <= x.n
), stretches AS (
    SELECT row_no, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row_no, q ORDER BY i) AS island FROM equal_words) GROUP BY row_no, q, island
    HAVING count(*) + q >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q)
), runs AS (
    SELECT row_no, start, length, min(q) AS q FROM stretches GROUP BY row_no, start, length
), summed AS (
    SELECT row_no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
           list({{'start': start, 'length': length, 'q': q}} ORDER BY length DESC, start, q)[1] AS longest
    FROM runs GROUP BY row_no
), kept AS (
    SELECT e.row_no, string_agg(e.w, ' ' ORDER BY e.i) AS kept FROM edited e
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row_no = e.row_no AND e.i >= r.start + r.q AND e.i < r.start + r.length) GROUP BY e.row_no
)
SELECT g.doc_id, coalesce(s.n_runs, 0) AS n_runs, s.longest.start::BIGINT AS start, s.longest.length::BIGINT AS length, s.longest.q::BIGINT AS period,
       (1000 * s.longest.length // s.longest.q)::BIGINT AS exponent_milli, sha256(coalesce(s.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM given g LEFT JOIN summed s ON g.row_no = s.row_no LEFT JOIN kept k ON g.row_no = k.row_no
"""
