"""Language-model scores of texts: quantised n-gram counts in a log-frequency Bloom filter, smoothed from repeated membership probes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import lean, mixed, read_table, text_chunks, with_fields
from citelink.llm.near_dup import word_hashes
from citelink.sources.scratch import dropped, stored

#: Words of the longest n-grams.
ORDER = 2
#: A count is kept as the number of these thresholds that it reaches: each is a quarter, and at least one, above the one before.
THRESHOLDS = [1]
while THRESHOLDS[-1] < 1 << 60:
    THRESHOLDS.append(max(THRESHOLDS[-1] + 1, math.ceil(THRESHOLDS[-1] * 1.25)))
#: Filter bits for each (n-gram, level), and bits that an n-gram and level sets, all in one block of 256.
BITS, PROBES, BLOCK = 12, 4, 256
#: N-gram tokens of one segment of the filter, which one task merges, and the most bytes of filter and word counts that are broadcast at a time.
SEGMENT_TOKENS, MOST_BYTES = 1 << 20, 80 << 20
#: The counts that the next shorter n-gram's probability adds to a history, as if it had been seen so many times more.
PRIOR = 200.0
#: Bytes of text whose n-grams are counted together before they are shuffled.
COUNT_BYTES = 4 << 20
_ADDED = ("n_tokens", "n_known", "base_score", "score")
_SO_FAR = ("_levels", "_known", "_base")

_END = np.uint64(0x6A09E667F3BCC909)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(THRESHOLDS), counts, "right").astype(np.uint8)


def expected_counts() -> np.ndarray:
    """For each level the count that it stands for: its only one, or the middle of its counts on a log scale."""
    low = np.array(THRESHOLDS, float)
    high = np.append(low[1:] - 1, low[-1])
    return np.concatenate([[0.0], np.sqrt(low * high)])


def ngrams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1-grams to ``order``-grams that end at each token of the rows, and each row's first token.

    A row's tokens are its words and one end; what would lie before its first word counts as ends.
    """
    words, at = word_hashes(data, offsets)
    rows = len(offsets) - 1
    first = at + np.arange(rows + 1)
    tokens = np.full(len(words) + rows, _END)
    inside = np.ones(len(tokens), bool)
    inside[first[1:] - 1] = False
    tokens[inside] = words
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    found, gram = [], np.zeros(len(tokens), np.uint64)
    for n in range(order):
        before = np.full(len(tokens), _END)
        before[n:] = tokens[: len(tokens) - n]
        before[place < n] = _END
        gram = mixed(gram * _STEP + before + np.uint64(n + 1))
        found.append(gram)
    return found, first


def _segment(grams: np.ndarray, segments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)


def _places(grams: np.ndarray, level: int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram and level's block, and 32 bits of which every eight name a bit of the block."""
    h = mixed(grams + np.uint64(level * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(32)) * np.asarray(blocks).astype(np.uint64) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(segment: np.ndarray, cuts: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    return {int(segment[a]): values[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(values)][: len(cuts)], strict=True)}


def _counted(order: int, segments: int):
    """By segment, the words and the longer n-grams of some text and how often each comes."""

    def part(words: list[np.ndarray], longer: list[np.ndarray]) -> pa.RecordBatch:
        columns = []
        for grams in (words, longer):
            grams, counts = np.unique(np.concatenate(grams or [np.zeros(0, np.uint64)]), return_counts=True)
            segment = _segment(grams, segments)
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            columns += [_packed(segment, cuts, grams), _packed(segment, cuts, counts.astype(np.uint32))]
        some = sorted({*columns[0], *columns[2]})
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([c.get(k, b"") for k in some], pa.binary()) for c in columns)], ["segment", "words", "word_counts", "grams", "counts"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, longer, size = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):  # hashes take far less memory than the work of hashing
                found, _ = ngrams(data, offsets, order)
                words.append(found[0])
                longer += found[1:]
                size += len(data)
                if size >= COUNT_BYTES:
                    yield part(words, longer)
                    words, longer, size = [], [], 0
        if words:
            yield part(words, longer)

    return run


_PARTS = "segment int, words binary, word_counts binary, grams binary, counts binary"
_SEGMENTS = "segment int, tokens bigint, blocks bigint, filter binary, words binary, counts binary"


class _Sums:
    """Counts that are added up. Equal keys become one whenever many have come in, so that the distinct keys of a segment bound the memory."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: bytes, counts: bytes) -> None:
        self.keys.append(np.frombuffer(keys, np.uint64))
        self.counts.append(np.frombuffer(counts, np.uint32).astype(np.int64))
        self.waiting += len(self.keys[-1])
        if self.waiting > 2 * SEGMENT_TOKENS:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate(self.counts))
        self.keys, self.counts, self.waiting = [values], [counts], 0
        return values, counts


def _filter(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(blocks, filter) that hold every n-gram with each level up to its count's."""
    levels = _levels_of(counts)
    blocks = max(1, -(-int(levels.sum(dtype=np.int64)) * BITS // BLOCK))
    held = np.zeros(blocks * BLOCK, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        block, inside = _places(keys[levels >= level], level, blocks)
        for i in range(PROBES):
            held[block * BLOCK + (inside >> np.uint32(8 * i) & np.uint32(255))] = True
    return blocks, np.packbits(held, bitorder="little").tobytes()


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by segment: each segment's filter and exact word counts."""
    now, words, grams = None, _Sums(), _Sums()

    def done() -> pa.RecordBatch:
        (w, n), (g, m) = words.total(), grams.total()
        blocks, held = _filter(np.concatenate([w, g]), np.concatenate([n, m]))
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), *(pa.array([x], pa.int64()) for x in (int(n.sum()), blocks)), *(pa.array([x], pa.binary()) for x in (held, w.tobytes(), n.tobytes()))], ["segment", "tokens", "blocks", "filter", "words", "counts"]
        )

    for batch in batches:
        for segment, w, n, g, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                if now is not None:
                    yield done()
                now, words, grams = segment, _Sums(), _Sums()
            words.add(w, n)
            grams.add(g, m)
    if now is not None:
        yield done()


@dataclass(frozen=True)
class Model:
    """A filter in segments, with the words of each and their exact counts, as a table in the shared folder; and what the smoothing needs besides."""

    parts: DataFrame
    segments: int
    order: int
    tokens: int
    distinct: int
    texts: int


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all texts of ``docs``: every n-gram and word counts. An empty table gives a model that knows none.

    N-grams are counted in chunks of text and added up by segments of their hashes, so that a frequent one is a row for each chunk, never one for each place.
    Words and n-grams are known by 64-bit hashes; among 10**9 different ones two agree with a chance of about 3 %.
    """
    texts, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    segments = max(1, -(-(chars // 6 + texts) * order // SEGMENT_TOKENS))
    parts = docs.select("text").mapInArrow(_counted(order, segments), _PARTS)
    table = stored(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, _SEGMENTS), "ngrams")
    tokens, distinct = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.expr("length(words) div 8")), F.lit(0))).first()
    return Model(table, segments, order, tokens, distinct, texts)


class _Held:
    """Some neighbouring segments of a model, in one piece of memory."""

    def __init__(self, segments: list, rows: Iterator):
        """``segments``: (segment, blocks, filter bytes, words) of each, ascending; ``rows``: (segment, filter, words, counts) in any order."""
        self.first, self.last = (segments[0][0], segments[-1][0]) if segments else (0, -1)
        self.blocks, self.start = np.zeros(self.last - self.first + 1, np.int64), np.zeros(self.last - self.first + 1, np.int64)
        size, n, at = 0, 0, {}
        for segment, blocks, held, words in segments:
            self.blocks[segment - self.first], self.start[segment - self.first] = blocks, size
            at[segment] = size, n
            size, n = size + held, n + words
        self.data, self.words, self.counts = np.zeros(max(size, 1), np.uint8), np.zeros(n, np.uint64), np.zeros(n, np.uint8)  # segments ascend as hashes do
        high_at, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # few words have counts of 255 or more
        for segment, held, words, counts in rows:
            size, n = at[segment]
            self.data[size : size + len(held)] = np.frombuffer(held, np.uint8)
            self.words[n : n + len(words) // 8] = np.frombuffer(words, np.uint64)
            exact = np.frombuffer(counts, np.int64)
            self.counts[n : n + len(exact)] = np.minimum(exact, 255)
            high_at.append(n + np.flatnonzero(exact >= 255))
            high.append(exact[exact >= 255])
        order = np.argsort(np.concatenate(high_at))
        self.high_at, self.high = np.concatenate(high_at)[order], np.concatenate(high)[order]

    def levels(self, grams: np.ndarray, segments: int) -> np.ndarray:
        """The n-grams' levels, each the last that is found when probing from the first up; 0 for those of other segments."""
        segment = _segment(grams, segments)
        found = np.zeros(len(grams), np.uint8)
        left = np.flatnonzero((segment >= self.first) & (segment <= self.last))
        segment = segment[left] - self.first
        keys, blocks, start = grams[left], self.blocks[segment], self.start[segment]
        some = blocks > 0
        left, keys, blocks, start = left[some], keys[some], blocks[some], start[some]
        level = 0
        while len(left):
            level += 1
            block, inside = _places(keys, level, blocks)
            at = start + block * (BLOCK // 8)
            held = np.ones(len(left), bool)
            for i in range(PROBES):
                bit = inside >> np.uint32(8 * i) & np.uint32(255)
                held &= self.data[at + (bit >> np.uint32(3))] >> (bit & np.uint32(7)).astype(np.uint8) & np.uint8(1) > 0
            left, keys, blocks, start = left[held], keys[held], blocks[held], start[held]
            found[left] = level
        return found

    def exact(self, words: np.ndarray) -> np.ndarray:
        """The words' counts; 0 for those of other segments."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        counts = np.where(self.words[at] == words, self.counts[at], np.uint8(0)).astype(np.int64)
        high = np.flatnonzero(counts == 255)
        counts[high] = self.high[np.searchsorted(self.high_at, at[high])]
        return counts


def _log_scores(levels: np.ndarray, starts: np.ndarray, model: dict) -> np.ndarray:
    """log10 of each row's probability: of every order, a count over its history's, with the next shorter order as a prior."""
    counts = expected_counts()[levels]
    p = (counts[0] + 1) / (model["tokens"] + model["distinct"] + 1)
    for n in range(1, len(counts)):
        history = np.concatenate([[0.0], counts[n - 1][:-1]])
        history[starts] = model["texts"]
        p = (np.minimum(counts[n], history) + PRIOR * p) / (history + PRIOR)
    return np.add.reduceat(np.log10(p), starts)


def _probed(shared, model: dict, last: bool):
    """Rows with what these segments tell of their n-grams and words; in the last round, with the scores that follow."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            names = batch.schema.names
            so_far, known, base = (batch.column(names.index(c)) for c in _SO_FAR)
            known, base = known.to_numpy(zero_copy_only=False).copy(), base.to_numpy(zero_copy_only=False).copy()
            sizes, scores, kept = [], [], []
            for row, rows, data, offsets in text_chunks(batch.column(names.index("text"))):
                found, first = ngrams(data, offsets, model["order"])
                starts = first[:-1]
                words, at = np.unique(found[0], return_inverse=True)
                levels = np.stack([held.levels(words, model["segments"])[at], *(held.levels(g, model["segments"]) for g in found[1:])])
                exact = held.exact(words)
                known[row : row + rows] += np.add.reduceat((exact > 0).astype(np.int64)[at], starts)
                base[row : row + rows] += np.add.reduceat(np.log10(exact + 1.0)[at], starts)
                if so_far.null_count < len(so_far):
                    for i in range(rows):
                        levels[:, first[i] : first[i + 1]] |= np.frombuffer(so_far[row + i].as_py(), np.uint8).reshape(len(found), -1)
                if last:
                    sizes.append(np.diff(first))
                    scores.append(_log_scores(levels, starts, model))
                else:
                    kept += [levels[:, first[i] : first[i + 1]].tobytes() for i in range(rows)]
            own = [(batch.column(i), n) for i, n in enumerate(names) if n not in _SO_FAR]
            if last:
                size = np.concatenate(sizes or [np.zeros(0, np.int64)])
                added = zip([pa.array(size), pa.array(known), pa.array(base - size * math.log10(model["tokens"] + model["distinct"] + 1)), pa.array(np.concatenate(scores or [np.zeros(0)]))], _ADDED, strict=True)
            else:
                added = zip([pa.array(kept, pa.binary()), pa.array(known), pa.array(base)], _SO_FAR, strict=True)
            columns, labels = zip(*own, *added, strict=True)
            yield pa.RecordBatch.from_arrays([*columns], [*labels])

    return run


def score(docs: DataFrame, model: Model, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` (text and any other columns) with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    ``score`` is the log10 probability of the whole text. Of each n-gram the filter tells the level of its count, by probing level after level until
    one isn't held; a level too high is found with a chance of about one in a hundred. ``base_score`` takes exact counts of words alone, ``n_known`` counts the tokens learned.
    Filter and word counts are broadcast at most ``most_bytes`` at a time: a larger model goes round after round over the texts, which keep
    what was found so far, and results are the same whatever the rounds.

    A null or empty text has one token, its end. Very long texts are scored whole; repeated rows alike; an empty table gives
    an empty one. Columns already named as those added are replaced, all others stay.
    """
    docs = docs.drop(*_ADDED, *_SO_FAR)
    spark = docs.sparkSession
    about = {k: getattr(model, k) for k in ("segments", "order", "tokens", "distinct", "texts")}
    sizes = model.parts.selectExpr("segment", "blocks", "length(filter)", "length(words) div 8").collect()  # four numbers for each segment
    groups: list[list] = [[]]
    room = most_bytes
    for segment in sorted(map(tuple, sizes)):
        room -= segment[2] + 9 * segment[3]
        if room < 0 and groups[-1]:
            groups.append([])
            room = most_bytes - segment[2] - 9 * segment[3]
        groups[-1].append(segment)
    rows, old = docs.withColumns({"_levels": F.lit(None).cast("binary"), "_known": F.lit(0).cast("bigint"), "_base": F.lit(0.0)}), None
    for i, group in enumerate(groups):
        wanted = model.parts.where(F.col("segment").between(group[0][0], group[-1][0])) if group else model.parts
        shared = spark.sparkContext.broadcast(_Held(group, wanted.select("segment", "filter", "words", "counts").toLocalIterator()))
        if i + 1 == len(groups):
            return rows.mapInArrow(_probed(shared, about, True), with_fields(docs, "n_tokens bigint, n_known bigint, base_score double, score double"))
        rows = stored(rows.mapInArrow(_probed(shared, about, False), with_fields(docs, "_levels binary, _known bigint, _base double")), "levels")
        shared.unpersist()
        if old is not None:
            dropped(old)
        old = rows
    raise AssertionError


def op12_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the filter's model and by exact word counts, both learned from six sevenths of the documents.

    A null doc_id is never held out. A null text is empty: one token. Rows that repeat a doc_id are rows of their own.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    model = fit(docs.where(~F.col("held_out")))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
