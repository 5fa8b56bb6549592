"""Removal of repeated byte passages by content-defined sampling and grouping of hashes, spread over shards.

This replaces an external induced sort of suffixes: no suffix is ordered by its bytes, no common-prefix value is carried, and there
are no queues, recursion or merges on disk. Of every string of LENGTH bytes the GRAM-byte gram of least hash is its sample
(winnowing), so each such string holds at least one, at the same place wherever the string occurs. Samples are grouped
by hash, and what one decides for the strings around it is found by the hashes of their contexts. Shards are
ranges of the samples' hashes, mixed once more; tasks hold a bounded part at a time. A sample that very many texts hold may have as many different contexts; its
strings are dealt over the shards one by one, by their own hashes. The README has figures of an attempt to order all suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import lean, mixed, text_chunks
from citelink.sources.scratch import dropped, stored

LENGTH, GRAM = 50, 24
#: Text bytes whose samples share a shard, and samples that are grouped at a time.
SHARD_BYTES, RUN = 8 << 20, 1 << 13
#: Texts that may hold a sample before its strings are dealt one by one: this many, or one for each of so many bytes in all,
#: so that there are at most MOST_HOT such samples (8 bytes each), about a fourteenth of that in plain text, however large the input is.
HOT_TEXTS, MOST_HOT = 1000, 1 << 24
#: Text bytes that a task samples at a time, and those after which it sends samples on.
READ_BYTES, SEND_BYTES = 1 << 16, 4 << 20
#: Low bits of a sample's rank that hold its place; longer texts are read in overlapping parts.
PLACE_BITS = 24
PART_BYTES = 4 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, place, first, last, hash) of the sampled grams of UTF-8 rows.

    Of the ``length - gram + 1`` grams in a string of ``length`` bytes the one of least hash is its sample (the first
    of equals). ``first`` to ``last`` are the starts of the strings that a sample decides. Places are in ``data``.
    """
    found = []
    for a, b in _parts(data, offsets, length):
        part = data[a:b]
        grams = len(part) - gram + 1
        two = part[:-1].astype(np.uint64) | part[1:].astype(np.uint64) << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        h = np.zeros(grams, np.uint64)
        for i in (*range(0, gram - 8, 8), gram - 8):
            h = mixed(h * _B + eight[i : i + grams] * _A)
        low = np.uint64((1 << PLACE_BITS) - 1)
        rank = (h & ~low) | np.arange(grams, dtype=np.uint64)
        width, reach = length - gram + 1, 1
        least = rank
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        at = np.arange(len(least))
        row = np.searchsorted(offsets, at + a, "right") - 1
        inside = at + a + length <= offsets[row + 1]
        at, row, best = at[inside], row[inside], (least[inside] & low).astype(np.int64)
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        found.append((row[first], best[first] + a, at[first] + a, at[last] + a, h[best[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parts(data: np.ndarray, offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ranges of the data that hold every string of ``length`` bytes of a row in just one."""
    if len(data) < length:
        return []
    if len(data) <= PART_BYTES:
        return [(0, len(data))]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out += [(x, min(x + PART_BYTES + length - 1, b)) for x in range(a, max(a + 1, b - length + 1), PART_BYTES) if b - x >= length]
    return out


#: Bytes of a hash that are sent where hashes are only matched: a chance match merely adds a sample to look at.
SHORT = 5


def _short(h: np.ndarray) -> np.ndarray:
    """The low bytes of hashes, packed."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :SHORT]).ravel()


def _widened(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // SHORT, 8), np.uint8)
    out[:, :SHORT] = packed.reshape(-1, SHORT)
    return out.view(np.uint64).ravel()


_LOW = np.uint64((1 << 8 * SHORT) - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays))


def _unpacked(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) of each value in an array."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
        yield group[order[a]].item(), order[a:b]


def _rows(kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows (shard, kind, blob): packed arrays on their way to the task that has their shard."""
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["shard", "kind", "blob"])


_ROWS = "shard int, kind int, blob binary"
#: Kinds of rows: what a shard has to group, answers to texts (dealt by the texts' keys), samples that very many texts hold, and strings of these.
_ASKED, _ANSWER, _HOT, _STRINGS = 0, 1, 2, 3


def _bucket(key: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(key.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of hashes, mixed once more: a sample's hash is the least of many, so plain ranges would put most samples into the first."""
    return ((mixed(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _answers(shards: int, key: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Arrays that go with texts' keys, by bucket of the key."""
    return [(k, _packed(key[at], *(x[at] for x in arrays))) for k, at in _by(_bucket(key, shards))]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(shard, kind, blob) of rows, one at a time."""
    for batch in batches:
        shard, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            yield shard[i], kind[i], batch.column(2)[i].as_py()


def _shared_by(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples in order of hash and text, repeats left out, and which of them two texts or more hold."""
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    own = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])]) if len(h) else np.zeros(0, bool)
    h, key = h[own], key[own]
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    return h, key, many


def _sampled(shards: int):
    """Of (key, text): by shard the samples' hashes; what two texts here share is known at once and sent but once."""

    def sent(got: list) -> Iterator[pa.RecordBatch]:
        h, key, many = _shared_by(*(np.concatenate(x) for x in zip(*got, strict=True)))
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else many
        h1, key1 = h[first], key[first]
        texts = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.uint32)  # more than one: those are sure
        yield _rows(_ASKED, [(k, _packed(_short(h1[at]), key1[at], texts[at])) for k, at in _by(_shard(h1, shards))])
        yield _rows(_ANSWER, _answers(shards, key[many], h[many]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, _, data, offsets in text_chunks(batch.column(1), READ_BYTES):
                row, _, _, _, h = samples(data, offsets)
                got.append((h, keys[at + row]))
                held += len(data)
                if held >= SEND_BYTES:
                    yield from sent(got)
                    got, held = [], 0
        if got:
            yield from sent(got)

    return run


def _repeated(shards: int, hot_texts: int):
    """Of rows sorted by shard: for the texts, the hashes of their samples that some other text holds too; and what ``hot_texts`` hold."""

    def done(held: list) -> Iterator[pa.RecordBatch]:
        h, key, texts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, key, texts = h[order], key[order], texts[order]
        same = h[1:] == h[:-1]
        many = np.zeros(len(h), bool)
        many[1:] |= same
        many[:-1] |= same
        fresh = many & (texts == 1)  # the others know already
        yield _rows(_ANSWER, _answers(shards, key[fresh], h[fresh]))
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            hot = h[first][np.add.reduceat(texts.astype(np.int64), first) >= hot_texts]
            if len(hot):
                yield _rows(_HOT, [(shards, hot.tobytes())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for shard, kind, blob in _each(batches):
            if kind == _ANSWER:
                yield _rows(_ANSWER, [(shard, blob)])
                continue
            if shard != now:
                if held:
                    yield from done(held)
                now, held = shard, []
            short, keys, texts = _unpacked(blob, (np.uint8, np.int64, np.uint32))
            held.append((_widened(short), keys, texts))
        if held:
            yield from done(held)

    return run


@lean
def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of answers sorted by bucket: one row for each text with its samples' hashes, short; rows without a key hold those of hot samples."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        key, h = (np.concatenate(x) for x in zip(*held, strict=True))
        out = [(k, _short(h[at]).tobytes()) for k, at in _by(key)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "hashes"])

    for bucket, kind, blob in _each(batches):
        if kind == _HOT:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([blob], pa.binary())], ["key", "hashes"])
            continue
        if bucket != now:
            if held:
                yield done()
            now, held = bucket, []
        held.append(_unpacked(blob, (np.int64, np.uint64)))
    if held:
        yield done()


_KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint8)


def _contexts(shards: int, hot: np.ndarray):
    """Of each text with its shared samples: by shard the bytes that each of these decides on; of ``hot`` samples (short hashes, sorted) the strings."""

    def strings(at: np.ndarray, h, doc, key, first, more, begin, text) -> Iterator[pa.RecordBatch]:
        """Rows for contexts at the given places: of each string the hash and the first document here, answers for the others."""
        n = more[at].astype(np.int64) + 1
        which = np.repeat(at, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        codes = mixed(_codes(text, begin[which] + step) + h[which] * _B)
        late = _later(codes, doc[which])
        start = first[which] + step
        yield _rows(_ANSWER, _answers(shards, *_runs(key[which[late]], start[late], start[late] + LENGTH)))
        codes, which, start = codes[~late], which[~late], start[~late]
        yield _rows(_STRINGS, [(k, _packed(codes[x], doc[which[x]], key[which[x]], start[x])) for k, x in _by(_shard(codes, shards))])

    def sent(got: list) -> Iterator[pa.RecordBatch]:
        h, whole, doc, key, first, more, place, size, text = (np.concatenate(x) for x in zip(*got, strict=True))
        # equal contexts: those of later documents go, the first document's stand for all
        order = np.lexsort((doc, whole))
        head = np.concatenate([[True], whole[order][1:] != whole[order][:-1]]) if len(order) else np.zeros(0, bool)
        least = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        late = np.zeros(len(order), bool)
        late[order] = doc[order] > least
        start = np.cumsum(size) - size
        yield _rows(_ANSWER, _answers(shards, *_runs(key[late], first[late], first[late] + more[late] + LENGTH)))
        many = np.isin(h & _LOW, hot) & ~late
        at = np.flatnonzero(many)
        for a in range(0, len(at), RUN // 4):
            yield from strings(at[a : a + RUN // 4], h, doc, key, first, more, start, text)
        stay, out = np.flatnonzero(~late & ~many), []
        for k, at in _by(_shard(h[stay], shards)):
            at = stay[at]
            n = size[at]
            begin = np.cumsum(n) - n
            out.append((k, _packed(h[at], whole[at], doc[at], key[at], first[at], more[at], place[at], text[np.repeat(start[at] - begin, n) + np.arange(int(n.sum()))])))
        yield _rows(_ASKED, out)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            keys, docs, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for at, n, data, offsets in text_chunks(batch.column(2), READ_BYTES):
                row, place, first, last, h = samples(data, offsets)
                known = [_widened(np.frombuffer(lists[at + r].as_buffer(), np.uint8)) for r in range(n)]
                salt = np.arange(1, n + 1, dtype=np.uint64) * _B
                wanted = np.concatenate([mixed(x + salt[r]) for r, x in enumerate(known)])
                keep = np.isin(mixed((h & _LOW) + salt[row]), wanted)
                row, place, first, last, h = row[keep], place[keep], first[keep], last[keep], h[keep]
                size = last - first + LENGTH
                start = np.cumsum(size) - size
                step = np.arange(int(size.sum())) - np.repeat(start, size)
                text = data[np.repeat(first, size) + step]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(text.astype(np.uint64) + step.astype(np.uint64) * np.uint64(256) + np.uint64(1)), dtype=np.uint64)])
                whole = mixed(sums[start + size] - sums[start] + h + (place - first).astype(np.uint64) * _A)
                got.append((h, whole, docs[at + row], keys[at + row], first - offsets[row], (last - first).astype(np.uint8), (place - first).astype(np.uint8), size, text))
                held += len(text)
                if held >= SEND_BYTES:
                    yield from sent(got)
                    got, held = [], 0
        if got:
            yield from sent(got)

    return run


def _runs(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (key, start, end) in order, put together where those of one key meet."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    lift = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(key) - 1]])
    return key[at], start[at], reach[last] - lift[last]


def _later(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which strings an earlier document here holds too."""
    late = np.zeros(len(codes), bool)
    if len(codes):
        order = np.lexsort((doc, codes))
        codes, doc = codes[order], doc[order]
        top = np.concatenate([[True], codes[1:] != codes[:-1]])
        late[order] = doc > doc[np.maximum.accumulate(np.where(top, np.arange(len(top)), 0))]
    return late


def _matched(shards: int):
    """Of rows sorted by shard: for the texts, the ranges that strings of earlier documents cover."""

    def compared(held: list) -> pa.RecordBatch:
        codes, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
        late = _later(codes, doc)
        return _rows(_ANSWER, _answers(shards, *_runs(key[late], start[late], start[late] + LENGTH)))

    def done(held: list) -> pa.RecordBatch:
        h, whole, doc, key, first, more, place, text = (np.concatenate(x) for x in zip(*held, strict=True))
        size = more.astype(np.int64) + LENGTH
        start = np.cumsum(size) - size
        order = np.lexsort((doc, whole, h))
        cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        out, a = [], 0
        while a < len(cuts):  # whole groups of one hash, about RUN samples at a time
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + RUN)))
            at = order[cuts[a] : cuts[b] if b < len(cuts) else len(order)]
            a = b
            which, x, y = _decided(h[at], whole[at], doc[at], first[at], more[at], start[at], text)
            out.append(_runs(key[at][which], x, y))
        return _rows(_ANSWER, _answers(shards, *_runs(*(np.concatenate(x) for x in zip(*out, strict=True)))))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for shard, kind, blob in _each(batches):
            if kind == _ANSWER:
                yield _rows(_ANSWER, [(shard, blob)])
                continue
            if (shard, kind) != now:
                if held:
                    yield (compared if now[1] == _STRINGS else done)(held)
                now, held = (shard, kind), []
            held.append(_unpacked(blob, (np.uint64, np.int64, np.int64, np.int64) if kind == _STRINGS else _KINDS))
        if held:
            yield (compared if now[1] == _STRINGS else done)(held)

    return run


@lean
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of answers sorted by bucket: one row for each text with its ranges as pairs of 64-bit integers."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        key, start, end = _runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
        pairs = np.stack([start, end], 1)
        out = [(k, pairs[at].tobytes()) for k, at in _by(key)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "spans"])

    for bucket, _, blob in _each(batches):
        if bucket != now:
            if held:
                yield done()
            now, held = bucket, []
        held.append(_unpacked(blob, (np.int64, np.int64, np.int64)))
    if held:
        yield done()


def _codes(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of LENGTH bytes that start at the given places, RUN places at a time."""
    out = np.zeros(len(begin), np.uint64)
    for a in range(0, len(begin), RUN):
        at, codes = begin[a : a + RUN], np.zeros(len(begin[a : a + RUN]), np.uint64)
        for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            eight = np.zeros(len(at), np.uint64)
            for i in range(8):
                eight |= text[at + (j + i)].astype(np.uint64) << np.uint64(8 * i)
            codes = mixed(codes + eight * _A + np.uint64(j + 1))
        out[a : a + RUN] = codes
    return out


def _decided(h, whole, doc, first, more, start, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, start, end) of ranges to remove, from samples in order of hash, context and document."""
    head = np.concatenate([[True], whole[1:] != whole[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    late = doc > doc[lead]  # the same bytes around the sample in an earlier document: all of its strings go
    out = [(np.flatnonzero(late), first[late], first[late] + more[late] + LENGTH)]
    # several contexts of one hash: their strings of LENGTH bytes are compared one by one, a context's first document standing for it
    group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    contexts = np.bincount(group, head)
    open_ = np.flatnonzero(~late & (contexts[group] > 1))
    if len(open_):
        n = more[open_].astype(np.int64) + 1
        which = np.repeat(open_, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        begin = start[which] + step
        codes = mixed(_codes(text, begin) + group[which].astype(np.uint64) * _B)
        gone = np.flatnonzero(_later(codes, doc[which]))
        out.append((which[gone], first[which[gone]] + step[gone], first[which[gone]] + step[gone] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "kind")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans binary, copy boolean) of documents (key, doc_id, text) that lose bytes; a copy loses all."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-total // SHARD_BYTES))
    asked = docs.select("key", "text").mapInArrow(_sampled(shards), _ROWS)
    answers = _by_shard(asked).mapInArrow(_repeated(shards, max(HOT_TEXTS, total // MOST_HOT)), _ROWS)
    lists = stored(_by_shard(answers).mapInArrow(_lists, "key bigint, hashes binary"), "lists")
    hot = np.frombuffer(b"".join(bytes(r[0]) for r in lists.where("key is null").select("hashes").collect()), np.uint64)
    hot = np.unique(hot)  # bounded by MOST_HOT
    digest = docs.where(F.octet_length("text") >= LENGTH).select("key", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    digest = stored(digest, "digest")
    many = stored(digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "many")
    copies = stored(digest.join(many, "digest").where("doc_id > least").select("key").distinct(), "copies")
    open_ = docs.join(copies, "key", "left_anti").join(lists, "key").select("key", "doc_id", "text", "hashes")
    found = _by_shard(open_.mapInArrow(_contexts(shards, hot), _ROWS)).mapInArrow(_matched(shards), _ROWS)
    spans = stored(_by_shard(found).mapInArrow(_spans, "key bigint, spans binary"), "spans")
    dropped(lists, digest, many)
    return spans.join(copies.withColumn("copy", F.lit(True)), "key", "full_outer").withColumn("copy", F.coalesce("copy", F.lit(False)))


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for s in range(0, whole.num_rows, 512):
            batch = whole.slice(s, 512)
            names = batch.schema.names
            texts, spans, copies = (batch.column(names.index(c)).to_pylist() for c in ("text", "_spans", "_copy"))
            kept, runs, n_bytes, n_removed = [], [], [], []
            for text, blob, copy in zip(texts, spans, copies, strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                pairs = [[0, len(raw)]] if copy else np.frombuffer(blob or b"", np.int64).reshape(-1, 2).tolist()
                out, at = [], 0
                for a, b in pairs:
                    out.append(raw[at:a])
                    at = b
                out.append(raw[at:])
                kept.append(b"".join(out))
                runs.append(len(pairs))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
            own = [n for n in names if n not in ("text", "_spans", "_copy")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(n)) for n in own), pa.array(n_bytes), pa.array(n_removed), pa.array(runs), pa.array(kept, pa.binary())], [*own, "n_bytes", "n_removed", "n_spans", "kept"]
            )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of (doc_id, text): each byte goes that a string of LENGTH bytes covers
    which also starts in a document of smaller doc_id. Strings are judged on the input and don't cross documents.

    What is kept may be cut inside a character, so it is binary. Null texts are empty. Rows with the same doc_id are one
    document: they never take bytes from each other. Rows without a doc_id keep their bytes and take none.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("key", F.xxhash64("text", "doc_id"))
    spans = repeated_spans(keyed.where("doc_id is not null"))
    both = keyed.join(spans.select("key", F.col("spans").alias("_spans"), F.col("copy").alias("_copy")), "key", "left")
    return both.select("doc_id", "text", "_spans", F.coalesce("_copy", F.lit(False)).alias("_copy")).mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that earlier documents hold."""
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)
), first AS (SELECT s, min(doc_id) AS owner, max(doc_id) AS last FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (SELECT t.doc_id, t.i FROM starts t JOIN first f ON t.s = f.s AND f.owner < t.doc_id
), edges AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, TRUE) AS opens FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges) GROUP BY doc_id, r
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM (
        SELECT r.doc_id, r.b AS x, coalesce(lead(r.a) OVER (PARTITION BY r.doc_id ORDER BY r.a), len(h) // 2) AS y, h FROM runs r JOIN d ON d.doc_id = r.doc_id
        UNION ALL SELECT r.doc_id, 0, min(r.a), min(h) FROM runs r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
