"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import lean, mixed, text_chunks, with_fields

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 29
#: Sharpness of the sampling: 1 takes the pieces' weights as they are, larger values come closer to the best segmentation.
SHARPNESS = 1.0
#: Characters whose distinct units share one pass.
PASS_CHARS = 1 << 18
#: Longer units are cut where no piece crosses, which changes nothing and lets their parts be worked on side by side.
LONG_UNIT = 64
#: With fewer unfinished units than this, one character after another is cheaper than a step over arrays.
FEW_UNITS = 8
_BYTE_BASE = 1 << 24
_TURN = 0x9E3779B97F4A7C15
#: Added to a weight for each character covered: the same on every path, it only keeps sums near 1.
_PER_CHAR = 2.5


class Pieces:
    """A piece vocabulary: which strings are pieces, their log weights, and the bytes that each id stands for."""

    def __init__(self, proto: bytes, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in plain]
        ranked = sum(x == int(x) for x in scores) > 0.9 * len(scores)  # a BPE model's scores are merge ranks, not log probabilities
        weight = (lambda s: -math.log(2.0 - s)) if ranked else (lambda s: s)
        self.ids = {model.id_to_piece(i).replace("▁", " "): (i, sharpness * weight(s)) for i, s in zip(plain, scores, strict=True)}
        least = min((w for _, w in self.ids.values()), default=0.0)
        self.byte_weight = least - 1.0
        self.byte_ids = np.zeros(256, np.int32)
        of = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                of[i] = bytes([value])
        for p, (i, _) in self.ids.items():
            of[i] = p.encode()
        ends = np.cumsum([0, *map(len, of)])
        self.starts, self.lengths, self.data = ends[:-1], np.diff(ends), np.frombuffer(b"".join(of), np.uint8)
        # where no piece goes on with a blank after another character, the lattice falls apart before every blank
        apart = not any(" " in p.lstrip(" ") or "\n" in p for p in self.ids)
        self.units = re.compile(r" *[^ \n]+| +|\n") if apart else re.compile(r".+", re.S)
        self._index()

    def _index(self) -> None:
        """An open-addressed table of all prefixes of pieces by their rolling hash, with the piece that ends there."""
        prefixes: dict[str, tuple[int, float]] = {}
        for p, hit in self.ids.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], (-1, 0.0))
            prefixes[p] = hit
        self.bits = max(4, (len(prefixes) * 4).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.hit, self.weight = np.full(1 << self.bits, -2, np.int32), np.zeros(1 << self.bits)
        mask, hashes = (1 << 64) - 1, []
        for p in prefixes:
            h = 0
            for c in p:
                h = (h * _TURN + ord(c) + 1) & mask
            hashes.append(h)
        keys = np.array(hashes, np.uint64)
        taken = bytearray(1 << self.bits)
        places = []
        for at in (mixed(keys) >> np.uint64(64 - self.bits)).tolist():
            while taken[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            taken[at] = 1
            places.append(at)
        self.key[places], self.hit[places], self.weight[places] = keys, [i for i, _ in prefixes.values()], [w for _, w in prefixes.values()]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Table slots of rolling hashes; -1 where no piece begins so."""
        at = (mixed(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero(self.key[at] != h)
        while len(open_):
            free = self.hit[at[open_]] == -2
            at[open_[free]] = -1
            open_ = open_[~free]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[self.key[at[open_]] != h[open_]]
        return at

    def _matches(self, chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width: it, where pieces so wide start (among places with that many characters ``left``), and their table slots."""
        n = len(chars)
        start, h, width = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64), 0
        while len(start):
            width += 1
            h = h * np.uint64(_TURN) + chars[start + width - 1] + np.uint64(1)
            at = self._find(h)
            go = at >= 0
            start, h, at = start[go], h[go], at[go]
            real = self.hit[at] >= 0
            yield width, start[real], at[real]
            more = left[start] > width
            start, h = start[more], h[more]

    def _parts(self, unit: str) -> list[str]:
        """A unit cut wherever no piece goes over the cut."""
        chars = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(chars)
        over = np.zeros(n + 1, np.int64)
        for width, start, _ in self._matches(chars, np.arange(n, 0, -1)):
            if width > 1:
                np.add.at(over, start + 1, 1)
                np.add.at(over, start + width, -1)
        cuts = np.flatnonzero(np.cumsum(over)[1:n] == 0) + 1
        edges = [0, *cuts.tolist(), n]
        return [unit[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _lattice(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering over many units at once.

        A node is a character at which pieces may end. Returns each unit's first node and, for each node, its first edge;
        for each edge the running chance that a sample takes it or an earlier one of its node, the
        number of characters it covers, and its piece.
        """
        size = np.array([len(u) for u in units], np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, first = len(chars), np.cumsum(size) - size
        local = (np.arange(n) - np.repeat(first, size)).astype(np.int32)
        left = np.repeat(size, size).astype(np.int32) - local
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        plain = np.zeros(n, bool)
        for width, start, at in self._matches(chars, left):
            piece = self.hit[at]
            if width == 1:
                plain[start] = True
                odd = np.flatnonzero(~plain).astype(np.int32)
                wide = 1 + (chars[odd] > 0x7F) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
                ends, ids, weight = np.concatenate([start, odd]), np.concatenate([piece, _BYTE_BASE + chars[odd].astype(np.int32)]), np.concatenate([self.weight[at], self.byte_weight * wide])
            else:
                ends, ids, weight = start + width - 1, piece, self.weight[at]
            found.append((ends, ids, np.exp(weight + _PER_CHAR * width)))
        count = np.zeros(n, np.int64)
        for ends, _, _ in found:
            count[ends] += 1
        edge = np.cumsum(count) - count
        total = int(count.sum())
        filled, value, covers, pieces = np.zeros(n, np.int32), np.zeros(total), np.zeros(total, np.int32), np.zeros(total, np.int32)
        for width in range(len(found), 0, -1):  # long pieces first, as samples mostly take them
            ends, ids, weight = found.pop()
            slot = edge[ends] + filled[ends]
            filled[ends] += 1
            value[slot], covers[slot], pieces[slot] = weight, width, ids
        # mass[i]: the sum over all ways to reach character i, relative to that of the character before it (kept as logs between)
        mass, log_mass = np.zeros(n), np.zeros(n)
        by_local = np.argsort(local, kind="stable")
        cuts = np.cumsum(np.bincount(local)) if n else np.zeros(0, np.int64)
        for t, (a, b) in enumerate(zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True)):
            ends = by_local[a:b]
            if len(ends) < FEW_UNITS:
                self._filter_rest(ends, t, first, size, edge, count, covers, value, log_mass)
                break
            near = log_mass[ends - 1] if t else np.zeros(len(ends))
            counts = count[ends]
            for k in range(int(counts.max())):
                on = counts > k
                sub, base = (ends[on], near[on]) if k else (ends, near)
                slot = edge[sub] + k
                far = covers[slot]
                inner = far <= t
                value[slot] *= np.exp(np.where(inner, log_mass[(sub - far) * inner], 0.0) - base)
                mass[sub] += value[slot]
            log_mass[ends] = np.log(mass[ends]) + near
        run = np.cumsum(value)
        run -= np.repeat(run[edge] - value[edge], count)
        chance = run / np.repeat(np.maximum(run[edge + count - 1], 1e-300), count)
        chance[edge + count - 1] = 2.0
        return first, size, edge, chance, covers, pieces

    @staticmethod
    def _filter_rest(ends, t, first, size, edge, count, covers, value, log_mass) -> None:
        """Forward filtering of a few long units from their character ``t`` on, one character after another."""
        for i in ends.tolist():
            u = int(np.searchsorted(first, i, "right")) - 1
            stop = int(first[u] + size[u])
            lo, hi = int(edge[i]), int(edge[stop - 1] + count[stop - 1])
            far, own, many = covers[lo:hi].tolist(), value[lo:hi].tolist(), count[i:stop].tolist()
            logs = log_mass[i - t : i].tolist()
            at = 0
            for local, n in enumerate(many, t):
                near, mass = logs[local - 1] if local else 0.0, 0.0
                for k in range(at, at + n):
                    w = far[k]
                    own[k] *= math.exp((logs[local - w] if w <= local else 0.0) - near)
                    mass += own[k]
                at += n
                logs.append(math.log(mass) + near)
            value[lo:hi] = own
            log_mass[i:stop] = logs[t:]

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, offsets of the texts in them). The same key, seed and text give the same pieces anywhere."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.units.findall(" " + text)
                if max(map(len, found)) > LONG_UNIT:
                    found = [x for u in found for x in (self._parts(u) if len(u) > LONG_UNIT else (u,))]
                words += found
                counts[i] = len(found)
        place = {u: i for i, u in enumerate(dict.fromkeys(words))}
        unit = np.array(list(map(place.__getitem__, words)), np.int64)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first, size, node, cum, back, piece = self._lattice(list(place))
        row = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        start_state = mixed(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[row] + within.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        occ, pos, base = np.arange(len(unit)), size[unit], first[unit] - 1
        state, taken, steps = start_state, np.zeros(len(unit), np.int64), []
        turn = 0
        while len(occ) and len(occ) >= FEW_UNITS:  # backward sampling, one piece of every unfinished unit at a time
            draw = (mixed(state + np.uint64(turn)) >> np.uint64(11)) * (1.0 / (1 << 53))
            edge = node[base + pos]
            late = np.flatnonzero(draw >= cum[edge])
            while len(late):
                edge[late] += 1
                late = late[draw[late] >= cum[edge[late]]]
            steps.append((occ, piece[edge]))
            taken[occ] = turn + 1
            pos = pos - back[edge]
            go = pos > 0
            occ, pos, base, state = occ[go], pos[go], base[go], state[go]
            turn += 1
        rests = []
        for o, p, b, x in zip(occ.tolist(), pos.tolist(), base.tolist(), state.tolist(), strict=True):  # what is left, piece by piece
            got, k = [], turn
            while p > 0:
                draw = (_mixed_int(x + k) >> 11) * (1.0 / (1 << 53))
                edge = int(node[b + p])
                while draw >= cum[edge]:
                    edge += 1
                got.append(int(piece[edge]))
                p -= int(back[edge])
                k += 1
            taken[o] = k
            rests.append((o, got[::-1]))
        ends = np.cumsum(taken)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for o, got in rests:
            out[ends[o] - taken[o] : ends[o] - taken[o] + len(got)] = got
        for turn, (occ, got) in enumerate(steps):
            out[ends[occ] - 1 - turn] = got
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, row, taken)
        if (out >= _BYTE_BASE).any():
            out, per_text = self._with_bytes(out, per_text)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(per_text)])

    def _with_bytes(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(ids >= _BYTE_BASE)
        raw = [chr(int(ids[i]) - _BYTE_BASE).encode("utf-8", "surrogatepass") for i in odd]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(x) for x in raw]
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        for i, x in zip(odd, raw, strict=True):
            out[ends[i] - len(x) : ends[i]] = self.byte_ids[list(x)]
        text = np.repeat(np.arange(len(per_text)), per_text)
        more = np.zeros(len(per_text), np.int64)
        np.add.at(more, text, width)
        return out, more

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text; the blank that encoding puts first is taken off."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.starts[ids] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.data[at].tobytes()
        cut = np.concatenate([[0], ends])[offsets]
        return [data[a + 1 : b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _mixed_int(h: int) -> int:
    """``mixed`` of one number."""
    h &= _MASK
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & _MASK
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & _MASK
    return h ^ h >> 32


_MASK = (1 << 64) - 1
_known: dict[tuple[int, float], Pieces] = {}


def _pieces(proto: bytes, sharpness: float = SHARPNESS) -> Pieces:
    """The vocabulary, read once in each Python worker."""
    key = (hash(proto), sharpness)
    if key not in _known:
        _known.clear()
        _known[key] = Pieces(proto, sharpness)
    return _known[key]


def _run(shared, sharpness: float, seed: int, digest: bool, decoded: bool = False):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value, sharpness)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("_text"))
            keys = batch.column(names.index("_key")).to_numpy(zero_copy_only=False)
            kept = [n for n in names if n not in ("_text", "_key")]
            for a, n, _, _ in text_chunks(column, PASS_CHARS):
                b = a + n
                texts = column.slice(a, n).to_pylist()
                ids, offsets = pieces.encode(texts, keys[a:b], seed)
                own = [batch.column(names.index(n)).slice(a, b - a) for n in kept]
                if digest:
                    cuts = offsets.tolist()
                    back = pieces.decode(ids, offsets)
                    more = [
                        pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(ids[x:y].astype("<i4").tobytes()).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array([x == (t or "").encode() for x, t in zip(back, texts, strict=True)]),
                    ]
                    yield pa.RecordBatch.from_arrays([*own, *more], [*kept, "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])
                else:
                    mask = pa.array([t is None for t in texts])
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=mask)
                    if decoded:
                        back = [None if t is None else x.decode("utf-8", "surrogatepass") for x, t in zip(pieces.decode(ids, offsets), texts, strict=True)]
                        yield pa.RecordBatch.from_arrays([*own, lists, pa.array(back, pa.string())], [*kept, "pieces", "text"])
                    else:
                        yield pa.RecordBatch.from_arrays([*own, lists], [*kept, "pieces"])

    return run


def _prepared(docs: DataFrame, key: str, text: str, model_path: str, drop: tuple[str, ...]):
    with open(model_path, "rb") as f:  # a vocabulary file beside the driver, about half a megabyte, goes to the executors as bytes
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in (*drop, "_text", "_key")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("_text"), F.coalesce(F.col(key).cast("bigint"), F.lit(-1).cast("bigint")).alias("_key"))
    return shared, rows


def encode(docs: DataFrame, model_path: str = MODEL_PATH, key: str = "doc_id", text: str = "text", seed: int = SEED, sharpness: float = SHARPNESS, decoded: bool = False) -> DataFrame:
    """``docs`` with ``pieces`` (array of ids), one segmentation sampled for each row from the lattice of its whole text.

    The draw depends on the row's key, the seed and the text only, never on how rows are dealt out. Characters
    that are no pieces become bytes, so decoding always gives the text back. Empty texts give no pieces, null ones null. With
    ``decoded`` the pieces are decoded in the same pass, and ``text`` is what they stand for.
    """
    shared, rows = _prepared(docs, key, text, model_path, ("pieces", "text") if decoded else ("pieces",))
    added = "pieces array<int>, text string" if decoded else "pieces array<int>"
    return rows.mapInArrow(_run(shared, sharpness, seed, False, decoded), with_fields(rows, added, ("_text", "_key")))


def digests(docs: DataFrame, model_path: str = MODEL_PATH, key: str = "doc_id", text: str = "text", seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """``docs`` without its text but with ``n_pieces``, SHA-256 of the ids (32-bit little-endian) and of the decoded text, and ``lossless``. Null counts as empty."""
    taken = ("n_pieces", "pieces_sha256", "decoded_sha256", "lossless", text)
    shared, rows = _prepared(docs, key, text, model_path, taken)
    return rows.mapInArrow(_run(shared, sharpness, seed, True), with_fields(rows, "n_pieces bigint, pieces_sha256 string, decoded_sha256 string, lossless boolean", ("_text", "_key")))


def _decoded(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            names = batch.schema.names
            own = [n for n in names if n != "pieces"]
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                lists = part.column(names.index("pieces"))
                ids = lists.flatten().to_numpy().astype(np.int64)
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                texts = pieces.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
                back = [t.decode("utf-8", "surrogatepass") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in own), pa.array(back, pa.string())], [*own, "text"])

    return run


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """The rows of ``encode`` with ``text``, the text that the pieces stand for, in place of ``pieces``. Null pieces give a null text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(*(f"`{c}`" for c in encoded.columns if c not in ("text", "pieces")), "pieces")
    return rows.mapInArrow(_decoded(shared), with_fields(rows, "text string", ("pieces",)))


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and the proof that it decodes to the text."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
