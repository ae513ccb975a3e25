"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public vocabulary file (its path is a parameter; nothing is trained). The file ranks its pieces
by the order of their merges; a piece's log score is that of its rank under Zipf's law, -ln(1 + rank) - ln(H), and a
byte outside all pieces costs FALLBACK more than the worst piece. Spaces become markers and one marker is put before
the text; a marker character that the text itself contains is spelt in bytes, so decoding gives back every text.

No piece holds a marker after another character (checked when the vocabulary is loaded), so the best segmentation is
the concatenation of those of the units "markers + following characters". Units are segmented together, position by
position, with array operations, and remembered in a table of at most REMEMBERED units a task. Of segmentations with
equal scores the one whose last piece is longest wins, likewise for its prefix.

Defined results: null gives null ids and decodes to null; the empty text gives no ids. Any text of any length is
encoded whole. Repeated rows are encoded alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Log score of a byte below that of the worst piece.
FALLBACK = 10.0
REMEMBERED = 250_000
#: Units up to so many bytes are segmented together; texts at a time.
TOGETHER, TEXTS = 64, 256
MARKER, MARK = "▁", 0xFF  # the marker, and the byte (never in UTF-8) that stands for it here
_UNIT = re.compile(rb"\xff*[^\xff]+|\xff+")


class DoubleArray:
    """A trie in two arrays: child of s by byte b is t = base[s] + b + 1 if check[t] = s; value[t] is a key's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[:258] = bytes([1]) * 258  # places that not every code can reach stay empty
        free, front = 258, 258  # first free place; from where nodes of several children are tried
        waiting = [(0, 0, len(order), 0)]  # state, range of sorted keys, depth
        while waiting:
            state, low, high, depth = waiting.pop()
            while low < high and len(keys[order[low]]) == depth:
                self.value[state] = order[low]
                low += 1
            if low == high:
                continue
            codes, starts = [], []
            for i in range(low, high):
                code = keys[order[i]][depth] + 1
                if not codes or codes[-1] != code:
                    codes.append(code)
                    starts.append(i)
            while used[free]:
                free += 1
            base = first = max(1, free - codes[0]) if len(codes) == 1 else front
            while True:
                if base + 512 >= size:
                    for name, fill in (("base", 0), ("check", -1), ("value", -1)):
                        setattr(self, name, np.concatenate([getattr(self, name), np.full(size, fill, np.int32)]))
                    used.extend(bytes(size))
                    size *= 2
                if not any(used[base + c] for c in codes):
                    break
                base += 1
            if len(codes) > 1 and base - first > 32:
                front = base - 32  # the places before are nearly full; single children still fill their holes
            self.base[state] = base
            for c, a, b in zip(codes, starts, [*starts[1:], high], strict=True):
                used[base + c] = 1
                self.check[base + c] = state
                waiting.append((base + c, a, b, depth + 1))


@dataclass
class Vocabulary:
    trie: DoubleArray
    ids: np.ndarray  # id of the trie's key
    scores: np.ndarray  # log score of the trie's key
    byte_ids: np.ndarray
    fallback: float
    spelling: list[bytes]  # bytes that an id stands for, with spaces for markers
    longest: int

    def packed(self) -> tuple:
        """Plain arrays, which a broadcast carries to executors that lack this package."""
        t = self.trie
        return (t.base, t.check, t.value), (self.ids, self.scores, self.byte_ids, self.fallback, self.spelling, self.longest)

    @classmethod
    def unpacked(cls, parts: tuple) -> Vocabulary:
        trie = DoubleArray.__new__(DoubleArray)
        trie.base, trie.check, trie.value = parts[0]
        return cls(trie, *parts[1])


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    keys, ids, ranks, spelling = [], [], [], [b""] * n
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            spelling[i] = bytes([int(piece[3:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if re.search(f"[^{MARKER}]{MARKER}", piece):
                raise ValueError(f"piece {piece!r} holds a marker after another character")
            keys.append(piece.encode().replace(MARKER.encode(), bytes([MARK])))
            ids.append(i)
            ranks.append(min(max(-model.get_score(i), 0.0), float(n)))
            spelling[i] = piece.replace(MARKER, " ").encode()
    if (byte_ids < 0).any() or bytes([MARK]) not in keys:
        raise ValueError("the vocabulary lacks byte pieces or the marker")
    ranks = np.array(ranks)
    scores = -np.log1p(ranks) - np.log(np.log1p(n))
    return Vocabulary(DoubleArray(keys), np.array(ids, np.int32), scores, byte_ids, scores.min() - FALLBACK, spelling, max(map(len, keys)))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes, self.filled = [], [], [], 0

    def _one(self, unit: bytes) -> list[int]:
        """The best segmentation of one unit, byte by byte."""
        v, trie = self.v, self.v.trie
        n = len(unit)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            here = best[i]
            if here + v.fallback > best[i + 1]:
                best[i + 1], back[i + 1] = here + v.fallback, (i, int(v.byte_ids[unit[i]]))
            state = 0
            for j in range(i, min(n, i + v.longest)):
                t = int(trie.base[state]) + unit[j] + 1
                if trie.check[t] != state:
                    break
                state, k = t, int(trie.value[t])
                if k >= 0 and here + v.scores[k] > best[j + 1]:
                    best[j + 1], back[j + 1] = here + v.scores[k], (i, int(v.ids[k]))
        out, at = [], n
        while at:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]

    def _many(self, units: list[bytes]) -> list[np.ndarray]:
        """The best segmentations of units of similar length, all at once."""
        v, trie = self.v, self.v.trie
        m, sizes = len(units), np.array([len(u) for u in units])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(m, width).astype(np.int32)
        best = np.full((width + 1, m), -np.inf)
        best[0] = 0
        back, piece = np.zeros((width + 1, m), np.int32), np.zeros((width + 1, m), np.int32)
        for i in range(width):
            rows = np.flatnonzero(i < sizes)
            here = best[i]
            score = here[rows] + v.fallback
            better = score > best[i + 1][rows]
            r = rows[better]
            best[i + 1][r], back[i + 1][r], piece[i + 1][r] = score[better], i, v.byte_ids[text[r, i]]
            state = np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + v.longest)):
                if j > i:
                    on = sizes[rows] > j
                    rows, state = rows[on], state[on]
                t = trie.base[state] + text[rows, j] + 1
                ok = trie.check[t] == state
                rows, state = rows[ok], t[ok]
                if not len(rows):
                    break
                k = trie.value[state]
                r, k = rows[k >= 0], k[k >= 0]
                score = here[r] + v.scores[k]
                better = score > best[j + 1][r]
                r, k = r[better], k[better]
                best[j + 1][r], back[j + 1][r], piece[j + 1][r] = score[better], i, v.ids[k]
        found = np.zeros((width, m), np.int32)
        n, at, rows = np.zeros(m, np.int64), sizes.copy(), np.arange(m)
        while len(rows):
            found[n[rows], rows] = piece[at[rows], rows]
            n[rows] += 1
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [found[: n[i], i][::-1] for i in range(m)]

    def _learn(self, units: list[bytes]) -> None:
        units.sort(key=len)
        done: list[np.ndarray] = []
        short = [u for u in units if len(u) <= TOGETHER]
        start = 0
        while start < len(short):
            end = start
            while end < len(short) and end - start < 20_000 and len(short[end]) <= len(short[start]) + 3:
                end += 1
            done += self._many(short[start:end])
            start = end
        done += [np.array(self._one(u), np.int32) for u in units[len(short) :]]
        for unit, ids in zip(units, done, strict=True):
            self.place[unit] = len(self.starts)
            self.starts.append(self.filled)
            self.sizes.append(len(ids))
            self.filled += len(ids)
        self.pool.append(np.concatenate(done))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has (0 for null and the empty text)."""
        units, per_text = [], []
        for text in texts:
            own = _UNIT.findall(b"\xff" + text.encode().replace(b" ", b"\xff")) if text else []
            units += own
            per_text.append(len(own))
        if not units:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        new = set(units).difference(self.place)
        if len(self.place) + len(new) > REMEMBERED:
            self.forget()
            new = set(units)
        if new:
            self._learn(list(new))
        pool = np.concatenate(self.pool)
        self.pool = [pool]
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        starts, sizes = np.array(self.starts)[at], np.array(self.sizes)[at]
        ends = np.cumsum(sizes)
        ids = pool[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]
        bounds = np.r_[0, ends][np.cumsum(np.r_[0, per_text])]
        return ids, np.diff(bounds)


def decode(ids: list[int] | None, vocabulary: Vocabulary) -> str | None:
    if ids is None:
        return None
    return b"".join(map(vocabulary.spelling.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, n_byte_tokens, round_trip for every row of docs.

    round_trip tells whether the ids, decoded, give back the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary).packed())
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.unpacked(shared.value)
        encoder = Encoder(v)
        is_byte = np.zeros(len(v.spelling), bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = part.column(1).to_pylist()
                ids, sizes = encoder.encode(texts)
                offsets = np.r_[0, np.cumsum(sizes)]
                flat, same = ids.tolist(), []
                for i, text in enumerate(texts):
                    same.append((text or "") == decode(flat[offsets[i] : offsets[i + 1]], v))
                spelt = np.diff(np.r_[0, np.cumsum(is_byte[ids])][offsets])
                null = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=null), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(sizes), pa.array(spelt.astype(np.int64)), pa.array(same)],
                    ["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"],
                )

    return docs.select(id_col, text_col).mapInArrow(
        work, f"doc_id {kind}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean"
    )


def decoded(rows: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with a column `decoded`, the text that the ids stand for; one that is there already is replaced."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(load(vocabulary).packed())
    at = rows.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.unpacked(shared.value)
        for batch in batches:
            texts = [decode(ids, v) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")
