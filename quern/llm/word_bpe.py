r"""BPE encoding and decoding through a table of distinct words.

1. Each task splits its texts into words, some thousand texts (a chunk) at a time, and gives every distinct word of the
   chunk a number: a text becomes a row of numbers. A chunk is compressed and named by its bytes, so one that has to be
   made again is the same, and is shuffled once for both of the steps that read it.
2. The words of all chunks meet by word. Each distinct word is encoded once, by merging the pair of least (rank, place)
   until none is left, and its ids go back to the chunks that asked. A frequent word asks once a chunk, not once a text.
3. Each chunk takes the ids of its words and puts them at the positions of its numbers. A chunk is bounded by its words
   and texts, so is what meets for it; no text, and no table of all words, is held or sent anywhere.
4. Decoding joins each id with its piece map-side (the vocabulary of the file bounds that table) and sets a space
   between the pieces, as a file without a decoder asks.

Text is cut at added tokens, put in NFC and lower case code point by code point, and split into contractions, runs of
letters, single digits and runs of other marks; white space goes. Letters, digits and
lower case are those of Unicode 16; compositions of scripts newer than Python's tables are left as they are.

Defined results: null and empty texts have no ids and decode to the empty text. Texts of any length are read whole, in
pieces cut before a space or line feed, which no word spans; a word of any length is merged in n log n steps. Repeated
rows are encoded each; null ids stay. Ids outside of the vocabulary decode to nothing. Only the two named columns are
read, so others may have any name. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The file of the tokenizer; a parameter everywhere.
TOKENIZER = os.environ.get("QUERN_WORD_BPE", "/opt/tokenizers/word_bpe_49k.json")
#: A chunk ends with the text that reaches so many distinct words, words or texts. Texts that are decoded at a time.
DISTINCT, WORDS, LIMIT, TEXTS = 400_000, 4_000_000, 50_000, 256
#: Code points of a text that are split at a time, words that a task asks for and answers at a time, and words of the
#: texts of a chunk that are numbered or given their ids at a time (a longer text is one block).
PIECE, ROWS, ANSWERS, BLOCK = 1 << 16, 20_000, 300_000, 1 << 18
#: White space of Unicode, as the inside of a character class.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits of Unicode 16 that Python's tables lack.
LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
DIGITS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
#: Lower case of letters that are newer than Python's tables: first, last, step, distance to the lower case.
NEWER = [
    (0x1C89, 0x1C89, 1, 1),
    (0xA7CB, 0xA7CB, 1, 0x264 - 0xA7CB),
    (0xA7CC, 0xA7CE, 2, 1),
    (0xA7D2, 0xA7D4, 2, 1),
    (0xA7DA, 0xA7DA, 1, 1),
    (0xA7DC, 0xA7DC, 1, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 1, 0x20),
    (0x16EA0, 0x16EB8, 1, 0x1B),
]


class Rules:
    """What of a tokenizer's file this module reads, small enough to travel to executors whole."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or odd or told.get("decoder") or told.get("post_processor"):
            raise ValueError(f"not a plain word BPE: {path}")
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = [vocab[c] for c in byte_alphabet()]
        self.last = [vocab[c + end] for c in byte_alphabet()]
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.pieces = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for piece, k in [*vocab.items(), *self.added.items()]:
            self.pieces[k] = piece


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself where it is one, else the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def load(path: str) -> Rules:
    return Rules(path)


def _class(first: str, newer: list[tuple[int, int]]) -> tuple[str, str]:
    """The insides of two character classes, below and from 0x10000 on, of all code points of a category's first letter."""
    found, start = list(newer), None
    for c in range(0x110001):
        own = c < 0x110000 and unicodedata.category(chr(c))[0] == first
        if start is not None and (not own or c == 0x10000):
            found.append((start, c - 1))
            start = None
        if own and start is None:
            start = c
    low, high = [r for r in found if r[0] < 0x10000], [r for r in found if r[0] >= 0x10000]
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in half) for half in (low, high))


@lru_cache(maxsize=1)
def word_pattern() -> str:
    """Words of lower-case text. Classes below 0x10000 are looked up at once, those above only where one stands."""
    (low_l, high_l), (low_n, high_n) = _class("L", LETTERS), _class("N", DIGITS)
    high = "\\U00010000-\\U0010ffff"
    letters = f"(?>[{low_l}]++|(?=[{high}])[{high_l}]++)++"
    digit = f"[{low_n}]|(?=[{high}])[{high_n}]"
    marks = f"(?>[^{SPACES}{low_l}{low_n}{high}]++|(?=[{high}])[^{high_l}{high_n}\\u0000-\\uffff]++)++"
    return f"'s|'t|'re|'ve|'m|'ll|'d|{letters}|{digit}|{marks}"


class Splitter:
    """Words of texts, in order; an added token is a word of its own."""

    def __init__(self, pattern: str, added: dict[str, int]) -> None:
        self.word = re.compile(pattern).findall
        longest = sorted(added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if added else None
        self.lower = {c: c + d for a, b, step, d in NEWER for c in range(a, b + 1, step)} | {ord("Σ"): ord("σ")}
        self.rare = re.compile(f"[{''.join(map(chr, self.lower))}]").search

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.rare(text):
                text = text.translate(self.lower)
        return self.word(text.lower())

    def _whole(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            end = max(text.rfind(" ", at + 1, at + PIECE), text.rfind("\n", at + 1, at + PIECE))
            if end < 0:
                later = [x for x in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if x > 0]
                if not later:
                    break
                end = min(later)
            yield text[at:end]
            at = end
        yield text[at:]

    def pieces(self, text: str | None) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        for part in self._whole(text or ""):
            if self.cut is None or self.cut.search(part) is None:
                yield self._plain(part)
            else:
                for k, x in enumerate(self.cut.split(part)):
                    yield [x] if k % 2 else self._plain(x)


def merged(word: str, rules: Rules) -> list[int]:
    """The ids of one word."""
    if word in rules.added:
        return [rules.added[word]]
    raw = word.encode()
    ids: list[int] = [rules.inner[b] for b in raw[:-1]] + [rules.last[raw[-1]]]
    n, of = len(ids), rules.merges
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(of[p][0], k, of[p][1], p) for k, p in enumerate(zip(ids, ids[1:])) if p in of]
    heapq.heapify(heap)
    while heap:
        _, k, new, (a, b) = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j < 0 or ids[j] != b:
            continue
        ids[k], ids[j] = new, -1
        after[k] = after[j]
        if after[j] >= 0:
            before[after[j]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right >= 0 and (found := of.get(p := (ids[left], ids[right]))):
                heapq.heappush(heap, (found[0], left, found[1], p))
    return [x for x in ids if x >= 0]


def _packed(value: object) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> object:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def short_numbers(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2**28 as bytes, seven bits each, the last of a number without its high bit: small ones are short."""
    x = numbers.astype(np.uint32)
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = size > k
        out[(ends - size)[has] + k] = ((x[has] >> 7 * k) & 0x7F) | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint32)
    return out


def long_numbers(raw: np.ndarray) -> np.ndarray:
    """What short_numbers was given."""
    last = raw < 0x80
    ends = np.flatnonzero(last)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << 7 * place, starts) if len(ends) else np.zeros(0, np.int64)


def chunked(docs: DataFrame, rules: Rules) -> DataFrame:
    """(chunk, body) of docs (id, text), dealt by chunk. A body holds, each compressed: the distinct words of the chunk in
    order; and the ids of its texts, their numbers of words, and these as ranks by frequency with each rank's word."""
    pattern, added = word_pattern(), rules.added

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern, added)
        place, ids, sizes, numbers = defaultdict(count().__next__), [], [], []

        def chunk() -> pa.RecordBatch:
            words = sorted(place)
            often = np.zeros(len(words), np.int64)
            flat = [np.concatenate([np.zeros(0, np.int32), *block]) for block in numbers]
            for part in flat:
                often += np.bincount(part, minlength=len(words))
            by_rank = np.argsort(-often, kind="stable")
            rank, sorted_at = np.empty(len(words), np.int32), np.empty(len(words), np.uint32)
            rank[by_rank] = np.arange(len(words))
            sorted_at[np.fromiter(map(place.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            own = _packed(words)
            blocks = [(one, np.array(n), short_numbers(rank[part])) for one, n, part in zip(ids, sizes, flat, strict=True)]
            body = len(own).to_bytes(8, "little") + own + _packed((sorted_at[by_rank], blocks))
            name = int.from_bytes(hashlib.sha256(body).digest()[:8], "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body])], ["chunk", "body"])

        texts = words = filled = 0
        for batch in batches:
            for one, text in zip(batch.column(0), batch.column(1), strict=True):
                own = [np.fromiter(map(place.__getitem__, some), np.int32, len(some)) for some in splitter.pieces(text.as_py())]
                n = sum(map(len, own))
                if not ids or filled + n > BLOCK:
                    ids.append([])
                    sizes.append([])
                    numbers.append([])
                    filled = 0
                ids[-1].append(one.as_py())
                sizes[-1].append(n)
                numbers[-1] += own
                texts, words, filled = texts + 1, words + n, filled + n
                if len(place) >= DISTINCT or words >= WORDS or texts >= LIMIT:
                    yield chunk()
                    place, ids, sizes, numbers, texts, words = defaultdict(count().__next__), [], [], [], 0, 0
        if ids:
            yield chunk()

    return docs.mapInArrow(work, "chunk long, body binary").repartition("chunk")


def words_of(body: bytes) -> list[str]:
    return _unpacked(body[8 : 8 + int.from_bytes(body[:8], "little")])


def texts_of(body: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """By blocks: ids of texts, their numbers of words, and the places of all these words among the words of the chunk."""
    by_rank, blocks = _unpacked(body[8 + int.from_bytes(body[:8], "little") :])
    for ids, sizes, ranks in blocks:
        yield ids, sizes, by_rank[long_numbers(ranks)]


def asked_words(chunks: DataFrame) -> DataFrame:
    """(word, chunk, n): the words of each chunk and their places in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(body.as_py())
                for at in range(0, len(words), ROWS):
                    part = words[at : at + ROWS]
                    cols = [pa.array(part, pa.string()), pa.array([chunk.as_py()] * len(part)), pa.array(range(at, at + len(part)), pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["word", "chunk", "n"])

    return chunks.mapInArrow(work, "word string, chunk long, n int")


def _answer(places: list[int], ids: list[bytes]) -> bytes:
    """Ids of the words at some places of a chunk as bytes: steps from place to place, lengths, ids; many are compressed."""
    steps = short_numbers(np.diff(np.array(places, np.int64), prepend=0)).tobytes()
    sizes = short_numbers(np.fromiter(map(len, ids), np.int64, len(ids))).tobytes()
    raw = np.array([len(steps), len(sizes)], "<u4").tobytes() + steps + sizes + b"".join(ids)
    if len(ids) < 64:
        return b"\0" + raw
    return b"\1" + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _answered(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Places, lengths in bytes, ids."""
    raw = blob[1:] if blob[0] == 0 else pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), codec="zstd", asbytes=True)
    a, b = np.frombuffer(raw[:8], "<u4").tolist()
    steps, sizes = np.frombuffer(raw[8 : 8 + a], np.uint8), np.frombuffer(raw[8 + a : 8 + a + b], np.uint8)
    return np.cumsum(long_numbers(steps)), long_numbers(sizes), raw[8 + a + b :]


def encoded_words(asked: DataFrame, rules: Rules) -> DataFrame:
    """(chunk, ids): each distinct word encoded once, its ids to each chunk that asked, many words in one row.

    Words come in order, and so do the places of a chunk, whose words are in order too.
    """
    shared = asked.sparkSession.sparkContext.broadcast(rules)
    kind = "<u2" if len(rules.pieces) <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, ids, held = shared.value, None, b"", 0
        places: dict[int, list[int]] = defaultdict(list)
        found: dict[int, list[bytes]] = defaultdict(list)

        def out() -> pa.RecordBatch:
            rows = [_answer(places[c], found[c]) for c in places]
            made = pa.RecordBatch.from_arrays([pa.array(list(places), pa.int64()), pa.array(rows, pa.binary())], ["chunk", "ids"])
            places.clear()
            found.clear()
            return made

        for batch in batches:
            for word, chunk, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word != before:
                    before, ids = word, np.array(merged(word, own), kind).tobytes()
                places[chunk].append(n)
                found[chunk].append(ids)
            held += batch.num_rows
            if held >= ANSWERS:
                yield out()
                held = 0
        yield out()

    return asked.select("word", "chunk", "n").repartition("word").sortWithinPartitions("word", "chunk").mapInArrow(work, "chunk long, ids binary")


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    then: Callable[[pa.Table], pa.Table] | None = None,
    columns: str = "ids array<int>, n_tokens long",
) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens for every row of docs.

    `then` turns a table of some of these rows into one of doc_id and other `columns`, in the task that has them.
    """
    rules = load(tokenizer)
    kind = docs.schema[id_col].dataType
    own, width = to_arrow_type(kind), 2 if len(rules.pieces) <= 1 << 16 else 4
    chunks = chunked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rules)
    words = encoded_words(asked_words(chunks), rules)

    def placed(texts: pa.Table, known: pa.Table) -> pa.Table:
        answers = [_answered(blob) for blob in known.column("ids").to_pylist()]
        places = np.concatenate([np.zeros(0, np.int64), *[a[0] for a in answers]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[a[1] for a in answers]]) // width
        flat, ends = np.frombuffer(b"".join(a[2] for a in answers), f"<u{width}"), np.cumsum(sizes)
        known_at, first = np.unique(places, return_index=True)  # chunks of equal bytes ask for the same
        if len(known_at) and known_at[-1] != len(known_at) - 1:
            raise ValueError("a chunk without some of its words")
        long, starts = sizes[first], (ends - sizes)[first]
        found = []
        for doc_ids, counts, words in chain.from_iterable(map(texts_of, texts.column("body").to_pylist())):
            if len(words) and int(words.max()) >= len(long):
                raise ValueError("a chunk without its words: its input changed between two readings")
            take = long[words]
            stops = np.cumsum(take)
            total = int(stops[-1]) if len(stops) else 0
            every = flat[np.arange(total) + np.repeat(starts[words] - (stops - take), take)] if total else np.zeros(0)
            bounds = np.r_[0, stops][np.r_[0, np.cumsum(counts)]]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(every.astype(np.int32)))
            some = pa.table({"doc_id": pa.array(doc_ids, own), "ids": lists, "n_tokens": pa.array(np.diff(bounds))})
            found.append(some if then is None else then(some))
        return pa.concat_tables(found)

    return chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(placed, f"doc_id {kind.simpleString()}, {columns}")


def spelt(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """The decoded text of each list of ids: its pieces, joined by their ids, with spaces between them."""
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    offsets = offsets - offsets[0]
    good = (flat >= 0) & (flat < len(pieces))
    if not good.all():
        offsets = np.r_[0, np.cumsum(good)][offsets].astype(np.int32)
    taken = pieces.take(pa.array(flat[good]))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), taken)
    return pc.binary_join(lists, pa.scalar(" ", pieces.type))


def _pieces(rules: Rules) -> pa.Array:
    return pa.array(rules.pieces, pa.large_string())


def decoded(rows: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """rows with a column `decoded` (one that is there already is replaced); null ids decode to the empty text."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(_pieces(load(tokenizer)))
    at = rows.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                ids = pa.array(part.column(at).to_pylist(), pa.list_(pa.int32())).fill_null([])
                text = spelt(ids, shared.value).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")


def report(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(_pieces(load(tokenizer)))

    def digests(rows: pa.Table) -> pa.Table:
        hashed, texts = [], []
        for start in range(0, rows.num_rows, TEXTS):
            ids = rows.column("ids").slice(start, TEXTS).combine_chunks()
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            hashed += [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:])]
            texts += [hashlib.sha256(t.as_py().encode()).hexdigest() for t in spelt(ids, shared.value)]
        return pa.table([rows.column("doc_id"), rows.column("n_tokens"), pa.array(hashed, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, tokenizer=tokenizer, then=digests, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
