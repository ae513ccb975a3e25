"""Exact self-join of documents on the Jaccard similarity of their word-shingle sets, as a metric-space join.

The distance d = 1 - Jaccard is a metric: the Steinhaus transform of the symmetric difference D(A, B) = |A xor B|.
Documents link when d <= e = 0.25, and the result is the partition of the documents into connected components, so a
link between two documents that are already connected need not be tested.

Regions, first level. Nearly every document of a corpus lies at distance 1 from any other, so no bounded number of
documents can serve as pivots that tell them apart. The pivots of the first level are therefore the singleton sets
{s} of the shingle universe, in one global order (rarest first). A document's home region is that of its first
shingle; the triangle inequality through the pivots that it leaves behind bounds how far its boundary reaches. If x and
y link and s is their first common shingle, all shingles of x before s count into |x - y| <= |x| - ceil(0.75 |x|), so x
is replicated to the regions of its first |x| - ceil(0.75 |x|) + 1 shingles, and every linking pair meets in a region.
Going on by SHARED - 1 more shingles makes it meet in SHARED regions (or ceil(0.75 |x|), if that is less), so a pair
that meets in fewer is dropped unless it meets in a large region, which is joined for itself. The window of sizes (the
triangle inequality through the empty set) and the shingles that are left behind the first common one (through {s})
cut the pairs further.

Sieve. A set is mapped to bits by the parity of its shingles in each of as many places as it has shingles (256 at
least): a contraction, for the bits that two sets differ in are at most the shingles that they differ in. A region of
more than LEAF texts (and at most SIEVED) is first compared by these bits alone, a 64th of the sets: texts whose bits
lie too far from all others leave it, and where few pairs are left they are measured as they are. What is left is dense.

Regions, recursively. Regions of more than LEAF texts that overlap are joined as one, which is split level by level.
PIVOTS of its documents become pivots, and the distances of all its texts to them are measured exactly. A text within e
of a pivot is linked with it and belongs to its core; texts of one core are connected and need no test among each other.
Every text is at home in the Voronoi cell of its nearest pivot, and is replicated as a guest to the cell of each pivot p
with d(x, p) <= d(x, nearest) + 2e: if y is at home there and d(x, y) <= e, then d(x, p) <= e + d(y, p) <=
e + d(y, nearest of x) <= 2e + d(x, nearest). A cell with few tests left is joined: texts outside its main core
against the texts at home, in blocks of bounded size, by windows on their distances to the pivots. Other cells are
split again. Where a split does not help (no bounded number of pivots tells texts apart that lie far from all of them)
the cell turns to singleton pivots of its own, ordered by their exact frequency inside the cell, so that what all its
texts share comes last; what is large even then is joined in blocks. Nothing is lost on the way.

Copies. Documents with equal sets form one class, named by a hash of the set; a class enters the join once for each
task that reads it, so a group of copies of any size costs no more than a line a task.

Global order. A Misra-Gries summary of all shingles (at most HEAVY entries in the merged result) ranks the frequent
ones by document frequency after all others, which keep the order of their hashes. The order decides only how much
work there is, never what is found.

Shingles are compared by 64-bit hashes, and classes named by 64 bits.

Defined results: null and blank texts have empty sets, link with nothing and form their own component. Repeated rows
are copies. A null doc_id is ignored by the minimum unless its component has no other id. An empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import connected, cut, partitions, small_batches
from quern.llm.shingles import class_of, shingle_set

#: Similarity in hundredths, and the distance that goes with it.
NEAR = 75
#: How many regions a linking pair must share (fewer where a text has not that many common shingles at least).
SHARED = 6
#: Regions of at most so many texts are joined pairwise; larger ones take this many pivots on each of so many levels.
LEAF, PIVOTS, LEVELS = 32, 4, 8
#: Regions of at most so many texts are sieved by bits, of which a set has at least so many.
SIEVED, LEAST_BITS = 4096, 256
#: A split helps if it leaves at most this share of the tests.
HELPS = 0.75
#: Frequency in the summary from which on a region is known to be large before it is read, and is dealt to many tasks.
HOT = 1024
#: Counters of a task's Misra-Gries summary; entries of the merged one; least frequency of an entry.
COUNTERS, HEAVY, FREQUENT = 1 << 15, 1 << 16, 8
#: Pairs that are measured together at most (about).
PAIRS_TOGETHER = 1024
#: Shingles at a time on either side of a block of the recursive step (about), and texts that are measured together.
OUTSIDE_BLOCK, HOME_BLOCK, MEASURED_TOGETHER = 1 << 17, 1 << 20, 512
#: Words of 64 bits of the filter that spares hashing sets nobody asked for.
FILTER_WORDS = 1 << 17


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class Counts:
    """A Misra-Gries summary of at most `size` counters, fed with whole arrays of keys."""

    def __init__(self, size: int):
        self.size, self.keys, self.counts = size, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Counts keys, which are sorted in place. All new counts are taken down by one first: singles never enter."""
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[first, len(keys)]) - 1
        new, n = keys[first[n > 0]], n[n > 0]
        merged, where = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([self.counts, n]), minlength=len(merged)).astype(np.int64)
        if len(merged) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
            merged, total = merged[total > 0], total[total > 0]
        self.keys, self.counts = merged, total


def parity_bits(s: np.ndarray) -> bytes:
    """For each of 2^k places, as many as the set has shingles at least, whether it has an odd number of shingles there."""
    places = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (0, id, class or null, set size, the set's bits where the task first sees the class); at the end
    (1, shingle, null, count, null) of the frequent shingles."""
    seen: set[int] = set()
    summary = Counts(COUNTERS)
    for batch in batches:
        names, sizes, fresh, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            names.append(class_of(s) if len(s) else None)
            sizes.append(len(s))
            bits.append(None)
            if len(s) and names[-1] not in seen:
                seen.add(names[-1])
                fresh.append(s)
                bits[-1] = parity_bits(s)
        if fresh:
            summary.add(np.concatenate(fresh))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(names), np.int32)), batch.column(0).cast(pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
            ["kind", "a", "b", "c", "bits"],
        )
    often = summary.counts >= 1
    n = int(often.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(n, np.int32)), pa.array(_signed(summary.keys[often])), pa.nulls(n, pa.int64()), pa.array(summary.counts[often]), pa.nulls(n, pa.binary())],
        ["kind", "a", "b", "c", "bits"],
    )


def frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of the most frequent shingles, at most HEAVY of them."""
    total = cut(survey.where("kind = 1").groupBy("a").agg(F.sum("c").alias("n")).where(F.col("n") >= FREQUENT))
    level = F.floor(4 * F.log2("n"))
    room, least = HEAVY, None
    for bucket, n in total.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect():  # at most 256 rows
        room -= n
        if room < 0:
            break
        least = bucket
    rows = total.where(level >= least).toPandas() if least is not None else None
    if rows is None or not len(rows):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = rows["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


def _ordered(s: np.ndarray, heavy: np.ndarray, counts: np.ndarray, first: int) -> np.ndarray:
    """The first shingles of a sorted set in the global order."""
    if not len(heavy):
        return s[:first]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    often = heavy[at] == s
    rare = s[~often]
    if len(rare) >= first:
        return rare[:first]
    common, n = s[often], counts[at[often]]
    return np.concatenate([rare, common[np.lexsort((common, n))][: first - len(rare)]])


def shared(n):
    """How many regions a set of n, the smaller of two, shares at least with one that it links with."""
    return np.minimum(SHARED, -(-NEAR * n // 100))


def reach(n: int) -> int:
    """How many leading shingles of a set of n are pivots of regions that it must be in."""
    return n - -(-NEAR * n // 100) + int(shared(n))


def _place(heavy: np.ndarray, counts: np.ndarray, spread: int):
    """(key, node, n, pos, sub) for every region that a class belongs to, once for each task and class.

    sub deals the rows of regions that are known to be large over `spread` places; it is -1 for all others.
    """
    hot = heavy[counts >= HOT]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes, places, subs = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                k = _ordered(s, heavy, counts, reach(len(s)))
                keys.append(k)
                nodes.append(np.full(len(k), name, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
                places.append(np.arange(len(k), dtype=np.int32))
                known = hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k if len(hot) else np.zeros(len(k), bool)
                subs.append(np.where(known, name % spread, -1).astype(np.int32))
            if keys:
                columns = [_signed(np.concatenate(keys)), *(np.concatenate(c) for c in (nodes, sizes, places, subs))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "pos", "sub"])

    return place


def _summed(x, y, need, left, times=None):
    """Distinct pairs (x < y) with the regions they share, the regions they need, and whether one leaves enough behind."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    low, high, need, left = low[order], high[order], need[order], left[order]
    times = np.ones(len(low), np.int64) if times is None else times[order]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    return low[first], high[first], need[first], np.maximum.reduceat(left, first), np.add.reduceat(times, first)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node become (0, x, y, regions needed, window open, regions shared) for pairs of small
    regions, (1, first node, node, n, 0, 0) for large regions, and (2, key, node, n, 0, 0) for those that lie in many tasks."""
    held = [np.empty(0, np.int64) for _ in range(5)]
    large, lead = None, 0  # the key and the first node of the large region that the stream is in

    def out(kind, a, b, n, left, times):
        numbers = [pa.array(x.astype(np.int32)) for x in (n, left, times)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), *numbers], ["kind", "a", "b", "n", "open", "times"]
        )

    def settle(rows, last):
        nonlocal held, large, lead
        key, node, n, pos, sub = rows
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, pos, sub = key[fresh], node[fresh], n[fresh], pos[fresh], sub[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        ends = np.r_[starts[1:], len(key)] if len(key) else starts
        size = ends - starts
        goes_on = key[starts] == large if large is not None else np.zeros(len(starts), bool)
        big = (size > LEAF) | goes_on | (sub[starts] >= 0)
        first = np.where(goes_on, lead, node[starts])
        owner = np.repeat(np.where(sub[starts] >= 0, key[starts], first), size)
        keep = np.repeat(big, size)
        if len(starts) and not last:  # the last region may go on in the next batch
            tail = slice(starts[-1], ends[-1])
            if big[-1]:
                large, lead = key[starts[-1]], first[-1]
                # one row is kept back, to recognise a repeated node at the seam
                held = [c[ends[-1] - 1 : ends[-1]] for c in (key, node, n, pos, sub)]
                keep[ends[-1] - 1] = False
            else:
                held = [c[tail] for c in (key, node, n, pos, sub)]
            starts, ends, size, big = starts[:-1], ends[:-1], size[:-1], big[:-1]
        for kind, chosen in ((1, keep & (sub < 0)), (2, keep & (sub >= 0))):
            if chosen.any():
                zero = np.zeros(int(chosen.sum()), np.int32)
                yield out(kind, owner[chosen], node[chosen], n[chosen], zero, zero)
        pairs = []
        for g in np.unique(size[(~big) & (size > 1)]):
            rows_of = starts[(size == g) & ~big][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            for part in np.array_split(rows_of, max(1, len(rows_of) * len(i) // 2_000_000)):
                x, y = part[:, i].ravel(), part[:, j].ravel()
                nx, ny = n[x], n[y]
                ok = 100 * np.minimum(nx, ny) >= NEAR * np.maximum(nx, ny)
                x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
                if len(x):
                    left = (100 + NEAR) * np.minimum(nx - pos[x], ny - pos[y]) >= NEAR * (nx + ny)
                    pairs.append(_summed(node[x], node[y], shared(np.minimum(nx, ny)), left.astype(np.int32)))
        if pairs:
            low, high, need, left, times = _summed(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
            yield out(0, low, high, need, left, times)

    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
        held = [c[:0] for c in held]
        yield from settle(rows, False)
    yield from settle(held, True)


def _sets(words: np.ndarray):
    """(node, shingles as bytes) of the classes that the filter lets through, once for each task and class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, found = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                name = class_of(s)
                if name in seen or not (int(words[(name >> 6) % FILTER_WORDS]) >> (name & 63)) & 1:
                    continue
                seen.add(name)
                nodes.append(name)
                found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "shingles"])

    return sets


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for the given nodes: a filter of fixed size over the texts, then an exact join."""
    place = F.pmod(F.shiftright("node", 6), F.lit(FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    rows = nodes.select(place.alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(FILTER_WORDS, np.uint64)  # at most FILTER_WORDS rows come back: 1 MB
    words[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    found = texts.mapInArrow(_sets(words), "node long, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles")).join(nodes, "node", "left_semi")


def _grouped(rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """work(rows of one group as columns of Python lists) for each group, streamed group after group in sorted partitions."""
    width = len(by)
    dealt = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = [table.column(i).to_numpy() for i in range(width)]
            change = np.zeros(table.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = np.r_[0, np.flatnonzero(change)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from work(table.slice(a, b - a))
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return dealt.mapInArrow(stream, schema)


def _near_bits(n: np.ndarray, bits: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Which texts (sizes, bits) have another one that their bits let link with them, and those pairs (places) if at most `most`."""
    width = np.array([len(b) for b in bits])
    partnered, found, count = np.zeros(len(n), bool), [], 0
    for w in np.unique(width):
        # the sizes of texts that link are within 4/3, so the longer one has as many bits or twice as many, which fold
        same, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        who = np.r_[same, twice]
        rows = np.stack([*(bits[i] for i in same), *(bits[i][:w] ^ bits[i][w:] for i in twice)])
        for k, i in enumerate(same):
            others = who[k + 1 :]
            apart = np.bitwise_count(rows[k + 1 :] ^ rows[k]).sum(axis=1, dtype=np.int64)
            ok = (100 + NEAR) * apart <= (100 - NEAR) * (n[others] + n[i])
            near = others[ok & (100 * np.minimum(n[others], n[i]) >= NEAR * np.maximum(n[others], n[i]))]
            if len(near):
                partnered[i] = partnered[near] = True
                count += len(near)
                if count <= most:
                    found.append(np.stack([np.full(len(near), i), near]))
    if count > most:
        return partnered, None
    return partnered, np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def _sieve(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """A region (cell, node, n, bits): (0, node, node, 0) for the few pairs that may link, or (1, cell, node, n) for its texts
    that may link with another one."""
    node, n = group.column("node").to_numpy(), group.column("n").to_numpy().astype(np.int64)
    bits = [np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()]
    partnered, pairs = _near_bits(n, bits, max(LEAF * LEAF // 2, len(n)))
    if pairs is None:
        kind, a, b, c = 1, group.column("cell").to_numpy()[partnered], node[partnered], n[partnered]
    else:
        x, y = node[pairs[0]], node[pairs[1]]
        kind, a, b, c = 0, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c.astype(np.int32))], ["kind", "a", "b", "n"])


def _sieved(big: DataFrame, bits: DataFrame) -> DataFrame:
    """(kind, a, b, n) as _sieve makes them of large regions (cell, node, n); those of more than SIEVED texts stay whole."""
    size = big.groupBy(F.col("cell").alias("c")).agg((F.count(F.lit(1)) <= SIEVED).alias("fits"))
    both = big.join(size, F.col("cell") == F.col("c")).drop("c")
    held = both.where("fits").join(bits, "node").select("cell", "node", "n", "bits")
    whole = both.where("not fits").select(F.lit(1).alias("kind"), F.col("cell").alias("a"), F.col("node").alias("b"), "n")
    return cut(_grouped(held, ["cell"], _sieve, "kind int, a long, b long, n int").unionByName(whole))


def _compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sets (kind 0: a, shingles) and pairs (kind 1: a, b) of a group: (a, b, common, total) for each pair."""
    kind = group.column("kind").to_numpy()
    a, b, raw = group.column("a").to_numpy(), group.column("b").to_numpy(), group.column("shingles")
    sets = {int(a[i]): np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in np.flatnonzero(kind == 0)}
    pairs = np.flatnonzero(kind == 1)
    common, total = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for k, i in enumerate(pairs):
        x, y = sets[int(a[i])], sets[int(b[i])]
        if len(x) > len(y):
            x, y = y, x
        common[k] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
        total[k] = len(x) + len(y) - common[k]
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(a[pairs]), pa.array(b[pairs]), pa.array(common), pa.array(total)], ["a", "b", "common", "total"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) for each pair (a < b).

    A pair is measured in the group of the least neighbour of a, so that a cluster's sets travel to one place rather
    than once for each pair; groups of more than PAIRS_TOGETHER pairs are split by the hash of a.
    """
    both = pairs.union(pairs.select("b", "a"))
    least = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")).select("x", F.least("x", "m").alias("grp"))
    grouped = cut(pairs.join(least, pairs.a == least.x).select("grp", "a", "b"))
    size = grouped.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") / F.lit(PAIRS_TOGETHER)).cast("int")
    sub = F.pmod(F.xxhash64("a"), parts).cast("int")
    placed = cut(grouped.join(size, F.col("grp") == F.col("g")).select("grp", sub.alias("sub"), "a", "b"))
    nodes = placed.select("grp", "sub", "a").union(placed.select("grp", "sub", F.col("b").alias("a"))).distinct()
    held = nodes.join(sets, nodes.a == sets.node).select("grp", "sub", F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("b"), "shingles")
    asked = placed.select("grp", "sub", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("shingles"))
    return cut(_grouped(held.unionByName(asked), ["grp", "sub"], _compare, "a long, b long, common long, total long"))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, sub and kind, pivots (kind 0) before texts (kind 1): the texts with their distances to the
    pivots of their cell and links to pivots that connect all that they link with. Holds the pivots of one cell and a batch."""
    at, pivots, joined = None, [], Joined()
    for batch in batches:
        cell, sub, kind, node = (batch.column(i).to_numpy() for i in range(4))
        raw = batch.column(7)
        rows, far, near = [], [], []
        for i in range(batch.num_rows):
            if (cell[i], sub[i]) != at:
                at, pivots, joined = (cell[i], sub[i]), [], Joined()
            s = np.frombuffer(raw[i].as_py(), np.uint64)
            if kind[i] == 0:
                pivots.append((int(node[i]), s))
                continue
            rows.append(i)
            common = [np.count_nonzero(p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s) for _, p in pivots]
            total = [len(s) + len(p) - c for (_, p), c in zip(pivots, common, strict=True)]
            far.append([1 - c / t for c, t in zip(common, total, strict=True)])
            close = [p for (p, _), c, t in zip(pivots, common, total, strict=True) if 100 * c >= NEAR * t]
            # one link to a text's core, and more only where they connect pivots that no text before it has
            near.append(close[:1] + [p for p in close[1:] if joined.add(close[0], p)])
        part = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(3), part.column(4), part.column(5), part.column(6), pa.array(far, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.int64()))],
            ["cell", "node", "n", "home", "core", "far", "near"],
        )


class Joined:
    """What links have connected so far, of a group that one task holds."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.over.get(x, x)) != x:
            self.over[x] = x = self.over.get(y, y)
        return x

    def add(self, a: int, b: int) -> bool:
        """Whether a and b were apart until now."""
        a, b = self.root(a), self.root(b)
        self.over[max(a, b)] = min(a, b)
        return a != b


def _cells(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between the outside texts (side 0) and the home texts (side 1) of a block of a cell: of all that there are,
    those that connect what others of the block do not, so fewer than the block has texts."""
    side, node, root = (group.column(c).to_numpy() for c in ("side", "node", "root"))
    far = np.array(group.column("far").to_pylist(), dtype=float)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    home = np.flatnonzero(side == 1)
    words = np.concatenate([sets[i] for i in home]) if len(home) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(home)), sizes[home])
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    links, joined = [], Joined()
    for k, r in zip(node, root, strict=True):
        joined.add(int(k), int(r))  # a core is connected by the links to its pivot
    for i in np.flatnonzero(side == 0):
        near = (np.abs(far[home] - far[i]) <= 1 - NEAR / 100 + 1e-9).all(axis=1) & (root[home] != root[i])
        near &= 100 * np.minimum(sizes[home], sizes[i]) >= NEAR * np.maximum(sizes[home], sizes[i])
        if not near.any():
            continue
        a, b = np.searchsorted(words, sets[i]), np.searchsorted(words, sets[i], side="right")
        hit = [owner[p:q] for p, q in zip(a, b, strict=True) if q > p]
        common = np.bincount(np.concatenate(hit), minlength=len(home)) if hit else np.zeros(len(home), int)
        linked = near & (100 * common >= NEAR * (sizes[home] + sizes[i] - common))
        for j in np.flatnonzero(linked):
            if joined.add(int(node[i]), int(node[home[j]])):
                links.append((int(node[i]), int(node[home[j]])))
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tests(cells: DataFrame) -> DataFrame:
    """(cell, texts, main, tests): the size of each cell, its main core, and how many pairs are left to test in it."""
    core = cells.groupBy("cell", "core").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("home").cast("long")).alias("h"))
    top = F.max(F.when(F.col("core").isNotNull(), F.struct("t", "h", "core")))
    whole = core.groupBy("cell").agg(F.sum("t").alias("texts"), F.sum("h").alias("homes"), top.alias("top"))
    spared = F.coalesce(F.col("top.t") * F.col("top.h"), F.lit(0))
    return whole.select("cell", "texts", F.col("top.core").alias("main"), (F.col("texts") * F.col("homes") - spared).alias("tests"))


def _in_blocks(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of cells (cell, main, node, n, home, core, far): texts outside the main core against those at home."""
    outside = F.col("core").isNull() | F.coalesce(F.col("core") != F.col("main"), F.lit(True))
    both = cells.withColumn("out", outside).withColumn("root", F.coalesce("core", "node"))
    size = both.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("out"), F.col("n"))) / OUTSIDE_BLOCK).cast("int").alias("obs"),
        F.ceil(F.sum(F.when(F.col("home"), F.col("n"))) / HOME_BLOCK).cast("int").alias("mbs"),
    )
    met = both.join(size.where("obs > 0 AND mbs > 0").withColumnRenamed("cell", "c"), F.col("cell") == F.col("c"))
    ob, mb = F.pmod(F.xxhash64("node"), F.col("obs")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("mbs")).cast("int")
    cols = ["cell", "ob", "mb", "side", "node", "root", "far"]
    out = met.where("out").withColumn("side", F.lit(0)).withColumn("ob", ob).withColumn("mb", F.explode(F.expr("sequence(0, mbs - 1)")))
    home = met.where("home").withColumn("side", F.lit(1)).withColumn("mb", mb).withColumn("ob", F.explode(F.expr("sequence(0, obs - 1)")))
    rows = out.select(*cols).unionByName(home.select(*cols))
    return _grouped(rows.join(sets, "node").select(*cols, "shingles"), ["cell", "ob", "mb"], _cells, "a long, b long")


def _by_own_pivots(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of cells that no document pivots split: singleton pivots, rarest inside the cell first."""
    held = cells.join(sets, "node").select("cell", "node", "n", "core", "shingles")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            which = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            words = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(which) for i in range(3)), words], ["cell", "node", "n", "s"])

    each = cut(held.select("cell", "node", "n", "shingles").mapInArrow(spread, "cell long, node long, n int, s long"))
    often = each.groupBy(F.col("cell").alias("c"), F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("k"))
    ordered = each.join(often, (F.col("cell") == F.col("c")) & (F.col("s") == F.col("t")))
    place = F.row_number().over(Window.partitionBy("cell", "node").orderBy("k", "s")) - 1
    least = F.ceil(F.col("n") * NEAR / 100)
    # alone in the cell, a shingle is a region of one text
    placed = ordered.withColumn("pos", place).where((F.col("pos") < F.col("n") - least + F.least(F.lit(SHARED), least)) & (F.col("k") > 1))
    placed = placed.select(F.xxhash64("cell", "s").alias("key"), "node", "n", "pos", F.lit(-1).alias("sub"))
    met = _met(placed.repartition(partitions(cells.sparkSession), "key"))
    core = cells.where("core IS NOT NULL").select(F.col("node").alias("x"), "core").distinct()
    pairs = met.where("kind = 0").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(core.select(F.col("x"), F.col("core").alias(f"core_{end}")), F.col(end) == F.col("x"), "left").drop("x")
    pairs = cut(pairs.where("core_a IS NULL OR core_b IS NULL OR core_a <> core_b").select("a", "b").distinct())
    none = F.lit(None).cast("long")
    wide = met.where("kind = 1").select(F.col("a").alias("cell"), none.alias("main"), F.col("b").alias("node"), "n", F.lit(True).alias("home"))
    wide = wide.join(core, F.col("node") == F.col("x"), "left").drop("x").dropDuplicates(["cell", "node"]).withColumn("far", F.array().cast("array<double>"))
    return _links(_measured(pairs, sets)).unionByName(_in_blocks(wide, sets))


def _links(measured: DataFrame) -> DataFrame:
    return measured.where(F.lit(100) * F.col("common") >= F.lit(NEAR) * F.col("total")).select("a", "b")


def _met(placed: DataFrame) -> DataFrame:
    """What _leaves makes of placed rows, with the pairs that meet in too few regions dropped."""
    met = placed.sortWithinPartitions("key", "node").mapInArrow(_leaves, "kind int, a long, b long, n int, open int, times int")
    met = met.groupBy("kind", "a", "b").agg(F.max("n").alias("n"), F.max("open").alias("open"), F.sum("times").alias("times"))
    return cut(met.where("kind > 0 OR (open = 1 AND times >= n)"))


def voronoi(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what links within regions (cell, node, n), by recursion over Voronoi cells.

    Texts that link with one another are connected by the result, not necessarily by a link of their own.
    """
    none = F.lit(None).cast("long")
    cells = regions.select("cell", "node", "n", F.lit(True).alias("home"), none.alias("core"))
    links, few, stuck = [], [], []
    for level in range(LEVELS):
        chosen = [F.min_by("node", F.struct(F.col("core").isNotNull(), F.xxhash64("node", F.lit(level * PIVOTS + i)))) for i in range(PIVOTS)]
        info = cells.where("home").groupBy(F.col("cell").alias("c")).agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
        size = cells.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count(F.lit(1)) / MEASURED_TOGETHER).cast("int").alias("parts"))
        info = cut(info.join(size, "c"))
        sub = F.pmod(F.xxhash64("node", F.lit(-1 - level)), F.col("parts")).cast("int")
        texts = cells.join(info, F.col("cell") == F.col("c")).select("cell", sub.alias("sub"), F.lit(1).alias("kind"), "node", "n", "home", "core")
        pivots = info.select("c", F.explode("pivots").alias("node"), "parts")
        pivots = pivots.select(F.col("c").alias("cell"), F.explode(F.expr("sequence(0, parts - 1)")).alias("sub"), F.lit(0).alias("kind"), "node",
                               F.lit(0).alias("n"), F.lit(True).alias("home"), none.alias("core"))
        rows = texts.unionByName(pivots).join(sets, "node").select(*texts.columns, "shingles")
        dealt = rows.repartition(partitions(rows.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub", "kind", "node")
        seen = dealt.mapInArrow(_distances, "cell long, node long, n int, home boolean, core long, far array<double>, near array<long>")
        seen = cut(seen.withColumn("core", F.coalesce("core", F.get("near", F.lit(0)))))
        links.append(seen.select(F.col("node").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        before = _tests(seen)
        best = F.array_min("far")
        window = 2 * (1 - NEAR / 100) + 1e-9
        reached = F.filter(F.sequence(F.lit(0), F.size("far") - 1), lambda i: F.get("far", i) <= best + window)
        below = seen.withColumn("i", F.explode(reached)).withColumn("own", F.array_position("far", best) - 1)
        below = cut(below.select(F.col("cell").alias("parent"), F.xxhash64("cell", F.lit(level), "i").alias("cell"), "node", "n", (F.col("home") & (F.col("i") == F.col("own"))).alias("home"), "core", "far"))
        after = cut(_tests(below).join(below.select("parent", "cell").distinct(), "cell"))
        left = after.groupBy(F.col("parent").alias("p")).agg(F.sum("tests").alias("left"))
        judged = cut(before.join(left, F.col("cell") == F.col("p")).select("cell", "main", "texts", "tests", (F.col("left") <= HELPS * F.col("tests")).alias("helps")))
        small = (F.col("tests") <= LEAF * LEAF) | (F.col("texts") <= LEAF)
        done, hopeless = judged.where(small & (F.col("tests") > 0)), judged.where(~small & ~F.col("helps"))
        few.append(seen.join(done.select("cell", "main"), "cell").select("cell", "main", "node", "n", "home", "core", "far"))
        stuck.append(seen.join(hopeless.select("cell"), "cell", "left_semi").select("cell", "node", "n", "core"))
        open_ = judged.where(~small & F.col("helps")).select(F.col("cell").alias("q"))
        ready = after.join(open_, F.col("parent") == F.col("q"), "left_semi")
        tight = (F.col("tests") <= LEAF * LEAF) | (F.col("texts") <= LEAF)
        few.append(below.join(ready.where(tight & (F.col("tests") > 0)).select("cell", "main"), "cell").select("cell", "main", "node", "n", "home", "core", "far"))
        cells = cut(below.join(ready.where(~tight).select("cell"), "cell", "left_semi").select("cell", "node", "n", "home", "core"))
        if cells.isEmpty():
            break
    stuck.append(cells.select("cell", "node", "n", "core"))
    slow = cut(reduce(DataFrame.unionByName, stuck))
    links.append(cut(_in_blocks(reduce(DataFrame.unionByName, few), sets)))
    if not slow.isEmpty():
        links.append(cut(_by_own_pivots(slow, sets)))
    return reduce(DataFrame.unionByName, links)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = cut(texts.mapInArrow(_survey, "kind int, a long, b long, c long, bits binary"))
    heavy, counts = frequent(survey)
    only = texts.select("text")
    n = partitions(docs.sparkSession)
    placed = only.mapInArrow(_place(heavy, counts, n), "key long, node long, n int, pos int, sub int")
    met = _met(placed.repartition(n, "key", "sub"))
    pairs = met.where("kind = 0").select("a", "b")
    # Large regions with the same first node are joined as one: overlapping regions become few. Regions in many tasks
    # are at most HEAVY, as each is an entry of the summary.
    hot = met.where("kind = 2")
    lead = hot.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("lead"))
    hot = hot.join(F.broadcast(lead), F.col("a") == F.col("k")).select(F.col("lead").alias("cell"), F.col("b").alias("node"), "n")
    big = met.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("node"), "n")
    big = cut(big.unionByName(hot).distinct())
    bits = survey.where("bits IS NOT NULL").groupBy(F.col("b").alias("node")).agg(F.first("bits").alias("bits"))
    sieved = _sieved(big, bits)
    pairs = pairs.union(sieved.where("kind = 0").select("a", "b")).distinct()
    big = sieved.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("node"), "n")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(big.select("node")).distinct()
    sets = cut(_sets_of(only, nodes))
    links = _links(_measured(pairs, sets))
    if not big.isEmpty():
        links = cut(links.unionByName(voronoi(big, sets)))
    roots = connected(links)
    rows = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    named = cut(classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select(F.col("node").alias("cls"), "component")
    out = rows.join(named, rows.node == named.cls, "left")
    # everything that runs Python is materialised by now; what is left are joins of narrow tables
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the documents that link, directly or not, with one of a smaller id; same columns.

    Rows with a null id stay. Rows that repeat an id are one document: they stay or go together.
    """
    found = components(docs, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(id_col).alias("__id"))
    return row.join(found, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
