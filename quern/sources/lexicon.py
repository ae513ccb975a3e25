"""A maintained lexical index: postings in immutable segments, kept right under upserts and deletes.

A segment holds, in buckets of terms, its postings in blocks sorted by term and slice: the ids, tfs, dls and positions
(one text's after the other's) of a term and slice, about `BLOCK` numbers a row at most, with their statistics: how many texts,
the largest tf and the least dl. A slice is a range of text lengths, each about a fifth longer than the one before, so
these three give a close bound on what a text of the slice can score; they are read without the lists beside them.
It also holds a forward list (id, dl, terms), by which a later delete finds what to take off the document frequencies
without reading postings: every segment carries the counts (`minus`) that its dead ids take off each older one. Texts
are read once, when they come; a search reads none.

Postings are shuffled once, when their texts come, packed by bucket. Merging shuffles none: tasks read the same buckets
of all segments and leave out what is dead. Files are compressed with zstd, and a step's shuffle files go when it ends.

A search takes statistics of its terms first. From the slices with the highest bounds it reads postings until the k-th
best score is known, then only from slices whose bound reaches that score; no posting is read twice, and scores equal
operators.search.bm25 over the texts that count. Phrases need their positions everywhere, so they read all postings of
their words, once. `last_read` says how many postings of the terms there were and how many were read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import TOKEN, folded
from quern.operators.graph import materialised
from quern.operators.search import B, K1, ROUND, split_tokens
from quern.plans.requests import TextQuery
from quern.sources.segments import Segments

#: Slices a doubling of the length, and how many times the hits asked for the first slices should hold.
FINE, FIRST = 4, 8
#: Below so many postings everything is read at once.
FEW = 50_000
#: Texts whose tokens a task holds at a time; postings and positions that it sorts at a time, and that a block has.
TOGETHER, HELD, BLOCK = 500, 4_000_000, 32_768
#: Dead ids of a merge or a delete that go to every task; more of them meet their rows in a shuffle, in so many rounds.
GONE, ROUNDS = 1_000_000, 8
#: Bytes of postings in files that a task of a merge reads at least, while there are as many in a few buckets, and at most.
READ = 16 << 20, 128 << 20
MINUS = "term string, n long, victim string, bucket int"
#: Of the files; an index of another form is built anew.
FORM = 2


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def part_of(id_: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, low, ts) as (id, tokens): ts, or the tokens of an ASCII text in lower case."""
    for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
        plain = pc.is_valid(batch.column(1))
        rest = batch.filter(pc.invert(plain))
        if rest.num_rows:
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2)], ["id", "ts"])
        batch = batch.filter(plain)
        lists = pc.split_pattern_regex(batch.column(1), pattern="[^a-z0-9_.$]+")
        words = lists.flatten()
        full = pc.not_equal(words, "")  # before the first token and after the last one
        ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(full))], ["id", "ts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, tokens) as (id, dl, terms, tfs, positions): a text's distinct tokens, how often and where each occurs."""
    for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
        size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        starts = np.cumsum(size) - size
        named = batch.column(1).flatten().dictionary_encode()
        code, text = named.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
        place = np.arange(len(code)) - starts[text]
        order = np.lexsort((place, code, text))
        code, text, place = code[order], text[order], place[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.empty(0, np.int64)
        tf = np.diff(np.r_[first, len(code)])
        cuts = pa.array(np.r_[0, np.cumsum(np.bincount(text[first], minlength=len(size)))].astype(np.int32))
        ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        terms = pa.ListArray.from_arrays(cuts, named.dictionary.take(pa.array(code[first])).cast(pa.string()))
        tfs = pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size), terms, tfs, pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))], ["id", "dl", "terms", "tfs", "positions"]
        )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _counted makes of texts as postings (term, id, dl, positions), a run for each term."""
    for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
        cuts = pa.array(np.r_[0, np.cumsum(batch.column(3).flatten().to_numpy())].astype(np.int32))
        terms, places = batch.column(2).flatten(), pa.ListArray.from_arrays(cuts, batch.column(4).flatten())
        together = pa.array(np.argsort(terms.dictionary_encode().indices.to_numpy(), kind="stable"))  # equal terms shuffle as one run
        row = pa.array(row).take(together)
        columns = [terms.take(together), batch.column(0).take(row), batch.column(1).take(row), places.take(together)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "id", "dl", "positions"])


def _small(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings (term, id, dl, positions) as a row (bucket, size, blob) for each bucket that a batch has terms of."""
    codec = pa.Codec("zstd", 1)  # once for all columns of a blob, which are small
    for batch in batches:
        named = batch.column(0).dictionary_encode()
        of = np.array([zlib.crc32(t.encode()) % buckets for t in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
        batch = batch.take(pa.array(np.argsort(of, kind="stable")))
        ends = np.r_[0, np.cumsum(np.bincount(of, minlength=buckets))]
        out = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            rows = batch.slice(ends[k], ends[k + 1] - ends[k])
            tfs, places = pc.list_value_length(rows.column(3)).to_numpy(), rows.column(3).flatten().to_numpy()
            whole = [rows.column(0), rows.column(1), _small(rows.column(2).to_numpy()), _small(tfs), _small(places)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
            said = pa.RecordBatch.from_arrays(lists, ["term", "id", "dl", "tf", "positions"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, said.schema) as stream:
                stream.write_batch(said)
            raw = sink.getvalue()
            out.append((k, raw.size, codec.compress(raw, asbytes=True)))
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "size", "blob"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Postings of rows (bucket, size, blob) as arrays: bucket, term, id, tf, dl, positions."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for k, size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            with pa.ipc.open_stream(codec.decompress(blob.as_buffer(), size)) as stream:
                term, id_, dl, tf, places = (c.flatten() for c in stream.read_next_batch().columns)
            yield np.full(len(term), k, np.int32), term, id_, tf.cast(pa.int32()), dl.cast(pa.int32()), places.cast(pa.int32())


def _living(batches: Iterator[pa.RecordBatch], gone: dict[int, pa.Array]) -> Iterator[tuple]:
    """Postings of blocks (bucket, term, ids, tfs, dls, positions, seq) as arrays, without the ids that are gone from their segment."""
    for batch in batches:
        seqs = batch.column(6).to_numpy()
        for seq in np.unique(seqs).tolist():
            rows = batch.filter(pa.array(seqs == seq))
            row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(2)).to_numpy())
            term, bucket = rows.column(1).dictionary_encode(), rows.column(0).to_numpy()[row]
            term = pa.DictionaryArray.from_arrays(term.indices.take(pa.array(row)), term.dictionary).cast(pa.string())
            ids, tfs, dls, places = (rows.column(i).flatten() for i in (2, 3, 4, 5))
            if seq in gone:
                stay = pc.invert(pc.is_in(ids, value_set=gone[seq]))
                keep = stay.to_numpy(zero_copy_only=False)
                places = places.filter(pa.array(np.repeat(keep, tfs.to_numpy())))
                bucket, term, ids, tfs, dls = bucket[keep], term.filter(stay), ids.filter(stay), tfs.filter(stay), dls.filter(stay)
            yield bucket, term, ids, tfs, dls, places


def _blocks(postings: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Postings as blocks; those of a term and slice that come near each other share one."""
    held: list[tuple] = []
    size = 0
    for some in postings:
        held.append(some)
        size += len(some[1]) + len(some[5])
        if size >= HELD:
            yield from _sorted(held)
            held, size = [], 0
    yield from _sorted(held)


def _sorted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    bucket = np.concatenate([np.empty(0, np.int32), *[x[0] for x in held]])
    if not len(bucket):
        return
    term, ids, tfs, dls, places = (pa.concat_arrays([x[i] for x in held]) for i in range(1, 6))
    named = term.dictionary_encode()
    code, size = named.indices.to_numpy(), len(named.dictionary)
    of = np.empty(size, np.int32)
    of[code] = bucket
    place = np.empty(size, np.int64)
    place[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(size)
    place[np.lexsort((place, of))] = np.arange(size)  # in the order of the files, which then cost little to sort
    slice_ = np.floor(np.log2(dls.to_numpy()) * FINE).astype(np.int32)
    key = place[code] * (64 * FINE) + slice_
    order = np.argsort(key, kind="stable")
    starts = pa.array(np.r_[0, np.cumsum(tfs.to_numpy())].astype(np.int32))
    spots = pa.ListArray.from_arrays(starts, places).take(pa.array(order))
    key, tf, dl = key[order], tfs.to_numpy()[order], dls.to_numpy()[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.r_[0, np.cumsum(1 + tf.astype(np.int64))[:-1]]
    full = (weight - np.repeat(weight[first], np.diff(np.r_[first, len(key)]))) // BLOCK  # how many blocks of its group are full before
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (full[1:] != full[:-1])])
    ends = pa.array(np.r_[first, len(key)].astype(np.int32))
    inner = pa.array(np.r_[0, np.cumsum(tf)][np.r_[first, len(key)]].astype(np.int32))
    columns = [
        named.dictionary.take(pa.array(code[order[first]])), pa.array(slice_[order[first]]),
        pa.array(np.diff(np.r_[first, len(key)])), pa.array(np.maximum.reduceat(tf, first).astype(np.int64)), pa.array(np.minimum.reduceat(dl, first).astype(np.int64)),
        pa.ListArray.from_arrays(ends, ids.take(pa.array(order))), pa.ListArray.from_arrays(ends, pa.array(tf)), pa.ListArray.from_arrays(ends, pa.array(dl)),
        pa.ListArray.from_arrays(inner, spots.flatten()), pa.array(bucket[order[first]]),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["term", "slice", "n", "most", "least", "ids", "tfs", "dls", "positions", "bucket"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, seq, ids, tfs, dls, positions) as postings (term, seq, id, tf, dl, positions)."""
    for batch in batches:
        row = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy()))
        ids, tfs, dls, places = (batch.column(i).flatten() for i in (2, 3, 4, 5))
        spots = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tfs.to_numpy())].astype(np.int32)), places)
        columns = [batch.column(0).take(row), batch.column(1).take(row), ids, tfs.cast(pa.int64()), dls.cast(pa.int64()), spots]
        yield pa.RecordBatch.from_arrays(columns, ["term", "seq", "id", "tf", "dl", "positions"])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


class LexicalIndex(Segments):
    """BM25 over texts (id, text) whose ids are unique."""

    last_read: dict[str, int] | None = None

    def exists(self) -> bool:
        entry = self.log.latest()
        return entry is not None and entry["state"]["config"].get("form") == FORM

    def state(self) -> dict:
        state = super().state()
        if state["config"].get("form") != FORM:
            raise ValueError("the index has an older form and must be built anew")
        return state

    def build(self, texts: DataFrame, buckets: int = 64, batch: tuple[str, int] | None = None) -> None:
        """Indexes texts anew; what was there before counts no more."""
        config = {"buckets": buckets, "id_type": texts.schema["id"].dataType.simpleString(), "form": FORM}
        self._append(config, lambda at: self._write(texts, at, config), None, True, batch)

    def upsert(self, texts: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """One segment: texts come in place of older ones of their ids, the ids of gone (id) leave."""
        config = self.state()["config"]
        killed = texts.select("id") if gone is None else texts.select("id").union(gone.select("id"))
        self._append(config, lambda at: self._write(texts, at, config), killed, False, batch, self._settle)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> None:
        none = self.spark.createDataFrame([], f"id {self.state()['config']['id_type']}, text string")
        self.upsert(none, ids, batch)

    def _schema(self, config: dict) -> str:
        return f"term string, slice int, n long, most long, least long, ids array<{config['id_type']}>, tfs array<int>, dls array<int>, positions array<int>, bucket int"

    def _forward(self, config: dict) -> str:
        return f"id {config['id_type']}, dl long, terms string, part int"

    def _write(self, texts: DataFrame, at: str, config: dict) -> dict:
        """Words are counted text by text where the texts are read, and kept once: postings packed by bucket, and forward lists."""
        n, kind, staged = config["buckets"], config["id_type"], f"{at}/words"
        schema, low = f"bucket int, size int, blob binary, id {kind}, dl long, terms string", folded(F.col("text"))
        plain = F.octet_length("low") == F.char_length("low")  # then its tokens are the same in any version of Unicode
        found = texts.select("id", low.alias("low")).select("id", F.when(plain, F.col("low")).alias("low"), F.when(~plain, F.regexp_extract_all("low", F.lit(TOKEN), F.lit(0))).alias("ts"))

        names = ["bucket", "size", "blob", "id", "dl", "terms"]

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _counted(_split(batches)):
                lists = pc.binary_join(batch.column(2), " ")
                none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, batch.column(0), batch.column(1), lists], names)
                for blobs in _packed(_posted(iter([batch])), n):
                    none = [pa.nulls(blobs.num_rows, t) for t in (batch.column(0).type, pa.int64(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*blobs.columns, *none], names)

        found.mapInArrow(words, schema).write.option("compression", "zstd").parquet(staged)
        kept = self.spark.read.schema(schema).parquet(staged)
        said = self._listed(kept.where("bucket IS NULL").select("id", "dl", "terms"), at, config)
        self._blocked(kept.where("bucket IS NOT NULL").select("bucket", "size", "blob"), at, config)
        self.log.remove(staged.removeprefix(f"{self.folder}/"))
        return said

    def _blocked(self, blobs: DataFrame, at: str, config: dict) -> None:
        """Writes the postings of packed rows (bucket, size, blob)."""
        self._put(blobs.hint("rebalance", "bucket").mapInArrow(lambda batches: _blocks(_unpacked(batches)), self._schema(config)), at)

    @staticmethod
    def _put(blocks: DataFrame, at: str) -> None:
        blocks.sortWithinPartitions("bucket", "term", "slice").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/postings")

    def _listed(self, lists: DataFrame, at: str, config: dict) -> dict:
        """Writes the forward lists (id, dl, terms)."""
        lists = lists.withColumn("part", part_of(F.col("id"), config["buckets"])).hint("rebalance", "part")
        lists.sortWithinPartitions("part", "id").write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/forward")
        rows, total = self.spark.read.schema(self._forward(config)).parquet(f"{at}/forward").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"rows": rows, "tokens": total, "removed": {}}

    def _settle(self, state: dict, killed: DataFrame, at: str) -> dict:
        """What the killed ids take off each older segment: texts and tokens in the entry, words in a table of their own."""
        config = state["config"]
        ids = killed.withColumn("part", part_of(F.col("id"), config["buckets"]))
        parts = sorted(r[0] for r in ids.select("part").distinct().collect())  # at most `buckets`
        old = self._all(state["segments"], "forward", self._forward(config)).where(F.col("part").isin(parts))
        hit = self._alive(old.select("id", "dl", "seq", "of").join(ids.select("id").distinct(), "id", "left_semi"), state)
        hit = materialised(hit.select("id", "dl", "of"))
        removed = {r["of"]: [r["n"], r["t"]] for r in hit.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t")).collect()}
        those = hit.select("id", "of")
        if sum(n for n, _ in removed.values()) <= GONE:
            those = F.broadcast(those)
        words = self._all([s for s in state["segments"] if s["folder"] in removed], "forward", self._forward(config)).where(F.col("part").isin(parts) & (F.col("terms") != ""))
        words = words.select("id", "of", "terms").join(those, ["id", "of"], "left_semi")
        minus = words.select(F.explode(F.split("terms", " ")).alias("term"), F.col("of").alias("victim")).groupBy("term", "victim").agg(F.count(F.lit(1)).alias("n"))
        minus = minus.withColumn("bucket", bucket_of(F.col("term"), config["buckets"])).repartition("bucket")
        minus.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{at}/minus")
        return {"removed": removed, "minus": at}

    def _merged(self, state: dict, run: list[dict], older: list[dict], folder: str) -> dict:
        config, at = state["config"], f"{self.folder}/{folder}"
        ids, dead = self._all(run, "forward", self._forward(config)).select("id", "seq"), self._killed(state)
        gone = materialised(ids.limit(0) if dead is None else ids.join(dead, "id").where("seq < upto").select("id", "seq"))
        few = gone.count() <= GONE
        lists = self._all(run, "forward", self._forward(config)).join(F.broadcast(gone) if few else gone, ["id", "seq"], "left_anti")
        said = self._listed(lists.select("id", "dl", "terms"), at, config)
        if few:
            self._without(run, gone, at, config)
        else:
            self._joined(run, gone, at, config)
        before = {s["folder"] for s in older}
        for s in run:  # what the run takes off segments that are older than all of it
            for victim, (n, tokens) in s["removed"].items():
                if victim in before:
                    a, b = said["removed"].get(victim, [0, 0])
                    said["removed"][victim] = [a + n, b + tokens]
        carried = self._minus(run).where(F.col("victim").isin(sorted(before)))
        if said["removed"]:
            carried = carried.groupBy("bucket", "term", "victim").agg(F.sum("n").alias("n")).repartition("bucket")
            carried.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/0/minus")
            said["minus"] = f"{folder}/0"
        return said

    def _without(self, run: list[dict], gone: DataFrame, at: str, config: dict) -> None:
        """The postings of a run of segments without those of a few ids (id, seq), which go to every task. Nothing is shuffled:
        a task reads neighbouring buckets of all segments, or a share of a large bucket."""
        found = gone.toArrow()
        dead = {q: found.filter(pc.equal(found["seq"], q))["id"].combine_chunks() for q in pc.unique(found["seq"]).to_pylist()}
        dead = self.spark.sparkContext.broadcast(dead)
        tables = [self._read(s, "postings", self._schema(config)).select("bucket", "term", "ids", "tfs", "dls", "positions", "seq") for s in run if s["rows"]]
        shares = []
        for buckets, size in self._neighbours([s for s in run if s["rows"]], config):
            rows = reduce(DataFrame.unionByName, [t.where(F.col("bucket").isin(buckets)) for t in tables])
            shares.append(rows.coalesce(-(-size // READ[1])))
        if shares:
            self._put(reduce(DataFrame.unionByName, shares).mapInArrow(lambda batches: _blocks(_living(batches, dead.value)), self._schema(config)), at)
        else:
            self._put(self.spark.createDataFrame([], self._schema(config)), at)
        dead.destroy()

    def _neighbours(self, run: list[dict], config: dict) -> list[tuple[list[int], int]]:
        """Buckets in turn, as many together as hold READ[0] bytes of postings, and how many bytes these hold."""
        out: list[tuple[list[int], int]] = []
        for k in range(config["buckets"]):
            size = sum(self.log.size(f"{s['folder']}/postings/bucket={k}") for s in run)
            if out and out[-1][1] + size <= READ[0]:
                out[-1] = [*out[-1][0], k], out[-1][1] + size
            elif size:
                out.append(([k], size))
        return out

    def _joined(self, run: list[dict], gone: DataFrame, at: str, config: dict) -> None:
        """The same for any number of ids: postings meet them in a shuffle, some buckets a round, so that of the postings'
        shuffle files a part alone exists at a time."""
        n, kind = config["buckets"], config["id_type"]
        blocks = self._all(run, "postings", self._schema(config)).select("term", "seq", "ids", "tfs", "dls", "positions", "bucket")
        for k in range(ROUNDS):
            some = blocks.where(F.col("bucket").isin(list(range(k, n, ROUNDS)))).drop("bucket")
            rows = some.mapInArrow(_opened, f"term string, seq int, id {kind}, tf long, dl long, positions array<int>").join(gone, ["id", "seq"], "left_anti")
            rows = rows.select("term", "id", "dl", "positions").mapInArrow(lambda batches: _packed(batches, n), "bucket int, size int, blob binary")
            self._blocked(rows, at, config)

    def _minus(self, segments: list[dict]) -> DataFrame:
        at = [f"{self.folder}/{s['minus']}/minus" for s in segments if s.get("minus")]
        out = self.spark.createDataFrame([], MINUS)
        for a in at:
            out = out.unionByName(self.spark.read.schema(MINUS).parquet(a))
        return out

    @staticmethod
    def counts(state: dict) -> tuple[int, float]:
        """Texts that count and their mean length."""
        held = {s["folder"] for s in state["segments"]}
        off = [v for s in state["segments"] for victim, v in s["removed"].items() if victim in held]
        n = sum(s["rows"] for s in state["segments"]) - sum(v[0] for v in off)
        tokens = sum(s["tokens"] for s in state["segments"]) - sum(v[1] for v in off)
        return n, tokens / n if n else 0.0

    def search(self, query: TextQuery, limit: int | None, where: DataFrame | None = None) -> DataFrame:
        """(id, score) as bm25 gives them; `where` (id) restricts the hits, not what is counted."""
        state = self.state()
        config = state["config"]
        parts = list(dict.fromkeys(tuple(p) for p in map(split_tokens, [*query.phrases, *query.terms]) if p))
        if not parts or not state["segments"]:
            return self.spark.createDataFrame([], f"id {config['id_type']}, score double")
        words = sorted({w for p in parts for w in p})
        # buckets of constants are constants to the optimizer, which prunes by them
        mine = F.col("bucket").isin(*[bucket_of(F.lit(w), config["buckets"]) for w in words]) & F.col("term").isin(words)
        n, mean = self.counts(state)
        phrases = any(len(p) > 1 for p in parts)
        blocks = self._all(state["segments"], "postings", self._schema(config)).where(mine)
        # a row for each term and slice of the query's own terms
        stats = blocks.groupBy("term", "slice").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).collect()
        total = sum(r["n"] for r in stats)
        if phrases:
            self.last_read = {"postings": total, "read": total}
            rows = blocks.select("term", "seq", "ids", "tfs", "dls", "positions").mapInArrow(_opened, f"term string, seq int, id {config['id_type']}, tf long, dl long, positions array<int>")
            return self._with_phrases(self._alive(rows, state), parts, words, n, mean, limit, where)
        held, off = {s["folder"] for s in state["segments"]}, {}
        if any(s.get("minus") for s in state["segments"]):
            minus = self._minus(state["segments"]).where(mine & F.col("victim").isin(sorted(held)))
            off = {r["term"]: r["n"] for r in minus.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        df = {w: sum(r["n"] for r in stats if r["term"] == w) - off.get(w, 0) for w in words}
        order = [p[0] for p in parts]

        def scored(some: DataFrame) -> DataFrame:
            at = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(order)]
            some = some.select("term", "seq", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            some = some.select("term", "seq", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
            hits = self._alive(some, state).groupBy("id").agg(F.first("dl").alias("dl"), *at)
            if where is not None:
                hits = hits.join(where.select("id").distinct(), "id", "left_semi")
            tfs = [F.coalesce(F.col(f"tf{i}"), F.lit(0)).cast("double") for i in range(len(order))]
            return hits.select("id", F.round(_bm25(tfs, [F.lit(df[w]) for w in order], n, mean), ROUND).alias("score"))

        if limit is None or total <= FEW:
            self.last_read = {"postings": total, "read": total}
            hits = scored(blocks)
            return hits if limit is None else hits.orderBy(F.desc("score"), "id").limit(limit)
        bound: dict[int, float] = {}
        size: dict[int, int] = {}
        for r in stats:
            most = _best(r["most"], r["least"], df[r["term"]], n, mean)
            bound[r["slice"]] = bound.get(r["slice"], 0.0) + most
            size[r["slice"]] = max(size.get(r["slice"], 0), r["n"])
        ranked = sorted(bound, key=lambda s: -bound[s])
        first, seen = [], 0
        while ranked and seen < FIRST * limit:
            seen += size[ranked[0]]
            first.append(ranked.pop(0))
        top = materialised(scored(blocks.where(F.col("slice").isin(first))).orderBy(F.desc("score"), "id").limit(limit))
        found = top.agg(F.count(F.lit(1)), F.min("score")).first()
        least = found[1] if found[0] == limit else float("-inf")
        rest = [s for s in ranked if bound[s] >= least - 2 * 10**-ROUND]
        self.last_read = {"postings": total, "read": sum(r["n"] for r in stats if r["slice"] in {*first, *rest})}
        if rest:
            top = top.unionByName(scored(blocks.where(F.col("slice").isin(rest))))
        return top.orderBy(F.desc("score"), "id").limit(limit)

    @staticmethod
    def _with_phrases(rows: DataFrame, parts: list[tuple[str, ...]], words: list[str], n: int, mean: float, limit: int | None, where: DataFrame | None) -> DataFrame:
        """Phrases by their positions: a narrow table of counts, kept, gives document frequencies and scores."""
        at = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)]
        held = rows.groupBy("id").agg(F.first("dl").alias("dl"), *at)
        counts = [_times([F.col(f"p{words.index(w)}") for w in p]).alias(f"tf{i}") for i, p in enumerate(parts)]
        counted = materialised(held.select("id", "dl", *counts).where(_any([F.col(f"tf{i}") > 0 for i in range(len(parts))])))
        dfs = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(parts))]).first()
        if where is not None:
            counted = counted.join(where.select("id").distinct(), "id", "left_semi")
        tfs = [F.col(f"tf{i}").cast("double") for i in range(len(parts))]
        hits = counted.select("id", F.round(_bm25(tfs, [F.lit(x) for x in dfs], n, mean), ROUND).alias("score"))
        return hits if limit is None else hits.orderBy(F.desc("score"), "id").limit(limit)


def _bm25(tfs: list[Column], dfs: list[Column], n: int, mean: float) -> Column:
    total = F.lit(0.0)
    for tf, df in zip(tfs, dfs, strict=True):
        idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    return total


def _best(tf: int, dl: int, df: int, n: int, mean: float) -> float:
    """The most that a term can add to a text of at least dl tokens that holds it at most tf times."""
    from math import log

    return log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1.0)))


def _times(places: list[Column]) -> Column:
    """How often tokens at these positions follow one another."""

    def back(p: Column, k: int) -> Column:
        return F.transform(p, lambda x: x - k)

    follow = places[0]
    for k, p in enumerate(places[1:], 1):
        follow = F.array_intersect(follow, back(p, k))
    return F.coalesce(F.array_size(follow), F.lit(0)).cast("long")
