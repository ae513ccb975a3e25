"""Sharding by extendible hashing (native).

A document's hash is 60 bits of an md5 over its id and its text's md5. The directory starts with one bucket of depth 0;
a bucket whose documents exceed the byte limit, and only such a bucket, is split on the next bit of the hash. A
document's shard is therefore the shallowest prefix of its hash whose bucket fits. Splitting works on a histogram by
hash prefix (partial aggregation, at most 2^STEP rows a pass), never on the documents themselves; only documents of
buckets that are still too large after STEP bits are counted again on the next STEP bits. A bucket in which all rows
have one hash cannot be split by any bit and is not split further.

Placement is one join: documents and directory entries are laid out by so many bits of the hash as the directory has
entries for (an entry of fewer bits stands for all prefixes below it, of more bits for its own one), and of the entries
that meet a document the one whose prefix is the document's own holds it.

Defined results: null text has 0 bytes; a null id hashes as ''. Rows that agree in all 60 bits (wholly repeated rows)
cannot be told apart by bits; a bucket of several such rows that is too large is dealt into overflow pages of as many as
fit (one at least), numbered after the shard's name; shard_bytes is then the page's. A single document above the limit
is alone in its shard. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, ranked

LIMIT = 4 << 20
#: Bits of a hash; bits that a histogram holds; levels of the directory that are decided at a time.
BITS, STEP, LEVELS = 60, 20, 8


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return docs.select(
        F.col(id_col).alias("__id"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("__hash"),
        F.octet_length(text).cast("long").alias("__bytes"),
    )


def _prefix(depth) -> F.Column:
    """The first `depth` bits of __hash as a number."""
    return F.shiftrightunsigned("__hash", BITS - depth)


def directory(hashed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, shard_bytes, rows) of every bucket. Only one of rows of a single hash is ever above the limit."""
    found, left, base = None, hashed, 0
    while True:
        top = min(BITS, base + STEP)
        sums = [F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("__hash").alias("low"), F.max("__hash").alias("high")]
        waiting = cut(left.groupBy(_prefix(top).alias("fine")).agg(*sums))
        low = base
        while True:
            high = min(top, low + LEVELS - 1)
            levels = waiting.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
            at = F.call_function("shiftrightunsigned", F.col("fine"), (F.lit(top) - F.col("depth")).cast("int"))
            sums = [F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("rows"), (F.min("low") == F.max("high")).alias("one")]
            sizes = levels.groupBy("depth", at.alias("prefix")).agg(*sums)
            sizes = cut(sizes.withColumn("done", (F.col("shard_bytes") <= limit) | F.col("one")))
            split = sizes.where("not done").select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
            mine = (F.col("depth") == F.col("d")) & (F.shiftrightunsigned("prefix", 1) == F.col("p"))
            rows = sizes.where("done").join(split, mine, "left").where((F.col("depth") == low) | F.col("d").isNotNull())
            rows = rows.select("depth", "prefix", "shard_bytes", "rows")
            found = rows if found is None else found.unionByName(rows)
            large = sizes.where((F.col("depth") == high) & ~F.col("done")).select(F.col("prefix").alias("p"))
            if large.isEmpty():
                return found
            if high == top:
                break
            waiting = waiting.join(large, F.shiftrightunsigned("fine", top - high) == F.col("p"), "left_semi")
            low = high + 1
        left = left.join(large, _prefix(top) == F.col("p"), "left_semi")
        base = top


def _laid_out(entries: DataFrame, bits: int) -> DataFrame:
    """The directory with the prefixes of `bits` bits that each entry stands for: fewer than 2^bits and one an entry."""
    wide = F.greatest(F.lit(0), F.lit(bits) - F.col("depth")).cast("int")
    deep = F.greatest(F.lit(0), F.col("depth") - bits).cast("int")
    first = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("prefix"), wide), deep)
    last = first + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1
    return entries.withColumn("__at", F.explode(F.sequence(first, last)))


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (the bits; page number appended to overflow pages), shard_bytes for each row."""
    hashed = cut(_hashed(docs, id_col, text_col))
    entries = cut(directory(hashed, limit))
    bits = min(BITS, max(1, entries.count()).bit_length())
    own = F.call_function("shiftrightunsigned", F.col("__hash"), (F.lit(BITS) - F.col("depth")).cast("int")) == F.col("prefix")
    placed = hashed.withColumn("__key", _prefix(bits)).join(_laid_out(entries, bits), (F.col("__key") == F.col("__at")) & own)
    name = F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("prefix"), BITS, "0"), BITS + 1 - F.col("depth"), BITS))
    placed = placed.withColumn("shard", name)
    full = (F.col("shard_bytes") > limit) & (F.col("rows") > 1)
    out = placed
    if not entries.where(full).isEmpty():
        # equal rows: numbers drawn among them in any order come to the same, so the group may lie in many tasks
        numbered = ranked(placed.where(full).withColumn("__any", F.rand(7)), [F.col("prefix"), F.col("depth"), F.col("__any")], ["prefix", "depth"])
        per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("__bytes")))
        page = F.floor((F.col("rank") - 1) / per_page).cast("long")
        size = F.least(per_page, F.col("rows") - page * per_page) * F.col("__bytes")
        paged = numbered.withColumn("shard_bytes", size).withColumn("shard", F.concat("shard", F.lit("."), page.cast("string")))
        out = placed.where(~full).unionByName(paged.select(*placed.columns))
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__bytes").alias("n_bytes"), "depth", "shard", F.col("shard_bytes").cast("long")
    )
