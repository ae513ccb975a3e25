"""Document fingerprints: bottom-k sketches of word-shingle hashes (native).

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's 5-word shingles (in lower case;
with fewer words the whole sequence is one shingle). Sketches merge: that of the union of two sets is the k smallest
hashes of both. From sketches follow estimates of resemblance (Jaccard), containment and the number of distinct
shingles, all exact while a set has no more than k shingles. All are Column functions; nothing leaves the JVM.

Defined results: null text counts as empty; an empty text has the empty sketch, which resembles only another empty one
(1.0). Equal texts have equal fingerprints. The next document of the report is the next row by descending id (null last,
equal ids by a hash of their texts), the first one after the last; wholly repeated rows count once in that order and get
equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import SPACE, cut, ranked

K, WIDTH = 128, 5


def words(text: Column) -> Column:
    """Words of a text in lower case; an empty array for null and blank texts."""
    bare = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def sketch_of_words(w: Column, k: int = K) -> Column:
    """The sketch of an array column of words (bind the array to a column first, so that it is split once)."""
    n = F.size(w)
    places = F.sequence(F.lit(0), n - WIDTH)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)]))
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    return F.slice(F.sort_array(F.array_distinct(F.when(n < WIDTH, whole).otherwise(hashes))), 1, k)


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K) -> DataFrame:
    return df.withColumn("__words", words(text)).withColumn(name, sketch_of_words(F.col("__words"), k)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sets behind two sketches."""
    both = F.size(F.array_intersect(F.array_intersect(merged(a, b, k), a), b))
    size = F.size(merged(a, b, k))
    return F.when(size == 0, 1.0).otherwise(both / size)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the set behind a that lies in the set behind b."""
    j = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, next_id per row.

    The texts are shuffled once, by row key; what a document needs of the next one (the beginning of its text and its
    sketch) is sent to it by that key.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("hash", F.xxhash64("text"))
    base = base.withColumn("key", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("hash")))
    rows = base.select("key", "id", "hash", F.char_length("text").alias("n")).groupBy("key").agg(
        F.first("id").alias("id"), F.first("hash").alias("hash"), F.first("n").alias("n")
    )
    order = cut(ranked(rows, [F.col("id").desc_nulls_last(), F.col("hash")]).select("key", "n", "rank"))
    total = order.count()
    # each row learns who comes before it in the circle, and how much of its text that one takes
    before = order.select(
        F.col("key").alias("before"), F.floor(F.col("n") / 3).cast("int").alias("taken"), (F.col("rank") % F.lit(max(total, 1)) + 1).alias("rank")
    )
    order = cut(order.join(before, "rank").select("key", "before", "taken"))
    texts = base.select("key", "id", "text").join(order, "key")
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    # next_id is carried along so that both uses of texts need the same columns, and share one shuffle
    sent = texts.where("nth = 1").select(
        F.col("before").alias("target"), F.col("id").alias("next_id"), F.expr("substring(text, 1, taken)").alias("start"), "text"
    )
    sent = with_sketch(sent, F.col("text"), "next", k).drop("text")
    met = texts.join(sent, texts.key == sent.target)
    n = F.char_length("text")
    met = met.withColumn("n_chars", n).withColumn("cut", F.floor(n / 3).cast("int"))
    met = met.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(start, 1, cut)")))
    met = with_sketch(with_sketch(met, F.col("text"), "own", k), F.col("edited"), "other", k)
    return met.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("n_shingles"),
        "next_id",
    )
