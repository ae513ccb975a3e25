"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import (
    ball_tree,
    chat_format,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    pii,
    quality,
    sentencepiece_codec,
    sharding,
    turn_repair,
    word_bpe,
)
from quern.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(documents(spark, sf_dir, "conversations"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.report(documents(spark, sf_dir))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.report(documents(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(documents(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_format": op3_chat_format,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_word_bpe": op11_word_bpe,
    "op12_ball_tree": op12_ball_tree,
    "op13_turn_repair": op13_turn_repair,
}

def _rounds(n: int) -> str:
    """Assignments a1 to a(n+1) to the centroids c0 to c(n), each round's means floored; for WITH, after points and c0."""
    step = """a{next} AS (
            SELECT r, (min((d, c)))[1] AS d, (min((d, c)))[2] AS c
            FROM (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM points JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r),
        """
    means = """c{next} AS (
            SELECT c, i, coalesce(m, y) AS y
            FROM c{k} LEFT JOIN (
                SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
                FROM a{next} JOIN points USING (r) GROUP BY c, i) USING (c, i)),
        """
    return "".join(step.format(k=k, next=k + 1) + (means.format(k=k, next=k + 1) if k < n else "") for k in range(n + 1))


ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
                   length('<s>[ROLE]  [/ROLE] [INST]  [/INST]</s>') + 1
                   + length(regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|\[/?ROLE\])', '\\\1\2', 'g'))
                   + length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|\[/?ROLE\])', '\\\1\2', 'g')) AS n
            FROM c),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
                   coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
                   CAST(sum(n) AS BIGINT) AS formatted_chars
            FROM f GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS l FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                     ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
        m AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (
            SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.k + b.k - c)),
        sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (
            SELECT doc_id AS d, doc_id AS z FROM documents
            UNION
            SELECT r.d, b.y FROM r JOIN sym b ON b.x = r.z)
        SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, t.component_id
        FROM w LEFT JOIN n USING (doc_id)
        JOIN (SELECT d, min(z) AS component_id FROM r GROUP BY d) t ON t.d = w.doc_id
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
    """,
    "op5_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        t AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INTEGER] AS w FROM s),
        fill AS (
            SELECT 0 AS round, source, source_size, w, source_size = 0 AS capped, TRUE AS moved,
                   NULL::DOUBLE AS even FROM t
            UNION ALL
            SELECT round + 1, source, source_size, w, capped OR share > 2 * source_size,
                   max(CASE WHEN NOT capped AND share > 2 * source_size THEN 1 ELSE 0 END) OVER () = 1, share
            FROM (
                SELECT *,
                       (1.5::DOUBLE * sum(source_size) OVER ()
                        - coalesce(sum(CASE WHEN capped THEN 2 * source_size END) OVER (), 0)) * w
                       / greatest(coalesce(sum(CASE WHEN NOT capped THEN w END) OVER (), 0), 1)::DOUBLE AS share
                FROM fill WHERE moved)),
        last AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
        aims AS (
            SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE even END AS target
            FROM last),
        r AS (
            SELECT d.doc_id, d.size, a.source_size, a.target,
                   CASE WHEN a.source_size = 0 THEN 0.0::DOUBLE ELSE a.target / a.source_size END AS rate,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
                   ('0x' || substr(md5('mix' || CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END), 1, 8))::BIGINT::DOUBLE
                   / 4294967296.0::DOUBLE AS u
            FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
        SELECT doc_id, size, source_size, target,
               CAST((floor(k * rate + u) - floor((k - 1) * rate + u)) * size AS BIGINT) AS taken
        FROM r
    """,
    "op9_sharding": r"""
        WITH d AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                   ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
            FROM documents),
        levels AS (SELECT unnest(range(0, 61)) AS depth),
        b AS (
            SELECT depth, h >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS bucket, count(*) AS n, min(h) = max(h) AS one
            FROM d, levels GROUP BY ALL),
        pick AS (
            SELECT d.doc_id, d.h, d.n_bytes, min(b.depth) AS depth, row_number() OVER (PARTITION BY d.h) - 1 AS k
            FROM (SELECT *, row_number() OVER () AS i FROM d) d JOIN b ON b.prefix = d.h >> (60 - b.depth)
            WHERE b.bucket <= 4194304 OR b.one GROUP BY d.i, d.doc_id, d.h, d.n_bytes),
        placed AS (
            SELECT p.*, b.bucket, b.n, CASE WHEN p.depth = 0 THEN '' ELSE right(lpad(bin(p.h >> (60 - p.depth)), 60, '0'), p.depth) END AS bits,
                   bucket > 4194304 AND n > 1 AS paged, greatest(1, 4194304 // greatest(n_bytes, 1)) AS fits
            FROM pick p JOIN b ON b.depth = p.depth AND b.prefix = p.h >> (60 - p.depth))
        SELECT doc_id, n_bytes, depth, CASE WHEN paged THEN bits || '.' || (k // fits) ELSE bits END AS shard,
               CAST(CASE WHEN paged THEN least(fits, n - (k // fits) * fits) * n_bytes ELSE bucket END AS BIGINT) AS shard_bytes
        FROM placed
    """,
    "op12_ball_tree": """
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id,
                   list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        points AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
        c0 AS (
            SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS y
            FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept)
            WHERE c < 16),
    """
    + _rounds(3)
    + """
        own AS (SELECT *, sum(d) OVER (PARTITION BY c) AS cluster_inertia, sum(d) OVER () AS inertia FROM a4),
        named AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, cluster_inertia::BIGINT AS cluster_inertia,
               inertia::BIGINT AS inertia, centroid_sha256
        FROM own JOIN kept USING (r) JOIN named USING (c)
    """,
    "op13_turn_repair": r"""
        WITH RECURSIVE o AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                  lambda x: ascii(x)::BIGINT) AS name
            FROM conversations),
        k AS (
            SELECT *, xor(list_reduce(name, lambda h, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
                       lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)),
                       4294967295::BIGINT), 4294967295) % 20 AS kind FROM o),
        d AS (
            SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k)),
        n AS (
            SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        f AS (
            SELECT *, left(role, 1) AS a,
                   CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM n),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        v AS (
            SELECT conv_id, 0::BIGINT AS pos, {c: 0, a: ''} AS e, {c: 1000000, a: ''} AS s, {c: 2, a: 'I'} AS u, {c: 4, a: 'II'} AS z FROM ids
            UNION ALL
            SELECT conv_id, pos, e, s, u, least(z, {c: u.c + 2, a: u.a || 'I'}) FROM (
                SELECT conv_id, pos, e, s, z, least(u, {c: e.c + 2, a: e.a || 'I'}, {c: s.c + 2, a: s.a || 'I'}, {c: z.c + 2, a: z.a || 'I'}) AS u
                FROM (
                    SELECT v.conv_id, f.pos,
                           {c: e.c + 3, a: e.a || 'D'} AS e,
                           least({c: s.c + 3, a: s.a || 'D'}, {c: e.c + t + CASE WHEN f.a = 's' THEN no ELSE 1000000 END, a: e.a || 'K'}) AS s,
                           least({c: u.c + 3, a: u.a || 'D'},
                                 {c: e.c + t + 2 + no, a: e.a || 'R'}, {c: s.c + t + 2 + no, a: s.a || 'R'}, {c: z.c + t + 2 + no, a: z.a || 'R'},
                                 {c: e.c + t + nu, a: e.a || 'K'}, {c: s.c + t + nu, a: s.a || 'K'}, {c: z.c + t + nu, a: z.a || 'K'}) AS u,
                           least({c: z.c + 3, a: z.a || 'D'}, {c: u.c + t + 2 + no, a: u.a || 'R'},
                                 {c: u.c + t + CASE WHEN f.a = 'a' THEN no ELSE 1000000 END, a: u.a || 'K'}) AS z
                    FROM v JOIN (
                        SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t, CASE WHEN fault IN ('b', 'd') THEN 1000000 ELSE 0 END AS no,
                               CASE WHEN a = 'u' AND fault NOT IN ('b', 'd') THEN 0 ELSE 1000000 END AS nu FROM f) f
                    ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1))),
        best AS (SELECT conv_id, least(e, z) AS w FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        edits AS (
            SELECT conv_id, generate_subscripts(string_split(w.a, ''), 1) AS p, unnest(string_split(w.a, '')) AS edit
            FROM best WHERE w.a <> ''),
        placed AS (
            SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS pos,
                   count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS j
            FROM edits),
        lines AS (
            SELECT y.conv_id, y.p, y.edit, y.j, f.role, CASE WHEN y.edit = 'I' THEN '' ELSE f.text END AS text,
                   max(CASE WHEN y.j = 1 AND y.edit = 'K' AND f.a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS led
            FROM placed y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.pos = y.pos
            WHERE y.edit <> 'D'),
        said AS (
            SELECT conv_id, sha256(string_agg(
                CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h
            FROM lines GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                   count(*) FILTER (WHERE fault = 't') AS truncated,
                   count(*) FILTER (WHERE before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id)
        SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
               coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, b.w.c::BIGINT AS cost, b.w.a AS audit,
               coalesce(s.h, sha256('')) AS repaired_sha256
        FROM ids i JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
    """,
}
