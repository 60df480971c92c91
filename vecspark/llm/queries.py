"""The operators of this folder as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.llm import (
    ann, centroids, chat, decontamination, importance, language, mixing, neardup, packing, pii, quality, repeats, warc,
)
from vecspark.llm.support import table
from vecspark.session import scratch_path


#: Key of the registered query; its results are for tests, not for release.
PSEUDONYM_KEY = "key of the registered query"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return chat.format_chats(table(spark, sf_dir, "conversations")).select(
        "conv_id", "n_turns", "n_copies", "text", F.array_join(spans, " ").alias("loss_spans")
    )


def op6_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_documents(docs, PSEUDONYM_KEY).select("doc_id", "n_replaced", "kinds", "text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_archives(spark, folder))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier, op2_minhash_near_dedup, op3_nearest_neighbours, op4_source_mixing, op5_chat_formatting,
        op6_packed_tokens, op7_decontamination, op8_pii_pseudonyms, op9_language_id, op10_substring_dedup, op11_warc,
        op12_importance_resampling, op13_centroid_clustering, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": OP5,
        "op7_decontamination": OP7,
        "op11_warc": OP11,
        "op12_importance_resampling": OP12,
        "op13_centroid_clustering": OP13,
    }


OP5 = r"""
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS (
    SELECT conv_id, place,
        string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2), '') OVER w AS said,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), whole AS (
    SELECT said, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE place = n GROUP BY said, n
), kept AS (
    SELECT conv_id, n AS n_turns, n_copies FROM whole
    WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.n AND p.place = whole.n AND p.said = whole.said)
), parts AS (
    SELECT conv_id, n_turns, n_copies, place, role, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
        coalesce(text, '') AS body, '<|im_end|>' || chr(10) AS tail
    FROM kept JOIN turns USING (conv_id)
), ended AS (
    SELECT *, sum(length(head || body || tail)) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) - length(tail) AS stop
    FROM parts
)
SELECT conv_id, n_turns::INTEGER AS n_turns, n_copies, string_agg(head || body || tail, '' ORDER BY place) AS text,
    coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ' ' ORDER BY place) FILTER (role = 'assistant'), '') AS loss_spans
FROM ended GROUP BY conv_id, n_turns, n_copies
"""

_SHINGLES = r"""
    SELECT {id}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})
    WHERE len(w) > 0
"""

OP7 = f"""
WITH d AS (SELECT DISTINCT doc_id, shingle FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
i AS (SELECT DISTINCT item_id, shingle FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*)::INTEGER AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*)::INTEGER AS n_shared FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM s JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

OP11 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), t AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS target FROM p
), r AS (
    SELECT *, target IS NOT NULL AND (page_id IS NULL OR target <> page_id) AS again FROM t
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN target END AS refers_to
FROM r
"""

# The CRC of a word, bit by bit: eight shifts for each byte of its UTF-8 form.
OP12 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
names AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
        lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT) % 10000 AS bucket FROM names
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (word) GROUP BY bucket),
gain AS (
    SELECT k.bucket, floor(1000 * ln(
        (coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
        / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
    FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (SELECT r, sum(gain) AS total FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (
    SELECT doc_id, len(w)::BIGINT AS n_features,
        CASE WHEN len(w) = 0 THEN 0 ELSE ((total - ((total % len(w)) + len(w)) % len(w)) // len(w))::BIGINT END AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM d LEFT JOIN sums USING (r)
), scored AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS able
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * able) // 100 THEN place END AS rank FROM ranked
"""


def _op13() -> str:
    """The rounds written out, one after the other."""
    steps = [
        """e AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
)""",
        """c0 AS (
    SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v FROM (
        SELECT v, sha256('1:' || vec_id) AS h FROM e ORDER BY h NULLS LAST, v LIMIT 16)
)""",
    ]
    for i in range(4):
        steps.append(
            f"""a{i} AS (
    SELECT r, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))::BIGINT, c := c.cluster)) AS best
    FROM e, c{i} c GROUP BY r
)"""
        )
        if i < 3:
            steps.append(
                f"""m{i} AS (
    SELECT cluster, list(x ORDER BY place) AS v FROM (
        SELECT best.c AS cluster, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
        FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS place FROM a{i} JOIN e USING (r)) GROUP BY best.c, place)
    GROUP BY cluster
), c{i + 1} AS (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN e USING (r) JOIN c3 ON c3.cluster = best.c
"""


OP13 = _op13()
