"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import dedup, fingerprint, licenses, mixing, neardup, packing, quality, resampling, simhash, tokens, toxicity, tries, warc
from quillon.llm.common import cut, remove
from quillon.session import on_workers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), least=0.3)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return out.drop("next_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def byte_tokenizer() -> tuple[str, str, str]:
    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_tokenizer())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), least=0.5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    read = cut(warc.read_archives(warc.archive(pages, folder), folder, with_payload=False))
    remove(spark, folder)  # what is left to tell is in the records that were read
    return read.select(
        F.col("id").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"), F.col("place").alias("history_place"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=25, seed=7, longest=2, buckets=10_000, least_words=20)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"), family=5, heads=9)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def _registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _registered(f)
    for f in (
        op1_quality, op2_exact_dedup, op3_mix_sources, op4_fingerprints, op5_token_counts, op6_pack_sequences, op7_near_dedup,
        op8_license_scan, op9_toxicity, op10_warc, op11_resample, op12_prefix_trie, op13_simhash,
    )
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH base AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM base WINDOW w AS (PARTITION BY t)
    """,
    "op3_mix_sources": r"""
        WITH slim AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars,
                   len(regexp_extract_all(coalesce(text, ''), '[0-9#$%&*<>{}|=_@~^+]')) AS symbols FROM documents),
        weighed AS (
            SELECT *, CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 4.0 AND 13.0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS words,
                   1.0::DOUBLE - least(1.0::DOUBLE, symbols * 4.0::DOUBLE / greatest(chars, 1)) AS clean FROM slim),
        keyed AS (
            SELECT doc_id, source, size,
                   -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
                   / greatest(0.015625::DOUBLE, words * (clean * clean)) AS e
            FROM weighed),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM slim GROUP BY source),
        caps AS (SELECT *, (i % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM sums),
        levels AS (
            SELECT *, ((SELECT sum(source_size)::DOUBLE FROM sums)
                       - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                      / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM caps),
        common AS (SELECT arg_min(lv, {'r': cap / w, 'i': i}) AS lv FROM levels WHERE lv * w <= cap),
        plan AS (SELECT source, source_size, least(cap, coalesce((SELECT lv FROM common) * w, cap)) AS target FROM caps),
        epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS ep FROM plan),
        keys AS (
            SELECT k.*, p.source_size, p.target, p.ep, p.target - p.ep * p.source_size AS g0
            FROM keyed k JOIN epochs p ON k.source IS NOT DISTINCT FROM p.source),
        u0 AS (SELECT *, sum(CASE WHEN size <= g0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY e, doc_id, size) AS upto FROM keys),
        t0 AS (SELECT *, size <= g0 AND upto <= g0 AS in0 FROM u0),
        v0 AS (SELECT *, g0 - sum(CASE WHEN in0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS g1 FROM t0),
        u1 AS (SELECT * EXCLUDE (upto), sum(CASE WHEN NOT in0 AND size <= g1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY e, doc_id, size) AS upto FROM v0),
        t1 AS (SELECT *, in0 OR (size <= g1 AND upto <= g1) AS in1 FROM u1),
        v1 AS (SELECT *, g1 - sum(CASE WHEN in1 AND NOT in0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS g2 FROM t1),
        u2 AS (SELECT * EXCLUDE (upto), sum(CASE WHEN NOT in1 AND size <= g2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY e, doc_id, size) AS upto FROM v1),
        t2 AS (SELECT *, in1 OR (size <= g2 AND upto <= g2) AS in2 FROM u2),
        v2 AS (SELECT *, g2 - sum(CASE WHEN in2 AND NOT in1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM t2),
        last AS (
            SELECT source, arg_min(doc_id, {'off': abs(gap - size), 'e': e, 'id': doc_id}) AS last_id
            FROM v2 WHERE NOT in2 AND size > 0 AND abs(gap - size) < gap GROUP BY source)
        SELECT c.doc_id, c.size, c.source_size, c.target,
               CAST(c.size * (c.ep + CASE WHEN c.in2 OR (l.last_id IS NOT NULL AND c.doc_id = l.last_id) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM v2 c LEFT JOIN last l ON c.source IS NOT DISTINCT FROM l.source
    """,
    "op10_warc": r"""
        WITH base AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d, sha256(coalesce(html, '')) AS h, lower(trim(coalesce(url, ''))) AS u FROM pages),
        best AS (SELECT h, max(page_id) AS keep FROM base WHERE n >= 1000 GROUP BY h),
        keyed AS (
            SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1), '^www[0-9]*[.]', ''), '.')), ',')
                   || ')' || CASE regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) END
                   || CASE regexp_extract(u, '[?]([^#]*)', 1) WHEN '' THEN '' ELSE '?' || regexp_extract(u, '[?]([^#]*)', 1) END AS url_key FROM base),
        history AS (SELECT page_id, row_number() OVER (PARTITION BY url_key ORDER BY CAST(page_id AS VARCHAR)) AS history_place FROM keyed)
        SELECT b.page_id, CAST(b.n AS BIGINT) AS payload_bytes, b.d AS payload_digest,
               CASE WHEN k.keep IS NULL OR k.keep = b.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN k.keep <> b.page_id THEN k.keep END AS refers_to, h.history_place
        FROM base b LEFT JOIN best k ON b.n >= 1000 AND b.h = k.h JOIN history h ON h.page_id = b.page_id
    """,
    "op11_resample": r"""
        WITH RECURSIVE texts AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        cut AS (
            SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        grams AS (
            SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM cut),
        kinds AS (SELECT DISTINCT g, hex(encode(g)) AS x FROM grams),
        -- CRC-32 is linear: the xor of what each byte gives at its distance from the end, and of what the length gives
        one AS (
            SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
            FROM (SELECT unnest(range(256)) AS b)),
        far(d, b, v) AS (
            SELECT 0, b, v FROM one
            UNION ALL
            SELECT f.d + 1, f.b, xor(f.v // 256, o.v) FROM far f JOIN one o ON o.b = f.v % 256 WHERE f.d < (SELECT max(strlen(g)) FROM kinds)),
        starts(d, v) AS (
            SELECT 0, 4294967295::BIGINT
            UNION ALL
            SELECT s.d + 1, xor(s.v // 256, o.v) FROM starts s JOIN one o ON o.b = s.v % 256 WHERE s.d < (SELECT max(strlen(g)) FROM kinds)),
        bytes AS (
            SELECT g, len(x) // 2 AS n, i, CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) AS b FROM (SELECT g, x, unnest(range(len(x) // 2)) AS i FROM kinds)),
        sums AS (SELECT g, any_value(n) AS n, bit_xor(f.v) AS v FROM bytes JOIN far f ON f.d = n - 1 - i AND f.b = bytes.b GROUP BY g),
        hashed AS (SELECT g, xor(xor(sums.v, s.v), 4294967295) % 10000 AS bucket FROM sums JOIN starts s ON s.d = n),
        features AS (SELECT kind, id, bucket FROM grams JOIN hashed USING (g)),
        counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features GROUP BY bucket),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts)::DOUBLE + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts)::DOUBLE + 10000)))) AS BIGINT) AS gain
            FROM counts),
        means AS (
            SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
        scored AS (
            SELECT d.id AS doc_id, len(d.w) AS words, coalesce(m.n, 0) AS n_features,
                   coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, 0) AS weight,
                   CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
            FROM cut d LEFT JOIN means m ON d.id = m.id WHERE d.kind = 'd'),
        ranked AS (
            SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) FILTER (words >= 20) OVER () AS total FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
               CASE WHEN able AND r <= 25 * total // 100 THEN r END AS rank
        FROM ranked
    """,
    "op12_prefix_trie": """
        WITH RECURSIVE turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations),
        crc(c, place, left_bits, v) AS (  -- CRC-32 of the decimal, a bit a step; each byte enters with its first bit
            SELECT c, 0, 0, 4294967295::BIGINT FROM (SELECT DISTINCT c FROM turns)
            UNION ALL
            SELECT c, CASE WHEN left_bits = 0 THEN place + 1 ELSE place END, CASE WHEN left_bits = 0 THEN 8 ELSE left_bits - 1 END,
                   CASE WHEN left_bits = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), place + 1, 1))::BIGINT)
                        WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
            FROM crc WHERE left_bits > 0 OR place < length(CAST(c AS VARCHAR))),
        heads AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE left_bits = 0 AND place = length(CAST(c AS VARCHAR))),
        rebuilt AS (
            SELECT h.c, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c - h.c % 5 AND t.pos <= h.h
            UNION ALL
            SELECT h.c, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.pos > h.h),
        deep AS (
            SELECT c, row_number() OVER w AS d, strlen(text) AS bytes, sha256(role) || sha256(text) AS x FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
        paths AS (SELECT c, d, bytes, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM deep
                  UNION ALL SELECT c, 0, 0, '' FROM heads),
        lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
        nodes AS (
            SELECT d, key, min(p.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends
            FROM paths p JOIN lengths l ON p.c = l.c GROUP BY d, key),
        named AS (SELECT n.*, u.key AS up FROM nodes n LEFT JOIN paths u ON u.c = n.conv_id AND u.d = n.d - 1),
        children AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM named WHERE d > 0 GROUP BY 1, 2),
        below AS (  -- each node counts at every prefix of its smallest member's path
            SELECT a.d, a.key, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
            FROM named n LEFT JOIN children k ON k.d = n.d AND k.key = n.key JOIN paths a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.d, a.key)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
               CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
        FROM named n JOIN below b ON b.d = n.d AND b.key = n.key LEFT JOIN children k ON k.d = n.d AND k.key = n.key
        LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.up
    """,
}
