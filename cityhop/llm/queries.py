"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityhop.llm.chat import expand, read_back
from cityhop.llm.exact_stream import exact_duplicates
from cityhop.llm.fingerprint import with_next
from cityhop.llm.importance import resample
from cityhop.llm.line_dedup import dedup_lines
from cityhop.llm.mixing import mix
from cityhop.llm.near_dedup import near_duplicates
from cityhop.llm.packing import pack
from cityhop.llm.pii import pseudonymise
from cityhop.llm.scratch import importable
from cityhop.llm.toxicity import fit, held_out, score
from cityhop.llm.trie import numbered_turns, prefix_trie, rebuilt
from cityhop.llm.url_filter import filter_urls
from cityhop.llm.warc import round_trip

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(_table(spark, sf_dir, "documents"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select cast(-7 as bigint) conv_id, cast(t as bigint) turn, if(t = 0, 'user', 'assistant') role from (select explode(array(0, 1)) t)")
    return read_back(expand(turns.unionByName(own.withColumn("text", F.lit(said)))))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with pseudonyms; in production the key is a secret of the caller's."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key=b"a fixed key, so that reruns agree")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.withColumn("removed", F.array_join("removed", ","))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = numbered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie(rebuilt(turns, source=conv - conv % 5, head=F.crc32(conv.cast("string")) % 9))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_source_mixing": op2_source_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_fingerprints": op7_fingerprints,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}
#: CRC-32 of a string's UTF-8 bytes, over the table of all byte values.
_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
                       lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)),
              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""
SQL: dict[str, str] = {
    "op13_warc": """
        SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS payload_digest,
               CASE WHEN strlen(p) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(p) >= 1000 AND page_id < top THEN top END AS refers_to
        FROM (SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS top FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
    """,
    "op12_prefix_trie": r"""
        WITH crc AS MATERIALIZED (""" + _CRC_TABLE + r"""), o AS MATERIALIZED (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
        ), c AS MATERIALIZED (
            SELECT conv_id, conv_id - conv_id % 5 AS source, """ + _CRC.format("id") + r""" % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS id FROM conversations), crc
        ), a AS MATERIALIZED (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, text, sha256(strlen(role) || ':' || role || text) AS said
            FROM (SELECT c.conv_id, false AS own, k, role, text FROM c JOIN o ON o.conv_id = source WHERE k <= h
                  UNION ALL SELECT c.conv_id, true, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE k > h)
        ), p AS MATERIALIZED (
            SELECT conv_id, depth, octet_length(encode(text)) AS n_bytes, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM a
            UNION ALL SELECT conv_id, 0, 0, '' FROM c
        ), m AS MATERIALIZED (
            SELECT conv_id, depth, node, n_bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p
        ), n AS MATERIALIZED (
            SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM m GROUP BY node, depth, parent
        ), f AS MATERIALIZED (
            SELECT parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent
        ), t AS (
            SELECT m.node, count(*) FILTER (f.node IS NULL) AS n_leaves, sum((n_convs - 1) * n.n_bytes) AS saved_tokens
            FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN f ON f.node = n.node GROUP BY m.node
        )
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN t ON t.node = n.node LEFT JOIN f ON f.node = n.node LEFT JOIN n u ON u.node = n.parent
    """,
    "op11_importance_resampling": r"""
        WITH crc AS MATERIALIZED (""" + _CRC_TABLE + r"""), corpora AS (
            SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark
        ), w AS MATERIALIZED (
            SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM corpora
        ), f AS MATERIALIZED (
            SELECT doc_id, own, unnest(w) AS f FROM w
        ), b AS MATERIALIZED (
            SELECT f, """ + _CRC.format("f") + r""" % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc
        ), h AS MATERIALIZED (
            SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (f) GROUP BY bucket
        ), g AS MATERIALIZED (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
            FROM h, (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM h)
        ), m AS (
            SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE own GROUP BY doc_id
        ), d AS MATERIALIZED (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM w LEFT JOIN m USING (doc_id) WHERE own
        ), r AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM d LEFT JOIN r USING (doc_id)
    """,
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS MATERIALIZED (
            SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
        ), e AS MATERIALIZED (
            SELECT x, y FROM l UNION SELECT y, x FROM l
        ), r(x, y) AS (
            SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
        ), m AS (
            SELECT x, min(y) AS low FROM r GROUP BY x
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
    """,
    "op10_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
        ), lines AS MATERIALIZED (
            SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(
                       translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS ws
            FROM (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM split)
        ), ordered AS MATERIALIZED (
            SELECT doc_id, k, ws, len(ws) AS n, row_number() OVER (ORDER BY doc_id, k) AS o,
                   row_number() OVER (PARTITION BY ws ORDER BY doc_id, k) AS nth
            FROM lines WHERE len(ws) > 0
        ), f AS MATERIALIZED (
            SELECT o, n, ws FROM ordered WHERE nth = 1
        ), t AS (
            SELECT o, n, unnest(ws) AS w FROM f
        ), r AS MATERIALIZED (
            SELECT o, n, w FROM (SELECT o, n, t.w, row_number() OVER (PARTITION BY o ORDER BY df, t.w) AS place
                                 FROM t JOIN (SELECT w, count(*) AS df FROM t GROUP BY w) c ON c.w = t.w)
            WHERE place <= n - (80 * n + 99) // 100 + 1
        ), c AS MATERIALIZED (
            SELECT DISTINCT a.o AS later, b.o AS earlier FROM r a JOIN r b ON a.w = b.w AND b.o < a.o
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        ), v AS (
            SELECT later, x.n + y.n AS total, len(list_intersect(x.ws, y.ws)) AS i FROM c JOIN f x ON x.o = later JOIN f y ON y.o = earlier
        ), gone AS MATERIALIZED (
            SELECT doc_id, list(k ORDER BY k) AS ks FROM ordered
            WHERE nth > 1 OR o IN (SELECT later FROM v WHERE 100 * i >= 80 * (total - i)) GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN ks IS NULL THEN d.text ELSE coalesce(array_to_string([ls[k + 1] FOR k IN range(len(ls)) IF NOT list_contains(ks, k)], chr(10)), '') END AS text,
               CAST(coalesce(len(ls), 1) AS INTEGER) AS n_lines, coalesce(array_to_string(ks, ','), '') AS removed
        FROM documents d JOIN split s ON s.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                   length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
                     || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10)) AS chars
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), p AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id
    """,
}
