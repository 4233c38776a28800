"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_fusion.llm import (
    angle_negatives,
    block_names,
    chat_format,
    merkle_manifest,
    metric_topk,
    parity_join,
    secret_links,
    sentence_pieces,
    shard_tree,
    template_leaks,
    token_transducer,
    url_sweep,
    word_language,
)
from catalog_fusion.llm.tables import table

SHARDS = 8


def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = shard_tree.balanced_tree(SHARDS)
    rows = shard_tree.shard_rows(table(spark, sf_dir, "documents"), tree, shard_tree.grown(tree))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), model)
    covered = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0), lambda a, n: a + n)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        covered.cast("long").alias("covered_bytes"),
    )


def op3_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Control strings in a text, to be read back.
CONTROL_CHAT = """
SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_CHAT))
    read = chat_format.read_chats(chat_format.format_chats(rows))
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select("conv_id", "turns", "formatted", learnt.alias("learnt")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.linked_spans(table(spark, sf_dir, "documents"))
    base = [i for i, k in enumerate(secret_links.KINDS) if not k.weak]

    def of(kinds: list[int]):
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    return found.select(
        "doc_id",
        *[F.size(of([i])).cast("long").alias(f"n_{secret_links.KINDS[i].name}") for i in base],
        F.sha2(secret_links.span_list(of(base)), 256).alias("base_sha256"),
        secret_links.span_list(F.col("spans")).alias("spans"),
    )


def op6_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = word_language.Training()
    model = word_language.fit_language_field(word_language.sample_labelled(documents.where(~word_language.held_out()), training), training)
    rows = word_language.identify_languages(documents, model)
    return rows.select("doc_id", word_language.held_out().alias("held_out"), "lang_pred", "score")


URL_RULES = """
SELECT * FROM VALUES
('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
('net', '/es/', 'block'), ('net', '/fr/', 'block') AS t(host, path, verdict)
"""


def op9_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_sweep.judge_urls(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(documents["doc_id"].cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace(documents["text"], F.lit("\n"), F.lit(""))).otherwise(documents["text"])
    return merkle_manifest.verified_rows(documents, MANIFEST_FIELDS, changed={"text": text})


def op12_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents"))


def op13_angle_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angle_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


QUERIES = {
    "op1_shard_tree": op1_shard_tree,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_metric_topk": op3_metric_topk,
    "op4_chat_format": op4_chat_format,
    "op5_secret_links": op5_secret_links,
    "op6_token_transducer": op6_token_transducer,
    "op7_template_leaks": op7_template_leaks,
    "op8_word_language": op8_word_language,
    "op9_url_sweep": op9_url_sweep,
    "op10_parity_join": op10_parity_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_block_names": op12_block_names,
    "op13_angle_negatives": op13_angle_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_metric_topk": """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""",
    "op4_chat_format": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), marked AS (
    SELECT *,
        lag(role) OVER w IS DISTINCT FROM role AS opens,
        length(regexp_replace(role, '([<\[]\\*)(/?(?:s>|INST\]|SEP\]))', '\1\\\2', 'g')) AS role_chars,
        length(regexp_replace(text, '([<\[]\\*)(/?(?:s>|INST\]|SEP\]))', '\1\\\2', 'g')) AS text_chars
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(text_chars + CASE WHEN opens THEN role_chars + 9 + 11 ELSE 5 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op9_url_sweep": r"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rests AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
    SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('1' || source, '0') AS tree,
        sha256(concat(
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
            coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
        sha256(concat(
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
            coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) AS bare,
        -- CRC-32 bit by bit; its last bit is that of the inverse.
        list_reduce(
            list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END) AS crc
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n,
        CASE WHEN crc & 1 = 1 THEN bare ELSE leaf END AS other
    FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, spot, n, leaf AS digest FROM placed
    UNION ALL
    SELECT tree, level + 1, spot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot))
    FROM nodes WHERE n > 1 GROUP BY tree, level, spot // 3, n
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, spot, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, spot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot)) FROM tops WHERE n > 1 GROUP BY level, spot // 3, n
), steps AS (
    SELECT p.tree, p.spot, 0 AS part, s.level,
        coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot < p.spot // (3 ** s.level)::BIGINT), '') AS l,
        coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot > p.spot // (3 ** s.level)::BIGINT), '') AS r
    FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.spot // 3 = p.spot // (3 ** (s.level + 1))::BIGINT
    GROUP BY p.tree, p.spot, s.level
    UNION ALL
    SELECT p.tree, p.spot, 1, s.level,
        coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot < r.spot // (3 ** s.level)::BIGINT), ''),
        coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot > r.spot // (3 ** s.level)::BIGINT), '')
    FROM placed p JOIN subroots r ON r.tree = p.tree JOIN tops s ON s.n > 1 AND s.spot // 3 = r.spot // (3 ** (s.level + 1))::BIGINT
    GROUP BY p.tree, p.spot, s.level
), ways AS (
    SELECT tree, spot, string_agg(l || r, '' ORDER BY part, level) AS proof, list({'l': l, 'r': r} ORDER BY part, level) AS way FROM steps GROUP BY tree, spot
), folded AS (
    SELECT doc_id, leaf, r.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(list_concat([{'l': other, 'r': ''}], coalesce(way, [])), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root
    FROM placed p JOIN subroots r ON r.tree = p.tree LEFT JOIN ways w ON w.tree = p.tree AND w.spot = p.spot
)
SELECT *, folded_root = root AS verified FROM folded
""",
    "op12_block_names": r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), ranked AS (
    SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size
    FROM texts WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM ranked
""",
    "op13_angle_negatives": """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
""",
}
