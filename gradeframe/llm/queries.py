"""The registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import (
    collocations,
    decontamination,
    language_id,
    lm_scoring,
    nearest,
    packing,
    passages,
    prefix_trie,
    repeats,
    secrets,
    simhash,
    token_counts,
    toxicity,
)
from gradeframe.session import share_code


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _id_remainder(n: int):
    """crc32 of the id as text, by which rows are held out; null ids are not held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, categories = toxicity.document_labels(_table(spark, sf_dir, "labels"))
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), labels, categories)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, learn="pmod(crc32(cast(cast(doc_id AS string) AS binary)), 10) != 0")
    held_out = F.coalesce(_id_remainder(10) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, learn="pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) != 2")
    held_out = F.coalesce(_id_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digest(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(lists))


OP9_SQL = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pattern AS (
    SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM pattern),
spot AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, n, item_id FROM spot JOIN pattern USING (n, words)),
marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = r"""
WITH piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), gram AS (
    SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS a
    FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (VALUES (1), (2), (3)) size(k) WHERE len(w) >= k)
    GROUP BY ALL
), total AS (SELECT lang, sum(a)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, g, a FROM gram WHERE k > 1 AND a >= 10),
cut AS (
    SELECT c.lang, c.g, c.a, x.k, l.a AS l, r.a AS r,
        (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM candidate c, (VALUES (1), (2)) x(k), gram l, gram r
    WHERE x.k < len(c.g) AND l.lang = c.lang AND r.lang = c.lang AND l.g = c.g[:x.k] AND r.g = c.g[x.k + 1:]
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
    SELECT lang, part, max(a) AS a FROM (
        SELECT lang, unnest([g[1:2], g[2:3]]) AS part, a FROM candidate WHERE len(g) = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (
    SELECT b.lang, array_to_string(g, ' ') AS phrase, b.a, l, r, n, score
    FROM best b JOIN total USING (lang) LEFT JOIN longer ON longer.lang = b.lang AND longer.part = b.g
    WHERE longer.a IS NULL OR 100 * longer.a < 50 * b.a
) QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), least AS (SELECT words, min(doc_id) AS first FROM spot GROUP BY words HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM spot JOIN least USING (words) WHERE doc_id > first
), kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

# CRC-32 is 8 shifts a byte, here as a fold over bits inside a fold over bytes
OP13_SQL = r"""
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
        ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), code AS (
    SELECT conv_id, t, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
        4294967295) % 6 AS h FROM own
), built AS (
    SELECT c.conv_id, coalesce(b.t[:c.h], []) || c.t[c.h + 1:] AS t
    FROM code c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), member AS (SELECT conv_id, t, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth FROM built),
node AS (
    SELECT depth, t[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
    FROM member GROUP BY depth, t[:depth]
), child AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
own_sum AS (
    SELECT node.*, coalesce(child.n, 0) AS n_children,
        (n_convs - 1) * CASE WHEN depth > 0 THEN length(node.path[depth].text) ELSE 0 END AS saved
    FROM node LEFT JOIN child USING (path)
), subtree AS (
    SELECT path[:d] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_sum) GROUP BY 1
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own_sum o JOIN subtree s USING (path) LEFT JOIN node p ON o.depth > 0 AND p.path = o.path[:o.depth - 1]
"""


def _shared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {
        "op1_token_counts": op1_token_counts,
        "op2_secrets": op2_secrets,
        "op3_toxicity": op3_toxicity,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_nearest": op5_nearest,
        "op6_simhash": op6_simhash,
        "op7_repeats": op7_repeats,
        "op8_language_id": op8_language_id,
        "op9_decontamination": op9_decontamination,
        "op10_packing": op10_packing,
        "op11_collocations": op11_collocations,
        "op12_passages": op12_passages,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _shared(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_decontamination": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op12_passages": OP12_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
