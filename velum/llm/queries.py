"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.collocations import collocations
from velum.llm.decontaminate import mark_contaminated
from velum.llm.exact_dedup import exact_dedup
from velum.llm.hard_negatives import hard_negatives
from velum.llm.main_text import main_text
from velum.llm.mixing import mixed_sizes
from velum.llm.near_dedup import near_duplicates
from velum.llm.repeated_windows import dedup_windows
from velum.llm.sharding import extendible_shards
from velum.llm.suffix_dedup import dedup_substrings
from velum.llm.token_files import token_files
from velum.llm.toxicity import toxicity
from velum.llm.url_templates import Rule, filter_urls

SHARD_BYTES = 64 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return mark_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op3_near_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def op4_url_templates(spark, sf_dir):
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_files(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files(_table(spark, sf_dir, "documents"), str(path), end_id=2)


def op6_suffix_dedup(spark, sf_dir):
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixed_sizes(_table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    sharded = extendible_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return sharded.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "shard",
        "shard_bytes",
        "shard_rows",
    )


def op10_repeated_windows(spark, sf_dir):
    return dedup_windows(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    def relabel(vec_id, label):
        return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)

    return hard_negatives(_table(spark, sf_dir, "embeddings"), relabel=relabel)


def op12_main_text(spark, sf_dir):
    return main_text(_table(spark, sf_dir, "pages"))


def op13_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_templates": op4_url_templates,
    "op5_token_files": op5_token_files,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_repeated_windows": op10_repeated_windows,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_main_text": op12_main_text,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_sharding": f"""
        WITH hashed AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
            FROM documents),
        placed AS (SELECT *, h >> (60 - depth) AS prefix FROM hashed, range(0, 61) r(depth)),
        nodes AS (
            SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
            FROM placed GROUP BY ALL),
        fitting AS (
            SELECT p.*, n.shard_bytes, n.shard_rows,
                row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS place
            FROM placed p JOIN nodes n USING (depth, prefix)
            WHERE n.shard_bytes <= {SHARD_BYTES} OR n.shard_rows <= 1)
        SELECT doc_id, n_bytes,
            CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard,
            CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
        FROM fitting WHERE place = 1""",
    "op10_repeated_windows": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM texts),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM places),
        least AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
        hits AS (SELECT doc_id, i FROM windows JOIN least USING (g) WHERE d < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(0, 13) AS r(k)),
        words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
        kept AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
            CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": r"""
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS MATERIALIZED (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score,
                row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
            FROM scores WHERE same),
        ranked AS (
            SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                CAST(row_number() OVER (
                    PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
            FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id
            WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score
                AND 100 * score <= 90 * positive_score)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
        grams AS (
            SELECT lang, 1 AS k, ws[i] AS phrase FROM places
            UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM places WHERE i + 1 <= len(ws)
            UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM places WHERE i + 2 <= len(ws)),
        f AS MATERIALIZED (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING f >= 10 OR k = 1),
        sizes AS MATERIALIZED (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        cuts AS MATERIALIZED (
            SELECT lang, k, phrase, f AS a, 1 AS cut, split_part(phrase, ' ', 1) AS x,
                substr(phrase, strpos(phrase, ' ') + 1) AS y
            FROM f WHERE k > 1
            UNION ALL
            SELECT lang, k, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2),
                split_part(phrase, ' ', 3)
            FROM f WHERE k = 3),
        lefts AS MATERIALIZED (
            SELECT c.*, g.f AS l FROM cuts c JOIN f g ON g.lang = c.lang AND g.phrase = c.x),
        halves AS MATERIALIZED (
            SELECT c.*, g.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * g.f) AS BIGINT) AS score
            FROM lefts c JOIN f g ON g.lang = c.lang AND g.phrase = c.y),
        scored AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM halves),
        longer AS MATERIALIZED (
            SELECT lang, part, max(a) AS longer
            FROM (
                SELECT lang, a, x AS part FROM cuts WHERE k = 3 AND cut = 2
                UNION ALL SELECT lang, a, y FROM cuts WHERE k = 3 AND cut = 1)
            GROUP BY ALL),
        free AS (
            SELECT s.* FROM scored s LEFT JOIN longer p ON p.lang = s.lang AND p.part = s.phrase
            WHERE place = 1 AND (p.longer IS NULL OR 100 * p.longer < 50 * s.a)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
}
