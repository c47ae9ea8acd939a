"""The queries op1 to op13: each applies its operator to whole tables and derives the columns that are returned.

ORACLES has DuckDB SQL where SQL can say the same at a bearable cost; the others are tested against brute force.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact, lloyd, middle, packing, quality, rlz, rules, simhash, suffix, toxicity, wavelet
from .common import new_path, read

#: byte_bpe_50k has 50,257 ids.
BYTE_BITS = 16


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def digest(pairs: bpe.BytePairs, batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, shas, backs = [], [], []
        for ids, decoded in zip(batch.column("ids").to_pylist(), batch.column("decoded").to_pylist(), strict=True):
            sizes.append(len(ids) // 4)
            shas.append(hashlib.sha256(pairs.decimals(ids)).hexdigest())
            backs.append(hashlib.sha256(decoded).hexdigest())
        cols = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(read(spark, sf_dir, "documents"), *own, digest, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("rk")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_print("fp0").alias("fingerprint"), "component_id"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup_passages(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    wavelet.write_shards(
        read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), BYTE_BITS
    )
    return wavelet.read_shards(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(middle.rebuilt(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings")).drop("weight")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_byte_bpe,
        op3_toxicity,
        op4_exact_dedup,
        op5_suffix_dedup,
        op6_quality,
        op7_simhash,
        op8_substring_dedup,
        op9_quality_rules,
        op10_token_shards,
        op11_fill_in_middle,
        op12_centroids,
        op13_decontamination,
    )
}

def _lloyd_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Each round as two queries: who is nearest to what, and the floor of the means; empty centroids stay."""

    def nearest(c: str) -> str:
        return f"""SELECT v, k, d FROM (
            SELECT v, k, d, row_number() OVER (PARTITION BY v ORDER BY d, k) AS rn
            FROM (SELECT v, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM q JOIN {c} USING (p) GROUP BY 1, 2)) WHERE rn = 1"""

    def mean(a: str, c: str) -> str:
        low = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        return f"""SELECT k, p, coalesce({low}, c) AS c FROM {c} LEFT JOIN (
            SELECT k, p, sum(x) AS s, count(*) AS n FROM {a} JOIN q USING (v) GROUP BY 1, 2) USING (k, p)"""

    steps = [
        f"""e AS (SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""q AS MATERIALIZED (SELECT v, p, CAST(floor({scale} * embedding[p]::DOUBLE) AS BIGINT) AS x FROM (
            SELECT v, embedding, unnest(range(1, {dim} + 1)) AS p FROM e))""",
        f"""c0 AS MATERIALIZED (SELECT k, p, x AS c FROM q JOIN (
            SELECT v, row_number() OVER (ORDER BY h) - 1 AS k FROM (
                SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM e) QUALIFY k < {k}) USING (v))""",
    ]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})", f"c{r + 1} AS MATERIALIZED ({mean(f'a{r}', f'c{r}')})"]
    steps += [
        f"a AS MATERIALIZED ({nearest(f'c{rounds}')})",
        f"s AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)",
    ]
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a JOIN e USING (v) JOIN s USING (k)"""


_ITEM_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH u AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                   sha256('1:' || CAST(doc_id AS VARCHAR)) AS d
            FROM documents),
        h AS (
            SELECT *, len(w) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
                   CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
            FROM u),
        f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h),
        c AS (
            SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(w[1:a], '') END AS pre,
                   CASE WHEN b = a THEN '' ELSE array_to_string(w[a + 1:b], '') END AS mid,
                   CASE WHEN b = n THEN '' ELSE array_to_string(w[b + 1:n], '') END AS suf
            FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c
    """,
    "op12_centroids": _lloyd_sql(),
    "op13_decontamination": f"""
        WITH i AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        v AS (
            SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
        d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        s AS (
            SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS g
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
                  FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)),
        o AS (SELECT DISTINCT doc_id, k, size, item_id FROM s JOIN v USING (size, g)),
        p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS j FROM o) GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        g AS (
            SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        f AS (SELECT h, min(doc_id) AS first_id FROM g GROUP BY h HAVING count(*) > 1),
        s AS (SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE g.doc_id > f.first_id),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM s)),
        r AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        k AS (
            SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS n_gone,
                   CASE WHEN ps IS NULL THEN w
                        ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p))), lambda p: w[p])
                   END AS kept
            FROM d LEFT JOIN r USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
        FROM k
    """,
}
