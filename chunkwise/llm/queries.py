"""Registered queries of the llm operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.llm import centroids, decontaminate, fingerprints, html_text, langid, licenses, line_dedup, minhash_dedup, packing, periodic_runs, quality, secrets, token_files
from chunkwise.llm.storage import new_folder
from chunkwise.llm.tokens import default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_FILE_TOKENIZER, TOKEN_FILE_END = "word_bpe_49k.json", 1
PACK_TOKENIZER, PACK_END = "byte_bpe_50k.json", 2


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "tokens")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_files.write_token_files(docs, folder, default_path(TOKEN_FILE_TOKENIZER), TOKEN_FILE_END, shards)
    return token_files.read_token_files(spark, folder).withColumnRenamed("id", "doc_id")


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path(PACK_TOKENIZER), PACK_END)


@_query
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of all documents: doc_id, class_id, copy_of."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontaminate.contained_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that stand in an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed_col="lines_removed")


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, by models of the rows that may train."""
    docs = table(spark, sf_dir, "documents")
    train = langid.training_rows(docs)
    models = langid.fit_languages(docs.where(train))
    out = langid.predict_languages(docs, models)
    return out.select("doc_id", F.coalesce(~langid.training_rows(out), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, model)


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents with the base digest."""
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@_query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    rows = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    first = lambda col, n: F.substring(col, F.lit(1), n)
    edited = F.concat(first(F.col("text"), F.col("head")), first(F.col("next_text"), F.col("tail")))
    rows = rows.select(
        "*", *[fingerprints.key_hashes(F.col(c)).alias(f"{c}_set") for c in ("keys", "next_keys", "edited_keys")]
    )
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.key_text(F.col("keys")).alias("fingerprint"), fingerprints.key_text(F.col("edited_keys")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("keys_set"), F.col("edited_keys_set")).alias("near_edited"),
        fingerprints.likeness(F.col("keys_set"), F.col("next_keys_set")).alias("near_next"),
    )


CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIMS, CLUSTER_SEED = 40, 5, 64, "2"


@_query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    assigned, final = centroids.cluster_vectors(vectors, dims=CLUSTER_DIMS, k=CLUSTERS, rounds=CLUSTER_ROUNDS, seed=CLUSTER_SEED)
    return centroids.with_inertia(assigned, final).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql_clusters() -> str:
    """The clustering over all pairs, a chain of tables per round."""
    square = "CAST(list_dot_product({0}, {0}) AS BIGINT)"
    near = (
        "SELECT k.rid, k.vec_id, k.v, arg_min(c.c, {{'d': {d}, 'c': c.c}}) AS c, min({d}) AS d FROM kept k, {means} c GROUP BY ALL"
    )
    d = f"({square.format('k.v')} + {square.format('c.v')} - 2 * CAST(list_dot_product(k.v, c.v) AS BIGINT))"
    tables = {
        "kept": f"""SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE len(embedding) = {CLUSTER_DIMS} AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')""",
        "m0": f"""SELECT row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS}""",
    }
    for i in range(CLUSTER_ROUNDS + 1):
        tables[f"a{i}"] = near.format(d=d, means=f"m{i}")
        if i < CLUSTER_ROUNDS:
            tables[f"s{i}"] = f"""SELECT c, j, CAST(floor((s - (((s % n) + n) % n)) // n) AS DOUBLE) AS x FROM (
                SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {CLUSTER_DIMS + 1}) t(j) GROUP BY c, j)"""
            tables[f"m{i + 1}"] = f"""SELECT m.c, coalesce(t.v, m.v) AS v FROM m{i} m
                LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM s{i} GROUP BY c) t USING (c)"""
    last = CLUSTER_ROUNDS
    ctes = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in tables.items())
    return f"""WITH {ctes} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
        CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(list_aggregate(list_transform(m.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
        FROM a{last} a JOIN m{last} m USING (c)"""


ORACLES["op12_centroid_clusters"] = _sql_clusters()


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which get repeats first."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs.find_runs(docs.select("doc_id", periodic_runs.with_repeats(F.col("text"), number).alias("text")))
    return periodic_runs.run_digest(found)
