"""The registered queries opN_<name>: thin views that turn operator results into the columns asked for."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, hpylm, licenses, media, packing, rollups, simhash_dedup, substring_dedup, toxicity
from .common import shared_dir, stored


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; they come with the Python environment, thus are on every machine."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _media(n_bytes: int, data: bytes, declared: str):
    payload = media.read_wav(data)
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), media.features(data, declared)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.stored_texts(table(spark, sf_dir, "documents"), _media, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def remainder(doc_id, n: int):
    """crc32 of the id as text (a null id: empty), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, cuts = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    found = toxicity.score_table(docs, net, cuts)
    return found.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("toxic").alias("toxic_by_language"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), k=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document comes, counted by one vocabulary, English ones are counted anew by another (sent twice), and those without tokens of the first go."""
    one, two = "word_bpe_49k", "byte_bpe_50k"
    docs = table(spark, sf_dir, "documents")
    english = F.col("lang").eqNullSafe("en")
    counts = stored(rollups.count_tokens(docs, {one: (vocabulary(f"{one}.json"), None), two: (vocabulary(f"{two}.json"), english)}), "counts")
    kept = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    kept.commit("001-ingest", rollups.events(counts, one, F.col(one), +1))
    recount = rollups.revised(counts.where(english), (one, F.col(one)), (two, F.col(two)))
    kept.commit("002-recount", recount)
    kept.compact()
    kept.commit("002-recount", recount)
    empty = counts.where(F.col(one) == 0)
    kept.commit("003-empty", rollups.events(empty.where(english), two, F.col(two), -1).unionByName(rollups.events(empty.where(~english), one, F.col(one), -1)))
    return kept.totals()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the token capacity binds: as many documents as tokens, and the cost of one document that fills a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("fill")


def _digests(ids: list, path: str) -> list[pa.Array]:
    """Digests of encoded texts and of what they decode to."""
    numbers = bpe.byte_table(path).numbers
    ids_sha, text_sha = [], []
    for x in ids:
        x = x.tolist()
        ids_sha.append(hashlib.sha256(b",".join(map(numbers.__getitem__, x))).hexdigest())
        text_sha.append(hashlib.sha256(bpe.decode(path, x).encode()).hexdigest())
    return [pa.array(map(len, ids), pa.int64()), pa.array(ids_sha), pa.array(text_sha)]


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than bpe.LEAF characters are trees of leaves; shorter ones, most of them, are one leaf, which the unit encoder encodes without a join."""
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bpe.encode_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), _digests, schema).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_hpylm": op2_hpylm, "op3_token_rollups": op3_token_rollups, "op4_packing": op4_packing, "op5_media": op5_media, "op6_licenses": op6_licenses, "op7_toxicity": op7_toxicity, "op8_simhash": op8_simhash, "op9_substring": op9_substring, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_substring": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            x AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
            f AS (SELECT g, min(struct_pack(d := doc_id, s := s)) AS lead FROM x GROUP BY g HAVING count(*) > 1),
            r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM x JOIN f USING (g) WHERE struct_pack(d := doc_id, s := s) > lead),
            l AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM r GROUP BY 1)
            SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
                   sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
            FROM w LEFT JOIN l ON l.doc_id = w.doc_id
        """,
        "op1_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)
        """,
    }
