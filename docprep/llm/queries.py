"""Registered queries of the training-data operators: whole tables, production parameters.

Each query is thin: it runs its operator and derives the digest columns of its
contract. The archive, substring and embedding queries have DuckDB SQL. The others have none:
XXH64 and CRC-32 of texts, learned scores, tokenizer ids and dynamic programmes are beyond it or too
slow on whole tables, so ``tests/llm`` holds each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.llm import audit_repair, best_fit, byte_shards, ftrl_langid, id_coding, int8_tiles, lsi_decontam, periodic_runs, phrase_automata, piece_table, pu_toxicity, simhash_bk, warc_index


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_lsi_decontam(spark: SparkSession, sf: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    return lsi_decontam.matches(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op2_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    folder, top = warc_index.archive(pages)
    back = warc_index.read_back(pages, folder, top)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_bk(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_bk.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_phrase_automata(spark: SparkSession, sf: str) -> DataFrame:
    found = phrase_automata.deduplicated(_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_pu_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = pu_toxicity.train(docs, _table(spark, sf, "labels"))
    return pu_toxicity.scores(docs, model).select(
        "doc_id",
        (pu_toxicity.fold(F.col("doc_id")) == pu_toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= pu_toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = byte_shards.assign_shards(byte_shards.sized(_table(spark, sf, "documents")))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_int8_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return int8_tiles.near_duplicates(_table(spark, sf, "embeddings"))


def op8_best_fit(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = _table(spark, sf, "documents") if docs is None else docs
    return best_fit.pack(best_fit.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), crc_only=True))


def op9_ftrl_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = ftrl_langid.train(docs)
    found = ftrl_langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (ftrl_langid.fold(F.col("doc_id")) == ftrl_langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op10_id_coding(spark: SparkSession, sf: str) -> DataFrame:
    folder = id_coding.write_corpus(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    back = id_coding.read_corpus(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_audit_repair(spark: SparkSession, sf: str) -> DataFrame:
    talks = _table(spark, sf, "conversations")
    return audit_repair.repaired(audit_repair.damaged(talks), every=talks)


def op12_piece_table(spark: SparkSession, sf: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_table.encoded(_table(spark, sf, "documents"), model, keep=["doc_id"], decoded_col="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.with_repetition(_table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lsi_decontam,
        op2_warc_index,
        op3_simhash_bk,
        op4_phrase_automata,
        op5_pu_toxicity,
        op6_byte_shards,
        op7_int8_tiles,
        op8_best_fit,
        op9_ftrl_langid,
        op10_id_coding,
        op11_audit_repair,
        op12_piece_table,
        op13_periodic_runs,
    )
}

# payloads, their digests and the record that equal ones refer to, without archives
_ARCHIVE_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d),
r AS (SELECT *, CASE WHEN payload_bytes >= {warc_index.MIN_BYTES} AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

_LATER = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, phrase_automata.WINDOW))
# every window of words as a string, the smallest doc_id it starts in, the words that windows seen earlier cover
_SUBSTRING_SQL = rf"""WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM rows),
windows AS (SELECT r, doc_id, i, concat_ws(' ', word, {_LATER}) AS win, lead(word, {phrase_automata.WINDOW - 1}) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
seen AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM windows WHERE whole),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {phrase_automata.WINDOW})) AS i FROM seen WHERE again),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (r)"""

# cosines of all pairs in double precision, reachability by recursion over the rows
_EMBEDDING_SQL = f"""WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM rows
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {int8_tiles.THRESHOLD}),
reach(r, reached) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.reached),
class AS (SELECT reach.r, min(vec_id) AS c FROM reach JOIN v ON v.r = reach.reached GROUP BY reach.r),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), false) AS kept
FROM rows LEFT JOIN class USING (r) LEFT JOIN degree USING (r)"""

ORACLES: dict[str, str] = {
    "op2_warc_index": _ARCHIVE_SQL,
    "op4_phrase_automata": _SUBSTRING_SQL,
    "op7_int8_tiles": _EMBEDDING_SQL,
}
