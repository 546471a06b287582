"""The corpus operators over the given tables, with their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.llm.byte_bpe import CHUNK_BYTES, decoded, encode, read_ranks
from txrisk.llm.conversation_repair import repair_conversations
from txrisk.llm.cover_tree import near_vectors
from txrisk.llm.exact_dedup import exact_dedup
from txrisk.llm.language import fit_language_model, predict_language
from txrisk.llm.license_scan import license_scan
from txrisk.llm.mixing import mix
from txrisk.llm.periodic_runs import periodic_runs, strongest
from txrisk.llm.quality import fit_classifier, quality_scores
from txrisk.llm.sharding import shard_by_bytes
from txrisk.llm.simhash import simhash_groups
from txrisk.llm.substring_dedup import remove_repeats
from txrisk.llm.word_bpe import WordTokenizer, decode_words, encode_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op1(spark, d):
    return exact_dedup(documents(spark, d), keep="largest")


@query("op2_license_scan")
def op2(spark, d):
    return license_scan(documents(spark, d)).drop("spans")


@query("op3_mixing")
def op3(spark, d):
    docs = documents(spark, d)
    mixed, plan = mix(docs, F.array("source"))
    quotas = spark.createDataFrame(plan.sources, "__q_source string, __q_size long, __q_target double")   # one row per source
    mixed = mixed.select("doc_id", "source", "mix_size", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
    return mixed.join(quotas, mixed["source"].eqNullSafe(quotas["__q_source"])).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("__q_size").alias("source_size"), F.col("__q_target").alias("target"), "taken")


def token_digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encode with the multilingual byte-level ranks, decode, and give the digests of both."""
    import public_tokenizers
    ranks = read_ranks(docs.sparkSession, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = F.col("ids")
    return encode(docs, ranks, public_tokenizers.PATTERN, chunk_bytes=chunk_bytes).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, ranks), 256).alias("decoded_sha256"))


@query("op4_byte_bpe")
def op4(spark, d):
    return token_digests(documents(spark, d))


@query("op5_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM r, range(13) t(k)),
kept AS (SELECT p.doc_id, count(*) AS n_words, count(gone.at) AS n_removed, string_agg(word, ' ' ORDER BY p.at) FILTER (gone.at IS NULL) AS kept
         FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w) p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.at = gone.at GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""")
def op5(spark, d):
    return remove_repeats(documents(spark, d), with_text=False)


@query("op6_language_id")
def op6(spark, d):
    docs = documents(spark, d)
    return predict_language(docs, fit_language_model(docs))


@query("op7_cover_tree", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op7(spark, d):
    return near_vectors(spark.read.parquet(f"{d}/embeddings.parquet"), threshold=0.9)


def scored_documents(docs: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Hosts are sources; the sections of a host are its languages."""
    model = fit_classifier(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return quality_scores(docs, model, F.col("source"), F.col("lang"))


@query("op8_quality_classifier")
def op8(spark, d):
    return scored_documents(documents(spark, d), spark, d)


@query("op9_sharding")
def op9(spark, d):
    return shard_by_bytes(documents(spark, d), shards=40)


@query("op10_simhash")
def op10(spark, d):
    return simhash_groups(documents(spark, d), radius=4)


def with_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a checksum of their ids, get a tail of words that repeats with a period; a row without an id stays as it is."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("__words")
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    planted = F.array_join(F.transform("__words", lambda w, i: F.when(i < a, w).otherwise(F.get("__words", a + F.pmod(i - a, p)))), " ")
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__words"))
    return docs.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, d):
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    found = periodic_runs(with_repeats(documents(spark, d))).withColumn("__top", strongest("runs"))
    top = F.col("__top")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * __top.length div __top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by a checksum of conversation and turn: rows lost, emptied, cut short, repeated or under the wrong role."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    role, text = filled("role"), filled("text")
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
                       F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.array_repeat(F.lit(1), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)).alias("__copies"))
    return rows.withColumn("__copies", F.explode("__copies")).drop("__copies")


@query("op12_conversation_repair")
def op12(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return repair_conversations(damaged(rows), every=rows)


@query("op13_word_bpe")
def op13(spark, d):
    import public_tokenizers
    tokenizer = WordTokenizer.read(public_tokenizers.path("word_bpe_49k.json"))
    ids = F.col("ids")
    return decode_words(encode_words(documents(spark, d), tokenizer), tokenizer).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
