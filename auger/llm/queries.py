"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auger.llm import (alignment, bpe, chat, decontaminate, embeddings, jaccard, langid, licenses, packing, passages,
                       sharding, toxicity, whitening)
from auger.session import write_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark, d):
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grade 0: not toxic; 1: toxic; 2: toxic and of low quality. Rows without a toxic label have none."""
    toxic = F.col("toxic")
    return labels.select("doc_id", F.when(toxic == 0, 0).when((toxic == 1) & (F.coalesce("quality", F.lit(1)) == 0), 2)
                         .when(toxic == 1, 1).alias("grade"))


@query("op2_toxicity")
def toxicity_severity(spark, d):
    """The expected severity of every document, learned from ``labels``."""
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, severity_grades(table(spark, d, "labels")))
    return toxicity.predict(docs.select("doc_id", "text"), model).select("doc_id", "expected_severity", "grade", "toxic")


@query("op3_embedding_dedup", sql="""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null),
u as (
  select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
                    and len(list_filter(e, lambda x: x != 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id != b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select vec_id as id, vec_id as r from embeddings
  union select reach.id, links.b from reach join links on links.a = reach.r)
select e.vec_id, coalesce(n.n, 0) as n_links, min(reach.r) as component_id, e.vec_id = min(reach.r) as kept
from embeddings e join reach on reach.id = e.vec_id
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
group by e.vec_id, n.n
""")
def embedding_dedup(spark, d):
    """All embeddings linked within equal labels at a cosine of 0.93."""
    return embeddings.near_duplicates(table(spark, d, "embeddings"), 0.93)


@query("op4_substring_dedup")
def substring_dedup(spark, d):
    """Passages of at least 50 words of all documents that repeat in a document of a smaller id."""
    return passages.repeated_passages(table(spark, d, "documents")).drop("text_key")


@query("op5_decontaminate")
def decontamination(spark, d):
    """Documents that hold benchmark items, also with other numbers, names and units in them."""
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_key")


CHAT_PROBE = [(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]


@query("op6_chat_format", sql=r"""
with src as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (
  select *, regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'),
                           '#(\\*)## ([A-Za-z0-9_.*%+-]*): ', '#\\\1## \2: ', 'g') as body
  from src)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(body) + 14) as bigint) as formatted_chars,
       count(*) filter (where role = 'assistant') as n_spans, true as round_trip
from t group by conv_id
""")
def chat_format(spark, d):
    """All conversations and the probe conversation, formatted and read back from the formatted text."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(CHAT_PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


@query("op7_language_id")
def language_id(spark, d):
    """The language of every document, learned from the documents outside the held-out quarter."""
    docs = table(spark, d, "documents")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    langs, weights = langid.fit(docs.where(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), langs, weights).select(
        "doc_id", "held_out", "lang_pred", "score")


@query("op8_license_scan", sql=licenses.oracle())
def license_scan(spark, d):
    """The licences that all documents name."""
    return licenses.scan(table(spark, d, "documents").select("doc_id", "text"))


@query("op9_jaccard_join")
def jaccard_join(spark, d):
    """All documents joined on five-word shingle sets at a similarity of 0.8: class, links, kept row."""
    return jaccard.jaccard_join(table(spark, d, "documents")).drop("text_key")


@query("op10_uniform_shards")
def uniform_shards(spark, d):
    """All documents in eight shards whose counts are at most one apart."""
    text = F.col("text")
    rows = table(spark, d, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    return sharding.shard(rows, 8, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op11_bpe_round_trip")
def bpe_round_trip(spark, d):
    """The ids of every whole text, and what they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    ids = bpe.encode(table(spark, d, "documents"), path, packed=True)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark, d):
    """Groups and links of the byte-level and the piece tokenizer in every document."""
    paths = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = (alignment.align(table(spark, d, "documents"), *paths)
               .withColumn("groups_sha256", digest).drop("groups"))
    aligned = write_scratch(aligned, "aligned")
    counts = write_scratch(alignment.pair_counts(aligned), "link-counts")
    return alignment.score_links(aligned, counts)


@query("op13_embedding_whitening")
def embedding_whitening(spark, d):
    """All embeddings whitened on up to eight components, fitted on all of them."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, "embedding").select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained",
        "identity_error")
