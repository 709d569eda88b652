"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, language_id, lexical, mixing, near_dedup, quality, sharding, topk, toxicity, variants, warc
from .common import id_remainder, new_path, table, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit_profiles(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = warc.fresh_base(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), base)
    return warc.read_archives(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn toxicity from: those outside the held-out fifth."""
    return table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, training_labels(spark, sf_dir))
    held = id_remainder(F.col("doc_id"), 5) == 0
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return fingerprints.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), fingerprints.edited_prints(), columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def streamed(rows: DataFrame) -> DataFrame:
    """The log that rows of finished messages may come from: each text arrives as a draft and a delta, as a draft that is edited, or as a draft that is generated anew and streamed in two deltas, by its turn."""
    events = chat.events_of_rows(rows)
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, last = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    step = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    way = F.pmod(F.coalesce(F.col("seq").cast("long"), F.lit(0)), F.lit(3))
    begun = F.array(step("message", first))
    steps = F.when(way == 0, F.concat(begun, F.array(step("delta", last)))).when(way == 1, F.concat(begun, F.array(step("edit", text))))
    steps = steps.otherwise(F.concat(begun, F.array(step("regenerate", F.lit("")), step("delta", first), step("delta", last))))
    # steps of one message come one after another, messages in the order of their turns
    place = (F.coalesce(F.col("seq").cast("long"), F.lit(-1)) * 8 + F.col("i")).alias("seq")
    return events.select("conv_id", "seq", "message", "role", F.posexplode(steps).alias("i", "s")).select("conv_id", place, "s.kind", "message", "role", "s.text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.render(chat.fold_events(streamed(rows))))
    said = F.filter("turns", lambda t: t["loss"])
    loss = F.array_join(F.transform(said, lambda t: t["text"]), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) + length(text) - length(replace(text, '<', '')) AS escaped,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '#', '')) + length(role) - length(replace(role, '<', ''))
      + length(role) - length(replace(role, ':', '')) + length(role) - length(replace(role, chr(10), '')) AS escaped_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + escaped_role + 2 + escaped + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op7_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.to_integers(F.col("embedding")).alias("ints"))
    return topk.top_k(rows.where("vec_id % 100 = 0"), rows)


OP8_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (SELECT vec_id, len(v) AS dims, unnest(v) AS x, unnest(range(len(v))) AS i FROM good),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM long q JOIN long c ON q.i = c.i AND q.dims = c.dims AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = written(docs.withColumn("virtual_slot", sharding.slot_of(F.col("doc_id"), F.col("text_crc32"))), "slots")
    store = new_path(spark, "slot-map")
    versions = lambda: spark.read.parquet(store).select(F.col("version").cast("int"), "slot", "shard", "bytes")
    # version 1 deals all slots before any size is known; version 2 edits it for the bytes that were measured
    unknown = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(1).cast("long").alias("bytes"))
    sharding.edit_map(unknown, 8).drop("version").write.parquet(f"{store}/version=1")
    measured = sharding.slot_bytes(rows, "virtual_slot", "size")
    sharding.edit_map(measured, 8, sharding.latest_map(versions())).drop("version").write.parquet(f"{store}/version=2")
    placed = sharding.place(rows, sharding.latest_map(versions()))
    numbered = sharding.positions(placed, [F.col("doc_id"), F.col("text_crc32")])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_and_decode(spark, path, F.col("text")).alias("b"))
    back = both.select("doc_id", "b.ids", "b.decoded")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.count_words(table(spark, sf_dir, "documents")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counted AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT r, sum(tf) AS n FROM counted GROUP BY r), whole AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (SELECT term, count(*) AS df FROM counted WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM held, whole),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL AND item_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id, "op2_warc": op2_warc, "op3_toxicity": op3_toxicity, "op4_fingerprints": op4_fingerprints,
    "op5_near_dedup": op5_near_dedup, "op6_chat_format": op6_chat_format, "op7_mix_budget": op7_mix_budget, "op8_exact_topk": op8_exact_topk,
    "op9_slot_sharding": op9_slot_sharding, "op10_bpe": op10_bpe, "op11_variants": op11_variants, "op12_lexical": op12_lexical, "op13_quality": op13_quality, "pipeline": pipeline,
}

SQL = {"op6_chat_format": OP6_SQL, "op8_exact_topk": OP8_SQL, "op12_lexical": OP12_SQL}
