"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, decontam, langid, licenses, linededup, neardup, quality, substring, toxicity


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.tiktoken"):
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return bpe.parse_ranks(f.read()), public_tokenizers.PATTERN


def fold(key: str, n: int):
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled(spark, sf_dir, label: str, rows: int):
    """Texts with their label, without the held-out fifth: all of them, or about ``rows``.

    The sample is drawn from the labels before their texts are met, so what is broadcast has
    ``rows`` rows and no text is shuffled.
    """
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & (fold("doc_id", 5) != 0))
    labels = quality.sample_of(labels.groupBy("doc_id").agg(F.max(label).alias(label)), F.col("doc_id"), rows)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(labels), "doc_id")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    found = langid.predict(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")


def op2_toxicity(spark, sf_dir):
    model = toxicity.train(labelled(spark, sf_dir, "toxic", toxicity.SAMPLE_ROWS), "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "toxicity.score")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_bpe(spark, sf_dir):
    ranks, pattern = tokenizer()
    return bpe.digest(table(spark, sf_dir, "documents"), ranks, pattern)


def op6_line_dedup(spark, sf_dir):
    found = linededup.remove_common_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return found.select("doc_id", F.col("removed_lines").cast("long").alias("n_removed"), digest.alias("kept_sha256"))


def op7_substring_dedup(spark, sf_dir):
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    size = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", size.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


def op9_near_dedup(spark, sf_dir):
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op10_quality(spark, sf_dir):
    model = quality.train(labelled(spark, sf_dir, "quality", quality.SAMPLE_ROWS), "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_nearest": op4_nearest,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op7_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least_doc USING (k) WHERE win.doc_id > least_doc.m),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM hit)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
       FROM (SELECT item_id, ws, least(len(ws), 8) AS n, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i FROM b WHERE len(ws) > 0)),
sz AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sz)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
""",
}
