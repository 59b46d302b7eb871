"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_dedup import ALNUM, expected_classes, lower
from test_models import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = ["\n".join(prose(rng, lang, rng.randint(6, 30)) for _ in range(rng.randint(2, 6))) for _ in range(160) for lang in ["aa" if rng.random() < 0.6 else "bb"]]
    item = " ".join(ALNUM.findall(texts[7])[4:24])
    for i in (20, 40):
        texts[i] = texts[i] + "\n" + prose(rng, "aa", 5) + " " + item.upper() + " " + prose(rng, "bb", 3)
    for i in range(50, 62):
        words = texts[i - 40].split(" ")
        words[len(words) // 2] = "other"
        texts[i] = " ".join(words)
    texts[70:75] = [texts[3]] * 5
    texts += [None, "", "12 34 !!", "zxq wvy qqx " * 40]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "aa" if i % 5 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "unheard of words here in this one item"), (3, "ka")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(docs)

    def apply(name, df):
        out = stages[name](spark, df, folder)
        assert out.columns == COLUMNS or name == "bpe"
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    known = apply("language_id", docs)
    kept = rows_of(known)
    assert set(before) - set(kept) <= {160, 161, 162, 163} and {160, 161, 162} <= set(before) - set(kept)
    assert all(before[i] == t for i, t in kept.items())

    lines = apply("line_dedup", known)
    shorter = rows_of(lines)
    assert set(kept) - set(shorter) == {70, 71, 72, 73, 74}
    assert all(len(t) <= len(kept[i]) for i, t in shorter.items()) and shorter[3] == kept[3]
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    unique = apply("near_dedup", known)
    want = expected_classes(sorted(kept.items()))
    assert rows_of(unique) == {i: t for i, t in kept.items() if want[i] == i}

    clean = apply("decontamination", known)
    item = ALNUM.findall(lower(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text))
    windows = {tuple(item[j : j + 8]) for j in range(len(item) - 7)}
    dirty = {i for i, t in kept.items() for w in [ALNUM.findall(lower(t))] if any(tuple(w[j : j + 8]) in windows for j in range(len(w) - 7))}
    assert {7, 20, 40} <= dirty and rows_of(clean) == {i: t for i, t in kept.items() if i not in dirty}

    done = apply("bpe", known).collect()
    assert all(r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest() for r in done) and len(done) == len(kept)


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r.doc_id for r in found.collect()}
    assert ids and ids <= set(range(160)) and not ids & {7, 20, 40, 70, 71}


def test_no_rows(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("id", F.lit(1)).withColumn("language", F.lit("x")).withColumn("gone", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 100, name


def test_registered_queries(spark, folder):
    from akin.llm import queries

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic")).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.range(60).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(8))).alias("embedding")).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    n = docs.count()
    for name, query in queries.QUERIES.items():
        found = query(spark, folder)
        rows = found.count()
        assert rows == n or name in ("op3_licenses", "op4_nearest"), name
    assert query_columns(queries, spark, folder, "op1_language_id")[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert query_columns(queries, spark, folder, "op2_toxicity") == ["doc_id", "held_out", "score", "predicted"]
    assert query_columns(queries, spark, folder, "op4_nearest") == ["query_id", "rank", "vec_id", "score"]
    assert query_columns(queries, spark, folder, "op8_decontamination") == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contract_columns_by_value(spark, folder):
    from zlib import crc32

    from akin.llm import queries

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic")).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    texts = rows_of(docs)
    for name, folds, out, least in (("op1_language_id", 3, 1, None), ("op2_toxicity", 5, 0, 0.5), ("op10_quality", 5, 0, 0.3)):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert {r.doc_id: r.held_out for r in rows} == {i: crc32(str(i).encode()) % folds == out for i in texts}, name
        assert all(0 <= r.score <= 1 for r in rows)
        if least is None:
            assert {r.doc_id for r in rows if r.lang_pred == "und"} == {160, 161, 162} and {r.lang_pred for r in rows} == {"aa", "und"}
        else:
            assert all(r.predicted == (1 if r.score >= least else 0) for r in rows), name


def test_rows_that_share_an_id_or_have_none(spark, folder):
    """Stages judge rows by their texts: clean rows stay though another row with their id goes."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    long = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcde"]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (2, long[2]), (None, long[3]), (None, long[1]), (None, f"x {item} y"), (3, f"z {item}"), (3, long[4]), (3, long[4]), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    shown = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = shown(corpus_pipeline.dedup_documents(spark, docs, folder))
    assert kept == sorted([(1, long[0]), (1, long[1]), (2, long[2]), (None, long[3]), (3, f"z {item}"), (3, long[4]), (4, None)], key=str)
    clean = shown(corpus_pipeline.decontaminate(spark, docs, folder))
    assert clean == sorted(((i, t) for i, t in rows if not t or item not in t), key=str)


def query_columns(queries, spark, folder, name):
    return queries.QUERIES[name](spark, folder).columns
