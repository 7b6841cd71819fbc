"""Every operator over one table of awkward rows: nulls in all columns, empty
and very long texts, repeated rows and ids, and columns with clashing names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import lectern.llm
from lectern.llm import catalog

LONG = "alpha beta gamma, delta\n" * 120_000
ROWS = [
    (1, "plain words of one text that is long enough to pass the rule", "en", "a"),
    (1, "plain words of one text that is long enough to pass the rule", "en", "a"),
    (2, LONG, "en", "a"),
    (3, "x" * 3_000_000, "de", "b"),
    (4, "", "en", None),
    (5, None, None, "b"),
    (None, "no id but words", None, None),
    (None, None, None, None),
    (6, "\u0000  \x1c <|im_end|> é漢字", "fr", "é"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *[F.lit("q").alias(c) for c in ("size", "kept", "score", "shard", "fp", "taken", "items", "held_out", "component_id", "n_words", "position", "bytes", "block", "__m", "__hit", "__gone", "__row", "__HEAD", "Row_Key", "hit", "file", "ROW", "slot", "counts", "text_", "body", "a`b", "a.b", "a b")])
    clash.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, "long enough to pass", "q"), (None, None, None), (2, "", None)], "item_id long, text string, hits string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0, "q"), (2, 0, 1, "q"), (None, None, None, None), (3, None, None, "q")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "http://x", "<p>" * 3000 + LONG), (None, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("q")).write.parquet(f"{where}/pages.parquet")
    vectors = [(50, None, 1), (None, [1.0], 1), (100, [], 1), (7, [None], None), (150, [float("nan")], 1), (100, [], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("anchor", F.lit("q")).withColumn("v", F.lit("q")).write.parquet(f"{where}/embeddings.parquet")
    chats = [(1, 0, "user", LONG), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", "<|im_start|>")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("q")).write.parquet(f"{where}/conversations.parquet")
    return where


def literal_names():
    """Every name that a module of the subpackage gives a column."""
    text = "".join(p.read_text() for p in Path(lectern.llm.__file__).parent.glob("*.py"))
    found = set(re.findall(r'alias\("(\w+)"\)', text)) | set(re.findall(r'withColumn\("(\w+)"', text))
    for names in re.findall(r"fresh\(\w+, ([^)]*)\)", text):
        found |= set(re.findall(r'"(\w+)"', names))
    return sorted(x for x in found | {"text_", "TEXT_", "body", "doc_id_"} if x.lower() not in ("doc_id", "text", "lang", "source", "n_chars"))


@pytest.mark.parametrize("number", range(4))
def test_stages_pass_any_names(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), set()
    for x in literal_names():
        if x.lower() not in seen:
            docs, _ = docs.withColumn(x, F.lit("q")), seen.add(x.lower())
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and len(seen) > 40
    assert all(r[-1] == "q" for r in out.select(docs.columns[-1]).collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_whole_results_without_a_crash(spark, folder, name):
    want = {"op1_chat_format": 4, "op5_html_text": 4, "op12_hard_negatives": 0}.get(name, len(ROWS))
    out = catalog.QUERIES[name](spark, folder)
    assert len(out.collect()) == want
    assert len(set(out.columns)) == len(out.columns)


def test_pipeline(spark, folder):
    names = spark.read.parquet(f"{folder}/documents.parquet").columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == names
    assert corpus_pipeline.run(spark, folder).count() >= 0
