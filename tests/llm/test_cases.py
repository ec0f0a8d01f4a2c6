"""Nulls, ties, repeated rows, empty tables and clashing names."""

import re

import corpus_pipeline
import pytest

from weftline.llm import pu_quality, role_repair, secrets, set_sketch, tiling

LONG = " ".join(f"w{i}" for i in range(80))


def test_chats_with_null_and_equal_turns(spark):
    rows = [(1, None, "user", "a")] * 3 + [(1, 5, r, f"m{k}") for k in range(40) for r in ("user", "assistant")] + [(None, None, None, None)] * 3 + [(2, 1, "user", "q"), (2, 2, "assistant", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    whole, cut = ({}, {})
    for out, size in ((whole, 1024), (cut, 2)):
        for r in role_repair.format_chats(frame, part_turns=size).orderBy("conv_id", "part").collect():
            n, cost, text = out.get(r["conv_id"], (0, 0, ""))
            out[r["conv_id"]] = (n + r["n_messages"], cost + r["cost"], text + r["rendered"])
    assert {c: v[0] for c, v in whole.items()} == {1: 83, 2: 2, None: 3}
    assert {c: v[:2] for c, v in whole.items()} == {c: v[:2] for c, v in cut.items()}
    for _, _, text in [*whole.values(), *cut.values()]:
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        roles = roles[roles[0] == "system" :]
        assert len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2)
    assert whole[2][2] == "<|user|>\nq<|end|>\n<|assistant|>\nr<|end|>\n"


def test_repeated_rows_fill_no_sample(spark):
    rows = [(7, LONG)] * 500 + [(i, f"{LONG} {'x ' * i}") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (7, *range(20, 60))], "doc_id long, quality int")
    model = pu_quality.learn(docs, labels, max_positive=30, max_unlabelled=600)
    assert 0.02 <= model.prior <= 0.98
    assert len({r["score"] for r in pu_quality.score(docs.where("doc_id = 7"), model).collect()}) == 1


def test_masking_leaves_null_and_clean_rows(spark):
    frame = spark.createDataFrame([(1, None, None, "k"), (2, "clean", 5, "k"), (3, "token=abcdefghijklmnop", 22, "k")], "doc_id long, text string, n_chars long, found string")
    assert [tuple(r) for r in secrets.redact(frame).orderBy("doc_id").collect()] == [(1, None, None, "k"), (2, "clean", 5, "k"), (3, "<ASSIGN>", 8, "k")]


def test_repeated_items_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1.0), (1, "a b c d e f g", 1.0), (2, None, 2.0)], "doc_id long, text string, coverage double")
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "item_id long, text string")
    assert [tuple(r) for r in tiling.overlaps(docs, items).collect()] == [(1, 1, 6, 1.0)] * 4
    assert [r["doc_id"] for r in tiling.remove_contaminated(docs, items).collect()] == [2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(1, LONG, "en", "s", 9, "x"), (2, LONG + " end", "en", "s", 9, "x"), (2, LONG + " end", "en", "s", 9, "x"), (None, LONG, None, None, None, None), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (5, " ".join(f"v{i}" for i in range(30000)), "en", "t", 9, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_odd_rows(spark, folder):
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.run(spark, folder).collect()) == [0, 1, 5]


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert set_sketch.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet")).columns[-1] == "kept"
