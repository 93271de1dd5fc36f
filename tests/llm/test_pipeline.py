"""The pipeline's stages, each on its own input, against plain versions."""

import re

import pytest
import sentencepiece

import corpus_pipeline as C
from panelloom.llm import decontaminate as D
from panelloom.llm.token_file import public_path

EN, FR = "the house and the garden of the king with a river that was in the north ", "la maison et le jardin du roi avec une rivière qui était dans le nord "
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
TEXTS = [
    EN + "one morning early", EN + "one morning early", FR + "un matin", None, "", "123 456", EN * 3 + ITEM.lower() + " end", FR * 2 + "écrire à a.b@c.org ou 10.1.2.3 merci",
    "Call +1 (586) 555-8430 now, card 4111 1111 1111 1111 ok", EN + "password=897a334fdac2c39185 is it", "x" * 30000, " ".join(f"word{i}" for i in range(4000)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    rows = [(i, t, "fr" if t and t.startswith("la") else "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_names_and_order():
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "pieces"]


def test_stages(spark, docs, folder):
    kept = docs
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = stage(spark, kept, folder)
        after = {r["doc_id"]: r for r in kept.collect()}
        if name != "pieces":
            assert kept.columns == docs.columns
        if name == "language":
            assert set(before) - set(after) == {3, 4, 5}
        elif name == "near_duplicates":
            assert set(before) - set(after) == {1}
        elif name == "benchmark":
            want = {i for i, r in before.items() if not list(D.Sketches([(1, ITEM)], 5, 0.8).verify(r["text"], {0}))}
            assert set(after) == want and 6 not in want
        elif name == "personal_data":
            assert set(after) == set(before)
            assert "<EMAIL>" in after[7]["text"] and "<IP>" in after[7]["text"] and "<PHONE>" in after[8]["text"] and "<CARD>" in after[8]["text"] and "<SECRET>" in after[9]["text"]
            assert not any(re.search(r"@c\.org|10\.1\.2\.3|4111|555-8430", r["text"]) for r in after.values())
            assert all(after[i]["text"] == before[i]["text"] for i in (0, 2, 10))
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
            assert {i: list(r["ids"]) for i, r in after.items()} == {i: sp.encode(r["text"]) for i, r in before.items()}


def test_empty_table(spark, docs, folder):
    kept = docs.limit(0)
    for _, stage in C.STAGES:
        kept = stage(spark, kept, folder)
    assert kept.count() == 0


def test_further_columns_and_null_ids(spark, folder):
    rows = [(None, EN, "en", 1, 2, 3), (7, EN, "en", 1, 2, 3), (7, EN, "en", 1, 2, 3), (8, FR, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int, ids int, component_id int")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    got = docs.collect()
    assert {"fp", "component_id", "ids"} <= set(docs.columns) and sorted(str(r["doc_id"]) for r in got) == ["7", "8", "None"]


def test_rows_of_one_id_are_told_by_their_texts(spark):
    other = " ".join(f"else{i}" for i in range(50))
    rows = [(3, EN * 3, "b"), (7, EN * 3, "a"), (7, other, "a"), (7, other, "c"), (3, EN * 3, "a"), (9, EN * 3 + "x", "a"), (5, None, "a"), (5, "", "a")]
    kept = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(map(tuple, kept.collect()), key=str) == [(3, EN * 3, "a"), (5, None, "a"), (7, other, "a")]


def test_texts_without_a_main_language_are_dropped(spark):
    own = {"en": EN, "fr": FR, "de": "das haus und der garten des königs mit einem fluss der im norden war ", "es": "la casa y el jardín del rey con un río que estaba en el norte "}
    rows = [(k, (t + f"{k} ") * 4, lang, "s", 0) for k, (lang, t) in enumerate(list(own.items()) * 6)]
    rows += [(100, (EN * 5 + FR), None, "s", 0), (101, "".join(t * 4 for t in own.values()), None, "s", 0), (102, EN, None, "s", 0)]
    kept = {r["doc_id"] for r in C.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert {r[0] for r in rows} - kept == {101}
