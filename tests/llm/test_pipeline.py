"""The document pipeline on a small table with planted cases."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tracklens.llm import pii


def sentences(r, n):
    return "\n".join(" ".join(" ".join(f"w{r.randrange(500)}" for _ in range(9)).capitalize() + "." for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    texts = {k: sentences(r, 4) for k in range(20)}
    texts[20] = texts[3]  # exact copy
    texts[21] = texts[4].replace("W", "W", 1)[:-6] + " end."  # near copy
    texts[22] = "A | B | C | D | E | F\n" * 30  # navigation only
    texts[23] = "too short."
    texts[24] = None
    item = " ".join(f"q{r.randrange(400)}" for _ in range(30)) + "."
    texts[25] = sentences(r, 2) + "\n" + item + "\n" + sentences(r, 2)
    texts[26] = sentences(r, 3) + "\nPlease write to some.body@mail7.example.com about it."
    texts[27] = "All rights reserved.\n" + sentences(r, 3)
    rows = [(k, t, "en", "src0", len(t or ""), "extra") for k, t in texts.items()]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never seen in any of these documents at all here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_pipeline_keeps_and_drops(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(corpus_pipeline.TOKENIZER)
    where, texts = folder
    pieces = defaultdict(list)
    for x in corpus_pipeline.run(spark, where).collect():
        pieces[x.doc_id].append(x)
    assert set(pieces) == {*range(20), 26, 27}
    whole = tokenizers.Tokenizer.from_file(path)
    encode = lambda t: whole.encode(t, add_special_tokens=False).ids
    got = {k: [i for x in sorted(p, key=lambda x: x.start) for i in x.ids] for k, p in pieces.items()}
    for k in range(20):
        assert got[k] == [*encode(texts[k]), 1]
    assert got[27] == [*encode(texts[27].split("\n", 1)[1]), 1]
    safe = pii.pseudonymise(spark.createDataFrame([(texts[26],)], "text string")).first().text
    assert "some.body" not in safe and got[26] == [*encode(safe), 1]


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder[0])
        assert docs.columns == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in docs.collect())
