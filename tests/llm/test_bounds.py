"""What a task or the driver holds does not follow the input: blocks of items, one labelled row a key, ranges by size."""

import random
import zlib
from collections import defaultdict

import pytest

from tracklens.llm import common, decontam, packing, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(r, n):
    return " ".join(f"w{r.randrange(300)}" for _ in range(n))


def test_repeated_items_count_once_and_the_callers_table_stays(spark, monkeypatch):
    r = random.Random(11)
    items = [(k, words(r, 25)) for k in range(6)]
    rows = [(k, f"{words(r, 40)} {t} {words(r, 9)}") for k, t in items] + [(99, words(r, 90)), (None, items[0][1])]
    docs = common.stage(spark.createDataFrame(rows, "doc_id long, text string"), "given")
    bench = spark.createDataFrame(items * 40 + [(7, items[0][1]), (None, None)], "item_id long, text string")
    want = sorted([(k, k) for k in range(6)] + [(0, 7), (-1, 0), (-1, 7)])
    for size in (20_000, 3):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        found = [(-1 if x.doc_id is None else x.doc_id, x.item_id) for x in decontam.contamination(docs, bench).collect()]
        assert sorted(found) == want
        assert [x.doc_id for x in decontam.without_contaminated(docs, bench).collect()] == [99]
        assert docs.count() == len(rows)
    assert decontam.blocks_of(bench, None, "text", 3)[0] == 3  # six texts and the empty one
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    n, blocks = decontam.blocks_of(bench, "item_id", "text", 20_000)
    assert n > 3 and sorted(len(x) for x in blocks) and sum(len(b) for b in decontam.blocks_of(bench, "item_id", "text", 20_000)[1]) == 8


def test_one_key_on_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    r = random.Random(12)
    rows = [(k % 40 if k % 3 else 1, words(r, 30) + (" zwicken grubblo" if k % 5 == 0 else "")) for k in range(900)] + [(None, "x"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(40)] + [(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    sizes, real = [], toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda v: sizes.append(len(v)) or real(v))
    model = toxicity.fit(docs, labels, fit_rows=25)
    keys = {k for k in range(40) if zlib.crc32(str(k).encode()) % 5}
    assert sizes == [min(25, len(keys))]
    assert toxicity.toxicity(docs, model).count() == len(rows)


def test_ranges_by_size_keep_every_id(spark, monkeypatch):
    r = random.Random(13)
    rows = [(k, words(r, r.randrange(0, 400))) for k in range(200)] + [(None, words(r, 50)), (None, None), (300, words(r, 9000))] + [(301, "same words")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len({x.sequence_id >> 32 for x in got}) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled, by_doc = defaultdict(list), defaultdict(list)
    for x in got:
        filled[x.sequence_id].append((x.offset, x.length))
        by_doc[x.doc_id].append((x.start, x.length, x.doc_tokens))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for k, pieces in by_doc.items():
        if k not in (None, 301):
            assert sum(n for _, n, _ in pieces) == pieces[0][2] and sorted(s for s, _, _ in pieces)[0] == 0
    assert sum(n for _, n, _ in by_doc[301]) == 5 * by_doc[301][0][2]
