import random
from collections import defaultdict

import corpus_pipeline as CP
import pytest
from test_decontaminate import brute as brute_hits
from test_line_dedup import brute as brute_lines
from test_simhash_dedup import brute as brute_groups

from chatloom.llm.packing import encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    item = " ".join(rng.choice(vocab) for _ in range(40))
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.choice([30, 90, 250]))]
        good = rng.random() < 0.75
        if not good:
            words = rng.choice([[w + "###" for w in words], [w.upper() + "!!" for w in words], [words[0]] * len(words)])
        lines = [" ".join(words[j : j + 12]) for j in range(0, len(words), 12)]
        if i % 3 == 0:
            lines.insert(1, "Share this page")
        if i % 60 == 7:
            lines.append(item)
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    for i in range(400, 460):
        rows.append((i, rows[rng.randrange(400)][1]))
    rows += [(500, None), (501, ""), (502, "Share this page"), (503, rows[9][1]), (503, rows[9][1]), (None, rows[12][1]), (504, "word again " * 4000)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(d, t, "en", f"s{k % 3}", len(t or "")) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, dict(labels), item


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_one_by_one(spark, tables):
    path, rows, truth, item = tables
    stages = dict(CP.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = CP.staged(stages["quality_classifier"](spark, docs, path), "t")
    assert kept.columns == docs.columns
    ids = {d for d, _ in pairs(kept)}
    assert sum((d in ids) == bool(q) for d, q in truth.items()) > 0.95 * len(truth)
    assert sorted(pairs(kept), key=str) == sorted(((d, t) for d, t in rows if (d, t) in set(pairs(kept))), key=str)

    lines = CP.staged(stages["line_dedup"](spark, kept, path), "t")
    assert lines.columns == docs.columns
    assert sorted(pairs(lines), key=str) == sorted(((d, t) for d, _, _, t in brute_lines(pairs(kept), 10, 1)), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = CP.staged(stages["simhash_dedup"](spark, lines, path), "t")
    assert single.columns == docs.columns
    groups = defaultdict(list)
    for d, _, component in brute_groups(pairs(lines)):
        groups[component].append(d)
    assert sorted(d for d, _ in pairs(single)) == sorted(groups)

    clean = CP.staged(stages["decontamination"](spark, single, path), "t")
    gone = {d for d, _, _, _, bad in brute_hits(pairs(single), [("b1", item)], 13) if bad}
    assert gone and sorted(pairs(clean)) == sorted(x for x in pairs(single) if x[0] not in gone)

    packed = stages["best_fit_packing"](spark, clean, path).collect()
    encode, length = encoder(vocabulary_path()), defaultdict(int)
    for r in packed:
        length[r["doc_id"]] += r["length"]
    assert length == {d: len(encode.encode(t or "", allowed_special="all")) + 1 for d, t in pairs(clean)}


def test_run_is_the_stages_in_order(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in CP.STAGES:
        docs = CP.staged(stage(spark, docs, path), "t")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, CP.run(spark, path).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_stages_with_clashing_columns_and_no_rows(spark, tables):
    path = tables[0]
    extra = spark.createDataFrame([(1, "a b c", 1, 2.0, "x", "y", 3), (None, None, 1, 2.0, "x", "y", 3), (2, "a b c", 1, 2.0, "x", "y", 3)], "doc_id long, text string, score int, predicted double, dropped string, fp string, row_key int")
    for _, stage in CP.STAGES[:-1]:
        assert stage(spark, extra, path).columns == extra.columns
        assert stage(spark, extra.limit(0), path).collect() == []
    assert CP.packed(spark, extra, path).count() == 3


def test_one_stays_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b"), (1, "a B"), (None, "a b"), (None, None), (None, "")], "doc_id long, text string")
    got = CP.one_of_near_duplicates(spark, rows, "")
    assert sorted(r["doc_id"] is None for r in got.collect()) == [False, True]
