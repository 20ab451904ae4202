import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PythonException

from chatloom.llm import piece_encoding as P
from chatloom.llm.queries import QUERIES

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.vocabulary_path())


def awkward(seed, n):
    rng = random.Random(seed)
    plain = "the of and ing er re un ation 2024 1,000 x é ß ñ 中文 日本語 русский العربية हिन्दी 한국어 😀 👩‍👩‍👧 <s> </s> <unk> <0x41> ▁ ⁇   　 ​ \x00 \x7f ﻿ \U0010ffff  ﬁ Å".split(" ")
    spaces = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", "", "", "▁", " \n ", " " * 17]
    for _ in range(n):
        yield "".join(rng.choice(plain) + rng.choice(spaces) for _ in range(rng.randrange(0, 40)))
    for _ in range(n):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(0, 60)))


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "▁", "▁▁a", "\n", "a" * 5000, "abc" * 30000, "é" * 3000, " " * 100_000, ("word " * 20_000).strip(), "<s>", "</s>x", "<0x0A>", "ab\x00cd"]


def test_as_the_library(library):
    own = P.pieces(P.vocabulary_path())
    for text in [t for t in TEXTS if t] + list(awkward(1, 400)):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True), text[:80]
        assert own.decode(ids) == library.decode(ids)
        own.check()
    for part in [*awkward(3, 200), "aab" * 12, "in" * 16]:
        assert own._merged_short(part) == own._merged_long(part)


def test_parts_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(P, "KEPT_PARTS", 5)
    own = P.Pieces(P.vocabulary_path())
    for text in awkward(6, 60):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(own.parts) <= 5 and len(own.parts.older) <= 5


def test_any_ids_decode_as_in_the_library(library):
    own, rng = P.pieces(P.vocabulary_path()), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(0, 300), rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_whole_batches(spark, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS + list(awkward(2, 30)))] + [(None, "no id", "y", None), (3, "twice", None, None), (3, "twice", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, ids array<int>").repartition(3)
    out = P.decoded(P.encoded(docs)).collect()
    assert P.encoded(docs, whole=True).count() == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in out], key=key) == sorted(want, key=key)
    assert P.decoded(P.encoded(docs.limit(0))).collect() == []


def test_a_difference_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "some words")], "doc_id long, text string")
    ids = P.encoded(docs)
    wrong = P.Pieces(P.vocabulary_path())
    wrong.ranks = {}
    wrong.encode("some words")
    with pytest.raises(ValueError, match="some"):
        wrong.check()
    broken = ids.selectExpr("doc_id", "unhex('FFFFFF00') AS ids")
    with pytest.raises(PythonException):
        P.decoded(broken).collect()


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_encoding"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
