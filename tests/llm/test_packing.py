import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "Hello  world\n\n x", "naïve ÉÉ 漢字 🙂🙂", "a<|endoftext|>b <|endoftext|>", "it's we'll 123 ___ --- \t\t\r\n", "\x00\x01", "x" * 3000, " " * 3000, "ab " * 2000, "   　x", "1234567890" * 50]


def test_ids_are_the_tokenizers(tokenizer):
    encode = P.encoder(P.vocabulary_path())
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab É\n'<|>endoftext 09漢") for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert P.ids_of(encode, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_white_space(tokenizer):
    encode = P.encoder(P.vocabulary_path())
    spaces = [" " * 1_000_000, "\n" * 700_000, " \n\t" * 300_000, "\u3000" * 700_000, "\x85\xa0 " * 300_000]
    texts = [before + run + after for run in spaces for before, after in (("a", "b"), ("", ""), ("x<|endoftext|>", "<|endoftext|>"), (" \u200b", "'s  1"))]
    texts.append("a" + spaces[0] + "b<|endoftext|>" + spaces[2] + "\n" * 5000 + "c" + " " * 5000)
    for text in texts:
        assert P.ids_of(encode, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(P.ids_of(encode, "a" + " " * 10_000_000 + "b")) == 10_000_001


def test_long_white_space_is_packed(spark):
    got = P.pack(spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "x")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in got if r.doc_id == 1) == 1_000_002


def naive(lengths, capacity):
    """Remaining capacities after best-fit decreasing, one piece after another."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        insort(rooms, room - x)
    return rooms


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    used = defaultdict(list)
    for size, ranges in P.plan(dict(counts), 30).items():
        for rank in range(counts[size]):
            first, begin, each, at = ranges[np.searchsorted(ranges[:, 0], rank, "right") - 1]
            used[begin + (rank - first) // each].append((at + (rank - first) % each * size, size))
    for places in used.values():
        end = 0
        for at, size in sorted(places):
            assert at == end
            end += size
        assert end <= 30
    assert sorted(30 - sum(s for _, s in x) for x in used.values()) == naive(lengths, 30)


def test_whole_documents(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "É"]) for _ in range(rng.choice([0, 3, 50, 900, 4000])))) for i in range(80)]
    rows += [(500, None), (500, None), (None, "x"), (501, "y" * 9000)] + [(600 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, length int").repartition(5)
    got = P.pack(docs, keep_ids=True).collect()
    want = sorted((str(d), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows)
    by_doc = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
    for doc, parts in by_doc.items():
        if doc != 500:
            parts.sort(key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts)))
            assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
            assert all(r.length == 1024 for r in parts[1:])
    assert sorted((str(d), [x for r in p for x in r.ids]) for d, p in by_doc.items() if d != 500) == [x for x in want if x[0] != "500"]
    assert len(by_doc[500]) == 2
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        end = 0
        for at, size in sorted(places):
            assert at == end
            end += size
        assert end <= 1024
    assert len(full) == len(naive([r.length for r in got], 1024))


def test_no_rows(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
