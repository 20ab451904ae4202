import random

import pytest
import xxhash

from chatloom.llm import simhash_dedup as S


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(((rows[i][0], fps[i], min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows))), key=str)


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["wort%d" % i for i in range(60)] + ["Éa", "STRASSE", "ñ"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 40, 300, 700]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, rows[5][1]), (1003, rows[5][1]), (None, rows[7][1]), (1005, "x" * 50000), (1006, "y " * 20000)]
    return rows


@pytest.mark.parametrize("limit", [20000, 2])
def test_against_brute_force(spark, limit):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, label int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs, bucket_limit=limit).collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chain_of_near_fingerprints(spark):
    chain = [sum(1 << b for b in range(4 * i)) for i in range(16)]
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    for limit in (20000, 1):
        labels = S.components(S.close_edges(fps, bucket_limit=limit)).collect()
        assert len(labels) == 16 and len({r.label for r in labels}) == 1


def test_large_bucket_gives_few_edges(spark):
    fps = spark.range(4096).selectExpr("id * 1099511627776 as fp")
    assert S.close_edges(fps).count() < 15 * 4096


@pytest.mark.parametrize("blocks,limit", [(None, 20000), (7, 20000), (8, 20000), (None, 20), (8, 20)])
def test_links_of_crowded_fingerprints(spark, blocks, limit):
    """Fingerprints in clusters and with common bits, so that keys have large buckets: the same components as by comparing all."""
    rng = random.Random(9)
    fps = set()
    for _ in range(8):
        middle = rng.getrandbits(64)
        for _ in range(40):
            fps.add(middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps |= {rng.getrandbits(30) for _ in range(200)}
    fps = sorted(fps)
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                label[find(x)] = find(y)
    want = {}
    for x in fps:
        want.setdefault(find(x), set()).add(x)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {}
    for r in S.components(S.close_edges(frame, blocks=blocks, bucket_limit=limit)).collect():
        got.setdefault(r.label, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_keys_grow_with_the_corpus():
    assert [S.blocks_for(n, 4) for n in (0, 1, 1 << 20, 1 << 22, 1 << 27, 10**10, 10**12)] == [6, 6, 6, 7, 7, 9, 11]
    for mask in S.block_masks(6, 4)[:3]:
        finer = S.block_masks(6, 4, mask)
        assert len(finer) == 15 and all(x & mask == mask and x.bit_count() > mask.bit_count() for x in finer)
