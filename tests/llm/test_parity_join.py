import random
import re
from collections import defaultdict

import numpy as np
import pytest

from catalog_fusion.llm import parity_join
from catalog_fusion.llm.parity_join import bands, bit_sketch, components, folded, jaccard_components, one_of_each, shingle_sets, signatures, sketch, sketch_distance

SCHEMA = "doc_id long, text string, row long, name string, n int"


def shingles(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    """Sizes and components by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    tried = {(a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1 :]}
    for a, b in tried:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=order)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)
    out = jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, out), key=lambda r: tuple((x is None, x or 0) for x in r))


def variant(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1])
    return words


def corpus(seed):
    """Families at all distances around the threshold, a common passage, edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    for size in (4, 5, 6, 8, 9, 12, 13, 40, 67, 68, 69, 80, 200, 520, 600):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts += [variant(rng, base, rng.randrange(0, max(2, size // 20 + 1))) for _ in range(7)]
    texts += [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))] + passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))] for _ in range(150)]
    drift = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(120):  # a chain whose ends are not alike
        drift = variant(rng, drift, 1)
        texts.append(drift)
    texts = [" ".join(t) for t in texts] + ["a b c", "A\tB\x0bC", "a  b", "", " \n ", None, None, "x" * 50_000, "Ä b c d e f", "ä b c d e f"]
    texts += ["same text of exactly seven words here"] * 60 + ["the the the the the the the"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, "a b c"), (None, "alone in the world of words"), (7, rows[0][1]), (7, rows[1][1]), (None, "")]


@pytest.mark.parametrize(("small", "block", "sample"), [(32, 512, 1 / 16), (3, 8, 1.0), (2, 512, 0.0)])
def test_components_equal_brute_force(spark, monkeypatch, small, block, sample):
    monkeypatch.setattr(parity_join, "SMALL", small)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    monkeypatch.setattr(parity_join, "SAMPLE", sample)
    rows = corpus(small)
    assert run(spark, rows) == brute_force(rows)


def test_empty_table_and_tables_without_links(spark):
    assert run(spark, []) == []
    rows = [(1, None), (2, ""), (3, "one two three four five six")]
    assert run(spark, rows) == brute_force(rows)


def test_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute_force(rows)


def test_sets_split_words_like_the_contract():
    texts = ["a b c d e f", "A  B\tC\nD\x0bE\x0cF", "a b c d e", "a\x1cb c", "é É", "", "x" * 5000 + " " + "y" * 5000]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[1])
    long = shingle_sets([("x" * 64 + "ab").encode(), ("x" * 64 + "ba").encode(), b"xxxxxxxx", b"xxxxxxx"])
    assert len({int(s[0]) for s in long}) == 4


def test_sketch_distances_bound_the_symmetric_difference():
    rng = np.random.default_rng(3)
    nothing = np.zeros(0, np.uint64)
    for size in [*range(1, 20), 63, 64, 80, 300, 511, 512, 640, 4100]:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for edits in {0, 1, len(a) // 18, len(a) // 9}:
            b = np.unique(np.concatenate((a[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64))))
            far = len(np.setxor1d(a, b))
            band = bands(min(len(a), len(b)))[0]
            assert band in bands(len(a)) and band in bands(len(b)) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b))
            (na, va), (nb, vb) = sketch(a, band), sketch(b, band)
            differ = set(zip(na.tolist(), va.tolist(), strict=True)) ^ set(zip(nb.tolist(), vb.tolist(), strict=True))
            assert len({n for n, _ in differ}) <= far
            assert sketch_distance(bit_sketch(a), bit_sketch(b)) <= far
            assert np.array_equal(folded(bit_sketch(a), 16), np.packbits((np.bincount((a % np.uint64(1024)).astype(int), minlength=1024) & 1).astype(np.uint8)).view(np.uint64))
            if 5 * (len(a) + len(b) - far) // 2 >= 4 * (len(a) + len(b) + far) / 2:
                assert np.intersect1d(signatures(a, nothing), signatures(b, nothing)).size


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(300, 400)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_one_of_each_keeps_one_row_of_a_component(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (5, ""), (5, ""), (6, None), (9, "other words are here now"), (None, "a b c d e f g")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "A b c d e f g"), (5, ""), (5, ""), (6, None), (9, "other words are here now")], key=str)
