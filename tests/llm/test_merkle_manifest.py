import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from catalog_fusion.llm.merkle_manifest import Page, build_manifest, leaf_digest, verified_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def raised(nodes):
    """All levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_force(rows):
    groups = {}
    for doc_id, text, lang, source, chars, *_ in rows:
        bare = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            bare = text.replace("\n", "")
        leaf, other = (leaf_of((doc_id, source, lang, chars, t)) for t in (text, bare))
        groups.setdefault(source, []).append((doc_id is not None, doc_id, leaf, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0], m[1] or 0, m[2]))
    trees = {s: raised([m[2] for m in groups[s]]) for s in names}
    top = raised([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, (_, doc_id, leaf, other) in enumerate(groups[s]):
            proof, cur = [], other
            for levels, at in ((trees[s], i), (top, place)):
                for nodes in levels[:-1]:
                    low = at - at % 3
                    run = nodes[low : low + 3]
                    proof += run[: at - low] + run[at - low + 1 :]
                    cur = H(*run[: at - low], cur, *run[at - low + 1 :])
                    at //= 3
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, H(*proof), cur, cur == root))
    return sorted(out, key=str)


def rows_of(spark, rows, folder, **more):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    df = spark.read.parquet(folder)
    tampered = F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace(df["text"], F.lit("\n"), F.lit(""))).otherwise(df["text"])
    got = verified_rows(df, FIELDS, changed={"text": text}, **more)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def documents(sizes):
    texts = [None, "", "a\nb", "\n", "plain", "é\n" * 40]
    return [
        (1000 * g + i, texts[i % 6], "de" if i % 4 else None, s, i if i % 5 else None, "x", 1) for g, (s, n) in enumerate(sizes.items()) for i in range(n)
    ]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_proofs_equal_brute_force(spark, tmp_path, levels):
    rows = documents({None: 4, "": 1, "a": 3, "b": 28, "B": 10, "é": 9, "z": 2, "10": 27})
    rows += [(5, "same", "de", "a", 1, "x", 1)] * 3 + [(None, "no id\n", "de", "a", 1, "x", 1), (None, None, None, None, None, None, None)]
    want = brute_force(rows)
    assert rows_of(spark, rows, str(tmp_path / "d.parquet"), levels=levels) == want
    assert {r[-1] for r in want} == {True, False}


def test_one_row_and_one_group(spark, tmp_path):
    for i, rows in enumerate([documents({"a": 1}), documents({"a": 40}), documents({c: 1 for c in "abcdefghij"})]):
        assert rows_of(spark, rows, str(tmp_path / f"{i}.parquet")) == brute_force(rows)
    assert rows_of(spark, [], str(tmp_path / "none.parquet")) == []


def test_hot_group_in_many_pages_and_long_text(spark, tmp_path):
    rows = [(i, "long\n" * 50_000 if i == 7 else f"t{i}\n", "en", "hot" if i % 3 else f"s{i % 5}", i, None, None) for i in range(2500)]
    assert rows_of(spark, rows, str(tmp_path / "d.parquet")) == brute_force(rows)


def test_a_page_resumes_its_states():
    members = [H(str(i)).encode() for i in range(20)]
    page = Page(members, 3)
    for at in range(20):
        changed = [*members[:at], b"0" * 64, *members[at + 1 :]]
        assert page.fold(at, b"0" * 64) == Page(changed, 3).root
        assert page.fold(at, members[at]) == page.root


def test_leaf_frames_its_values(column):
    leaf = lambda c: leaf_digest([c, F.lit(12)])
    assert column(leaf, [None, "", "-", "é"]) == [H("-2:12"), H("0:2:12"), H("1:-2:12"), H("2:é2:12")]


def test_manifest_is_saved(spark, tmp_path):
    df = spark.createDataFrame(documents({"a": 5, "b": 4}), SCHEMA)
    manifest = build_manifest(df, df["doc_id"], df["source"], leaf_digest([df["text"]]))
    manifest.save(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "top-0")).first()["digest"] == manifest.root
    assert spark.read.parquet(str(tmp_path / "m" / "groups-0")).count() == 2
