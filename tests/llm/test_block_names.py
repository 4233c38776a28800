import re

import pytest
from pyspark.sql import functions as F

from catalog_fusion.llm import block_names
from catalog_fusion.llm.block_names import blocks_of, exact_groups

WHITE = re.compile(r"[\x20\x09-\x0D]")
TEXTS = [
    None, "", " \t\r\n\x0b\x0c", "a b", "ab", "a  b", "ab ", "AB", "é" * 700, "é" * 350 + "\n" + "é" * 350, "é" * 699,
    "x" * 64, "x" * 65, "x" * 128, "x" * 129, "x" * 192, "x" * 64 + "y", "long text " * 5000, "long\ttext" * 5000, "long text " * 4999 + "longtex", "\0a", "a", "😀" * 40,
]
ROWS = [(i, t, 1, "n") for i, t in enumerate(TEXTS)]
ROWS += [(None, "a b", 1, "n"), (3, "a b", 1, "n"), (3, "a b", 1, "n"), (None, None, 1, "n"), (None, "only null", 1, "n")]
ROWS += [(100 + i, "head " * 30 + str(i % 7), 1, "n") for i in range(150)]


def brute_force(rows):
    groups = {}
    for place, (i, t, *_) in enumerate(rows):
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, place))
    out = []
    for members in groups.values():
        best = min(members)
        keep = None if best[1] else best[2]
        out += [(None if m[1] else m[2], keep, len(members), m == best) for m in members]
    return sorted(map(str, out))


def groups_of(df, **more):
    found = exact_groups(df, **more).collect()
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in found)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(ROWS, "doc_id long, text string, row int, name string").coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("size", [64, 4096])
def test_groups_equal_brute_force(documents, size):
    assert groups_of(documents, size=size) == brute_force(ROWS)


def test_blocks_that_share_a_hash_are_told_apart(documents):
    assert groups_of(documents, size=64, hashing=lambda b: F.octet_length(b).cast("long")) == brute_force(ROWS)


def test_hot_keys_are_looked_up_by_broadcast(documents, monkeypatch):
    for hottest in (1, 3):
        monkeypatch.setattr(block_names, "HOTTEST", hottest)
        monkeypatch.setattr(block_names, "HOT_ROWS", 2)
        assert groups_of(documents, size=64) == brute_force(ROWS)


def test_blocks(column):
    cut = column(lambda c: F.transform(blocks_of(c.cast("binary"), 3), lambda b: b.cast("string")), ["", "abc", "abcd", "abcdefg"])
    assert cut == [[""], ["abc"], ["abc", "d"], ["abc", "def", "g"]]


def test_empty_table_and_no_python(documents, capsys):
    out = exact_groups(documents.limit(0))
    assert out.collect() == []
    out.explain()
    assert "Python" not in capsys.readouterr().out
