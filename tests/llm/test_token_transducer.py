import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalog_fusion.llm.queries import op6_token_transducer
from catalog_fusion.llm.token_transducer import _NEXT, TokenCounter, chunk_maps, count_tokens, scan_maps

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "   ", "a   ", "\n\n a  \n\n", "it's we're they'll I'd 'sx ''s  's \n's 're 'r 'l 'll'll x's's", "<|endoftext|>",
    " <|endoftext|>a<|endoftext|> <|endoftext|", "a" * 3000, "12 34a5.6!?'!'s ²½Ⅷ", "日本 😀x\0y　z\x1c \x85", "word and\n" * 20_000, "é ß ÅÅ",
]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def lengths(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(counter, library):
    texts = [t or "" for t in TEXTS]
    for chunk in (8, 64, 1024):
        assert counter.counts(texts, chunk) == lengths(library, texts)


def test_random_texts(counter, library):
    rng = random.Random(7)
    letters = "'''stmdrevl aA1 \n\t!.é日 　\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    assert counter.counts(texts, 16) == lengths(library, texts)


def test_each_token_of_the_vocabulary_and_random_bytes(counter, library):
    machine = counter.machine
    assert len(machine.tokens) == len(machine.rank)
    rng = random.Random(3)
    tokens = sorted(machine.tokens)
    assert all(machine.count(t) == 1 for t in rng.sample(tokens, 5000))
    pairs = [rng.choice(tokens) + rng.choice(tokens) for _ in range(3000)]
    pairs = [p for p in pairs if p.isalpha() and p.isascii()]
    assert [machine.count(p) for p in pairs] == lengths(library, [p.decode() for p in pairs])


def test_forgetting_compiled_parts_changes_nothing(counter, library, monkeypatch):
    import catalog_fusion.llm.token_transducer as module

    monkeypatch.setattr(module, "TRANSITIONS", 50)
    monkeypatch.setattr(module, "REMEMBERED", 5)
    small, texts = TokenCounter(FILE), [t or "" for t in TEXTS]
    assert small.counts(texts) == lengths(library, texts)


def test_scan_composes_maps_in_order():
    rng = np.random.default_rng(0)
    chunks = rng.integers(0, _NEXT.shape[1], (37, 5)).astype(np.uint8)
    maps = scan_maps(chunk_maps(chunks))
    for start in range(len(_NEXT)):
        state = start
        for i, chunk in enumerate(chunks):
            for kind in chunk:
                state = _NEXT[state, kind]
            assert maps[i, start] == state


def test_rows_of_a_table(spark, library):
    df = spark.createDataFrame([(i % 4, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, key string").repartition(3)
    got = count_tokens(df, FILE)
    want = sorted(zip((i % 4 for i in range(len(TEXTS))), (len((t or "").encode()) for t in TEXTS), lengths(library, [t or "" for t in TEXTS]), strict=True))
    assert sorted(map(tuple, got.collect())) == want
    assert count_tokens(df.limit(0), FILE).collect() == []


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, lengths(library, list(texts.values())), strict=True))
    out = op6_token_transducer(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) and r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in out)
