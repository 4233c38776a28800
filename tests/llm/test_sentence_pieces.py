import hashlib

import public_tokenizers
import pytest
import sentencepiece

from catalog_fusion.llm.queries import op2_sentence_pieces
from catalog_fusion.llm.sentence_pieces import _NORMALIZER, PieceCoder, encode_texts, message_fields

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "Hello  wörld 😀\n日本", " a  b ", "▁literal▁ marks ▁▁", "<s></s><unk><0x0A>", "nul\0byte", "\t tab\r\n",
    "a" * 5000, "word " * 30_000, "ﬁne ① Ｆｕｌｌ　ｗｉｄｔｈ é ½ ​­ x", "한국어 العربية हिन्दी 👩‍👩‍👧", "á̂ ÅÅÅ",
]


@pytest.fixture(scope="module")
def coder():
    return PieceCoder(MODEL)


def test_ids_and_text_are_the_librarys(spark, coder):
    df = spark.createDataFrame([(i % 4, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, key int, ids string").repartition(3)
    got = encode_texts(df, MODEL)
    assert got.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    out = sorted(((r["doc_id"], list(r["ids"]), r["decoded"], list(r["starts"]), list(r["ends"])) for r in got.collect()))
    want = []
    for i, t in enumerate(TEXTS):
        ids = coder.own.encode(t or "")
        want.append((i % 4, ids, coder.own.decode(ids)))
    assert [o[:3] for o in out] == sorted(want)


def test_spans_cover_the_text_in_order(coder):
    for t in TEXTS:
        data = (t or "").encode()
        ids, starts, ends = coder.encode(t or "")
        assert b"".join(data[s:e] for s, e in zip(starts, ends, strict=True)) == data
        for i, s, e in zip(ids.tolist(), starts, ends, strict=True):
            if not coder.own.is_byte(i):
                assert data[s:e].decode().replace(" ", "▁") in coder.own.id_to_piece(i)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_compiled_map_and_offsets(rule):
    """The same vocabulary behind a character map that the library compiles."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for n, v in message_fields(library.serialized_model_proto()) if n == _NORMALIZER)
    size = bytes([len(spec) & 127 | 128, len(spec) >> 7 & 127 | 128, len(spec) >> 14])
    with open(MODEL, "rb") as file:
        mapped = PieceCoder.from_bytes(file.read() + bytes([_NORMALIZER << 3 | 2]) + size + spec)
    for t in TEXTS[1:]:
        t = t[:3000]
        ids, starts, ends = mapped.encode(t)
        assert ids.tolist() == mapped.own.encode(t)
        normal, origin = mapped.normalize(t.encode())
        assert normal.decode() == mapped.own.normalize(t)
        # Each piece's span starts where the one before ended.
        assert all(a <= b for a, b in zip(starts, ends, strict=True))
        assert starts[1:].tolist() == ends[:-1].tolist()
        proto = mapped.own.encode(t, return_type="proto")
        own = [(p.id, p.begin, p.end) for p in proto.pieces]
        places = [len(t.encode()[:e].decode(errors="ignore")) for e in ends]
        for (i, _, end), at, mine in zip(own, places, ids.tolist(), strict=True):
            if not mapped.own.is_byte(i):
                assert (i, end) in ((mine, at), (mine, int(ends[own.index((i, _, end))])))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(df, MODEL).collect() == []


def test_query_on_the_table(spark, coder):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op2_sentence_pieces(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = coder.own.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(coder.own.decode(ids).encode()).hexdigest()
        assert r["covered_bytes"] == len(texts[r["doc_id"]].encode())
