from catalog_fusion.llm.chat_format import BODY, CLOSE, NEXT, OPEN, escape, format_chats, read_chats, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def run(spark, rows):
    df = format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4))
    out = {r["conv_id"]: r for r in df.collect()}
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read_chats(df).collect()}
    return out, back


def test_adjacent_turns_of_a_role_merge_and_are_read_back(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", ""), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    out, back = run(spark, rows)
    assert out[1]["formatted"] == (
        f"{OPEN}user{BODY}a{NEXT}{NEXT}c{CLOSE}{OPEN}assistant{BODY}d{CLOSE}{OPEN}user{BODY}e{CLOSE}"
    )
    assert back[1] == [("user", "a", False), ("user", "", False), ("user", "c", False), ("assistant", "d", True), ("user", "e", False)]
    runs = out[1]["loss_runs"]
    assert sum(r["chars"] for r in runs) == len(out[1]["formatted"])
    at = 0
    for r in runs:
        if r["loss"]:
            assert out[1]["formatted"][at : at + r["chars"]] == "d"
        at += r["chars"]


def test_control_strings_come_back(spark, column):
    texts = ["</s>", "[INST]", "[/INST]", "[SEP]", "<s>", r"<\s>", r"[\\/INST]", r"<\\\/s>", "<<s>>", "[[SEP]]", "a\n</s>[INST] ok [/INST]\n", "", "\\", "[\\"]
    escaped = column(escape, texts)
    assert column(unescape, escaped) == texts
    assert not [e for e in escaped for c in (OPEN, BODY, NEXT, "[/INST]", "</s>") if c in e]
    assert len(set(escaped)) == len(texts)
    rows = [(5, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "</s>[SEP]") for t in texts)]
    _, back = run(spark, rows)
    assert [x[:2] for x in back[5]] == [r[2:] for r in rows]


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "wörd " * 50_000
    rows = [(None, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", long)]
    out, back = run(spark, rows)
    assert back[None] == [("", "", False), ("user", "x", False)]
    assert [t[1] for t in back[2]] == ["a", "a", "b"]
    assert back[3] == [("assistant", long, True)]
    assert out[3]["loss_runs"][1]["chars"] == len(long)


def test_empty_table(spark):
    assert run(spark, []) == ({}, {})


def test_many_turns_in_one_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(3000)]
    _, back = run(spark, rows)
    assert back[1] == [(r[2], r[3], r[2] == "assistant") for r in rows]
