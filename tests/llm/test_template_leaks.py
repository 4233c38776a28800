import itertools
import re

import numpy as np
import xxhash

from catalog_fusion.llm import template_leaks
from catalog_fusion.llm.queries import op7_template_leaks
from catalog_fusion.llm.template_leaks import LITERALS, SHARE, UNITS, WINDOW, _Tokens, canonical, find_leaks, without_leaks

QUESTION = "Anna has 12 apples and buys 5 kg of pears for 3 dollars each. How much does Anna pay if she sells 12 apples to Boris?"
OTHER = "the quick brown fox jumps over the lazy dog and runs home"


def words(text):
    """``(kind, value, may be a name)`` of each word, one by one."""
    out, before = [], "."
    for token in re.findall(r"\d(?:[\d.,]*\d)?|[^\W\d_]+|[.!?]", text or ""):
        low, opens = token.lower(), before in (".", "!", "?")
        kind, either = "=" + low, False
        if token[0].isdigit():
            kind = "number"
        elif low in UNITS:
            kind = "unit" if before == "number" else kind
        elif token[0].isupper() and token[1:].islower():
            kind, either = (kind, True) if opens else ("name", False)
        if token not in ".!?":
            out.append((kind, low, either))
        before = token if token in ".!?" else kind
    return out


def windows(text, size):
    """Place, identity, form and slots of each window in each of its forms."""
    w, need = words(text), min(LITERALS, (size + 1) // 2)
    for i in range(len(w) - size + 1):
        part = w[i : i + size]
        literal = sum(p[0][0] == "=" for p in part)
        openers = [j for j, p in enumerate(part) if p[2]]
        plain, own = tuple(p[0] for p in part), tuple(p[1] for p in part)
        identity = plain if literal >= need else ("own", own)
        if literal - len(openers) < need:
            yield i, identity, ("own", own), ()
        for n in range(min(len(openers), literal - need) + 1) if literal >= need else ():
            for chosen in itertools.combinations(openers, n):
                form = tuple("name" if j in chosen else p[0] for j, p in enumerate(part))
                yield i, identity, form, tuple(p[1] for p, k in zip(part, form, strict=True) if k[0] != "=")


def number(value):
    """As the operator sees a word, for the order of readings that tie."""
    n = xxhash.xxh3_64_intdigest(value)
    return n - (1 << 64) if n >> 63 else n


def settled(forms):
    """The forms of an alignment whose slots can stand together."""
    held = [(number(a), number(b)) for _, pairs in forms for a, b in pairs]
    if len(set(held)) == len({b for _, b in held}):
        return forms
    reading = []
    for a, b in sorted(set(held), key=lambda p: (p[0] != p[1], -held.count(p), p)):
        if all(a != x and b != y for x, y in reading):
            reading.append((a, b))
    return [f for f in forms if all(a == b for a, b in f[1]) or all((number(a), number(b)) in reading for a, b in f[1])]


def leaks(text, items, share=SHARE):
    """Items whose windows a text holds, by comparing every window with every other."""
    out = {}
    for item, body in dict.fromkeys(items):
        size = min(len(words(body)), WINDOW)
        if not size:
            continue
        own = {}
        for at, identity, form, slots in windows(body, size):
            own.setdefault((form, identity, slots), at)
        total = len({identity for _, identity, _ in own})
        lines = {}
        for at, _, form, slots in windows(text, size):
            for (other, identity, item_slots), item_at in own.items():
                if other == form:
                    best = lines.setdefault(at - item_at, {})
                    if at not in best or len(slots) < len(best[at][1]):
                        best[at] = (identity, list(zip(slots, item_slots, strict=True)))
        kept = [f for line in lines.values() for f in settled(list(line.values()))]
        found = {identity for identity, _ in kept}
        if found and len(found) / total >= share:
            value = (len(found), round(len(found) / total, 9), all(a == b for _, pairs in kept for a, b in pairs))
            out[item] = max(out.get(item, value), value, key=lambda v: (v[1], v[0], v[2]))
    return out


ITEMS = [(1, QUESTION), (2, OTHER), (3, None), (4, ""), (5, "two words"), (5, "two words"), (6, "What is 5 plus 7"), (7, "go go go go go go go go go go go go"), (8, "1 2 3 4 5 6 7 8 9 10"), (9, "17 + 25 + 31 - 8 = 65 and 4"),
    (10, "In Paris Anna Bob Clara Dora met Emil and Fritz"), (None, "an item that has no id but more than eight words in it"),
    *[(11, f"text number {w} of five that share an id and so must be told apart by what they say of {w}") for w in "one two three four five".split()]]
TEXTS = [
    None, "", "nothing of the kind here at all, really",
    "x y. " + QUESTION + " tail",
    QUESTION.replace("Anna", "Clara").replace("12", "31").replace("Boris", "Dora").replace("5 kg", "9 lbs"),
    # Slots that can't stand for the same values.
    "Anna has 12 apples and buys 12 kg of pears for 12 dollars each. How much does Carl pay if she sells 13 apples to Anna?",
    QUESTION.upper(), OTHER.replace("fox", "cat"), OTHER + " " + OTHER, "TWO   words", "i said two words to her",
    "what is 8 plus 9", "go " * 5000, "1 2 3 4 5 6 7 8 9 10 11", "é" * 20_000, ("filler text goes on " * 3000) + OTHER,
    "so 17 + 25 + 31 - 8 = 65 and 4 it is", "so 17 + 25 + 31 - 9 = 65 and 4 it is", "then In Paris Anna Bob Clara Dora met Emil and Fritz", "In Rome Anna Bob Clara Dora met Emil and Fritz",
    "and an item that has no id but more than eight words in it", "text number four of five that share an id and so must be told apart by what they say of four",
]


def frames(spark, texts=TEXTS, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, item_id int, name string, share double")
    return docs.repartition(3), spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, key string")


def test_pairs_equal_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]): (r["windows"], round(r["share"], 9), r["verbatim"]) for r in find_leaks(*frames(spark)).collect()}
    want = {(i, item): v for i, t in enumerate(TEXTS) for item, v in leaks(t, ITEMS).items()}
    assert got == want
    assert got[3, 1][2] and not got[4, 1][2] and (5, 1) not in got and (10, 5) in got
    arithmetic, places, nameless = len(TEXTS) - 6, len(TEXTS) - 4, len(TEXTS) - 2
    assert got[arithmetic, 9][2] and (arithmetic + 1, 9) not in got and got[places, 10][2] and got[nameless, None][1:] == (1.0, True)
    assert got[nameless + 1, 11][1:] == (1.0, True)


def test_random_documents_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    bank = ["Anna", "Bob", "pays", "12", "7", "kg", "for", "the", "a", "to", "gets", "x.", "sum", "of", "El"]
    text = lambda n: " ".join(rng.choice(bank, n))
    items = [(i, text(int(rng.integers(5, 30)))) for i in range(12)]
    texts = []
    for _ in range(60):
        body = items[rng.integers(12)][1].split()
        for _ in range(int(rng.integers(0, 4))):
            body[rng.integers(len(body))] = str(rng.choice(bank))
        texts.append(" ".join([text(10), *body, text(10)]))
    got = {(r["doc_id"], r["item_id"]): (r["windows"], round(r["share"], 9), r["verbatim"]) for r in find_leaks(*frames(spark, texts, items)).collect()}
    assert got == {(i, item): v for i, t in enumerate(texts) for item, v in leaks(t, items).items()}


def test_windows_that_many_items_share(spark, monkeypatch):
    """They open no pairs, but count for those that others open, and for items made of them."""
    monkeypatch.setattr(template_leaks, "COMMON", 3)
    task = "Read the following story with care and answer the question that stands below it"
    stories = [" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(60)) for i in range(12)]
    items = [(i, f"{task} {s}") for i, s in enumerate(stories)] + [(100 + i, f"{task} {c}") for i, c in enumerate("abcd")]
    texts = [task, f"{task} {stories[3]}", stories[4], f"{stories[5]} and {task}", "nothing of it", f"x {task} d"]
    got = {(r["doc_id"], r["item_id"]): (r["windows"], round(r["share"], 9), r["verbatim"]) for r in find_leaks(*frames(spark, texts, items)).collect()}
    assert got == {(i, item): v for i, t in enumerate(texts) for item, v in leaks(t, items).items()}
    assert (0, 0) not in got and (0, 100) in got and got[1, 3][1] == 1.0


def test_rows_with_a_leak_go_and_only_those(spark):
    docs, items = frames(spark)
    left = without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, t in enumerate(TEXTS) if not leaks(t, ITEMS)]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert find_leaks(docs.limit(0), items).collect() == []
    assert find_leaks(docs, items.limit(0)).collect() == []
    assert without_leaks(docs, items.limit(0)).count() == len(TEXTS)


def test_placeholders():
    _, template, values, slots = canonical(["It cost 5 kg. Kg of Anna In 7 in"], _Tokens())
    assert slots.tolist() == [False, False, True, True, False, False, True, False, True, True]
    assert len(set(template[[2, 8]].tolist())) == 1 and len(set(values[[2, 8]].tolist())) == 2


def test_query_finds_every_copied_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(d["doc_id"], i) for i, t in items for d in docs if plain(t) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in op7_template_leaks(spark, sf).collect()}
    assert want and want <= got
    grams = lambda t: {tuple(w[i : i + 8]) for w in [plain(t).split()] for i in range(len(w) - 7)}
    texts = {d["doc_id"]: grams(d["text"]) for d in docs}
    assert all(texts[d] & grams(dict(items)[i]) for d, i in got)
