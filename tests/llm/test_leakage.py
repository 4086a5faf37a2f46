import random

import pytest

from cellweave.llm.leakage import leaked_items, word_offsets, words_of

ITEM = "Chaque chout jèjeau cette boj depuis la caille peau passe notre saisè fin"
DOCS = [
    (1, "avant. " + ITEM + " après"),
    (2, "CHAQUE CHOUT, JÈJEAU -- cette\nboj depuis   la caille peau passe!"),
    (3, "Cha-\nque cho-\nut jèjeau cet​te <b>boj</b> depuis la ca­ille&nbsp;peau passe"),
    (4, "chaque chout j&egrave;jeau cette boj &lt;i&gt;depuis&lt;/i&gt; la caille peau passe"),
    (5, "chaque chout jèjeau cette boj depuis la caille peau autre passe"),  # nine in a row
    (6, "xchaque chout jèjeau cette boj depuis la caille peau passe"),  # begins inside a word
    (7, None),
    (8, ""),
    (None, ITEM),
    (9, "ｃｈａｑｕｅ chout jèjeau cette boj depuis la caille peau passe notre saisè fin"),
]


def test_words():
    assert words_of("Ünïcode ﬁne²​ x_y &amp;lt; <br>z") == ["unicode", "fine2", "x", "y", "z"]
    assert words_of("हिन्दी में") == words_of("हिन्दी, में!")


def test_found(spark):
    docs = spark.createDataFrame(DOCS + DOCS[:1], "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS begin")
    items = spark.createDataFrame([(10, ITEM), (11, "other words that stand nowhere in these texts at all today"), (12, None), (13, "chaque chout"), (None, ITEM), (14, ITEM)], "item_id long, text string")
    got = leaked_items(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2, 3, 4, 9) for i in (10, 14)}
    with pytest.raises(ValueError):
        leaked_items(docs, items, most_bytes=100)
    text = dict(DOCS)
    at = {(r.doc_id, r.item_id): text[r.doc_id][r.begin : r.end] for r in got}
    assert at[1, 10] == ITEM
    assert at[4, 10].startswith("chaque chout j&egrave;jeau") and at[4, 10].endswith("passe")
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_offsets_name_the_words():
    for _, t in DOCS:
        if t:
            assert len(word_offsets(t)) == len(words_of(t))


def brute(docs, items, least=10):
    runs = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - least + 1) for i in runs.get(tuple(w[k : k + least]), ())}


def test_many_items_and_every_alignment(spark):
    random.seed(3)
    words = [f"w{random.randint(0, 10**6):x}q" for _ in range(3_000)]
    say = lambda n: [random.choice(words) for _ in range(n)]
    items = [(i, say(random.randint(8, 30))) for i in range(21_000)]
    docs = []
    for d in range(600):
        w = say(40)
        for _ in range(2):
            own = random.choice(items)[1]
            a = random.randint(0, max(0, len(own) - 9))
            at = random.randint(0, 30)
            w[at:at] = own[a : a + random.randint(8, 14)]
        docs.append((d, " ".join(w)))
    items = [(i, " ".join(t)) for i, t in items]
    want = brute(docs, items)
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 300 and {(r.doc_id, r.item_id) for r in got} == want


def test_escaped_many_times():
    t = "a < b"
    for _ in range(6):
        t = t.replace("&", "&amp;").replace("<", "&lt;")
    assert words_of(t) == ["a", "b"]
