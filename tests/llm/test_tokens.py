import random

import pytest

from cellweave.llm.queries import TOKENIZER
from cellweave.llm.tokens import Encoder, chunk_ends, encode_corpus

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def exact():
    t = tokenizers.Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def texts():
    random.seed(7)
    alphabet = " \n\t  a'sdté中9.!٣​🙂"
    shared = "".join(random.choice("abcdefgh ,.") for _ in range(4000))
    out = ["", None, "a", " ", "<|endoftext|> x", "x" * 20_000, " " * 3000, "ab" * 6000, shared, "head " + shared, shared + " tail", "don't " * 500, "中文" * 2000]
    return out + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 1500))) for _ in range(60)]


def test_joins_are_exact(exact):
    with open(TOKENIZER, "rb") as f:
        e = Encoder(f.read())
    for t in texts():
        for mean, least in ((4, 1), (16, 3), (512, 64)):
            at, parts = 0, []
            for end in chunk_ends(t or "", mean, least):
                parts.append(e.chunk(t[at:end]))
                at = end
            assert e.join(parts) == exact(t or "")


def test_copies_are_cut_alike():
    random.seed(8)
    body = "".join(random.choice("abcdefgh ,.") for _ in range(9000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunk_ends(t)], chunk_ends(t), strict=False)}
    assert len(cut(body) & cut("something else before it " + body)) >= len(cut(body)) - 2


def test_corpus(spark, exact):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "null id", "", 1), (3, "again", "", 1), (3, "again", "", 1)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string, row int"), TOKENIZER).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(r[0]), exact(r[1] or "")) for r in rows)
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0
