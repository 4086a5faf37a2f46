import random

import pytest

from cellweave.llm.residue import MARK, QUOTED, TRUSTED, Cutter, plain, residue_records, residue_scores

NAMES = "first_name order_no price city img_alt link_text total recipient plan author".split()
NOTICES = ["The page you asked for could not be found", "Service temporarily unavailable", "Internal server problem, try again later"]


def corpus():
    """Prose, prose with placeholders, error pages, texts that speak of both, and residue that no pattern names."""
    random.seed(9)
    words = "river bridge lantern wind letter baker station garden morning ledger stone boat valley clerk painter".split()
    say = lambda n: random.sample(words, n)
    prose = [" ".join(say(12)).capitalize() + "." for _ in range(500)]

    def inside(mark):
        w = say(14)
        w.insert(random.randint(2, 12), mark.format(random.choice(NAMES)))
        return " ".join(w) + "."

    plainly = [inside("{{{{{0}}}}}") for _ in range(60)] + [f"{random.choice([403, 404, 500, 503])}\n{m}\nHome Search" for m in NOTICES for _ in range(15)] + [f"<noscript>Skripte sind abgeschaltet.</noscript> {p}" for p in prose[:20]]
    hidden = [inside("~~{0}~~") for _ in range(30)] + NOTICES + [f"{p} Skripte sind abgeschaltet." for p in prose[:3]]
    spoken = [f'The clerk explained that the mark "{{{{{n}}}}}" stood for a name.' for n in NAMES for _ in range(3)] + [f"The {w} could not be found for days, then the baker saw it under the bridge." for w in words for _ in range(3)]
    return prose, plainly, hidden, spoken


def test_decisions_are_the_models(spark):
    parts = corpus()
    rows = [(1_000 * k + i, t) for k, part in enumerate(parts) for i, t in enumerate(part)]
    rows += [(9_000, NOTICES[0]), (9_000, NOTICES[0]), (9_001, None), (9_002, ""), (None, NOTICES[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS f", "3 AS probability")
    scores = {r.doc_id: r for r in residue_scores(docs).collect()}
    found = {i for i, r in scores.items() if r.probability > 0.5}
    of = lambda k: set(range(1_000 * k, 1_000 * k + len(parts[k])))
    assert not found & of(0) and not found & of(3)
    assert len(found & of(1)) >= 0.97 * len(of(1))
    assert not any(scores[i].labelled for i in of(2)) and len(found & of(2)) >= 0.95 * len(of(2))  # no pattern matches these
    got = [r.doc_id for r in residue_records(docs).collect()]
    assert sorted(got) == sorted(found) and 9_000 in found and not {9_001, 9_002, None} & set(got)


@pytest.mark.parametrize(
    "text,bits",
    [
        ("Dear {{first name}}, welcome.", {MARK | TRUSTED, 0}), ('The mark "{{x}}" stands there.', {MARK | QUOTED, 0}), ("A &lt;%= plan %&gt; here.", {MARK | TRUSTED, 0}), ("A [sic] here.", {MARK, 0}),
        ("404", {TRUSTED}), ("HTTP 503\nGone away", {TRUSTED}), ("plain words only", {0}), ("bla bla bla and more", {TRUSTED, 0}), ("She wrote <b>bold</b> words.", {0}), ("", set()), ("12 345 6", set()),
    ],
)
def test_labels(text, bits):
    assert set(Cutter().passages(text)[1]) == bits


def test_plain():
    assert plain("a&amp;amp;b <b>x</b>​y") == "a&b  x y"
    assert len(Cutter().passages("word " * 200_000)[0]) >= 1


def test_empty(spark):
    assert residue_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0
