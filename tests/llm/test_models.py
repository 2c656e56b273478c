"""Learned operators on held-out rows, their recursions against brute force, HTML extraction."""

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from rowwarden.llm import html, language, toxicity
from tests.llm.conftest import rows_of


def test_posteriors_sum_all_paths():
    rng = np.random.default_rng(1)
    potentials, moves = rng.random((6, 3)).astype(np.float32) + .1, rng.random((3, 3)).astype(np.float32) + .1
    codes, bounds = np.array([0, 1, 2, 3, 5, 4, 4, 0]), np.array([0, 1, 5, 5, 8])
    found = language.posteriors(potentials, codes, bounds, moves)
    for a, b in zip(bounds, bounds[1:], strict=False):
        want = np.zeros((b - a, 3))
        for path in product(range(3), repeat=int(b - a)):
            p = math.prod(float(potentials[codes[a + n], s]) for n, s in enumerate(path))
            p *= math.prod(float(moves[s, t]) for s, t in zip(path, path[1:], strict=False))
            for n, s in enumerate(path):
                want[n, s] += p
        if b > a:
            assert np.allclose(found[a:b], want / want.sum(1, keepdims=True), atol=1e-5)


def spoken(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"aa": ["ba", "bo", "lu"], "bb": ["sch", "ung", "keit"], "cc": ["né", "oux", "tre"]}


def test_languages_of_held_out_rows(documents, awkward, nothing):
    rng = random.Random(2)
    rows = [(n, spoken(rng, SYLLABLES[lang], rng.randint(5, 60)), lang) for n in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    mixed = spoken(rng, SYLLABLES["aa"], 60) + " " + spoken(rng, SYLLABLES["bb"], 25)
    extra = [(1000, None, "aa"), (1001, "12 34 !?", "aa"), (1002, mixed, None), (None, spoken(rng, SYLLABLES["cc"], 9), "cc"), (3, rows[3][1], rows[3][2])]
    found = language.identify(documents(*rows, *extra)).collect()
    by_id = {row["doc_id"]: row for row in found}
    held = [r for r in rows if by_id[r[0]]["held_out"]]
    assert len(found) == 405 and 40 < len(held) < 120
    assert sum(by_id[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= row["score"] <= 1 for row in found)
    for n in (1000, 1001):
        assert (by_id[n]["lang_pred"], by_id[n]["score"]) == ("und", 0.0)
    assert by_id[1002]["lang_pred"] == "aa" and 0.6 < by_id[1002]["score"] < 0.8  # 60 of 85 words
    assert by_id[None]["lang_pred"] == "cc" and by_id[None]["held_out"] is False
    assert language.identify(nothing).collect() == []
    kept = language.recognised_documents(awkward)
    assert kept.columns == awkward.columns and all(row["text"] and row["text"].strip() for row in kept.collect())
    unlabelled = documents((1, "ba bo", None))
    assert rows_of(language.identify(unlabelled).select("lang_pred", "score")) == [("und", 0.0)]


def test_rare_languages_are_learned(documents, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_DOCS", 150)
    rng = random.Random(4)
    rows = [(n, spoken(rng, SYLLABLES[lang], 30), lang) for n in range(3000) for lang in ["cc" if n % 300 == 7 else rng.choice(["aa", "bb"])]]
    rows += [(9, "ba lu", "dd"), *[(rows[7][0], rows[7][1], "cc")] * 500]  # a label of one row; a repeated row
    docs = documents(*rows)
    found = {row["doc_id"]: row["lang_pred"] for row in language.identify(docs).collect()}
    assert [found[n] for n in range(3000) if rows[n][2] == "cc"] == ["cc"] * 10
    drawn = language.training_rows(docs)
    assert sum(lang == "cc" for _, lang in drawn) in range(5, 11)  # but those of fold 0
    assert "dd" in {lang for _, lang in drawn} and 150 < sum(lang == "aa" for _, lang in drawn) < 250 and len(drawn) < 500


def test_documents_without_any_language_stay(documents):
    docs = documents((1, "ba bo", None), (2, "12 34", None), (3, None, None), (4, " é ", None))
    assert rows_of(language.recognised_documents(docs).select("doc_id")) == [(1,), (4,)]


def test_grammar_states():
    t, automaton = toxicity, toxicity.Automaton()
    read = lambda *symbols: t.KINDS[automaton.read(list(symbols))]
    assert read(t.TARGET, t.OTHER, t.INSULT) == (2, 0, 1, 0)
    assert read(t.NEGATION, t.OTHER, t.INSULT) == (1, 0, 0, 0)
    assert read(t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT) == (2, 0, 0, 0)  # out of scope
    assert read(t.REPORT, t.THREAT, t.NEGATION, t.INSULT) == (1, 2, 0, 1)
    assert automaton.read([t.TARGET, t.OTHER]) == -1


def test_clauses_are_scored():
    grammar = toxicity.Grammar({"oaf", "blith*"})
    texts = ["you are an oaf.", "a calm, long day.", "she is not an oaf", "he said you are an oaf", "Blithering! crowd", "I will kill you, oaf", "", "oaf"]
    score = dict(zip(texts, grammar.scores(pa.array(texts)), strict=True))
    assert score["you are an oaf."] > score["oaf"] > score["she is not an oaf"] and score["you are an oaf."] > score["he said you are an oaf"]
    assert score["Blithering! crowd"] > 0.5 and score["I will kill you, oaf"] > 0.5
    assert score[""] == score["a calm, long day."] < 0.1


def test_toxicity_of_held_out_rows(documents, spark, awkward, nothing):
    rng = random.Random(3)
    rows, labels = [], []
    for n in range(500):
        words, toxic = spoken(rng, ["ba", "lu", "ti", "mo"], 40).split(), int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grunk", "Grunk,", "zoltox", "zoltai", "zolter."]))
        rows.append((n, " ".join(words)))
        labels.append((n, toxic))
    table = spark.createDataFrame([*labels, (0, labels[0][1]), (None, 1), (9999, None)], "doc_id long, toxic int")
    found = {row["doc_id"]: row for row in toxicity.score(documents(*rows, (2000, None), (None, "x")), table).collect()}
    held = [(i, y) for i, y in labels if found[i]["held_out"]]
    assert len(held) > 60 and sum(found[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert all(row["predicted"] == int(row["score"] >= 0.5) and 0 <= row["score"] <= 1 for row in found.values())
    assert found[2000]["predicted"] == 0 and found[None]["held_out"] is False
    assert toxicity.score(nothing, table).collect() == []
    assert toxicity.score(awkward, table.limit(0)).count() == awkward.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p><p>no";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies on this site and you have to accept all of them now.</div>
<article><header><h1>Short title</h1></header><p>The first paragraph of the text is &amp;here&amp and it is long&nbsp;enough&#33;
<p>Tiny.<p><a href="x>y">A link inside the article</a></p><pre>a   b</pre>one<br>two<br/><br>three
<aside>See also the other one</aside><form>Name <input></form>
<section class="comments"><p>I think that this is the best text of them all.</p></section></article>
<footer>&copy; 2024</footer>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Short title\nThe first paragraph of the text is &here& and it is long enough!\nTiny.\na b\none two\nthree"),
    ("", ""), ("no markup at all", "no markup at all"), ("Breaking: shop closed", "Breaking: shop closed"), ("<p>" + "the cat and the dog of the man in a house " * 2, ("the cat and the dog of the man in a house " * 2).strip()),
    ("<p>Heading</p><p>" + "it is the end of the day and a long one " * 2 + "</p><p>next<div id=nav>the a of</div>",
     "Heading\n" + ("it is the end of the day and a long one " * 2).strip() + "\nnext"),
    ("<article>a < b <b title='x", "a < b <b title='x"), ("<article><p>x</p><script>never closed <p>y", "x"),
    ("<article><p>1</p></div></article></p><p>out</p>", "1"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def plain_labels(labels, article):
    """The second pass by looking at all pairs of blocks."""
    out = []
    for n, label in enumerate(labels):
        near = sorted((abs(n - k), k > n, other) for k, other in enumerate(labels) if other != html.UNSURE)
        sides = [{later for _, later, other in near if later == side} and next(o for _, later, o in near if later == side) for side in (False, True)]
        if label == html.UNSURE and near:
            label = near[0][2] if not article else html.BAD if sides == [html.BAD, html.BAD] else html.GOOD
        out.append(label)
    return out


def test_second_pass_equals_all_pairs():
    rng = random.Random(6)
    for _ in range(500):
        labels = rng.choices([html.GOOD, html.BAD, html.UNSURE], [1, 1, 3], k=rng.randint(0, 12))
        for article in (False, True):
            assert html.inherited(labels, article) == plain_labels(labels, article)


FINNISH = "Koira juoksi metsän läpi nopeasti kohti järveä jossa kalat uivat hiljaa syvällä"
ENGLISH = "it is the end of the day and a long one for all of us"


@pytest.mark.parametrize(("page", "text"), [
    (f"<div>{FINNISH}</div><div>{FINNISH}</div>", f"{FINNISH}\n{FINNISH}"),
    (f"<nav>Etusivu</nav><ul><li><a href=/>Linkki</a></ul><h1>Otsikko</h1><p>{FINNISH}</p><footer>Loppu</footer>", f"Otsikko\n{FINNISH}"),
    ("<table><tr><td>one<td>two<tr><td>three</table><p>- Hi!<p>- Hello.", "one\ntwo\nthree\n- Hi!\n- Hello."),
    (f"<nav>Home</nav><h1>Title</h1><p>{ENGLISH}</p>", f"Title\n{ENGLISH}"),
    (f"<p>{ENGLISH}</p><p>End</p><footer>Imprint</footer>", f"{ENGLISH}\nEnd"),
    (f"<p>{ENGLISH}</p><p>near</p><p>far</p><p><a href=/>More</a></p>", f"{ENGLISH}\nnear"),
    ("<nav>Home</nav><footer>Imprint</footer>", ""), (FINNISH, FINNISH),
])
def test_pages_without_article(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<article class=teaser>Read more</article><div><p>{ENGLISH}</p><p>{ENGLISH} too</p></div>", f"Read more\n{ENGLISH}\n{ENGLISH} too"),
    (f"<article><h1>Title</h1><p>{ENGLISH}</p><p>Short</p></article><div>{ENGLISH}</div>", f"Title\n{ENGLISH}\nShort"),
    (f"<article><p>{ENGLISH}</p><ul><li><a href=/>one</a></li></ul><h2>Next</h2><p>{ENGLISH}</p></article>", f"{ENGLISH}\nNext\n{ENGLISH}"),
    (f"<article><p>{ENGLISH}</p><p>near</p><p>far</p><p><a href=/>More</a></p></article>", f"{ENGLISH}\nnear\nfar"),
    (f"<article><p>{ENGLISH}</p><p><a href=/>More</a></p><p>or</p><p><a href=/>Less</a></p><p>End</p></article>", f"{ENGLISH}\nEnd"),
    (f"<article><p>{FINNISH}</p><p>Lyhyt</p></article>", f"{FINNISH}\nLyhyt"),
    (f"<article><p data-x='{'>' * 12_000}'>{ENGLISH}</p></article>", ENGLISH),
    (f"<p title=\"{'a>' * 200_000}\" class='x'>{ENGLISH}", ENGLISH),
])
def test_texts_decide_on_pages_with_articles(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("opening", [
    "<article class='post has-sidebar'>", "<main class=no-sidebar>", "<article class=sidebar>", "<article id=search-result-7>",
    "<body class='nav menu'><article>", "<main class=search><article class=post>", "<div class='content social-news'>",
    "<div id=search-result-7>", "<div data-id=menu data-role=nav>", "<div title='a class=nav b'>", "<div class=with-comments>",
])
def test_marks_that_are_none(opening):
    assert html.main_text(f"{opening}<p>{ENGLISH}</p>") == ENGLISH


@pytest.mark.parametrize("opening", [
    "<div class=ad>", "<div class='x site-footer'>", "<section ID='comment-7'>", "<ol class=comment-list>", "<div role=navigation>",
    "<div data-x='1'class=\"nav\">", "<article class=comment>", "<div class=left_sidebar>", "<section class=comments><article class=comment>",
])
def test_marks_inside_an_article(opening):
    assert html.main_text(f"<article><p>{ENGLISH}</p>{opening}<p>{FINNISH}</p>") == ENGLISH


def test_extraction_of_awkward_pages(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<article><p>é😀</p>"), (2, "u", "<article>" + "<p>x</p>" * 50_000), (3, "u", "<a \"" * 20_000)]
    pages = spark.createDataFrame([(*row, "x", 1) for row in rows], "page_id long, url string, html string, text string, n_chars int")
    found = {(row["page_id"], row["url"]): row for row in html.extract(pages).collect()}
    assert found[(None, "u")]["text"] == "é😀" and found[(None, "u")]["n_chars"] == 2
    assert found[(1, "u")]["text"] == "" == found[(1, None)]["text"] and found[(2, "u")]["n_chars"] == 99_999
    assert html.extract(pages.limit(0)).collect() == []
