"""Small cases of the corpus operators that fix what their rules let through."""

import re

import pytest

from pyspark.sql import functions as F

from gazeloom.llm import html_text, mixing
from gazeloom.llm.components import components

TEXT = ("The people of the town were in the house and it was as if they had been there with the others for a long time, "
        "but she was not with them and that is which of the things he had to be sure of when it was said to him by the others.")  # fmt: skip


@pytest.mark.parametrize("attributes", ['aria-hidden="false"', 'data-hidden="0"', 'class="text not-hidden wide"', 'title="is it hidden "', "data-aria-hidden=true", "data-role=banner"])
def test_only_own_hidden_attributes_hide(attributes):
    assert html_text.main_text(f"<article><div {attributes}><p>{TEXT}</p></div></article>") == TEXT


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'HIDDEN class="x"', 'aria-hidden="true"', "aria-hidden=TRUE", 'role="banner"'])
def test_hidden_elements_stay_out(attributes):
    assert html_text.main_text(f"<article><p>{TEXT}</p><div {attributes}><p>{TEXT} No.</p></div></article>") == TEXT


@pytest.mark.parametrize("name", ["elementor-widget", "social", "entry-header", "related"])
def test_names_are_hints_only(name):
    assert html_text.main_text(f'<article><div class="{name}"><h2>A title</h2><p>{TEXT}</p></div></article>') == "A title\n" + TEXT
    assert html_text.main_text(f'<nav><a href=x>a</a></nav><div class="{name}"><h2>A title</h2><p>{TEXT}</p></div>') == "A title\n" + TEXT
    assert html_text.main_text(f'<div class="{name}"><article><p>{TEXT}</p></article></div>') == TEXT
    assert html_text.main_text(f'<article><p>{TEXT}</p></article><div class="{name}"><p>{TEXT} No.</p></div>') == TEXT
    assert html_text.main_text(f'<article><p>{TEXT}</p><div class="ad">Buy it.</div></article>') == TEXT


OTHER = "I was there as well and they had all of the things that you say, but it was not for me, so I went to the house with her and that is what I have to say to you about it, if you want to know what it was that we had to do with it."
PAGE = "<{tag}><p>{text}</p><div {at}={name}><p>{other}</p><p>Sign up now</p></div></{tag}>"


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "newsletter", "cookie-notice", "related", "social", "login", "commentList", "related-posts", "social-share", "newsletter_signup", "gdpr-consent-bar", "reply", "sidebar-left", "disqus_thread"])
@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("at", ["class", "id"])
def test_what_no_article_holds_is_dropped_in_articles_too(tag, at, name):
    assert html_text.main_text(PAGE.format(tag=tag, at=at, name=name, text=TEXT, other=OTHER)) == TEXT


@pytest.mark.parametrize("name", ["related-work", "nav-theory", "entry-header", "has-sidebar", "no-comments", "social-history", "with-ads", "text", "cookies-recipe", "widget"])
def test_names_of_the_authors_own_stay(name):
    assert html_text.main_text(PAGE.format(tag="article", at="class", name=name, text=TEXT, other=OTHER)) == f"{TEXT}\n{OTHER}\nSign up now"


#: Layouts: what is around or in the article, and what is left of it; T is the article's long text, O another one.
LAYOUTS = {
    "plain": ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>T</p></article><footer>All rights</footer></body>", "Title\nT"),
    "comments as articles": ("<article><p>T</p></article><section class=comments><article class=comment><p>O</p></article></section>", "T"),
    "comments in the article": ("<article><p>T</p><section id=comments><h3>2 comments</h3><ol class=comment-list><li><p>O</p></li><li>Nice.</li></ol></section></article>", "T"),
    "sidebar in main": ("<main><div class=post><p>T</p></div><div class=sidebar><p>O</p><ul><li><a href=x>One</a></li></ul></div></main>", "T"),
    "consent before": ("<div id=cookie-consent><p>O</p><button>OK</button></div><main><p>T</p></main>", "T"),
    "consent in main": ("<main><div class=cookie-banner><p>O</p></div><p>T</p><p>Short end.</p></main>", "T\nShort end."),
    "newsletter between": ("<article><p>T</p><div class=newsletter-box><p>O</p><p>Join</p></div><p>O</p></article>", "T\nO"),
    "share row": ("<article><p>T</p><div class=share-buttons>Tweet this</div><p>Short end.</p></article>", "T\nShort end."),
    "caption": ("<article><p>T</p><figure><img src=x><figcaption>A view.</figcaption></figure><p>O</p></article>", "T\nA view.\nO"),
    "table": ("<article><p>T</p><table><tr><td>1</td><td>2</td></tr></table><p>O</p></article>", "T\n1\n2\nO"),
    "wrapper named for layout": ("<div class=content-with-sidebar><article><p>T</p></article><div class=sidebar><p>O</p></div></div>", "T"),
    "aside": ("<article><p>T</p><aside><p>O</p></aside></article>", "T"),
    "form": ("<article><p>T</p><form><p>O</p><input></form></article>", "T"),
    "hidden": ("<article><p>T</p><p hidden>O</p></article>", "T"),
    "only a comment page": ("<div class=comments><p>T</p><p>O</p></div>", "T\nO"),
    "links under": ("<article><p>T</p></article><ul class=related><li><a href=x>O</a></li></ul>", "T"),
    "advert": ("<article><p>T</p><div class=ad-box><p>O</p></div><div class=ad>Buy</div><p>Short end.</p></article>", "T\nShort end."),
    "header element": ("<article><header><h1>Title</h1></header><p>T</p></article>", "T"),
    "login in main": ("<main><div id=login-form><p>O</p></div><p>T</p></main>", "T"),
    "script and style": ("<article><script>var a='<p>O</p>'</script><style>p{}</style><p>T</p></article>", "T"),
    "breadcrumbs": ("<main><div class=breadcrumbs>Home News</div><p>T</p></main>", "T"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    page, want = LAYOUTS[layout]
    fill = lambda s: re.sub(r"\b[TO]\b", lambda m: TEXT if m[0] == "T" else OTHER, s)
    assert html_text.main_text(fill(page)) == fill(want)


def test_languages_without_stop_words():
    finnish = "Kaupungin asukkaat kokoontuivat torille, jossa vanhat talot seisoivat vieretysten ja lapset juoksivat. "
    for page in ('<html lang="fi"><nav><a href=x>koti</a></nav>', "<nav><a href=x>koti</a></nav>"):
        assert html_text.main_text(f"{page}<div><p>{finnish * 3}</p><p>{finnish}</p></div>") == (finnish * 3).strip() + "\n" + finnish.strip()
    assert html_text.main_text(f'<html lang="en"><p>{TEXT}</p><p>{finnish}</p></html>') == TEXT


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(1, 41)}


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_a_giant_document_leaves_no_gap_that_short_ones_fill(spark, seed):
    rows = [(0, "w " * 20_000, "a")] + [(i, "w " * 10, "a") for i in range(1, 2001)] + [(i, "w " * 20, "b") for i in range(3000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, seed=seed).groupBy(F.col("doc_id") < 3000).agg(F.first("target"), F.sum("taken"), F.max(F.col("taken") / F.col("size"))).collect()
    assert all(abs(target - taken) <= 10 and most <= 3 for _, target, taken, most in mixed) and len(mixed) == 2
