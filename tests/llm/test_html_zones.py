"""Pages with furniture around and inside of articles, broken markup, and labelled pages the tree has not seen."""

from __future__ import annotations

import time
from functools import lru_cache

import pytest

from glossaria.llm import html_extract

TEXT = "<h1>A town</h1><p>the river rose through the night and people near the water left their houses</p><p>nobody was hurt</p>"
WANT = "A town the river rose through the night and people near the water left their houses nobody was hurt"
OTHER = "<p>one of many offers that you will want to see before the end of this week in our shop</p>"

# Blocks begin with + (main text) or -; none of these pages is in the table the tree is grown from.
HELD_OUT = (
    "<div id=header><a href=/>-evening post</a></div><div class=menu><a href=/1>-politics</a><a href=/2>-culture</a></div>"
    "<article><h1>+frost in may</h1><p>+the vines on the lower slopes lost their shoots in a single night</p><p>+growers lit fires "
    "between the rows</p><aside><p>-read more about the weather of the past ten years in our large overview</p></aside><p>+rain is "
    "expected</p><ul class=tags><li><a href=/t>-wine</a></li></ul></article><div class=newsletter><p>-a letter a week with all that "
    "matters from the valley and none of the noise</p></div><footer><p>-all rights reserved</p></footer>",
    "<main><h1>+how to sharpen a scythe</h1><ol><li>+hammer the edge thin</li><li>+wet the stone</li><li>+draw it along the blade"
    "</li></ol><p>+repeat this every quarter of an hour while you mow</p><div class=video-promo><p>-watch our film about mowing in "
    "the mountains now</p></div></main><div id=disqus><p>-my grandfather did it the same way and he mowed until he was ninety</p></div>",
    "<div class=wrapper><div class=breadcrumbs><a href=/>-home</a> <a href=/x>-letters</a></div><div class=story-body><p>+dear sister"
    "</p><p>+we arrived on the third of june after a crossing that i do not wish to repeat</p><p>+your brother</p></div><div "
    "class=related-stories><a href=/y>-the answer to this letter</a><p>-a box of letters found under the floor of the inn</p></div></div>",
    "<article><p>+the match ended without a goal</p><blockquote>+we had the chances and did not use them</blockquote><p>+said the "
    "trainer</p><div class='share social'><a href=/s>-share</a></div></article><section class=comments-area><h3>-two replies</h3>"
    "<p>-the referee should have seen that hand in the last minute of play</p></section><div class=ad-slot><p>-tickets for the next "
    "match are on sale</p></div>",
    "<table><tr><td>+year</td><td>+harvest in tons</td></tr><tr><td>+first</td><td>+forty</td></tr></table><p>+the table shows what "
    "the farm brought in after the new ditch was dug along the field</p><p><a href=/back>-back to the list</a></p>",
    "<form action=/all><div class=login-box><label>-name</label><p>-please sign in to see your list of books</p></div><div "
    "class=content><h2>+the library in winter</h2><p>+it opens at ten and closes when the light fails since there are no lamps in the "
    "reading room</p><p>+bring a coat</p></div></form>",
    "<body class='page has-sidebar'><header><h2>-the weekly bell</h2></header><div class=post><h1>+a bell for the chapel</h1><p>+it was "
    "cast in the yard because no cart could carry it up the lane</p></div><div class=sidebar-content><p>-the editor lives by the river "
    "with a dog and writes about bells</p></div><div class=cookie-bar><p>-this site keeps a small file on your machine</p></div></body>",
    "<nav><ul><li><a href=/1>-one</a></li><li>-search the archive by year or by name of the writer</li></ul></nav><section><h1>+ice</h1>"
    "<p>+blocks of ice were cut from the lake in january and kept under straw until august</p></section><section><h2>+straw</h2><p>+"
    "straw came from the lower farms</p></section><div class=pagination><a href=/p2>-next</a></div>",
)


@lru_cache
def tool():
    return html_extract.extractor()


def extract(page):
    return tool()([page])[0].to_pylist()[0]


@pytest.mark.parametrize("furniture", [
    f"<aside class=sidebar><div class='widget-content'>{OTHER}</div></aside>", f"<footer><div class='footer-content'>{OTHER}</div></footer>",
    f"<div class='sponsored-content'>{OTHER}</div>", f"<div class='cookie-modal'><div class='modal-content'>{OTHER}</div></div>",
    f"<div class='related-post'>{OTHER}</div>", f"<div class='main-menu'>{OTHER}</div>", f"<div class=site-footer>{OTHER}</div>",
    f"<nav><div class=content>{OTHER}</div></nav>", f"<aside>{OTHER * 5}</aside>", f"<div class=related><article>{OTHER}</article></div>",
    f"<section class=comments><article class=comment>{OTHER}</article></section>", f"<ol class='comments-open commentlist'><li>{OTHER}</ol>",
    f"<form><fieldset>{OTHER}</fieldset></form>", f"<div class='ad main'>{OTHER}</div>", f"<div id=adMainStory>{OTHER}</div>",
])
def test_furniture_beside_an_article_goes(furniture):
    for page in (f"<article>{TEXT}</article>{furniture}", f"{furniture}<div class=entry-content>{TEXT}</div>"):
        assert extract(page) == WANT, page


@pytest.mark.parametrize("page", [
    f"<body><form><div>{TEXT}</div></form></body>", f"<div id=page class='site has-sidebar'>{TEXT}</div>",
    f"<div class='product-comments-page'>{TEXT}</div>", f"<div class='product-comments-page'><article>{TEXT}</article></div>",
    f"<form id=aspnet><nav><a href=/>home</a></nav><div class=main>{TEXT}</div><div class=ad>{OTHER}</div></form>",
    f"<div class='legal notice'><article>{TEXT}</article></div>", f"<nav><a href=/>home</a><main>{TEXT}</main>",
    f"<article><div class=entry-header><h1>A town</h1></div>{TEXT.removeprefix('<h1>A town</h1>')}<div class=entry-footer>{OTHER}</div></article>",
    f"<article>{TEXT}<footer>{OTHER}</footer></article>", f"<body class='comments-closed single'>{TEXT}</body>",
    f"<div data-id='footer' aria-label=\"ad\">{TEXT}</div>", f"<article title=\"a > b\" lang=en'>{TEXT}</article>",
    f"<article><audio src=x>{TEXT}</article>", f"<article><p <b>{TEXT}</article>", f"</ x><article>{TEXT}</article><p",
])
def test_wrappers_and_broken_markup_lose_nothing(page):
    assert extract(page) == WANT


def test_text_with_angle_brackets_stays():
    assert extract("<article><p>if a < b and 3 <4 then b > a <3</p></article>") == "if a < b and 3 <4 then b > a <3"


def test_blocks_not_seen_before():
    right = wrong = missed = 0
    for page in HELD_OUT:
        found = html_extract.blocks(page)
        marks = [text.lstrip()[0] == "+" for text, *_ in found]
        plain = extract(page.replace(">+", ">").replace(">-", ">"))
        for (text, *_), good in zip(found, marks):
            # every block of the table is unlike the others
            kept = text[1:].strip().replace(" -", " ") in plain
            right, wrong, missed = right + (good and kept), wrong + (kept and not good), missed + (good and not kept)
    print(f"precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}, blocks {right + wrong + missed}")
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


@pytest.mark.parametrize("make", [
    lambda n: "<div>x" * n, lambda n: "<select><option>x" * n, lambda n: "<script " * n, lambda n: "<p class=\"" * n,
    lambda n: "<!-- " * n, lambda n: "</p " * n, lambda n: "<p a='" * n, lambda n: "<object>x" * n, lambda n: "<" * n,
    lambda n: "<nav><div>x" * n + "</nav>" * n, lambda n: "<svg " * n + ">", lambda n: "<p " + "a=\" \"   " * n + ">x",
    lambda n: "<p x" + " \"" * n + ">x", lambda n: "<title>" * n, lambda n: "&amp" * n, lambda n: "<p " + "class " * n + ">",
])
def test_time_grows_with_the_page(make):
    def seconds(n):
        page, began = make(n), time.process_time()
        extract(page)
        return time.process_time() - began

    extract("<p>x")
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)
