"""Main text of web pages from flat blocks and a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its
number of words and its link density, those of the blocks before and after it,
whether it is a heading or list item, and its zone: inside an article, inside
page furniture (by tag, or by words in class, id and role), or neither. A
decision tree (CART, Gini) decides from these numbers. It is trained, at import
time of the first page in a task, on the small labelled table ``LABELLED``:
short pages whose blocks begin with ``+`` (main text) or ``-``.

Scripts, styles, comments, titles and other elements without page text never
make blocks. Character references are decoded, white space inside a block
becomes one space, blocks are joined by one space. Broken markup is read as it
stands: unclosed elements reach to the end of their container, an unfinished
tag at the end of the page is no text.

Null and empty pages have empty text. Pages are read whole. Repeated rows are
extracted alike. Other columns pass through; a column named like an output is
replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossaria.llm.common import map_texts

# HTML element names by their role, and words used in class, id and role attributes.
RAW = "script style iframe title"
UNSEEN = "noscript template svg math object video audio canvas"
BLOCK = (
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li link main menu meta nav ol "
    "optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul"
)
CONTAINERS = (
    "article aside body button dialog div fieldset footer form header label main menu nav ol option search section select "
    "table td textarea ul"
)
FURNITURE = "aside button footer label menu nav option search select textarea"
WRAPPING_FURNITURE = "dialog fieldset form"  # also put around whole pages
ARTICLE_WORDS = "article articlebody content entry maincontent main post story"
FURNITURE_WORDS = (
    "ad ads advert advertisement alert author banner bio breadcrumb breadcrumbs byline captcha consent contentinfo cookie "
    "cookies copyright cta dialog disclaimer footer form gdpr legal links login menu menubar meta modal nav navbar "
    "navigation newsletter notice notification outbrain overlay pager pagination popup privacy promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola "
    "tag tags teaser toc toolbar topbar widget"
)
COMMENT_WORDS = "comment commentlist comments disqus replies respond"
# Words of comments that pages about other things have as well: no zone of comments, but furniture to the tree.
WEAK_COMMENT_WORDS = "discussion feedback reply reviews"
# Class names with these words tell about a page ("comments-open", "has-sidebar"), they do not name a part of it.
STATE_WORDS = "closed has is no off on open with without"
PAGE_WORDS = "page site"  # beside words of comments: a page that has comments

RAW_SET, UNSEEN_SET, BLOCK_SET, CONTAINER_SET = (set(x.split()) for x in (RAW, UNSEEN, BLOCK, CONTAINERS))
FURNITURE_SET, WRAPPING_SET, ARTICLE_SET = (set(x.split()) for x in (FURNITURE, WRAPPING_FURNITURE, ARTICLE_WORDS))
FURNITURE_WORD_SET, COMMENT_SET = set(f"{FURNITURE_WORDS} {WEAK_COMMENT_WORDS}".split()), set(COMMENT_WORDS.split())
STATE_SET, PAGE_SET = set(STATE_WORDS.split()), set(PAGE_WORDS.split())
NAME = re.compile(r"[a-zA-Z][^\s/><]*")
TAG_STOP = re.compile(r"[<>\"']")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.IGNORECASE) for n in RAW_SET | UNSEEN_SET}
NAMED = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading", "item",
)
OUTPUTS = T.StructType([T.StructField("main_text", T.StringType()), T.StructField("n_blocks", T.IntegerType())])

# The labelled table. Blocks begin with + (main text) or - (everything else).
LABELLED = (
    "<nav><ul><li><a href=/a>-home</a></li><li><a href=/b>-world news</a></li><li><a href=/c>-sport</a></li></ul></nav>"
    "<div class=ad>-buy one of these and get the second for free today</div><article><h1>+a town rebuilds its bridge</h1>"
    "<p>+work on the old stone bridge began on monday after two years of planning and a long search for money<p>+the mayor "
    "said the town had waited long enough</p><p>+short.</p></article><footer>-copyright of the town paper all rights "
    "reserved</footer>",
    "<header><a href=/>-the daily</a><p>-news since long ago</p></header><main><h1>+rain</h1><p>+rain fell.</p><p>+rivers "
    "rose through the night and people near the water left their houses</p><blockquote>+we saw the water come</blockquote>"
    "<ul><li>+boots</li><li>+a lamp and dry matches</li></ul><h2>+what is next</h2><p>+more <a href=/x>rain is expected"
    "</a> on friday</p></main><aside><h3>-most read</h3><p>-ten ways to cook an egg that you did not know about</p></aside>"
    "<form><label>-your mail address</label><p>-get the best of the week in one letter</p></form>",
    "<div id=top class=cookie-notice><p>-we use cookies to make this site better for you and our partners</p></div>"
    "<div class=post-content><h1>+on bread</h1><p>+flour water salt and time are all that it needs</p><p>+fold the dough "
    "every half hour</p><p>+bake</p></div><div class=comments><h3>-two comments</h3><p>-great recipe my bread came out well "
    "and the whole family liked it</p><p>-thanks</p></div><div class=sidebar><p>-about me</p><p>-i bake bread and write "
    "about it for people who like bread</p></div>",
    "<h1>+notes on a garden</h1><p>+the beds were dug over in march and left to the frost for some weeks</p><p>+then came "
    "the beans which like a warm soil and much water</p><p><a href=/1>-one</a> <a href=/2>-two</a> <a href=/3>-next page"
    "</a></p><p><a href=/about>-about this site</a></p>",
    "<div><a href=/1>-first</a> <a href=/2>-second</a></div><div><p>+the ship left port at dawn with forty men and food for "
    "a month at sea</p><p>+no storm came and the wind held all the way to the islands in the south</p></div><div><a "
    "href=/3>-imprint</a> <a href=/4>-contact us</a></div>",
    "<article><header><h1>+the long road</h1></header><p>+they walked from spring to autumn along the river and over the "
    "hills</p><p>+home.</p><table><tr><td>+day</td><td>+miles</td></tr></table><footer>-filed under travel</footer><section "
    "class=comments><article><p>-what a fine story i have walked there myself in my youth</p></article></section></article>",
    "<article><p>+the report came out in may</p><p><a href=/r>+read the report of the council in full</a></p><ul><li><a "
    "href=/m>+map of the valley</a></li><li><a href=/n>+names</a></li></ul></article><div><a href=/4>-contact us</a></div>",
    "<nav><p>-all that you may want to find here is listed below by subject and by year so that old pieces turn up as well</p>"
    "</nav><article><p>+yes</p><p>+it was the last summer before the mill closed and everyone in the valley came to see the "
    "wheel turn once more for an afternoon</p></article><footer><p>-this paper is printed on the hill since the year of the "
    "great flood and delivered to every house in the valley twice a week</p><p>-imprint</p></footer>",
    "<div class=advert>-the new lamp burns for forty hours on one filling and costs less than a candle does in all good "
    "shops of the country from today</div><p>+they sang</p><p>+the choir had come over the pass in two carts and sang until "
    "the lights went out in all the houses around the square</p><div class=comments><p>-i remember that evening well since "
    "i was one of the singers and we had to sleep in the school because of the snow</p></div>",
    "<form><p>-please tell us your name and the street where you live so that we can send the catalogue of this year to you "
    "without delay</p></form><main><p>+no one knows</p><p>+where the old road went is not on any map that the archive of "
    "the county keeps in its cellar</p><p><a href=/q>+maps</a></p></main><aside><p>-the weather of the week will be fine in "
    "the south and wet in the north with some wind on the coast and over the lakes</p><p>-fine</p></aside>",
    "<h1>+a plain page</h1><p>+it has no furniture at all and ends with its last paragraph</p><p>+like this</p>",
    "<div><h2>+minutes</h2><p>+the meeting began at eight</p><ul><li>+accounts</li><li>+repairs of the roof</li></ul><p>+it "
    "ended at ten after a long talk about the price of coal</p></div>", "<p>+a page with a single block</p>", "<p>+hello</p>",
    "<a href=/1>-back</a>", "<p>+the old shop is closed</p><p><a href=/map>-map</a></p>",
    "<div class=promo-banner>-subscribe now and save half of the price for one year</div><article><p>+one</p><p>+two words"
    "</p><div class=newsletter-signup><p>-do you like this then read our letter every morning</p></div><p>+the third part of "
    "the text follows after the box and goes on for a while</p><div class=share-links><a href=/s>-share this</a></div>"
    "</article><div class=related><h4>-read also</h4><p>-how a small town saved its old library from the rain</p></div>",
    "<div class=page-wrap><div class=site-header><p>-news of the coast</p></div><div class='col has-sidebar'><div class=entry-content>"
    "<h1>+salt</h1><p>+salt was carried over the hills on mules until the railway came through the pass and put an end to it</p>"
    "<ol><li>+mules</li><li>+carts</li></ol><p>+no trace is left</p></div><aside class=sidebar><div class=widget-content><p>-join the "
    "walk of our readers on the first sunday of the month and bring good shoes and some bread</p></div><div class=widget><p>-map"
    "</p></div></aside></div><footer><div class=footer-content><p>-printed in the old customs house by the harbour since the year "
    "of the great storm</p></div></footer></div>",
    "<form id=all><div class=main-menu><ul><li><a href=/1>-start</a></li><li><a href=/2>-all letters</a></li></ul></div><div><h1>+the "
    "clock</h1><p>+the clock of the tower has stood still since the winter when the keeper left and nobody learned how to wind it"
    "</p><p>+it shows ten past four</p><p>+children say that it waits</p></div><div class='modal-content notice'><p>-you have read "
    "three of five free pieces this month so please think about a subscription</p></div></form>",
    "<article class='post comments-open'><header class=entry-header><h1>+a house by the sea</h1></header><div class=post-content><p>+"
    "the house stood empty for years before two sisters bought it and mended the roof</p><table><tr><td>+roof</td><td>+two months"
    "</td></tr></table><figure><figcaption>+the house in spring</figcaption></figure></div><div class=sponsored-content><p>-a new "
    "paint keeps salt and wind from your walls for twenty years or you get your money back</p></div><footer class=post-meta><p>-by "
    "our own writer</p></footer></article><section id=comments><h2>-what readers say</h2><ol class=commentlist><li><div "
    "class=comment-content><p>-we lived next door and saw them carry every tile up by hand that summer</p></div></li></ol></section>",
)


# Kinds of containers. A wrapping one is furniture unless most of the page is in it.
PLAIN, ARTICLE_TAG, ARTICLE_NAME, HEADER, FURNITURE_TAG, WRAPPING, COMMENTS = range(7)


def kind_of(name: str, attributes: str) -> int:
    """What a container is by its element name, else by the names in its attributes.

    In one name, words of furniture outweigh those of articles (``sponsored-content``);
    ``body``, ``main`` and ``article`` are never comments.
    """
    comments = furniture = article = header = False
    for m in NAMED.finditer(attributes) if attributes else ():
        for token in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in WORD.findall(token)}
            if words & STATE_SET:
                article = article or bool(words & ARTICLE_SET)
            elif words & COMMENT_SET:
                comments = comments or not words & PAGE_SET
            elif words & FURNITURE_WORD_SET:
                furniture = True
            elif words & ARTICLE_SET:
                article = True
            header = header or "header" in words
    if comments and name not in ("body", "main", "article"):
        return COMMENTS
    if name in FURNITURE_SET:
        return FURNITURE_TAG
    if name in ("article", "main"):
        return ARTICLE_TAG
    if name in WRAPPING_SET or (furniture and name != "body"):
        return WRAPPING
    if article:
        return ARTICLE_NAME
    return HEADER if header or name == "header" else PLAIN


def markup(page: str):
    """Yield (text before, element name, whether it ends, attributes) for each tag; the name is empty for other markup.

    One pass: every step goes on behind what it has read. A tag that another one
    or the end of the page breaks off is no text and no element.
    """
    at, n, lost = 0, len(page), set()
    while at < n:
        start = page.find("<", at)
        # a "<" that begins no markup is text
        while start >= 0 and not (page[start + 1 : start + 2].isalpha() and page[start + 1] < "\x80" or page[start + 1 : start + 2] in ("/", "!", "?")):
            start = page.find("<", start + 1)
        if start < 0:
            break
        text = page[at:start]
        if page[start + 1] in "!?" or (page[start + 1] == "/" and not NAME.match(page, start + 2)):
            close = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(close, start + (4 if close == "-->" else 2))
            at = n if end < 0 else end + len(close)
            yield text, "", False, ""
            continue
        ends = page[start + 1] == "/"
        found = NAME.match(page, start + 1 + ends)
        name, end = found[0].lower(), found.end()
        while True:
            stop = TAG_STOP.search(page, end)
            if stop is None or stop[0] in "<>":
                break
            end, mark, before = stop.end(), stop[0], stop.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and mark not in lost:  # a quote opens a value there alone, if it is closed again
                close = page.find(mark, end)
                if close < 0:
                    lost.add(mark)
                else:
                    end = close + 1
        at = n if stop is None else stop.start() + (stop[0] == ">")
        if stop is None or stop[0] == "<":
            yield text, "", False, ""
            continue
        attributes = page[found.end() : stop.start()]
        if not ends and (name in RAW_SET or (name in UNSEEN_SET and not attributes.endswith("/"))) and name not in lost:
            close = RAW_END[name].search(page, at)
            if close:
                at = close.end()
            elif name in RAW_SET:
                at = n
            else:
                lost.add(name)
            yield text, "", False, ""
            continue
        yield text, name, ends, attributes
    yield page[at:] if at < n else "", "", False, ""


class Container:
    __slots__ = ("name", "kind", "parent", "words", "articles", "titles", "state")

    def __init__(self, name: str, kind: int, parent: Container | None):
        self.name, self.kind, self.parent = name, kind, parent
        self.words = self.articles = self.titles = self.state = 0


NEITHER, ARTICLE, PAGE_FURNITURE, READER_COMMENTS, HEAD = range(5)


def settle(containers: list[Container]) -> None:
    """State of every container: inside an article, furniture or comments. Parents come first in the list."""
    for c in containers:
        c.articles += c.kind in (ARTICLE_TAG, ARTICLE_NAME)
    for c in reversed(containers):
        if c.parent:
            c.parent.words += c.words
            c.parent.articles += c.articles
            c.parent.titles += c.titles
    root = containers[0]
    for c in containers[1:]:
        above, most = c.parent.state, 2 * c.words > root.words
        # around most words and all articles: a wrapper of the page, whatever its name
        wraps = most and c.articles == root.articles
        if above == READER_COMMENTS or (c.kind == COMMENTS and not c.titles):
            c.state = READER_COMMENTS
        elif c.name == "main" or (most and c.kind in (ARTICLE_TAG, ARTICLE_NAME)):
            c.state = ARTICLE
        elif above == PAGE_FURNITURE or c.kind == FURNITURE_TAG or (c.kind == WRAPPING and not wraps):
            c.state = PAGE_FURNITURE
        elif c.kind in (ARTICLE_TAG, ARTICLE_NAME):
            c.state = ARTICLE
        elif c.kind == HEADER and above == NEITHER:
            c.state = HEAD
        else:
            c.state = above


def blocks(page: str) -> list[tuple[str, int, tuple[int, int], str]]:
    """Text, words inside links, place (article, furniture) and element of each flat block."""
    out, parts, linked = [], [], []
    here = Container("", PLAIN, None)
    containers, opened = [here], Counter()
    in_link, element = False, ""

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, len(html.unescape(" ".join(linked)).split()), here, element))
                here.words += text.count(" ") + 1
            parts.clear()
            linked.clear()

    for text, name, ends, attributes in markup(page):
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if name == "a":
            in_link = not ends
        elif name in BLOCK_SET:
            close()
            in_link = False
            if name in CONTAINER_SET:
                if not ends:
                    here = Container(name, kind_of(name, attributes), here)
                    containers.append(here)
                    opened[name] += 1
                elif opened[name]:
                    while True:
                        closed, here = here, here.parent
                        opened[closed.name] -= 1
                        if closed.name == name:
                            break
            elif name == "h1" and not ends:
                here.titles += 1
            element = "" if ends else name
    close()
    settle(containers)
    place = {NEITHER: (0, 0), ARTICLE: (1, 0)}
    return [(text, n, place.get(c.state, (0, 1)), tag) for text, n, c, tag in out]


def measure(found: list[tuple[str, int, tuple[int, int], str]]) -> np.ndarray:
    """Feature rows of the blocks of one page."""
    x = np.zeros((len(found) + 2, len(FEATURES)))
    for i, (text, linked, (article, furniture), element) in enumerate(found, 1):
        n = text.count(" ") + 1
        x[i, :2] = n, min(1.0, linked / n)
        x[i, 6:] = article, furniture, element in ("h1", "h2", "h3", "h4", "h5", "h6"), element in ("li", "td", "th", "dt", "dd")
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, :2], x[2:, :2]
    return x[1:-1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """Decision tree as nested tuples (feature, cutoff, left, right); a leaf is the share of main text."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cutoff in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cutoff
            n = low.sum()
            if least <= n <= len(y) - least:
                a, b = y[low].mean(), y[~low].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if impurity < best[0]:
                    best = (impurity, f, float(cutoff))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def train(labelled=LABELLED):
    """Tree from labelled pages."""
    xs, ys = [], []
    for page in labelled:
        found = blocks(page)
        ys += [text.lstrip()[0] == "+" for text, *_ in found]
        xs.append(measure([(re.sub(r"(^| )[+-]", r"\1", text), *rest) for text, *rest in found]))
    return grow(np.concatenate(xs), np.array(ys, float))


def predict(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def extractor(labelled=LABELLED):
    """Function from pages to main texts and numbers of their blocks."""
    tree = train(labelled)

    def extract(pages: list[str]):
        texts, counts = [], []
        for page in pages:
            found = blocks(page)
            kept = [b[0] for b, row in zip(found, measure(found)) if predict(tree, row) > 0.5]
            texts.append(" ".join(kept))
            counts.append(len(kept))
        return pa.array(texts, pa.string()), pa.array(counts, pa.int32())

    return extract


def extract(pages: DataFrame, column: str = "html", labelled=LABELLED) -> DataFrame:
    """Append ``main_text`` and ``n_blocks`` to every page."""
    return map_texts(pages, column, OUTPUTS, lambda: extractor(labelled))
