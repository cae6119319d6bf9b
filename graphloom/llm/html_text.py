"""Operator 10: main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches, texts, tuned

# Element names by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
DROPPED = frozenset("aside button dialog footer form head input label menu nav object optgroup option select svg canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption".split())
#: Elements that a start tag closes if open, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, BLOCKS),
}
#: Words of class, id and role that mark what is no article, and those that outweigh the weaker ones of them.
OUTSIDE = frozenset("nav navigation navbar menu sidebar footer header masthead banner contentinfo complementary breadcrumb breadcrumbs pagination pager toolbar widget search login signup register share sharing social related recommended recommendations popular trending tags meta byline".split())
NEVER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert newsletter subscribe subscription popup modal overlay comment comments disqus reply replies respond dialog paywall hidden".split())
INSIDE = frozenset("article content main story post entry body text prose".split())
#: Words of names that hold what readers wrote, and those that do so as a whole class only; they are out whatever their size.
THREAD = frozenset("comment comments commentlist commentaries disqus respond".split())
WHOLE_THREAD = frozenset("discussion discussions replies reply thread".split())
#: Words that make a class a state of the page ("no-sidebar", "has-header-image", "comments-open"), and classes of what can't be seen.
STATES = frozenset("no not has with without hide show open closed enabled disabled layout".split())
UNSEEN = frozenset("hidden is-hidden visually-hidden d-none screen-reader-text".split())
#: Words of NEVER that only count as a whole class, since parts of other names have them ("overflow-hidden", "alert-icon").
WHOLE = frozenset("hidden alert overlay ad reply replies".split())
#: The share of a page's text outside links from which an element is no boilerplate, though its name or its class says so.
SHARE = 0.7
#: Ancestors that a block passes points to.
LEVELS = 8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
#: One attribute after the other, so that no value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ASKED = frozenset("class id role hidden aria-hidden style".split())
UNSTYLED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hinted_out(tag: str, attributes: str, threads: bool = True) -> int:
    """2 if an element can't be seen or its class, id or role says that it is no part of an article, 1 if a part of one hints at it, else 0.

    A whole name of NEVER says so, one of OUTSIDE too where no other name is of INSIDE words. A part of a longer name ("site-footer") hints
    at it, unless another part makes it a state of the page, or the element has a name of INSIDE words without such a part. A part of THREAD
    says so too, where ``threads`` is set.
    """
    if tag in ("html", "body", "article", "main") or not attributes:
        return 0
    outside = hinted = inside = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name not in ASKED:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSTYLED.search(value):
            return 2
        if name in ("style", "aria-hidden"):
            continue
        for token in value.split():
            whole = token.lower()
            if whole in UNSEEN:
                return 2
            own = {w.lower() for w in HINT_WORD.findall(token)}
            if whole in THREAD or whole in WHOLE_THREAD or own & THREAD and not own & STATES:
                if threads:
                    return 2
                hinted = True
                continue
            if whole in NEVER:
                return 2
            if whole in OUTSIDE:
                outside = True
            elif not own & STATES:
                marked = own & (NEVER | OUTSIDE) - WHOLE
                hinted |= bool(marked & NEVER) or bool(marked) and not own & INSIDE
                inside |= bool(own & INSIDE) and not marked
    return 2 if outside and not inside else int(outside or hinted and not inside)


class Page:
    """The element tree of a page with its blocks of text; elements are numbered in page order, parents first."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset(), threads: bool = True):
        self.threads, self.threaded = threads, 0  # whether names of readers' threads count, and the characters inside such
        self.spared, self.weak, self.said = spared, {}, 0  # weak: characters outside links of elements that are out by a hint
        self.parent, self.tag, self.out = [-1], ["#page"], [False]
        self.strong, self.above = [False], [0]  # out for good; the nearest element that is out by a hint, 0 for none
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters inside links)
        self.stack, self.linked, self.run, self.link_chars, self.owner = [0], 0, [], 0, 0
        self.block, self.there = [0], Counter()  # the nearest block element of each; how many of each name are open
        self.read(html)

    def dominating(self) -> frozenset[int]:
        """The elements that are out by a hint but hold the better part of the page's text."""
        for k in sorted(self.weak, reverse=True):
            if above := self.above[self.parent[k]]:
                self.weak[above] += self.weak[k]
        return frozenset(k for k, size in self.weak.items() if size and size >= SHARE * self.said)

    def flush(self) -> None:
        """End the block that is open."""
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((self.owner, text, self.link_chars))
            self.run, self.link_chars = [], 0

    def say(self, raw: str) -> None:
        here = self.stack[-1]
        if not self.linked and not self.strong[here]:
            size = len(raw.strip())
            self.said += size
            if self.above[here]:
                self.weak[self.above[here]] += size
        if self.out[here]:
            self.threaded += len(raw) if self.strong[here] else 0
            return
        if not self.run:
            self.owner = self.block[here]
        text = unescape(raw) if "&" in raw else raw
        self.run.append(text)
        if self.linked:
            self.link_chars += len(text.strip())

    def pop_to(self, at: int) -> None:
        for k in self.stack[at:]:
            self.linked -= self.tag[k] == "a"
            self.there[self.tag[k]] -= 1
        del self.stack[at:]

    def close(self, names, until) -> None:
        if not any(self.there[x] for x in names):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[at]]
            if tag in names:
                self.pop_to(at)
                return
            if tag in until:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close({"p"}, {"button", "table", "td", "th", "caption", "object"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        top = self.stack[-1]
        if tag in EMPTY:
            if tag in ("br", "hr"):
                self.run += [" "] if self.run else []
            return
        inside = tag == "header" and not self.there["article"] and not self.there["main"]
        self.parent.append(top)
        self.tag.append(tag)
        self.there[tag] += 1
        self.block.append(len(self.tag) - 1 if tag in BLOCKS else self.block[top])
        here, hint = len(self.tag) - 1, hinted_out(tag, attributes, self.threads)
        strong, weak = inside or hint == 2 or tag in DROPPED and tag != "form", hint == 1 or tag == "form"
        self.strong.append(self.strong[top] or strong)
        self.out.append(self.out[top] or strong or weak and here not in self.spared)
        if weak and not self.strong[here]:
            self.weak[here] = 0
        self.above.append(here if here in self.weak else self.above[top])
        self.stack.append(here)
        self.linked += tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close({tag}, {"table"} if tag in ("p", "li", "div") else ())
        elif tag == "a":
            self.close({tag}, ())
        else:
            self.close({tag}, BLOCKS)

    def read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1  # no markup ends behind the last ">"
        while m := TOKEN.search(html, at, last):
            if m.start() > at:
                self.say(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)
                    break
                continue
            if m[1] or m[4]:
                self.end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at, last)
                at = over.end() if over else len(html)
                continue
            if tag == "body":
                self.flush()
                self.pop_to(next((k for k in range(1, len(self.stack)) if self.tag[self.stack[k]] == "head"), len(self.stack)))
            self.open(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "path", "use"):
                self.end(tag)
        if at < len(html):  # markup that is cut off is no text
            cut = CUT_OFF.search(html, at)
            self.say(html[at : cut.start() if cut else len(html)])
        self.flush()


def block_score(page: Page, element: int, text: str) -> float:
    """A point for a paragraph, one for each comma and up to three for its length; headings score nothing."""
    if page.tag[element] in HEADINGS:
        return 0.0
    return (1.0 if len(text) >= 25 else 0.25) + text.count(",") + min(len(text) / 100, 3.0)


#: How many times the points of the best element the blocks of a wider one must have, for that to be the container.
WIDER = 1.4


def widened(page: Page, best: int, whole: list[float], chars: list[int], links: list[int]) -> int:
    """The best element, or the one around it that holds the paragraphs which wrappers of their own keep from it.

    An element that adds nothing is only a wrapper; one whose blocks have WIDER times the points is the container. Both are climbed, up to the body.
    """
    here = best
    while (here := page.parent[here]) > 0 and page.tag[here] not in ("body", "html"):
        if chars[here] == chars[best] or whole[here] >= WIDER * whole[best] and links[here] <= 0.5 * chars[here]:
            best = here
    return best


def main_blocks(page: Page) -> list[str]:
    """The blocks of the best container and of its siblings that belong to it.

    A block gives its score to the element that holds it, half to the next ancestor and ever less to those above, up to LEVELS. An
    element's points are discounted by the share of its text that is inside links. The best element is the one with most points left,
    the first of equals, or the article or main element around it. Where it holds no h1, the last one before it that stands beside
    it or one of its ancestors is its title.
    """
    n = len(page.tag)
    points, chars, links, whole = [0.0] * n, [0] * n, [0] * n, [0.0] * n
    for element, text, linked in page.blocks:
        score = block_score(page, element, text)
        whole[element] += score * (1 - linked / len(text))
        above = page.parent[element] if page.tag[element] in PARAGRAPHS and element else element
        for level in range(LEVELS):
            if above < 0:
                break
            points[above] += score / (1, 2)[level] if level < 2 else score / (3 * level)
            above = page.parent[above]
        chars[element] += len(text)
        links[element] += linked
    for k in range(n - 1, 0, -1):  # children come after their parents
        chars[page.parent[k]] += chars[k]
        links[page.parent[k]] += links[k]
        whole[page.parent[k]] += whole[k]
    final = [p * (1 - links[k] / chars[k]) if chars[k] else 0.0 for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (final[k], -k), default=0)
    if final[best] <= 0:
        return []
    best = widened(page, best, whole, chars, links)
    lineage, above = [best], page.parent[best]
    while above >= 0:
        lineage.append(above)
        above = page.parent[above]
    around = next((k for k in lineage if page.tag[k] in ("article", "main")), best)
    lineage = lineage[lineage.index(around) :]
    best = around
    kept = {best}
    beside = [k for k in range(1, n) if page.parent[k] == page.parent[best] and k != best and not page.out[k]] if page.parent[best] > 0 else []
    for k in beside:
        density = links[k] / chars[k] if chars[k] else 1.0
        if final[k] >= max(2.0, 0.2 * final[best]) or page.tag[k] not in HEADINGS and chars[k] >= 80 and density < 0.25:
            kept.add(k)
    first, last = min(kept), max(kept)
    kept.update(k for k in beside if first < k < last and page.tag[k] in HEADINGS)
    for k in reversed([k for k in beside if k < first]):  # headings right before it
        if page.tag[k] not in HEADINGS:
            break
        kept.add(k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in kept or page.parent[k] >= 0 and inside[page.parent[k]]
    if not any(inside[k] and page.tag[k] == "h1" for k in range(n)):
        own = set(lineage)
        title = max((k for k in range(1, min(kept)) if page.tag[k] == "h1" and page.parent[k] in own and not page.out[k]), default=0)
        inside[title] |= title > 0
    return [text for element, text, _ in page.blocks if inside[element]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    found = main_of(html, page)
    if page.threaded > FEW and len(found) < FEW:  # hardly anything is left without the threads: perhaps the page's own text has such a name
        other = main_of(html, Page(html, threads=False))
        return other if len(other) > 4 * len(found) else found
    return found


#: Characters of a main text that are too few to do without what stands in a thread.
FEW = 80


def main_of(html: str, page: Page) -> str:
    spared = page.dominating()
    return "\n".join(main_blocks(Page(html, spared, page.threads) if spared else page))


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html, and one without text outside boilerplate, give an empty text. The whole html is read, and
    damaged markup too: tags left open end with their parent. Repeated rows each give a row; other columns are
    ignored; an empty table gives an empty result.
    """
    tuned(spark)

    def run(batch):
        out = [main_text(x) for x in texts(batch, "html")]
        return pa.table({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string, n_chars long")
