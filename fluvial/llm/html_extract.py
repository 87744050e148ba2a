"""Main-text extraction from HTML by tree scoring.

A page becomes a small tree. Paragraphs give points for their length and commas to their ancestors: all to the parent,
half to the grandparent, ever less above; an element's points are discounted by the share of its text that stands in
links. The best element is the container; it grows to the article or main element around it, and siblings with enough
points of their own are kept beside it. Where the page has no such element, so are all sibling paragraphs, headings, lists
and other blocks of text, and sections of them, that aren't mostly links. Menus, page headers and footers, sidebars, notices, adverts,
comments, scripts and styles are left out by element or role; an article's own header stays, with its title. A whole word of
class or id leaves out an element, unless it holds nine tenths of a page's text that has no article beside it; the clearest
words as a part of one, and a form, leave out an element with at most half of the text; another word that is only a part
one with at most a tenth, or one that is mostly links, and none that says what a wrapper has. If nothing is left, neither
words nor forms count. Scores only choose the container.

In the result character references are decoded, white space inside a block is one space, blocks are joined by \\n in
page order; nothing is cut. Null or empty html, or a page without text: an empty string. Broken markup (unclosed tags and
quotes, stray end tags) is read as browsers do in the common cases. Pages are independent of each other; other columns
are ignored, whatever their names; repeated rows are extracted each; of elements with equal scores the first is the container.
The work is linear in the page, however it is written.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from fluvial.common import small_batches

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What can end a tag: a quoted value that begins, or >.
IN_TAG = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[a-z]+")
PART_WORD = re.compile(r"^(?:has|no|with|without)[-_]|^(?:article|post|entry|content|story|section)[-_]+header$")

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object audio video canvas xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"html", "body", "table", "ul", "ol", "dl", "article", "section", "main", "div", "td", "th", "select", "blockquote", "form", "aside", "nav", "header", "footer"}
LEFT_OUT = set("nav header footer aside button select menu dialog head label input datalist".split())
#: RAW elements that, without an end tag, hold the rest of the page; of others only the tag goes.
SWALLOW = set("script style textarea title iframe xmp noembed noframes".split())
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist".split())
LEFT_OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets pagination pager "
    "toolbar copyright disclaimer skip hidden".split()
)
#: Of the words to be left out, those that say the same as a part of a longer word.
CLEAR_WORDS = set("advert adverts advertisement advertising adsense sponsored sidebar navbar breadcrumb breadcrumbs cookie cookies consent gdpr newsletter comments disqus pagination footer".split())
#: Blocks of text: beside a container they are kept unless most of them is links.
PROSE = set("p h1 h2 h3 h4 h5 h6 pre ul ol dl blockquote table figure".split())
PLAIN = {"html", "body", "article", "main"}  # never left out by class or id


class Node:
    __slots__ = ("tag", "parent", "children", "out", "maybe", "score", "length", "linked")

    def __init__(self, tag, parent, out, maybe=1.0):
        self.tag, self.parent, self.children, self.out, self.maybe = tag, parent, [], out, maybe
        self.score, self.length, self.linked = 0.0, 0, 0


#: The share of the page's text up to which an element is left out: by a whole class or id word; by a clear part of one, or
#: as a form; by another part of one.
BY_WORD, BY_CLEAR, BY_PART = 0.9, 0.5, 0.1


def _left_out(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether the element is left out by what it is, and else up to which share of the page's text it is (0: never)."""
    if tag in LEFT_OUT:
        return True, 0.0
    most = BY_CLEAR if tag == "form" else 0.0
    if not attributes or tag in PLAIN:
        return False, most
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = set() if PART_WORD.search(token) else set(NAME_WORD.findall(token))
                if token in LEFT_OUT_WORDS:
                    most = BY_WORD
                elif parts & CLEAR_WORDS:
                    most = max(most, BY_CLEAR)
                elif parts & LEFT_OUT_WORDS:
                    most = max(most, BY_PART)
        if name == "role" and value.strip() in LEFT_OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0.0
    return False, most


def _settle(root: Node, words: bool) -> None:
    """Decide what may be left out, by its share of the page's text; with words False only what is left out by what it is."""
    order = _measure(root)
    around = set()  # elements that hold an article with text
    for node in order:
        up = node if node.tag in ("article", "main") and node.length else None
        while up is not None and up not in around:
            around.add(up)
            up = up.parent
    most = root.length
    stack = [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if not isinstance(c, str):
                few = c.length <= c.maybe * most or c.maybe == BY_WORD and around and c not in around
                few = few or c.maybe == BY_PART and c.linked * 2 > c.length and c.length * 2 <= most
                c.out = c.out or node.out or words and c.maybe > 0 and few
                stack.append(c)
    for node in order:
        node.length = node.linked = 0


class _Open:
    """The open elements, outermost first, and where each tag and each scope stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.scopes = [root], {"html": [0]}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close all elements from the k-th on."""
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def close_in_scope(self, tags: set[str]) -> None:
        """Close the outermost of tags in the innermost scope that isn't one of them."""
        k = len(self.scopes) - 1
        while k > 0 and self.nodes[self.scopes[k]].tag in tags:
            k -= 1
        border = self.scopes[k]
        found = [places[j] for t in tags if (places := self.at.get(t)) and (j := bisect.bisect_right(places, border)) < len(places)]
        if found:
            self.cut(min(found))


def _tag_end(page: str, at: int, ends: dict[int, int]) -> int:
    """Where the tag that goes on at `at` ends: at the first > outside quotes; -1 if a quote doesn't close.

    ends: the same for each quote that opens and each > met so far. Every one is looked at once, and the stretches to their
    closing quotes don't overlap for either kind of quote, so all calls for a page together are linear in it.
    """
    met, end = [], -1
    while q := IN_TAG.search(page, at):
        if q.start() in ends:
            end = ends[q.start()]
            break
        met.append(q.start())
        if not q[1]:
            end = q.start()
            break
        at = page.find(q[1], q.end()) + 1
        if not at:
            break
    ends.update(dict.fromkeys(met, end))
    return end


def parse(page: str) -> Node:
    root = Node("html", None, False, 0.0)
    stack = _Open(root)
    done, at, n = 0, 0, len(page)  # text up to done is in the tree
    last_end = page.rfind(">")
    absent: set[str] = set()
    ends: dict[int, int] = {}

    def text_to(k: int) -> None:
        if k > done:
            stack.nodes[-1].children.append(page[done:k])

    while 0 <= (lt := page.find("<", at)) < last_end or lt >= 0 and page.startswith("<!--", lt):
        if page.startswith("<!--", lt):
            text_to(lt)
            end = page.find("-->", lt + 4)
            done = at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            text_to(lt)
            done = at = page.find(">", lt) + 1
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            at = lt + 1
            continue
        end = _tag_end(page, m.end(), ends)
        if end < 0:
            end = page.find(">", lt)
        text_to(lt)
        done = at = end + 1
        tag, attributes = m[0].lower(), page[m.end() : end]
        if tag[0] == "/":
            tag = tag[1:]
            if tag != "html" and stack.at.get(tag):
                stack.cut(stack.at[tag][-1])
            elif tag == "br":
                stack.nodes[-1].children.append(Node("br", stack.nodes[-1], False, 0.0))
            continue
        if tag in RAW:
            close = None if tag in absent else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if close:
                done = at = page.find(">", close.start()) + 1 or n
            elif tag in SWALLOW:
                done = at = n
            else:
                absent.add(tag)
            continue
        if tag in CLOSES_P and stack.at.get("p"):
            stack.close_in_scope({"p"})
        if tag in IMPLIED:
            stack.close_in_scope(IMPLIED[tag])
        if tag in ("html", "body") and stack.at.get(tag):
            continue
        here = stack.nodes[-1]
        out, maybe = _left_out(tag, attributes)
        if tag == "header" and stack.at.get("article"):
            out = False  # an article's own header has its title
        node = Node(tag, here, here.out or out, maybe)
        here.children.append(node)
        if tag not in VOID:
            stack.push(node)
    text_to(n)
    return root


def blocks_of(nodes: list) -> list[tuple[Node | None, str]]:
    """(innermost block element, text) for each block of text below nodes, in page order, without what is left out."""
    found: list[tuple[Node | None, str]] = []
    held: list[str] = []

    def flush(owner):
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((owner, text))

    stack: list = [(None, iter(nodes), None)]  # element, its children, the innermost block element
    while stack:
        owner, rest, block = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if owner is not None and owner is block:
                flush(owner)
        elif isinstance(child, str):
            held.append(child)
        elif child.tag == "br":
            held.append(" ")
        elif not child.out:
            if child.tag in BLOCK:
                flush(block)
            stack.append((child, iter(child.children), child if child.tag in BLOCK else block))
    flush(None)
    return found


def _measure(root: Node) -> list[Node]:
    """Text lengths in and out of links for each element that isn't left out; returns them in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        order.append(node)
        for c in node.children:
            if isinstance(c, str):
                size = len(c.strip())
                node.length += size
                node.linked += size * in_link
        stack.extend((c, in_link) for c in reversed(node.children) if not isinstance(c, str) and not c.out)
    for node in reversed(order):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    return order


def _links(x: Node | str) -> tuple[int, int]:
    return (len(x.strip()), 0) if isinstance(x, str) else (x.length, x.length if x.tag == "a" else x.linked)


def _is_prose(x: Node) -> bool:
    """Whether x is or holds a block of text, and isn't mostly links."""
    if not x.length or x.linked * 2 >= x.length:
        return False
    stack = [x]
    while stack:
        node = stack.pop()
        if node.tag in PROSE and node.length:
            return True
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.out)
    return False


def _beside(best: Node, enough: float, worth) -> list:
    """best and those of its siblings that belong to it, in page order."""
    marked = best.tag in ("article", "main")
    kept, run = [], []

    def flush():  # text without an element of its own
        size, linked = map(sum, zip(*map(_links, run))) if run else (0, 0)
        if not marked and linked * 2 < size and any(ch.isalnum() for c in run for ch in (c if isinstance(c, str) else "x")):
            kept.extend(run)
        run.clear()

    for c in best.parent.children:
        if isinstance(c, str) or c.tag not in BLOCK and not c.score and c is not best:
            if isinstance(c, str) or not c.out:
                run.append(c)
            continue
        flush()
        if c is best or not c.out and (worth(c) >= enough > 0 or not marked and _is_prose(c)):
            kept.append(c)
    flush()
    return kept


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return _main_text(root, True) or _main_text(parse(page), False)


def _main_text(root: Node, words: bool) -> str:
    """words: whether class and id words, and forms, leave out elements."""
    _settle(root, words)
    order = _measure(root)
    for owner, text in blocks_of([root]):
        if owner is None:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        if owner.length:
            points *= 1 - owner.linked / owner.length
        up, share = owner.parent if owner.tag not in ("div", "article", "section", "main", "body", "td") else owner, 1.0
        level = 0
        while up is not None and level < 6:
            up.score += points * share
            up, level = up.parent, level + 1
            share = 0.5 if level == 1 else 1 / (3 * level)
    worth = lambda x: x.score * (1 - x.linked / x.length if x.length else 0)
    best = max(order, key=worth)  # of equal ones the first
    if not worth(best):
        return "\n".join(t for _, t in blocks_of([root]))
    for around in ("article", "main"):
        up, top = best, None
        while up is not None:
            top = up if up.tag == around else top
            up = up.parent
        if top is not None:
            best = top
            break
    if best.parent is None:
        kept = [best]
    else:
        kept = _beside(best, 0.2 * worth(best), worth)
    return "\n".join(t for _, t in blocks_of(kept))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    p = pages.select("page_id", "url", "html")
    return p.mapInArrow(run, f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
