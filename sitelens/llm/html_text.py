"""Main text of HTML pages by two passes over text blocks.

Pass one decides each block by where it stands (menus, asides, forms and the like), its link density, length, density of
stop words and sentences. Only a place, a name, links or a closing notice speak against a block; that it holds few stop
words does not, since it may be in any language. Pass two gives each undecided block the label of its nearest decided
neighbours; where pass one found no main text at all, what is undecided stays.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import wide

MAX_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.25, 70, 200, 0.15, 0.25

#: Common function words of the languages served.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can for from had has have he her his how if in into is it its more
no not of on one or she so some such than that the their them there they this to was we were what when which who will with would you
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in ist
ja kann mein mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
al algo como con cuando de del desde donde dos el ella en entre era es esta este hasta hay la las le les lo los más me mi muy no nos o
para pero por porque que quien se ser si sin sobre su sus también te tiene todo un una uno y ya
au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais même mes ne nous on ou par pas pour qu que
qui sa sans se ses son sur te tu un une vous
""".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: One attribute after another, so that what stands inside a quoted value is never taken for a name.
_ANY_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+|\"[^\"]*+\"|'[^']*+'")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Marks that end a sentence, in any script.
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|[。！？｡।॥؟۔።។။]")
#: Letters of scripts in which a letter says as much as two or three elsewhere.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words of class names, ids and roles that mark what is not the article; a part between hyphens counts as a word.
_BOILER_WORDS = frozenset("""
ad ads adsense banner promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay
sidebar side aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist disqus
replies reply respond share sharing social related recommended newsletter subscribe subscription signup login search widget widgets pagination pager tags
complementary contentinfo skip copyright disclaimer advert adverts advertisement advertising
""".split())
#: Words that say nothing of their own beside one of those: inside an article a name counts only if it has no other words.
_PLAIN_WORDS = frozenset("""
box block container wrapper wrap section list area bar inner outer item items unit slot row col column left right top bottom inline mobile desktop
post posts entry article articles story stories link links button buttons icon icons form title heading media module group panel content js
""".split())
#: Inside an article these name its own heading.
_HEADING_WORDS = frozenset("header masthead banner".split())
#: Words before a hyphen that say what a page has or lacks, not what the element is.
_STATES = frozenset("has with no without not is show hide".split())
_RAW = {"script", "style", "textarea", "title", "template", "iframe", "noembed", "noframes", "svg", "math", "select", "object", "canvas", "audio", "video", "noscript"}
#: Without an end tag these reach to the end of the page; of the others only the start tag is skipped.
_ENDLESS = {"script", "style", "textarea", "title"}
_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in _RAW}
_BOILER = {"nav", "footer", "aside", "menu", "dialog", "button", "head"}
_FORMS = {"form", "fieldset"}
_SCOPES = {"main", "article"}
_CONTAINERS = {"html", "body", "div", "section", "header", "hgroup", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "blockquote", "center", "details", "address"} | _BOILER | _FORMS | _SCOPES
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "caption", "figcaption", "summary", "legend", "hr", "option"}


@dataclass
class Block:
    """form: inside a form; scope: number of the innermost article or main around it, or 0."""

    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    boiler: bool = False
    form: bool = False
    scope: int = 0
    heading: bool = False
    text: str = ""
    label: bool | None = None


def _hidden(attributes: str) -> bool:
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, *values in _ANY_ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _boiler_name(attributes: str, scope: int | bool = 0) -> bool:
    if not attributes:
        return False
    for names in _ATTRIBUTE.findall(attributes):
        for name in "".join(names).lower().split():
            words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
            told = [w for w in words if w in _BOILER_WORDS and not (scope and w in _HEADING_WORDS)]
            if told and words[0] not in _STATES and not (scope and any(w and w not in _BOILER_WORDS and w not in _PLAIN_WORDS for w in words)):
                return True
    return _hidden(attributes)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order, white space and references still as written."""
    out = [Block()]
    stack: list[tuple[str, bool, bool, int]] = []  # open containers: tag, boilerplate, form, scope
    opened: dict[str, int] = {}  # how many of each tag are open
    unclosed: set[str] = set()  # tags that no end tag follows any more
    leaf, leaf_boiler, linking, scopes, at, heading_until = "", False, False, 0, 0, False

    def start() -> None:
        boiler, form, scope = stack[-1][1:] if stack else (False, False, 0)
        if out[-1].parts:
            out.append(Block())
        out[-1].boiler, out[-1].form, out[-1].scope, out[-1].heading = boiler or leaf_boiler, form, scope, leaf[:1] == "h" and leaf[1:].isdigit()

    last = page.rfind(">")  # beyond it there is no tag, and at most one comment
    while True:
        found = _MARK.search(page, at) if at <= last else None
        stop = found.start() if found else page.find("<!--", at)
        piece = page[at : stop if stop >= 0 else len(page)]
        if piece:
            out[-1].parts.append(piece)
            if linking:
                out[-1].linked.append(piece)
        if not found:
            return out
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = None if tag in unclosed else _CLOSERS[tag].search(page, at, last + 1)
                if end:
                    at = end.end()
                elif tag in _ENDLESS:
                    at = len(page)
                else:
                    unclosed.add(tag)
            out[-1].parts.append(" ")
        elif tag == "a":
            linking = not closing
        elif tag in ("br", "img", "input", "wbr"):
            out[-1].parts.append("" if tag == "wbr" else " ")
        elif tag in _LEAVES:
            leaf, leaf_boiler = ("", False) if closing else (tag, _boiler_name(attributes, stack[-1][3] if stack else 0))
            start()
        elif tag in _CONTAINERS:
            leaf, leaf_boiler = "", False
            if closing:
                linking = False
                while opened.get(tag):
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
            else:
                boiler, form, scope = stack[-1][1:] if stack else (False, False, 0)
                boiler = boiler or tag in _BOILER or tag == "header" and not scope or tag not in ("html", "body") and _boiler_name(attributes, scope or tag in _SCOPES)
                if tag in _SCOPES and not boiler:
                    scopes += 1
                    scope = scopes
                stack.append((tag, boiler, form or tag in _FORMS, scope))
                opened[tag] = opened.get(tag, 0) + 1
            start()


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _runs(text: str) -> bool:
    """Whether a text is running text, by its stop words or, in any language, by its sentences."""
    if _size(text) < SHORT:
        return False
    stops, words = _stops(text)
    share = stops / max(1, words)
    return share >= MANY_STOPS or share >= FEW_STOPS and len(text) >= LONG or bool(_SENTENCE.search(text))


def _linked(block: Block) -> bool:
    return len(" ".join("".join(block.linked).split())) > MAX_LINKS * len(block.text)


def _forms_hold_the_page(found: list[Block]) -> bool:
    """Whether a form is around most of a page's text, so that it says nothing of the text."""
    sizes = [(b.form, len(b.text)) for b in found if not b.boiler and not _linked(b)]
    return 2 * sum(n for form, n in sizes if form) > sum(n for _, n in sizes) and any(b.form and not b.boiler and _runs(b.text) for b in found)


def _decide(block: Block, closing: bool) -> bool | None:
    """True: main text; False: boilerplate; None: left to the second pass. ``closing``: no running text follows."""
    if block.boiler or _linked(block):
        return False
    if closing and not block.scope and "©" in block.text and _size(block.text) < LONG:
        return False
    return None if block.heading or not _runs(block.text) else True


def _neighbours(found: list[Block]) -> list[bool]:
    """Labels with undecided blocks filled in: from the nearest decided blocks of the same scope, a
    tie to the next one for headings and to main text inside an article; without any, by the scope. If no block at all was
    decided to be main text, all undecided ones are."""
    n, none = len(found), not any(b.label for b in found)
    nearest: list[list[tuple[int, bool] | None]] = [[], []]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        seen: dict[int, tuple[int, bool]] = {}
        row: list[tuple[int, bool] | None] = [None] * n
        for i in order:
            row[i] = seen.get(found[i].scope)
            if found[i].label is not None and not found[i].boiler:
                seen[found[i].scope] = (i, found[i].label)
        nearest[side] = row
    out = []
    for i, block in enumerate(found):
        if block.label is not None:
            out.append(block.label)
            continue
        before, after = nearest[0][i], nearest[1][i]
        if none:
            out.append(True)
        elif not before and not after:
            out.append(block.scope > 0)
        elif not before or not after:
            out.append((before or after)[1])
        elif before[1] == after[1]:
            out.append(before[1])
        elif block.heading:
            out.append(after[1])
        elif i - before[0] != after[0] - i:
            out.append((before if i - before[0] < after[0] - i else after)[1])
        else:
            out.append(block.scope > 0)
    return out


def main_text(page: str) -> str:
    found = []
    for block in blocks(page):
        text = "".join(block.parts)
        block.text = " ".join((html.unescape(text) if "&" in text else text).split())
        if block.text:
            found.append(block)
    if not _forms_hold_the_page(found):
        for block in found:
            block.boiler |= block.form
    last = max((k for k, b in enumerate(found) if not b.boiler and "©" not in b.text and _runs(b.text)), default=-1)
    for k, block in enumerate(found):
        block.label = _decide(block, k > last)
    labels = _neighbours(found)
    # where articles hold at least half of the main text, what stands around them is not part of it
    inside = sum(len(b.text) for b, good in zip(found, labels) if good and b.scope)
    outside = sum(len(b.text) for b, good in zip(found, labels) if good and not b.scope)
    return "\n\n".join(b.text for b, good in zip(found, labels) if good and (b.scope or inside < outside or not inside))


def main_text_of(page: Column) -> Column:
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return F.arrow_udf(run, "string")(page.cast("string"))


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with their main text in column ``into`` (a column of that name is replaced).

    Blocks are joined in page order by two newlines; references are decoded and white space inside a
    block becomes one space. Null, empty and text-free pages give an empty text; unclosed tags and
    cut pages are read as far as they go; the whole page is read. Repeated rows and null ids keep a row each, and other columns
    stay. An empty table stays empty.
    """
    return wide(pages).withColumn(into, main_text_of(F.col(html_col)))
