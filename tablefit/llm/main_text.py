"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass whose time grows with the page's length. Pass one decides a
block by where it stands (menu, footer, form, advert, comment, article ...), by link density, length and stop-word density,
or leaves it open: headings and short blocks. Pass two gives each open block the label of its nearest decided neighbours in
the same part of the page.

Names of classes and ids decide where they say what an element is ("sidebar", "site-footer"), not where they only
mention it ("has-sidebar", "search-result-page"); where names would leave a page without any text, they don't count at
all. Where stop words of no listed language occur (other scripts, or long Latin texts nearly without them), length and link
density decide alone; characters of scripts that write without spaces count three times.

Defined results: NULL and empty pages have an empty text; repeated rows keep their rows; an empty table gives an empty
table; tags that never close end with the page. Other input columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import blocks_of, map_batches

# Common words of the languages of the corpus; a share of them marks running text.
STOP_WORDS = frozenset("""
a an and are as at be by for from has have in is it its not of on or that the this to was were will with you
aber als am auch auf aus bei das dem den der des die ein eine einer es für hat im in ist mit nach nicht sich sie sind
und von war wie zu zum zur
au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas plus pour qui que sa se son sur un une
al como con de del el en es la las lo los más no o para pero por que se su sus un una y
""".split())

LONG, SHORT = 200, 70  # characters
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
LINKS_HIGH = 0.5

RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "canvas",
       "audio", "video", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
         "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "search"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form",
             "menu", "menubar"}
BAD_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
             "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus",
             "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
             "newsletter", "notice", "notices", "notification", "overlay", "pagination", "pager", "popup", "promo",
             "promoted", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
             "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "widget",
             "warning", "alert", "discussion", "reactions"}
# Tags that end when another of the set begins inside the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Words that only mention what follows, and words that make a wrapper of what they follow.
MENTIONS = {"has", "have", "with", "without", "no", "not", "is", "fixed", "sticky", "hide", "show", "under", "below", "above",
            "after", "before", "off", "on", "enable", "enabled", "js"}
WRAPPERS = {"layout", "page", "wrapper", "wrap", "container", "content", "main", "body", "visible", "open", "closed", "fixed",
            "sticky", "enabled", "active", "result", "results", "article", "post", "entry", "text", "story", "grid", "row"}
# Comments by readers: the word decides wherever it stands in a name.
READERS = {"comment", "comments", "disqus", "replies", "respond"}

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
LETTER = re.compile(r"[^\W\d_]")
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u0e00-\u0eff]")


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    part: int  # number of the enclosing article or main element; 0 outside
    good: bool | None = None


@dataclass
class _Open:
    tag: str
    bad: bool
    part: int
    link: bool
    block: int  # place of the innermost block-level element, itself included
    blocks: int  # how many of the open elements up to this one are block-level


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def _named_bad(name: str) -> bool:
    """Whether a class or id says that an element is no part of the text."""
    parts = [part.lower() for part in NAME_PART.findall(name)]
    if not BAD_NAMES.intersection(parts):
        return False
    if READERS.intersection(parts) or len(parts) == 1:
        return True
    if parts[0] in MENTIONS:
        return False
    return parts[-1] in BAD_NAMES or not WRAPPERS.intersection(parts[-1:])


def _bad_place(tag: str, attributes: str, inside: int, names: bool) -> bool:
    if tag in BAD_TAGS or (tag == "header" and not inside):
        return True
    if not attributes.strip(" /"):
        return False
    for match in ATTRIBUTE.finditer(attributes):
        name = (match[1] or match[5]).lower()
        value = html.unescape(match[2] or match[3] or match[4] or "")
        if name in ("class", "id"):
            if names and (tag not in ("html", "body", "article", "main") or "comment" in value.lower()):
                if any(map(_named_bad, value.split())):
                    return True
        elif name == "role" and value.lower() in BAD_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Place after the tag that is open at ``at``; quotes count only after an equals sign. -1: it never ends."""
    while match := QUOTED.search(page, at):
        if not match[1]:
            return match.end()
        at = page.find(match[1], match.end()) + 1
        if not at:
            break
    return -1


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" for an end tag, tag name or "", attributes) up to the end; the last one has no tag.

    Nothing is read twice: a comment, declaration or tag that never ends takes the rest of the page.
    """
    said = at = 0
    lower = None
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2)
            name = None
        elif name := TAG_NAME.match(page, at + 1):
            end, mark = _tag_end(page, name.end()) - 1, ">"
            end = end if end >= 0 else -1
        else:
            at += 1
            continue
        before = page[said:at]
        if end < 0:
            yield before, "", "", ""
            return
        after = end + len(mark)
        if name is None:
            yield before, "", "", ""
        else:
            tag = name[2].lower()
            yield before, name[1], tag, page[name.end():end]
            if tag in RAW and not name[1]:
                lower = page.lower() if lower is None else lower
                after = lower.find(f"</{tag}", after)
                if after < 0:
                    return
        said = at = after
    yield page[said:], "", "", ""


def blocks(page: str, names: bool = True) -> list[Block]:
    """The blocks outside menus, forms, scripts and the like, in page order; ``names``: class names and ids count."""
    out, stack, parts = _Page(), [_Open("", False, 0, False, 0, 0)], 0
    places: dict[str, list[int]] = {}  # where each tag is open

    def flush() -> None:
        text = " ".join(html.unescape("".join(out.pieces)).split())
        if text:
            out.blocks.append(Block(text, out.linked, stack[stack[-1].block].tag or "body", stack[-1].part))
        out.pieces.clear()
        out.linked = 0

    def close(depth: int) -> None:
        if stack[-1].blocks > stack[depth - 1].blocks:
            flush()
        for o in stack[depth:]:
            places[o.tag].pop()
        del stack[depth:]

    for text, end, tag, attributes in markup(page):
        if text and not stack[-1].bad:
            out.pieces.append(text)
            if stack[-1].link:
                out.linked += len(" ".join(text.split()))
        if not tag or (tag in RAW and not end):
            continue
        if end:
            depth = places[tag][-1] if places.get(tag) else 0
            # An inline end tag doesn't reach over the block that it stands in.
            if depth and (tag in BLOCK or stack[-1].blocks == stack[depth].blocks):
                close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].bad:
                out.pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            inner = stack[-1].block
            if inner and stack[inner].tag in CLOSES.get(tag, set()) | {"p"}:
                close(inner)
        above = stack[-1]
        part = above.part
        if tag in ("article", "main") and not part:
            parts += 1
            part = parts
        bad = above.bad or _bad_place(tag, attributes, above.part, names)
        block = tag in BLOCK
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, bad, part, above.link or tag == "a", len(stack) if block else above.block,
                           above.blocks + block))
    flush()
    return out.blocks


def _unlisted(found: list[Block], stops: list[int], words: list[int]) -> bool:
    """Is the page in a language without listed stop words: another script, or a long text nearly without them?"""
    if sum(stops) >= 0.03 * sum(words):
        return False
    text = " ".join(block.text for block in found)
    return sum(words) >= 100 or len(LATIN.findall(text)) < 0.5 * len(LETTER.findall(text))


def classify(found: list[Block]) -> list[Block]:
    """Both passes; every block gets a label."""
    words = [WORD.findall(block.text.lower()) for block in found]
    listed = [sum(map(STOP_WORDS.__contains__, own)) for own in words]
    unlisted = _unlisted(found, listed, list(map(len, words)))
    for block, own, count in zip(found, words, listed):
        size = len(block.text) + (0 if block.text.isascii() else 2 * len(DENSE.findall(block.text)))
        if block.linked > LINKS_HIGH * size:
            block.good = False
            continue
        if block.tag in HEADINGS:
            continue
        stops = count / max(1, len(own))
        if unlisted:
            stops = STOPS_LOW if size >= LONG else 0.0
        if block.part:
            if size >= SHORT and (stops >= STOPS_LOW or size >= LONG):
                block.good = True
        elif size < SHORT:
            block.good = False if block.linked or "©" in block.text else None
        elif stops >= STOPS_HIGH or (stops >= STOPS_LOW and size >= LONG):
            block.good = True
        elif stops < STOPS_LOW:
            block.good = False
    before: dict[int, tuple[int, bool]] = {}
    nearest: list[list[tuple[int, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        before.clear()
        for i in order:
            block = found[i]
            if block.good is not None:
                before[block.part] = (i, block.good)
            elif block.part in before:
                j, good = before[block.part]
                nearest[i].append((abs(i - j), good))
    for i, block in enumerate(found):
        if block.good is None:
            # A heading belongs to what follows; ties and articles without decided blocks count as text.
            near = nearest[i]
            if block.part:
                block.good = not near or any(good for _, good in near)
            elif not near:
                block.good = False
            else:
                least = min(distance for distance, _ in near)
                block.good = any(good for distance, good in near if distance == least)
    return found


def main_text(page: str | None) -> str:
    for names in (True, False) if page else ():
        good = [block.text for block in classify(blocks(page, names)) if block.good]
        if good:
            return "\n".join(good)
    return ""


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """Per row: the kept columns, text and n_chars (code points)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        source = batch.column(batch.num_columns - 1)
        for a, b in blocks_of(pc.binary_length(source).to_numpy(zero_copy_only=False)):
            found = [main_text(page) for page in source.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(found, pa.string()),
                 pa.array([len(text) for text in found], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select(*keep, F.coalesce(F.col(column), F.lit("")).alias("__page"))
    return map_batches(rows, run, ", ".join(f"`{name}` {kinds[name]}" for name in keep)
                       + ", text string, n_chars bigint")
