"""Main-text extraction from HTML by two passes of block rules.

The page is cut into blocks at block-level tags, in one pass over its characters. Pass one classifies each block
without context from its stop-word density, its length and its link density (and from the element it stands in:
navigation, footers, adverts, forms, comments are boilerplate whatever they say). Pass two lets
each ambiguous block (short, or long without a clear density) inherit the label of its nearest decided
neighbour. Of two equally near ones with different labels a long block follows the good one, a short one the
other. Inside an ``article`` or ``main`` element the element itself is the neighbour at either end, and boilerplate
elements in it are no neighbours.

An ``article`` or ``main`` decides about what stands outside it only if the rules find no more text there than it holds itself; else it
is a teaser, and all blocks go through the rules alike. On a page with hardly any of the known stop words (another language) length
and link density decide alone; characters of scripts that write a word in one or two count threefold.

Broken markup: a quote opens a value only after an equals sign; a value whose quote is never closed ends at white space or
``>``; a tag or comment without an end takes the rest of the page; a ``select``, ``button`` or other skipped element that
is never closed skips nothing, and one that is still open where an article, heading, paragraph or section starts ends there.
A form is boilerplate, but an ``article`` or ``main`` element in it is not, and on pages without one a form with more than
half of the text outside other boilerplate is the page.

Defined results: null or empty html, and pages without a main text, give the empty string;
character references are decoded once; white space inside a block becomes one space; blocks are joined by one newline
pair; repeated rows give repeated results; extra columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

# Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    "the of and a to in is it that for was with as on are be this by an or from at not which have had "
    "le la les de des du et en un une que qui dans pour pas sur au aux est avec par ce il elle "
    "der die das und ist in den dem ein eine zu von mit sich nicht auf für als auch es im "
    "el los las y que se del al lo por con para no su una como más".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BAD_TAGS = frozenset("nav header footer aside menu dialog".split())
FORM_TAGS = frozenset(("form", "fieldset"))
SKIP_TAGS = frozenset("head noscript template svg math iframe object select button canvas audio video datalist applet".split())
RAW_TAGS = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that end at the start of what they cannot hold.
CONTROLS = frozenset(("select", "button", "datalist"))
ENDS_CONTROL = frozenset("article main section header footer nav p h1 h2 h3 h4 h5 h6".split())
ENDED_BY_SAME = frozenset("p li dt dd option tr td th".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert menu nav navbar navigation sidebar widget share sharing social comment comments disqus reply replies respond footer masthead "
    "breadcrumb breadcrumbs related recommended newsletter subscribe subscription signup popup modal overlay toolbar pagination pager "
    "skip login search paywall copyright".split()
)
GOOD_WORDS = frozenset("article post entry content body main text story".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())

SHORT, LONG = 70, 200
LOW_STOPS, HIGH_STOPS, MAX_LINKS, KNOWN_STOPS = 0.15, 0.25, 0.33, 0.05
_DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9f]")

# possessive, so that no character is tried twice
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))"
_ATTR = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:{_VALUE})?+")
_REST = re.compile(rf"(?:[\s/=]++|[^\s/>=]++(?:{_VALUE})?+)*+")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}


class Block:
    __slots__ = ("linked", "bad", "form", "scope", "text")

    def __init__(self, text: str, linked: int, bad: bool, form: bool, scope: int):
        self.text, self.linked, self.bad, self.form, self.scope = text, linked, bad, form, scope


def _boilerplate_element(tag: str, attrs: str) -> bool:
    if tag in BAD_TAGS:
        return True
    if tag in MAIN_TAGS or tag in ("html", "body") or not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
            if words & BAD_WORDS and not words & GOOD_WORDS or "comment" in words or "comments" in words:
                return True
        elif name == "role" and value.lower() in BAD_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Tags:
    """The page as (text, closing, tag, attributes) steps; ``tag`` is empty after the last text."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.ends: dict[str, int] = {}

    def closes_later(self, tag: str) -> bool:
        """Whether ``</tag`` follows; each stretch of the page is searched once per tag."""
        if self.ends.get(tag, 0) != -1 and self.ends.get(tag, 0) <= self.at:
            m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(self.page, self.at)
            self.ends[tag] = m.end() if m else -1
        return self.ends[tag] != -1

    def __iter__(self):
        page, n, start = self.page, len(self.page), 0
        look = 0
        while (at := page.find("<", look)) >= 0:
            m = _NAME.match(page, at + 1)
            if m:
                end = _REST.match(page, m.end()).end()
                yield page[start:at], m[1], m[2].lower(), page[m.end() : end]
                if end >= n:
                    return
                at = end + 1
                if not m[1] and (raw := _RAW_END.get(m[2].lower())):
                    stop = raw.search(page, at)
                    if not stop:
                        return
                    at = stop.end()
                self.at = start = look = at
            elif page.startswith(("<!", "</", "<?"), at):
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(mark, at + 2)
                yield page[start:at], "", "!", ""
                if end < 0:
                    return
                self.at = start = look = end + len(mark)
            else:
                look = at + 1
        yield page[start:], "", "", ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. ``scope`` is the number of the enclosing article, 0 outside."""
    out: list[Block] = []
    parts: list[str] = []
    # block elements and those that change a state: tag, boilerplate, form, skipped, scope
    stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
    depth: dict[str, int] = {}
    scopes = links = linked = breaks = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                _, bad, form, _, scope = stack[-1]
                out.append(Block(text, linked, bad, form, scope))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    tags = _Tags(page)
    for piece, closing, tag, attrs in tags:
        if piece and not stack[-1][3]:
            parts.append(piece)
            if links:
                linked += len(html_lib.unescape(piece).strip())
            if not piece.isspace():
                breaks = 0
        if tag in ("", "!"):
            continue
        if tag in _RAW_END:
            continue
        if tag == "br":
            breaks += 1
            if not stack[-1][3]:
                parts.append(" ")
            if breaks >= 2:
                close_block()
            continue
        block = tag in BLOCK_TAGS
        if block:
            close_block()
            breaks = 0
        if tag == "a":
            links = 0 if closing else 1
            continue
        if closing:
            if depth.get(tag):
                above = len(stack) - 1
                while not block and stack[above][0] != tag and stack[above][0] not in BLOCK_TAGS:
                    above -= 1
                if block or stack[above][0] == tag:  # an inline element ends no block around it
                    close_block()
                    while pop() != tag:
                        pass
            continue
        if tag in VOID_TAGS or attrs.endswith("/"):
            continue
        while tag in ENDS_CONTROL and stack[-1][0] in CONTROLS or tag in ENDED_BY_SAME and stack[-1][0] == tag or tag == "body" and stack[-1][0] == "head":
            close_block()
            pop()
        _, bad, form, skip, scope = stack[-1]
        hides, marks = tag in SKIP_TAGS and tags.closes_later(tag), _boilerplate_element(tag, attrs)
        if not (block or hides or marks or depth.get(tag)):
            continue
        if hides or marks:
            close_block()
        if tag in MAIN_TAGS:
            form = False
            if not scope:
                scopes += 1
                scope = scopes
        stack.append((tag, bad or marks, form or tag in FORM_TAGS, skip or hides, scope))
        depth[tag] = depth.get(tag, 0) + 1
    close_block()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def weight(text: str) -> int:
    """Length of a text, in which a character from the ideographs on counts threefold."""
    return len(text) + 2 * len(_DENSE.findall(text))


def first_pass(b: Block, known: bool = True) -> str:
    """good, bad, near (long enough but without a clear density) or short. Without a ``known`` language stop words have no say."""
    if b.bad or not b.scope and "©" in b.text:
        return "bad"
    if b.linked > MAX_LINKS * len(b.text):
        return "short" if b.scope else "bad"
    size = weight(b.text)
    if size < SHORT:
        return "short"
    density = stop_density(b.text) if known else HIGH_STOPS
    if density >= HIGH_STOPS:
        return "good" if size > LONG or b.scope else "near"
    if density >= LOW_STOPS or b.scope:
        return "near"
    return "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbour in the same scope."""
    n = len(found)
    edge = {b.scope: bool(b.scope) for b in found}
    sides: list[list[tuple[int, bool]]] = []  # distance and label of the decided neighbour before and after each block
    for order in (range(n), range(n - 1, -1, -1)):
        side = [(0, False)] * n
        last: dict[int, tuple[int, bool]] = {}  # per scope: place among its blocks, label
        place: dict[int, int] = {}
        for i in order:
            s = found[i].scope
            place[s] = place.get(s, 0) + 1
            at, label = last.get(s, (0, edge[s]))
            side[i] = (place[s] - at, label)
            if labels[i] == "good" or labels[i] == "bad" and not s:
                last[s] = (place[s], labels[i] == "good")
        sides.append(side)
    out = []
    for label, (before, first), (after, second) in zip(labels, *sides):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif before == after and first != second:
            out.append(label == "near")
        else:
            out.append(first if before <= after else second)
    return out


def extract(page: str | None) -> list[str]:
    """The main text's blocks in page order."""
    if not page:
        return []
    found = blocks(page)
    open_text = sum(len(b.text) for b in found if not b.bad)
    in_form = sum(len(b.text) for b in found if b.form and not b.bad)
    if 2 * in_form <= open_text or any(b.scope for b in found):  # else the form is the page
        for b in found:
            b.bad = b.bad or b.form
    told = [b for b in found if not b.bad]
    known = stop_density(" ".join(b.text for b in told)) >= KNOWN_STOPS
    if any(b.scope for b in told):
        inside = sum(len(b.text) for b in told if b.scope)
        outside = sum(len(b.text) for b in told if not b.scope and first_pass(b, known) == "good")
        for b in found:
            if outside > inside:  # a teaser: the main text stands elsewhere
                b.scope = 0
            elif not b.scope:  # the page names its article: what stands outside is decided
                b.bad = True
    keep = second_pass(found, [first_pass(b, known) for b in found])
    return [b.text for b, k in zip(found, keep) if k]


def extract_pages(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns (but for one of that name) plus ``text`` string: the blocks of the main text, joined by ``\\n\\n``."""
    bounded_batches(pages.sparkSession)
    kept = pages.select(*(k for k in keep if k.lower() != "text"))
    source = pages.select(*kept.columns, F.col(html_col).alias(fresh(kept, "_lt_html")))
    schema = kept.withColumn("text", F.lit("")).schema

    def work(batches):
        for batch in batches:
            texts = ["\n\n".join(extract(x.as_py())) for x in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)
