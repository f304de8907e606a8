"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one looks at each block alone: blocks in
containers that never hold article text, and blocks that are mostly links, are bad; long blocks
with many stop words are good, long ones with few are bad; middling ones are near-good and short
ones ambiguous. A container's name is only a hint: names of what no article holds (comments, sidebars, consent) make
blocks bad, others make them ambiguous inside an article and bad outside, and no name says
anything on a page whose long texts are all under such names. Where the stop words don't fit
the page's language, length alone decides. Pass two gives ambiguous and near-good blocks the label of the nearest decided
blocks, of the same article or main container first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements, name hints and stop words.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "textarea", "select", "title", "desc", "annotation", "annotation-xml", "canvas", "audio", "video")
NEVER = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HINTS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "consent", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar")
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "al como con de del el en es esta la las lo los más no para pero por que se su sus un una y "
    "au aux avec ce ces dans des du elle est et il je le les leur mais ne nous ou par pas plus pour qui sa ses son sont sur une vous "
    "als auch auf aus bei bin das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht oder sich sie sind so über um und von vor war wie wird zu zum zur".split()
)
#: Hints that are final in an article too, if they are the whole name or stand beside words of PLAIN only.
FINAL = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments disqus consent cookie cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice pagination popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe".split())
#: Words of names that say nothing about the content.
PLAIN = frozenset("alert area articles bar block body box btn button buttons col container content count entry feed field form group header icons inner item items left link links list main media message more news outer panel policy post posts primary right row secondary section site stories thread text top bottom up user widget widgets wrap wrapper".split())
#: Hints of advertising: short blocks under them are never article text.
ADVERTS = frozenset(("ad", "ads", "advert", "advertisement", "sponsor", "sponsored"))
#: Languages of the stop words.
LANGUAGES = ("en", "es", "fr", "de")
#: In a name with one of these the hint is about what is beside the element (has-sidebar).
AROUND = frozenset(("has", "with", "without", "no", "content", "main", "layout"))
# Rules of pass one, after the published defaults of stop-word density classifiers.
SHORT, LONG, MANY_LINKS, LOW_STOP, HIGH_STOP = 70, 200, 0.4, 0.10, 0.20

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ENDS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("pieces", "linked", "bad", "hint", "inside", "language", "text", "label")

    def __init__(self, bad: bool, hint: int, inside: int, language: str):
        self.pieces: list[str] = []
        self.linked, self.bad, self.hint, self.inside, self.language = 0, bad, hint, inside, language


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), "".join(values))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    """Hidden, or of a role that no article text has."""
    role = attributes.get("role", "").split()
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(role) and role[0].lower() in ROLES


def _hint(attributes: dict[str, str]) -> int:
    """3 if the element's names speak of advertising, 2 if of something else that no article holds (comments,
    sidebars, consent), 1 if they only may: related-work is a name of the author's own."""
    found = 0
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if not any(p in HINTS for p in parts):
            continue
        if all(p in HINTS or p in PLAIN for p in parts) and FINAL & set(parts) and not AROUND - PLAIN & set(parts):
            found = max(found, 3 if ADVERTS & set(parts) else 2)
        elif not AROUND & set(parts):
            found = max(found, 1)
    return found


def _tag_end(page: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Where the tag ends in which `at` is: at the next >, outside of quotes if quotes close. From the
    first tag on whose quotes don't, they count for nothing (else a page could be read again for
    each of its tags). There is a > after `at`."""
    i = at
    while quoted:
        mark = _ENDS.search(page, i)
        if mark and mark[0] == ">":
            return mark.start(), True
        i = page.find(mark[0], mark.end()) + 1 if mark else 0
        quoted = i > 0
    return page.find(">", at), False


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open block elements: name, bad from here, hint, article
    articles, link, language = 0, 0, ""
    now = Block(False, 0, 0, "")

    def put(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            now.pieces.append(text)
            if link:
                now.linked += len("".join(text.split()))

    def fresh() -> None:
        nonlocal now
        if now.pieces:
            now.text = " ".join("".join(now.pieces).split())
            if now.text:
                out.append(now)
        now = Block(*(stack[-1][1:] if stack else (False, 0, 0)), language)

    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    opened: Counter[str] = Counter()
    never: set[str] = set()  # elements that are not closed from here on
    while at < n:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        put(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            put(page[start + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if start > last:
            put(page[start:])
            break
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            continue
        tag = _NAME.match(page, start)
        if not tag:
            put("<")
            at = start + 1
            continue
        end, quoted = _tag_end(page, tag.end(), quoted)
        name, closing, attributes = tag[2].lower(), bool(tag[1]), page[tag.end() : end]
        at = end + 1
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/") and name not in never:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if close:
                    at = page.find(">", close.end()) + 1 or n
                elif name in ("script", "style", "textarea", "title"):
                    at = n
                else:
                    never.add(name)
            fresh() if name in ("title", "textarea", "select") else None
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            now.pieces.append(" ")
            continue
        if name not in BLOCKS and name not in NEVER:
            continue
        if closing:
            while opened[name]:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    break
            link = 0
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                opened[stack.pop()[0]] -= 1  # these end where the next of their kind starts
            bad, hint, inside = stack[-1][1:] if stack else (False, 0, 0)
            named = _attributes(attributes) if attributes.strip() else {}
            if name in ("html", "body"):
                language = re.split("[-_]", named.get("lang", "").strip().lower())[0] or language
            if name in ("article", "main"):
                articles += 1
                inside = articles if name == "article" else -articles  # a main part often holds the whole page
            # A page or article is never given up for its name.
            if name not in ("html", "body", "article", "main"):
                bad, hint = bad or name in NEVER or _hidden(named), max(hint, _hint(named))
            stack.append((name, bad, hint, inside))
            opened[name] += 1
        fresh()
    fresh()
    return out


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are article text."""
    words = [[w.lower() for w in _WORD.findall(b.text)] for b in blocks]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    linked = [b.linked > MANY_LINKS * len(b.text.replace(" ", "")) for b in blocks]
    language = next((b.language for b in reversed(blocks) if b.language), "")
    own = [i for i, b in enumerate(blocks) if not b.bad and not linked[i]]
    fits = language in LANGUAGES if language else sum(stops[i] for i in own) >= LOW_STOP * sum(len(words[i]) for i in own)
    share = [n / max(1, len(ws)) for n, ws in zip(stops, words)]
    solid = [len(b.text) >= LONG and (share[i] >= HIGH_STOP or not fits) for i, b in enumerate(blocks)]
    # Names say nothing where all long texts of the page are under hints.
    hints, some = any(solid[i] and not blocks[i].hint for i in own), any(solid[i] for i in own)
    labels: list[bool | None] = []
    for i, b in enumerate(blocks):
        if b.bad or linked[i]:
            labels.append(False)
        elif b.hint and b.inside > 0:
            labels.append(False if b.hint > 1 and hints or b.hint == 3 and not solid[i] else None)
        elif b.hint and (hints or not solid[i]):
            labels.append(False if hints or b.hint == 3 or not some else None)
        elif len(b.text) < SHORT:
            labels.append(None)
        elif solid[i]:
            labels.append(True)
        elif fits and share[i] < LOW_STOP and not b.inside:
            labels.append(False)
        else:
            labels.append(None)
    before: list[tuple[int, bool] | None] = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int | None, tuple[int, bool]] = {}
        side: list[dict] = [{}] * len(blocks)
        for i in order:
            own, every = last.get(blocks[i].inside), last.get(None)
            side[i] = {"own": own, "all": every}
            if labels[i] is not None:
                last[None] = (i, labels[i])
                if not blocks[i].bad and (labels[i] or not blocks[i].hint):  # what its name took out says nothing of its neighbours
                    last[blocks[i].inside] = (i, labels[i])
        before.append(side)
    out = []
    for i, b in enumerate(blocks):
        if labels[i] is not None:
            out.append(labels[i])
            continue
        near = [x for side in before if (x := side[i]["own"])] if b.inside else []
        if b.inside and not near:
            out.append(True)  # an article of short blocks alone
            continue
        near = near or [x for side in before if (x := side[i]["all"])]
        if not near:
            out.append(True)  # a page of ambiguous blocks alone
            continue
        least = min(abs(x[0] - i) for x in near)
        out.append(any(x[1] for x in near if abs(x[0] - i) == least))
    return out


def main_text(page: str | None) -> str:
    """The page's article: blocks joined by a line feed; empty if there is none."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks)) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            texts = [main_text(p) for p in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages (page_id, url, html;
    more columns are ignored). Null or empty html gives an empty text; ids and urls may be
    null or repeated; each row stands for itself."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, PAGE_SCHEMA)
