"""Blocks of a web page: the text between block tags, in order, each with its path of open tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul xmp".split()
)
RAW = set("iframe noembed noframes script style template textarea title".split())
# Inside these only scripts and styles are raw, a title is text like any other, and a block tag ends them.
FOREIGN = set("svg math".split())
_FOREIGN_RAW = set("script style".split())
_FOREIGN_HOLDS = set("foreignobject desc annotation-xml".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_HOLDS = set("ul ol dl table select menu dir".split())

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_XMP_END = re.compile(r"</xmp(?![a-zA-Z0-9-])", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Element:
    tag: str
    tokens: tuple[str, ...]  # the tag, and the words of its class, id and role
    mark: str | None = None  # value of data-mark, which training pages carry


@dataclass
class Block:
    path: tuple[Element, ...]
    text: str
    link_chars: int


def _element(tag: str, attributes: str) -> Element:
    tokens, mark = [tag], None
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name in ("class", "id", "role"):
            words = [w.lower() for w in _PARTS.findall(unescape(value))]
            tokens += words + [f"{tag}.{w}" for w in words]
        elif name == "data-mark":
            mark = value
    return Element(tag, tuple(tokens), mark)


def blocks(html: str | None) -> list[Block]:
    """Blocks of the whole page. Scripts, styles, comments and the like give none; nor does a tag cut off at the end.

    Formulas, drawings and what an object holds are text; so is all between xmp tags, as it stands.

    A line break tag counts as a blank; unclosed paragraphs and list items end where the next one begins.
    """
    html = html or ""
    found: list[Block] = []
    stack: list[Element] = []
    pieces: list[str] = []
    links = link_chars = foreign = at = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(tuple(stack), text, min(link_chars, len(text))))
        pieces.clear()
        link_chars = 0

    def close(place: int) -> None:
        nonlocal links, foreign
        links -= sum(e.tag == "a" for e in stack[place:])
        foreign -= sum(e.tag in FOREIGN for e in stack[place:])
        del stack[place:]

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                link_chars += len(text.strip())

    known: dict[tuple[str, str], Element] = {}
    while match := _TAG.search(html, at):
        add(html[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in BLOCKS and not (foreign and tag == "title"):
                flush()
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag == tag:
                    close(place)
                    break
                if tag not in BLOCKS and stack[place].tag in BLOCKS:
                    break
            continue
        if foreign and tag in BLOCKS and tag != "title":
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag in _FOREIGN_HOLDS:
                    break
                if stack[place].tag in FOREIGN:
                    close(place)
        if tag in (_FOREIGN_RAW if foreign else RAW):
            if tag in BLOCKS:
                flush()
            if not match[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in BLOCKS and not (foreign and tag == "title"):
            flush()
            open_tags = CLOSES.get(tag, ())
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag == "p" or stack[place].tag in open_tags:
                    close(place)
                elif stack[place].tag in _HOLDS or (stack[place].tag in BLOCKS and not open_tags):
                    break
        elif tag == "br":
            pieces.append(" ")
        if tag not in VOID and not match[3].endswith("/>"):
            key = (tag, match[3])
            if key not in known:
                known[key] = _element(tag, match[3][:-1] if match[3].endswith(">") else match[3])
            stack.append(known[key])
            links += tag == "a"
            foreign += tag in FOREIGN
            if tag == "xmp" and (end := _XMP_END.search(html, at)):
                pieces.append(html[at : end.start()])
                link_chars += len(pieces[-1].strip()) if links else 0
                at = end.start()
    rest = html[at:]
    add(rest if "<" not in rest or not re.search(r"</?[a-zA-Z][^>]*\Z", rest) else rest[: rest.rindex("<")])
    flush()
    return found
