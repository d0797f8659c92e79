"""A small tolerant HTML reader: tags, attributes and leaf blocks with their tag paths."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of HTML: elements whose content is no text, without an end tag, and inside a line of text.
RAW = frozenset("script style noscript template textarea select svg math iframe object head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Tag:
    name: str
    closing: bool
    raw: str

    def attributes(self) -> dict[str, str]:
        return {
            m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(self.raw)))
        }


def tokens(page: str) -> Iterator[str | Tag]:
    """Texts (undecoded) and tags in order; comments, declarations and a tag cut off by the end are dropped."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            yield page[at:]
            return
        if m.start() > at:
            yield page[at : m.start()]
        at = m.end()
        if not m[2] or page[at - 1] != ">":
            continue
        tag = Tag(m[2].lower(), bool(m[1]), m[3])
        yield tag
        if tag.name in RAW and tag.name != "head" and not tag.closing and not tag.raw.endswith("/"):
            end = re.compile(rf"</{re.escape(tag.name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)


def clean(text: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    return _SPACE.sub(" ", entities.unescape(text)).strip()


@dataclass
class Leaf:
    """A block of text: its tag path (names with class and id words), the part of it in links, and its text."""

    path: tuple[str, ...]
    text: str
    link_chars: int


def _step(tag: Tag) -> str:
    if "=" not in tag.raw:
        return tag.name
    attributes = tag.attributes()
    words = re.findall(r"[a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower())
    return " ".join([tag.name, *words])


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in order. Inline tags do not end a block, a line break is white space in it."""
    out: list[Leaf] = []
    path: list[tuple[str, str]] = []
    held: list[str] = []
    links, link_chars = 0, 0

    def end_block() -> None:
        nonlocal link_chars
        text = clean("".join(held))
        if text:
            out.append(Leaf(tuple(s for _, s in path), text, min(link_chars, len(text))))
        held.clear()
        link_chars = 0

    for token in tokens(page):
        if isinstance(token, str):
            if not any(name in RAW for name, _ in path[:2]):
                held.append(token)
                link_chars += len(token.strip()) if links else 0
            continue
        name = token.name
        if name == "a":
            links = max(0, links - 1) if token.closing else links + 1
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        end_block()
        links = 0
        if token.closing:
            depth = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == name), None)
            if depth is not None:
                del path[depth:]
        elif name == "body":
            path[:] = [p for p in path if p[0] == "html"] + [(name, _step(token))]  # an open head ends here
        elif name not in VOID:
            # A block start ends an open paragraph; an item or row ends its open sibling.
            if path and (path[-1][0] == "p" or path[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                path.pop()
            if not token.raw.endswith("/"):
                path.append((name, _step(token)))
    end_block()
    return out
