"""One forward pass over the markup of a page, to blocks of text and where they stand.

The pass is linear: every search begins where the last ended, and a search
for a missing end mark ends the page.
"""

from __future__ import annotations

import re
from html import unescape

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noembed noframes xmp".split())
# elements whose content is no text of the page; an enclosing end tag closes them
EMBEDDED = frozenset("noscript template iframe svg math object select button canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
# elements that end an open paragraph, as all block elements do
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
# a misplaced end tag does not reach beyond these
SCOPES = frozenset("td th table article main body nav aside footer header form".split())

# Elements, roles and names that are not main text.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs byline-share comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

# words of layout that a compound name may add to these
LAYOUT_NAMES = frozenset(
    "area bar block bottom box button buttons column container content form frame group holder icon icons inner item items large left link links list main mobile module outer "
    "overlay panel placeholder right row section slot small sticky text title top unit up wrap wrapper zone".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=/>"'][^\s=/>]*)?(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_WANTED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "itemprop", "style"))


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a start tag from ``at`` on, and where the tag ends. A quote opens a value only after ``=``."""
    found: dict[str, str] = {}
    n = len(html)
    while at < n and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m.end() == at:  # a stray character
            at += 1
            continue
        name = (m[1] or "").lower()
        if name in _WANTED and name not in found:
            found[name] = next((v for v in m.groups()[1:] if v is not None), "")
        at = m.end()
    return found, min(at + 1, n)


def _marked(name: str, attributes: dict[str, str]) -> bool:
    """Does the element stand beside the main text?"""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        return True
    if attributes.get("role", "").lower() in ASIDE_ROLES:
        return True
    if name in ("html", "body"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if name in ("article", "main"):  # these are also named by what is in them
        return any(word in ASIDE_NAMES for word in names)
    return any(_names_aside(word) for word in names)


def _names_aside(word: str) -> bool:
    """A whole name, or a compound of such names and layout words: ``ad-slot``, ``social-share``, but not ``share-price``."""
    parts = [part.rstrip("0123456789") or "top" for part in re.split(r"[-_:]+", word) if part]
    return any(part in ASIDE_NAMES for part in parts) and all(part in ASIDE_NAMES or part in LAYOUT_NAMES for part in parts)


def _is_main(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "") == "articleBody"


MAIN, OPEN, BESIDE = 2, 1, 0


def blocks(html: str) -> list[tuple[int, str]]:
    """Blocks of text in page order: where each stands, and its text.

    MAIN: in an article or main element; BESIDE: in an element that is no main
    text by its kind, role or name; OPEN: neither.  White space in a block is
    one space; character references are decoded; empty blocks are left out.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    counts: dict[str, int] = {}
    place = OPEN

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((place, text))
            parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal place
        while len(stack) > depth:
            counts[stack.pop()[0]] -= 1
        place = stack[-1][1] if stack else OPEN

    def close(name: str, scopes: frozenset) -> bool:
        """Close the innermost open ``name``, unless a scope lies between."""
        if not counts.get(name):
            return False
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                flush()
                pop_to(depth)
                return True
            if stack[depth][0] in scopes:
                return False
        return False

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            parts.append(html[at:])
            break
        if lt > at:
            parts.append(html[at:lt])
        mark = html[lt + 1 : lt + 2]
        if mark == "!":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if mark == "?":
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if mark == "/":
            m = _NAME.match(html, lt + 2)
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            if m:
                name = m[0].lower()
                if name not in INLINE:
                    flush()
                    close(name, SCOPES if name not in SCOPES else frozenset(("td", "th", "table")))
                elif counts.get(name):
                    close(name, SCOPES)
            continue
        m = _NAME.match(html, lt + 1)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        name = m[0].lower()
        attributes, at = _attributes(html, m.end())
        if name in RAW:
            flush()
            end = re.compile(rf"</{name}\b", re.I).search(html, at)
            if not end:
                at = n
            else:
                close_at = html.find(">", end.end())
                at = n if close_at < 0 else close_at + 1
            continue
        if name in EMBEDDED and html[at - 2 : at] == "/>":
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in ENDS_P:
            close("p", SCOPES | EMBEDDED)
        if name == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif name in ("td", "th", "tr"):
            for cell in ("td", "th") if name != "tr" else ("td", "th", "tr"):
                close(cell, frozenset(("table",)))
        inside = place
        if inside != BESIDE:
            if name in EMBEDDED or _marked(name, attributes) or (name in ASIDE and not (name == "header" and inside == MAIN)):
                inside = BESIDE
            elif _is_main(name, attributes):
                inside = MAIN
        if name not in INLINE or inside != place or counts.get(name):
            if inside != place:
                flush()
            stack.append((name, inside))
            counts[name] = counts.get(name, 0) + 1
            place = inside
    flush()
    return out
