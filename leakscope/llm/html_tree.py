"""Pages as trees of elements with the text blocks they hold; tolerant of broken markup."""

import re
from dataclasses import dataclass, field
from html import unescape

# Element names of HTML by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Text up to the closing tag is no markup, and no text of the page; without one, to the page's end.
RAW = frozenset("script style textarea title iframe".split())
# Tags that say nothing of their text.
SKIPPED = frozenset("head option map".split())
# Elements whose text is not the page's; a block that opens in them ends them, as in browsers.
ASIDE = frozenset("svg select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br input "
    "noscript object canvas audio video "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable "
    "mtr mtd mstyle mpadded mspace mfenced menclose merror mmultiscripts mprescripts none "
    "semantics annotation annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul "
    "dt dd".split())
# An opening tag ends an open one of these, up to the nearest container named behind.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element, or with `words` a stretch of text of its parent's."""

    tag: str
    parent: int
    traits: list[str] = field(default_factory=list)
    main: bool | None = None


@dataclass
class Page:
    nodes: list[Node]
    #: (node of the text, block, text): a block ends where a block element begins or ends.
    texts: list[tuple[int, int, str]]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _traits(tag: str, parent: str, attributes: dict[str, str]) -> list[str]:
    """What is known of an element: its name, its parent's, the words of its class, id and role."""
    traits = [f"tag:{tag}", f"tags:{parent}>{tag}"]
    words = {w.lower() for name in ("class", "id", "role", "itemprop", "aria-label")
             for w in _WORD.findall(attributes.get(name, ""))}
    traits += [f"word:{w}" for w in sorted(words)]
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in ASIDE or tag == "template":
        traits.append("hidden")
    elif "hidden" in attributes or "display:none" in style or attributes.get("aria-hidden") == "true":
        traits.append("hidden")
    return traits


def _text_traits(parent: str, text: str, linked: int) -> list[str]:
    """How much of a stretch of text is links, and in which element it stands."""
    share = linked / max(1, len(text))
    link = "none" if not linked else "some" if share < 0.5 else "most"
    return [f"text:{link}", f"in:{parent}:{link}"]


def parse(html: str) -> Page:
    """The page's tree. Elements whose text is no markup (RAW) are left out with what they hold.

    Time is in proportion to the page, however deep its elements are nested. A tag without its end
    before the next `<` is text.
    """
    nodes, texts = [Node("root", -1, ["tag:root"])], []
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements; inline ones share the node around
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    blocks = [0]  # where in the stack the elements are that are not inline
    block, run, linked, links, asides = 0, [], 0, 0, False

    def flush():
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            parent = stack[-1][1]
            nodes.append(Node("#text", parent, _text_traits(nodes[parent].tag, text, linked)))
            texts.append((len(nodes) - 1, block, text))
        linked = 0

    def close(upto: int):
        nonlocal block, links
        for tag, _ in stack[upto:]:
            links -= tag == "a"
            places[tag].pop()
        broken = blocks[-1] >= upto
        while blocks[-1] >= upto:
            blocks.pop()
        if broken or stack[upto][1] != stack[upto - 1][1]:
            flush()
            block += broken
        del stack[upto:]

    def last(names) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def end_open(names, limits):
        found = last(names)
        if found > last(limits):
            close(found)

    def push(tag: str, node: int):
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            piece = unescape(piece)
            run.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if closing:
            found = last((tag,))
            if tag == "p" and not found:
                flush()
                block += 1
            # an inline element does not end outside its block
            if found and (tag not in INLINE or found > blocks[-1]):
                close(found)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            flush()
            block += tag not in ("script", "style")
            continue
        if tag in RAW or tag in SKIPPED:
            continue
        if m[3].endswith("/") and (tag in ("svg", "math") or last(("svg", "math"))):
            continue  # there, a tag may end its own element
        if tag == "br":
            run.append(" ")
            continue
        if tag == "hr":
            flush()
            block += 1
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            if asides:
                end_open(ASIDE, ("foreignobject",))
            end_open(("p",), ("table", "td", "th", "caption"))
        if tag in ENDS:
            end_open(*ENDS[tag])
        attributes = _attributes(m[3]) if m[3].strip() else {}
        asides |= tag in ASIDE
        inline = tag in INLINE
        if inline and not (attributes.keys() & {"class", "id", "role", "hidden", "style"}
                           and tag == "span"):
            links += tag == "a"
            push(tag, stack[-1][1])
            continue
        flush()
        block += not inline
        parent = stack[-1][1]
        main = {"1": True, "0": False}.get(attributes.get("data-main", ""))
        nodes.append(Node(tag, parent, _traits(tag, nodes[parent].tag, attributes), main))
        push(tag, len(nodes) - 1)
    flush()
    return Page(nodes, texts)
