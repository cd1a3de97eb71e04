"""HTML as a stream of text blocks with the elements they stand in; malformed pages give what can be read."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements of HTML by their role.
RAW = frozenset("script style title textarea noscript template iframe svg noembed noframes xmp object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html"}
LEFT_OUT = frozenset("aside button datalist dialog footer form header input label menu nav select textarea head".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus foot footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
# Parts of class names and ids that say nothing of the content.
NEUTRAL = frozenset("area article bar block bottom box column container content entry fixed float global group holder home inner item items js layout left links list main mobile module outer page panel post primary reader region right row section secondary site slot sticky sub tertiary top unit user wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus replies".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


@dataclass
class Element:
    name: str
    step: str
    left_out: bool
    main: bool
    #: named by a class or an id, or a form: what a whole page may stand in as well
    loose: bool = False
    comments: bool = False
    number: int = 0


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    #: numbers of the elements around it that are named as no main text
    named: tuple[int, ...]
    in_main: bool
    linked: int = 0
    left_out: bool = False


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: times that each path of elements was opened
    opened: dict[tuple[str, ...], int] = field(default_factory=dict)


def _element(name: str, attributes: str) -> Element:
    got = {m[1].lower(): next(v for v in m.groups()[1:] if v is not None) for m in ATTRIBUTE.finditer(attributes)} if attributes and attributes.strip() else {}
    classes, own_id, role = got.get("class", ""), got.get("id", ""), got.get("role", "").lower()
    names = [{w.lower() for w in PARTS.findall(c)} - NEUTRAL for c in (*classes.split(), own_id)] if got else []
    told = {w for parts in names if parts and parts <= WORDS for w in parts}  # every part of a name says so, but for the neutral ones
    step = name + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(classes.split())) + ("#" + re.sub(r"\d+", "#", own_id) if own_id else "")
    main = name in ("article", "main") or role in ("main", "article")
    firm = (name in LEFT_OUT and name != "form") or role in ROLES
    loose = not firm and (name == "form" or (bool(told) and name not in ("html", "body", "article", "main")))
    return Element(name, step, firm or loose, main, loose, bool(told & COMMENTS))


def parse(source: str) -> Page:
    """The page's text blocks in order. Character references are decoded, white space becomes one space, empty blocks are left out."""
    page, stack, parts = Page(), [], []
    state = {"linked": 0}
    at, n = 0, len(source)
    in_main = in_link = 0
    around: list[Element] = []  # the elements around the place that are named as no main text
    seen: list[Element] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append(Block(tuple(e.step for e in stack), text, tuple(e.number for e in around), in_main > 0, state["linked"]))
            parts.clear()
            state["linked"] = 0

    def pop() -> None:
        nonlocal in_main, in_link
        e = stack.pop()
        if e.left_out:
            around.pop()
        in_main -= e.main
        in_link -= e.name == "a"

    while at < n:
        match = TOKEN.search(source, at)
        chunk = source[at:match.start() if match else n]
        if chunk:
            parts.append(chunk)
            state["linked"] += len(chunk) * (in_link > 0)
        if not match:
            break
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        closing = bool(match[1] or match[4])
        attributes = match[3] or match[6] or ""
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in CLOSES_P and any(e.name == "p" for e in stack):
            while stack[-1].name != "p":
                pop()
            pop()
        for group, until in (({"li"}, {"ul", "ol", "menu", "dir"}), ({"dd", "dt"}, {"dl"}), ({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table", "tbody", "thead", "tfoot"}), ({"option"}, {"select"})):
            if name in group:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in until:
                        break
                    if stack[k].name in group:
                        while len(stack) > k:
                            pop()
                        break
        e = _element(name, attributes)
        stack.append(e)
        if e.left_out:
            e.number = len(seen)
            seen.append(e)
            around.append(e)
        in_main += e.main
        in_link += name == "a"
        if name in BLOCK:
            path = tuple(x.step for x in stack)
            page.opened[path] = page.opened.get(path, 0) + 1
        if match[3] is not None and attributes.endswith("/") and name not in BLOCK:
            pop()
    flush()
    _judge(page, seen)
    return page


def _judge(page: Page, named: list[Element]) -> None:
    """Mark the blocks in elements named as no main text.

    A name does not count where the element holds most of the page's article (comments excepted), or, in a page without one, where a class, an id or a form
    holds most of all text: then it is around the page and not beside its text.
    """
    held, main, total = [0] * len(named), [0] * len(named), [0, 0]
    for block in page.blocks:
        total[0] += len(block.text)
        total[1] += len(block.text) * block.in_main
        for number in block.named:
            held[number] += len(block.text)
            main[number] += len(block.text) * block.in_main
    void = {e.number for e in named if not e.comments and (2 * main[e.number] > total[1] if total[1] else e.loose and 2 * held[e.number] > total[0])}
    for block in page.blocks:
        block.left_out = any(number not in void for number in block.named)
