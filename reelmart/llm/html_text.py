"""Main text of web pages by tree scoring.

The page becomes a tree of its elements. Each block of text passes points, for its length and its
commas, to its parent and half of them to its grandparent; the points of a container are discounted
by its share of link text. The best container is kept, or the article or main element around it, and
beside it, up to the body, all running text that is not mostly links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are taken out of the tree before; text lies in blocks, one line each. Headings, paragraphs and
cells are never taken out by their names, ids count as whole known names only, and blocks whose names
merely hold an unwanted word come back where they lie in the article and are not full of links.

Defined results: NULL and empty pages, and pages without text, give an empty text; markup that is not
closed or not opened is read as browsers do; a page without markup is one block; NULL page_id and url
are kept; repeated rows are extracted each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from reelmart.llm.batches import slices
from reelmart.shipping import ship_package

# A comment, a declaration, a tag, or the text up to the next "<". Attribute values may hold ">".
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^<]+|<)""",
    re.S,
)
_OPENS = re.compile(r"/?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements that never hold main text.
_NEVER = frozenset(
    "script style noscript template iframe object embed applet svg canvas audio video map annotation "
    "annotation-xml head title nav footer aside form button input select option optgroup textarea label "
    "fieldset dialog menu xmp noembed noframes".split()
)
# Of these, those that a page may also put around its running text, and what makes them a form.
_FORMS = frozenset("form fieldset".split())
_CONTROLS = frozenset("input select textarea button".split())
# Elements that begin a new line of text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# An open p ends where one of these begins.
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
# An open element of the key ends where one of the values begins, within the nearest of the limits.
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
}
_STARTS = {
    tag: {open_tag for open_tag, (by, _) in _ENDED_BY.items() if tag in by}
    for tag in ("li", "dt", "dd", "option", "optgroup", "td", "th", "tr", "tbody", "tfoot")
}
_SCOPE = frozenset({"html", "body", "table", "td", "th", "article", "section", "div", "main"})

# Words of class and id names that mark what is not the article, each as a whole name part.
_UNWANTED = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|"
    r"sidebar|side|aside|rail|widget|related|recommended|recommendations|teaser|"
    r"header|masthead|topbar|footer|foot|copyright|legal|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"login|paywall|comments?|disqus|replies|reply|respond|responses|share|sharing|social|follow|"
    r"toolbar|skip|hidden)(?:$|[^a-z])"
)
# Of these, names that a layout may also give to what is around the article.
_AROUND = re.compile(
    r"(?:^|[^a-z])(?:sidebar|side|rail|header|topbar|banner|notice|alert|popup|modal|overlay|paywall|"
    r"login|subscribe|subscription|follow|toolbar|hidden|widget)(?:$|[^a-z])"
)
_WANTED = re.compile(
    r"(?:^|[^a-z])(?:article|content|main|body|entry|post|story|text|page|blog)(?:$|[^a-z])"
)
# Name parts that say something else: what a layout has, and the heading of an article itself.
_NO_MARK = re.compile(
    r"\b(?:has|with|without|no|show|hide)[-_]\w+|(?:article|entry|post|story|content|page)[-_ ]?head(?:er)?\b"
)
_UNWANTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar tooltip".split()
)

# Of the unwanted words, those that also occur in the names of parts of an article. A name of other words
# is sure if all of its parts are unwanted or say where and how a block lies.
_UNSURE = frozenset(
    "sponsor promotion side rail related recommended recommendations header foot legal consent notice alert "
    "social follow skip".split()
)
_LAYOUT = frozenset(
    "left right top bottom site page main global primary secondary section area list box container wrapper "
    "wrap block bar link links button buttons form post posts item inner outer content slot unit group".split()
)
# What is never left out by its names, as long as it is shown.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p td th".split())
# Share of links from which a block is left out that has an unsure name.
NAMED_LINKS = 0.3

# Elements that hold paragraphs, so that text directly within them counts for themselves.
_CONTAINERS = frozenset("article body div html main section".split())

# Elements that an article puts its text into.
_HOLDS_TEXT = frozenset(
    "h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th caption figcaption summary".split()
)
_ENDS_SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)\]]*$""")
# Share of links from which a block beside the article is no running text.
LINK_HEAVY = 0.5

_SPACE = re.compile(r"[\s\x00]+")


class _Node:
    __slots__ = (
        "tag", "parent", "children", "names", "score", "text_length", "link_length", "dropped", "by_name", "unsure",
    )

    def __init__(self, tag: str, parent: _Node | None, names: str = ""):
        self.tag = tag
        self.parent = parent
        self.children: list[_Node | str] = []
        self.names = names
        self.dropped = self.by_name = self.unsure = False
        self.score = 0.0
        self.text_length = self.link_length = 0


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def _is_dropped(tag: str, found: dict[str, str], parent: _Node) -> bool:
    """Whether an element is no main text by its tag, role or visibility."""
    if tag in _NEVER:
        return True
    if tag in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in _UNWANTED_ROLES:
        return True
    return tag == "header" and not _within(parent, ("article", "main"))


def _parted(name: str) -> str:
    # Names are read in parts: camel case and digits separate them as well.
    return re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()


@lru_cache(maxsize=1 << 14)
def _mark(name: str, whole: bool) -> int:
    """2 if one name of a class or id marks what is no article, 1 if it may, 0 if not.

    Ids are slugs of headings as well, so they count as ``whole`` known names only.
    """
    name = _NO_MARK.sub(" ", _parted(name))
    if not _UNWANTED.search(name):
        return 0
    parts = re.findall("[a-z]+", name)
    unwanted = {x for x in parts if _UNWANTED.search(x)}
    known = all(x in unwanted or x in _LAYOUT for x in parts)
    if known and unwanted - _UNSURE:
        return 2
    return 1 if known or not whole else 0


def _keep_around(node: _Node | None) -> None:
    """What holds an article or the main element is not left out for the names of a layout alone.

    Comments, menus and the like stay out, and with them articles that lie within.
    """
    inside = node
    while inside is not None:
        if inside.dropped and not (inside.by_name and _is_layout(inside.names)):
            return
        inside = inside.parent
    while node is not None:
        node.by_name = node.dropped = False
        node = node.parent


def _is_layout(names: str) -> bool:
    """Whether the unwanted names are all such as a layout may have."""
    return not _UNWANTED.search(_AROUND.sub(" ", _NO_MARK.sub(" ", names)))


def _within(node: _Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(html: str) -> _Node:
    """The tree of a page; text is a child as it is, still with character references."""
    root = _Node("#root", None)
    node = root
    forms: list[_Node] = []
    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.match(html, at)
        if match is None:
            node.children.append(html[at:])
            break
        at = match.end()
        closing, name, source, text = match.groups()
        if text is not None:
            if text == "<" and _OPENS.match(html, at):
                break  # a tag that never ends takes the rest of the page, as in browsers
            node.children.append(text)
            continue
        if name is None:
            continue
        tag = name.lower()
        if closing:
            node = _close(node, tag)
            continue
        node = _close_implied(node, tag)
        found = _attributes(source) if source.strip() else {}
        classes, own_id = found.get("class", ""), found.get("id", "").strip()
        names = f"{classes} {own_id}".strip()
        child = _Node(tag, node, _parted(names))
        if tag in _FORMS and not _is_dropped("div", found, node):
            forms.append(child)
        child.dropped = bool(found or tag in _NEVER or tag == "header") and _is_dropped(tag, found, node)
        if names and (tag in _FORMS or not child.dropped) and tag not in ("html", "body", "main"):
            mark = max([_mark(own_id, True), *(_mark(name, False) for name in classes.split())])
            child.by_name, child.unsure = mark > 0, mark == 1
            child.dropped |= mark > 0 and (tag not in _TEXT or "hidden" in classes.split())
        if tag in ("article", "main") and not child.dropped:
            _keep_around(node)
        node.children.append(child)
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        node = child
    if forms:
        _keep_forms_of_text(root, forms)
    return root


def _form_texts(node: _Node, inner: dict[int, tuple[int, bool]]) -> tuple[int, bool]:
    """Letters of the text below ``node`` that is not left out, forms apart, and whether it has controls.

    ``inner`` takes the same for each form, without what lies in forms within it.
    """
    # (element, the form it belongs to, whether it is left out)
    stack: list[tuple[_Node, _Node, bool]] = [(node, node, False)]
    length: dict[int, int] = {id(node): 0}
    controls: set[int] = set()
    while stack:
        current, form, out = stack.pop()
        for child in current.children:
            if isinstance(child, str):
                if not out:
                    length[id(form)] += len(child) - child.count(" ")
                continue
            if child.tag in _CONTROLS:
                controls.add(id(form))
            if child.tag in _FORMS:
                length[id(child)] = 0
                # Names and roles may leave out a form as anything else.
                stack.append((child, child, out or child.by_name))
            else:
                stack.append((child, form, out or child.dropped))
    inner.update({key: (size, key in controls) for key, size in length.items() if key != id(node)})
    return length[id(node)], id(node) in controls


def _keep_forms_of_text(root: _Node, forms: list[_Node]) -> None:
    """Forms that the page is built into are no forms: their controls are left out, not their text.

    A form holds the running text if it has more text than all that lies outside of forms, a
    fieldset without controls is a frame around text. Those that names mark stay out.
    """
    found: dict[int, tuple[int, bool]] = {}
    outside, _ = _form_texts(root, found)
    for node in forms:
        length, has_controls = found[id(node)]
        is_text = length > outside if node.tag == "form" else not has_controls
        if is_text and length and not node.by_name:
            node.dropped = False


def _close(node: _Node, tag: str) -> _Node:
    """The element that is open after ``</tag>``; an end tag without a start changes nothing."""
    found = node
    while found.parent is not None and found.tag != tag:
        # Formatting that is left open does not close the blocks around it.
        if tag not in _BLOCK and found.tag in _BLOCK:
            return node
        found = found.parent
    return found.parent if found.parent is not None else node


def _close_implied(node: _Node, tag: str) -> _Node:
    if tag in _ENDS_P:
        found = node
        while found.parent is not None and found.tag not in _SCOPE and found.tag not in ("button", "li"):
            if found.tag == "p":
                node = found.parent
                break
            found = found.parent
    ended = _STARTS.get(tag)
    if ended:
        found = node
        while found.parent is not None:
            if found.tag in ended:
                node = found.parent
                # A new row also ends the cell within it, a cell only itself.
                found = node
                continue
            if found.tag in ("ul", "ol", "menu", "dl", "select", "table"):
                break
            found = found.parent
    return node


def _clean(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


def _blocks(node: _Node, unsure: bool = False) -> Iterator[tuple[_Node, str, int]]:
    """``(element, text, letters in links)`` of each block of text, in page order.

    With ``unsure`` also of what is left out for an unsure name.
    """
    parts: list[str] = []
    state = {"owner": node, "links": 0}

    def flush() -> Iterator[tuple[_Node, str, int]]:
        if parts:
            text = _clean("".join(parts))
            if text:
                yield state["owner"], text, min(state["links"], len(text))
            parts.clear()
        state["links"] = 0

    # (element, its remaining children, the block around it, whether within a link)
    stack = [(node, iter(node.children), node, node.tag == "a")]
    while stack:
        current, children, block, in_link = stack[-1]
        for child in children:
            if isinstance(child, str):
                if not parts:
                    state["owner"] = block
                parts.append(child)
                if in_link:
                    state["links"] += len(_clean(child))
                continue
            if child.tag in _BLOCK:
                yield from flush()
            if child.dropped and not (unsure and child.unsure):
                continue
            if child.tag in _VOID:
                if child.tag in ("br", "hr") and parts:
                    parts.append(" ")
                continue
            inner = child if child.tag in _BLOCK else block
            stack.append((child, iter(child.children), inner, in_link or child.tag == "a"))
            break
        else:
            stack.pop()
            if current.tag in _BLOCK:
                yield from flush()
    yield from flush()


def _points(text: str) -> float:
    return 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)


def _link_density(node: _Node) -> float:
    return node.link_length / node.text_length if node.text_length else 0.0


def _restore(node: _Node) -> bool:
    """Takes back what was left out within ``node`` for an unsure name alone and has few links."""
    restored = False
    open_nodes = [node]
    while open_nodes:
        for child in open_nodes.pop().children:
            if isinstance(child, str):
                continue
            if child.dropped:
                if not child.unsure:
                    continue
                sizes = [(len(text), links) for _, text, links in _blocks(child, True)]
                if sum(links for _, links in sizes) >= NAMED_LINKS * sum(size for size, _ in sizes):
                    continue
                child.dropped, restored = False, True
            open_nodes.append(child)
    return restored


def _running_text(blocks: list[tuple[_Node, str, int]]) -> set[int]:
    """The elements that hold text of an article: in elements for text, or sentences."""
    found: set[int] = set()
    for owner, text, _ in blocks:
        if not owner.by_name and (owner.tag in _HOLDS_TEXT or _ENDS_SENTENCE.search(text)):
            node: _Node | None = owner
            while node is not None and id(node) not in found:
                found.add(id(node))
                node = node.parent
    return found


def main_text(html: str | None) -> str:
    """The lines of the article of a page."""
    if not html:
        return ""
    root = parse(html)
    blocks = list(_blocks(root))
    if not blocks and _restore(root):
        blocks = list(_blocks(root))
    scored: dict[int, _Node] = {}
    for owner, text, links in blocks:
        node: _Node | None = owner
        while node is not None:
            node.text_length += len(text)
            node.link_length += links
            node = node.parent
        # Text with the name of what is no article does not tell where the article is.
        points = 0.0 if owner.by_name else _points(text) * (1 - links / len(text))
        # Points go to the container of a paragraph, half of them to the one around it.
        container = owner if owner.tag in _CONTAINERS or owner.parent is None else owner.parent
        for share in (1.0, 0.5):
            if id(container) not in scored:
                scored[id(container)] = container
                if container.tag in ("article", "main"):
                    container.score += 25
                elif _WANTED.search(container.names):
                    container.score += 10
                elif container.tag in ("li", "ul", "ol", "dl", "dt", "dd", "th"):
                    container.score -= 3
            container.score += share * points
            if container.parent is None:
                break
            container = container.parent
    if not blocks:
        return ""
    best = max(
        scored.values(), key=lambda n: n.score * (1 - _link_density(n)), default=root
    )
    # An article, or the main element, is kept as a whole when its best container lies within it.
    whole: _Node | None = best
    while whole is not None and whole.tag != "article":
        whole = whole.parent
    if whole is None:
        whole = best
        while whole is not None and whole.tag != "main":
            whole = whole.parent
    best = whole or best
    kept = {id(best)}
    nodes = {id(best): best}
    # Elements whose own text is kept, without that of the elements within them.
    partly = set()
    running = _running_text(blocks)
    # Beside the article, or beside all that holds the best container up to the body, running text stays.
    node = best
    while node.parent is not None:
        around = node.parent
        partly.add(id(around))
        for sibling in around.children:
            if isinstance(sibling, str) or sibling is node or sibling.dropped or sibling.by_name:
                continue
            if id(sibling) in running and _link_density(sibling) < LINK_HEAVY:
                kept.add(id(sibling))
                nodes[id(sibling)] = sibling
        if whole is not None or around.tag in ("body", "html"):
            break
        node = around
    if any([_restore(nodes[i]) for i in kept]):
        blocks = list(_blocks(root))

    def is_kept(node: _Node | None) -> bool:
        while node is not None:
            if id(node) in kept:
                return True
            node = node.parent
        return False

    verdicts: dict[int, bool] = {}
    lines = []
    for owner, text, links in blocks:
        verdict = verdicts.get(id(owner))
        if verdict is None:
            verdict = verdicts[id(owner)] = is_kept(owner)
        if verdict or id(owner) in partly and _ENDS_SENTENCE.search(text) and links < LINK_HEAVY * len(text):
            lines.append(text)
    return "\n".join(lines)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (one line per block) and n_chars."""
    ship_package(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {id_type}, url string, text string, n_chars bigint"
    )
