"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block the odds of being
content, from its enclosing elements, their class, id and role words, the part of the
page's prose that a so marked element holds, the share of link text, length, punctuation
and neighbours; minus the logarithms of both probabilities are capacities to the two
terminals. Neighbouring blocks are joined by a smoothness edge, and so are each block and
the next in the same container, the stronger the closer they are in the tree. The minimum
cut, found by max-flow, separates content from boilerplate as a whole page.

The classifier is a logistic regression, ``fit`` on ``layouts.SAMPLE`` labelled pages of the
generator ``layouts``, as pages come without labels; ``WEIGHTS`` are what it gave
(``python -m scriptorium.llm.layouts`` prints them).

Elements that never show text (script, style, template, ...) are dropped while parsing,
which takes time in proportion to the page whatever is in it.

Defined cases: null html is empty, and a page without content gives an empty text;
unclosed, stray and misnested tags are tolerated, and a head left open ends at body or at
what may not stand in it; a page of any length is parsed whole;
repeated pages give equal rows; other columns are carried by ``extract`` except those
named like its results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

PIECE = 4 << 20

_MARK = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: "has-sidebar", "ad-free" and the like speak of another element, or of none.
_ABOUT = re.compile(r"\b(?:has|with|without|no|hide|show)[-_]\w+|\b\w+[-_](?:free|less|off|disabled)\b", re.I)
_RIGHTS = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|tous droits|alle rechte|derechos reservados", re.I)

_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_HIDDEN = frozenset("script style template noscript head title iframe noembed noframes textarea xmp svg math canvas object audio video map datalist select option button".split())
#: What may stand in a head; anything else, and text, ends a head left open.
_IN_HEAD = frozenset("base head link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag that ends an open element of these names, unless one of the others is between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "frameset", "legend"}
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())

_BAD_TAGS = frozenset("nav aside footer form menu search dialog fieldset".split())
_GOOD_TAGS = frozenset("article main".split())
_BAD_WORDS = frozenset(
    (
        "ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus submenu "
        "breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert privacy "
        "disclaimer comment comments commentlist commenter discussion disqus reply replies respond reactions share sharing social follow subscribe subscription newsletter signup login "
        "signin register search searchbox searchform form related recommended recommendations recommend popular trending more pager pagination pagenav prevnext toc tags tagcloud tag copyright legal "
        "outbrain taboola popup modal overlay skip skiplink hidden paywall rating ratings review reviews sitemap"
    ).split()
)
#: Of these, what an article may well be called by its matter.
_DOUBTFUL = frozenset("advertorial notice notices notification alert privacy disclaimer legal review reviews rating ratings promotion related social search consent".split())
_GOOD_WORDS = frozenset("article content post entry story body maintext main text prose".split())
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "status", "toolbar", "note"}


class Block:
    """A block of text: share of link text, tag, container, how many steps in the tree from
    the block before, and the features of its enclosing elements."""

    __slots__ = ("text", "links", "tag", "box", "steps", "around", "mark")

    def __init__(self, text, links, tag, box, steps, around, mark):
        self.text, self.links, self.tag, self.box, self.steps, self.around, self.mark = text, links, tag, box, steps, around, mark


#: What enclosing elements say: boilerplate element or role, header outside content, content
#: element or role, a name of boilerplate, a name of boilerplate that is a name of content
#: too ("review-body"), a name of content; and a name of boilerplate that is beyond doubt.
_TAG, _HEADER, _CONTENT, _NAMED, _MIXED, _GOOD, _SURE = 1, 2, 4, 8, 16, 32, 64


def _worth(tag: str, attributes: str, inside_content: bool) -> tuple[int, bool]:
    """What an element says of its text, and whether it is hidden."""
    says, hidden = 0, False
    if tag in _BAD_TAGS:
        says |= _TAG
    elif tag in _GOOD_TAGS:
        says |= _CONTENT
    elif tag == "header" and not inside_content:
        says |= _HEADER
    if attributes:
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "aria-label", "itemprop", "data-role"):
                for token in _ABOUT.sub(" ", value).split():
                    words = [w.lower() for w in _WORDS.findall(token)]
                    if inside_content:
                        words = [w for w in words if w not in ("header", "tag", "more")]
                    wrong, right = not _BAD_WORDS.isdisjoint(words), not _GOOD_WORDS.isdisjoint(words)
                    if wrong and tag not in ("body", "html", "article", "main"):
                        says |= _MIXED if right and words[-1] in _GOOD_WORDS else _NAMED
                        if says & _NAMED and not _DOUBTFUL.issuperset(_BAD_WORDS.intersection(words)):
                            says |= _SURE
                    elif right:
                        says |= _GOOD
                if name == "itemprop" and value == "articleBody":
                    says |= _CONTENT
            elif name == "role":
                if value.lower() in _BAD_ROLES:
                    says |= _TAG
                elif value.lower() in ("main", "article"):
                    says |= _CONTENT
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
                hidden = True
        if re.search(r"(?:^|\s)hidden(?:\s|=|/?$)", attributes):
            hidden = True
    return says, hidden


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order, with what is around each."""
    blocks: list[Block] = []
    # An open element: name, serial, what it and those around it say, the outermost element
    # that a name marks, hidden, is a link, the innermost block with its number and its
    # container's, is a block.
    stack: list[tuple] = [("#root", 0, 0, 0, False, False, ("#root", 0, 0), True)]
    opened: Counter = Counter()
    text: list[str] = []
    linked = serial = 0
    depth = low = last_depth = 0  # of blocks in the tree: now, least since the last block, at the last block
    worth: dict[tuple, tuple] = {}

    def flush() -> None:
        nonlocal linked, low, last_depth
        if text:
            joined = _SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                top = stack[-1]
                steps = last_depth + depth - 2 * low
                blocks.append(Block(joined, min(1.0, linked / len(joined)), top[6][0], top[6][2], steps, top[2], top[3]))
                low = last_depth = depth
            text.clear()
        linked = 0

    def cut(k: int) -> None:
        """Closes the elements from place k of the stack."""
        nonlocal depth, low
        for e in stack[k:]:
            opened[e[0]] -= 1
            depth -= e[7]
        low = min(low, depth)
        del stack[k:]

    def end_head() -> None:
        """Closes a head left open and what is open in it, but for a template."""
        if opened["head"] and not opened["template"]:
            cut(next(k for k, e in enumerate(stack) if e[0] == "head"))

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip(" \t\n\f\r"):
            end_head()
        if raw and not stack[-1][4]:
            text.append(raw)
            if stack[-1][5]:
                linked += len(raw.strip())

    at, end, quotes = 0, len(html), True
    while at < end:
        m = _MARK.search(html, at)
        if not m:
            say(html[at:])
            break
        name = m[2]
        if name is None:
            say(html[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA[") and stack[-1][0] != "head":
                say(m[0][9:-3])
            continue
        close = _QUOTED.match(html, m.end()) if quotes else None
        if close:
            stop = close.end()
        else:  # a quotation is left open: from here on tags end at the next >
            quotes, stop = False, html.find(">", m.end()) + 1
            if not stop:
                say(html[at:])
                break
        say(html[at : m.start()])
        at = stop
        name, closing, attributes = name.lower(), m[1], html[m.end() : stop - 1]
        if closing:
            if opened[name]:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                if any(e[7] for e in stack[k:]):
                    flush()
                cut(k)
            elif name in _BLOCK:
                flush()
            continue
        if name == "body" or stack[-1][0] == "head" and name not in _IN_HEAD:
            end_head()
        if name == "br":
            say("\n")
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if name in _CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    cut(k)  # formatting left open in the paragraph ends with it
                    break
                if stack[k][7]:
                    break
        if name in _ENDS and any(opened[x] for x in _ENDS[name][0]):
            ended, walls = _ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in walls:
                    break
                if stack[k][0] in ended:
                    cut(k)
                    break
        top = stack[-1]
        key = (name, attributes, top[2] & _CONTENT > 0)
        if key not in worth:
            worth[key] = _worth(*key)
        says, hidden = worth[key]
        serial += 1
        is_block = name in _BLOCK
        mark = top[3] or (serial if says & (_NAMED | _MIXED) else 0)
        if name in _RAW:
            found = _CLOSERS[name].search(html, at)
            at = found.end() if found else end
            continue
        if not attributes.rstrip().endswith("/") or is_block or name == "a":
            inner = (name, serial, top[6][1]) if is_block else top[6]
            stack.append((name, serial, top[2] | says, mark, top[4] or hidden or name in _HIDDEN, top[5] or name == "a", inner, is_block))
            opened[name] += 1
            depth += is_block
    flush()
    return blocks


_CLOSERS = {name: re.compile(rf"</{name}\s*/?>", re.I) for name in _RAW}

FEATURES = (
    "one tag header content named mixed good named_share mixed_share length links much_linked ends_sentence few_words commas heading item paragraph rights near_length near_links tag_content named_content alone"
).split()


def _prose(blocks: list[Block]) -> list[float]:
    """Characters of unlinked running text of each block outside elements of boilerplate."""
    return [len(b.text) * (1 - b.links) * (b.text.count(" ") > 8 and not b.around & _TAG) for b in blocks]


def features(blocks: list[Block]) -> list[list[float]]:
    """``FEATURES`` of each block of a page."""
    prose = _prose(blocks)
    total = sum(prose) or 1.0
    marked: Counter = Counter()
    for b, w in zip(blocks, prose):
        marked[b.mark] += w
    lengths = [log1p(len(b.text)) / 5 for b in blocks]
    found = []
    for i, b in enumerate(blocks):
        says, share = b.around, marked[b.mark] / total if b.mark else 0.0
        near = [k for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(blocks)]
        tag, content = float(says & _TAG > 0), float(says & _CONTENT > 0)
        named, mixed = float(says & _NAMED > 0), float(says & _MIXED > 0)
        found.append([
            1.0, tag, float(says & _HEADER > 0), content, named, mixed, float(says & _GOOD > 0), named * share, mixed * share, lengths[i], b.links, float(b.links > 0.5),
            float(b.text[-1] in ".!?…:;\"'»”)"), float(b.text.count(" ") < 5), min(1.0, (b.text.count(",") + b.text.count(". ")) / 3), float(b.tag in _HEADS), float(b.tag == "li"), float(b.tag in ("p", "blockquote", "pre")),
            float(not content and _RIGHTS.search(b.text) is not None), sum(lengths[k] for k in near) / max(1, len(near)), sum(blocks[k].links for k in near) / max(1, len(near)), tag * content, named * content, float(len(blocks) == 1),
        ])
    return found


WEIGHTS = [-5.3, -7.11, -4.14, 2.35, -8.0, -2.91, 2.22, 2.94, 3.09, 1.56, -3.2, -3.74, 5.27, -0.8, -1.09, 5.04, 5.89, 0.74, -4.37, 2.94, -1.75, 0.0, -3.71, 4.7]


def costs(found: list[float], weights: list[float] | None = None) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    z = sum(x * w for x, w in zip(found, weights or WEIGHTS))
    slip = log1p(exp(-abs(z)))
    return slip + max(z, 0.0), slip + max(-z, 0.0)


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between blocks: neighbours, and the next block in the same container."""
    found: dict[tuple[int, int], float] = {}
    last_in: dict[int, int] = {}
    for j, block in enumerate(blocks):
        if j:
            found[j - 1, j] = SMOOTH / (1 + block.steps)
        if block.box in last_in and block.box:
            i = last_in[block.box]
            found[i, j] = found.get((i, j), 0.0) + SMOOTH / 2
        last_in[block.box] = j
    return [(i, j, w) for (i, j), w in found.items()]


#: Weight of the edge between neighbours in one place of the tree.
SMOOTH = 1.2


def min_cut(content: list[float], boilerplate: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each block is on the content side of the minimum cut (Dinic's max-flow)."""
    n = len(content)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, forward: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forward)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):  # what can flow straight through is taken off at once
        through = min(content[i], boilerplate[i])
        if content[i] > through:
            edge(source, i, content[i] - through, 0.0)
        elif boilerplate[i] > through:
            edge(i, sink, boilerplate[i] - through, 0.0)
    for i, j, w in joined:
        edge(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while place[a] < len(heads[a]):
                e = heads[a][place[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            else:
                if a == source:
                    break
                level[a] = -2
                a = to[path.pop() ^ 1]
                continue
            path.append(heads[a][place[a]])
            a = to[heads[a][place[a]]]


def _labelled(blocks: list[Block]) -> list[bool]:
    good, bad = zip(*map(costs, features(blocks)))
    return min_cut(list(good), list(bad), edges(blocks))


def main_text(html: str) -> str:
    """The content blocks of a page, joined by one space.

    Where the cut leaves less than a fifth of the prose and half of all prose stands in one
    element that nothing but a doubtful name speaks against, the name tells its matter: the
    page is judged again without it.
    """
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept, prose = _labelled(blocks), _prose(blocks)
    total = sum(prose)
    if sum(w for w, k in zip(prose, kept) if k) < total / 5:
        marked: Counter = Counter()
        for b, w in zip(blocks, prose):
            marked[b.mark] += w if b.mark and not b.around & _SURE else 0.0
        most = max(marked, key=marked.__getitem__)
        if marked[most] >= total / 2:
            for b in blocks:
                if b.mark == most:
                    b.around, b.mark = b.around & ~(_NAMED | _MIXED), 0
            kept = _labelled(blocks)
    return " ".join([b.text for b, k in zip(blocks, kept) if k])


def extract(df: DataFrame) -> DataFrame:
    """All columns of ``df`` (html) with text and n_chars."""
    base = df.drop("text", "n_chars")
    schema = common.schema_of(base, "text string, n_chars long")
    arrow = common.arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "html", PIECE):
                texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
                yield common.carried(batch, arrow, {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return base.mapInArrow(run, schema)


def query(spark, sf_dir):
    return extract(common.pages(spark, sf_dir).select("page_id", "url", "html")).drop("html")
