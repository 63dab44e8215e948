"""HTML extraction with a tree-structured graphical model: parent-child potentials join the DOM's nodes, sum-product messages give each its marginal of being content."""

from __future__ import annotations

import functools
import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import labelled_pages
from .shared import map_arrow, table

# Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that may stand in a head; any other, or text, ends one that is still open.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
SPACE = " \t\n\f\r"
#: Elements that stand in a line of text and whose content isn't read; what is inside them makes no blocks.
UNSEEN = frozenset("noscript template svg math object canvas audio video select datalist button".split())
#: Elements that never hold text to read.
UNREAD = UNSEEN | {"head"}
#: Elements whose own markup may close itself.
FOREIGN = frozenset({"svg", "math"})
INLINE = frozenset(
    "a abbr acronym area b base basefont bdi bdo bgsound big cite code data del dfn em embed font i ins kbd label link map mark meta meter nobr output param picture progress q rb rp rt rtc ruby s samp slot small source span strike strong sub sup time track tt u var wbr br img input".split()
)
#: What an opening tag closes, if open, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>|<[!?/][^>]*+>?""", re.DOTALL
)
#: What may stand behind the last end of a tag, besides text.
UNCLOSED = re.compile(r"<!--.*\Z|<[!?/][^>]*+", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
LABEL = re.compile(r"""(?<![^\s"'/])data-block=([0-9]+)""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attrs: str = ""
    text: str | None = None  # of a leaf: one block's text
    linked: int = 0  # characters of it inside links
    own: int = -1  # the training label's place
    kids: list[int] = field(default_factory=list)


def inline(tag: str) -> bool:
    """Whether an element is part of a line of text, as custom elements are unless styled."""
    return tag in INLINE or "-" in tag


def parse(page: str, labelled: bool = False) -> list[Node]:
    """The page's block elements and, as leaves, its blocks of text, parents before children. Tolerates what browsers do: tags left open or never opened, raw script, text outside of body. labelled: a training page, whose data-block attributes number its blocks."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int, bool]] = [("#root", 0, True)]  # open elements, inline ones as well, with the node each belongs to, and whether they are blocks
    places: dict[str, list[int]] = {}  # where on the stack each tag is open
    blocks = [0]  # where blocks are
    held: list[str] = []
    state = {"linked": 0, "links": 0, "unseen": 0, "foreign": 0}
    last_end: dict[str, int] = {}
    hidden = 0

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                at = stack[-1][1]
                nodes.append(Node("#text", at, text=text, linked=min(state["linked"], len(text)), own=nodes[at].own))
                nodes[at].kids.append(len(nodes) - 1)
            state["linked"] = 0

    def pop_to(k: int):
        nonlocal hidden
        while len(stack) > k:
            tag, _, block = stack.pop()
            places[tag].pop()
            if block:
                blocks.pop()
            hidden -= tag in UNREAD
            state["links"] -= tag == "a"
            state["unseen"] -= tag in UNSEEN
            state["foreign"] -= tag in FOREIGN

    def last_open(tag: str) -> int:
        """The tag's last place on the stack, or 0."""
        return on[-1] if (on := places.get(tag)) else 0

    def end_head():
        if stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    def say(text: str):
        if hidden and text.strip(SPACE):
            end_head()
        if text and not hidden:
            text = entities.unescape(text) if "&" in text else text  # a reference ends where its text does
            held.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.IGNORECASE)), default=-1)
        return last_end[tag] >= at

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it; what opens one there is looked at once
    while at < end:
        m = TOKEN.search(page, at, last) if at < last else UNCLOSED.search(page, at)
        if not m:
            stop = last if at < last else end
            say(page[at:stop])
            at = stop
            continue
        say(page[at : m.start()])
        at = m.end()
        if m.re is UNCLOSED or not (tag := m["tag"]):
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in ("body", "html", "br"):
                end_head()
            if tag == "br":
                say(" ")
                continue
            k = last_open(tag)
            if k > (blocks[-1] if inline(tag) else 0):  # else it isn't open, or not in this block
                if stack[k][2]:
                    flush()
                pop_to(k)
            continue
        if state["foreign"] and m["attrs"].endswith("/"):
            continue
        if hidden and tag not in HEAD:
            end_head()
        if tag == "br":
            say(" ")
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag in UNSEEN and (tag in FOREIGN and m["attrs"].endswith("/") or not ends_later(tag)):
            continue
        block = not (inline(tag) or tag in UNSEEN or state["unseen"])
        if block:
            flush()
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                within = max(map(last_open, scope))
                while (k := max(map(last_open, ends))) > within:
                    pop_to(k)
            if stack[blocks[-1]][0] == "p":  # a block closes an open paragraph
                pop_to(blocks[-1])
        if tag in VOID:
            continue
        owner = stack[-1][1]
        if block:
            nodes.append(Node(tag, owner, m["attrs"], own=nodes[owner].own))
            nodes[owner].kids.append(len(nodes) - 1)
            owner = len(nodes) - 1
        if labelled and (label := LABEL.search(m["attrs"])):
            nodes[owner].own = int(label[1])
        places.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append((tag, owner, block))
        hidden += tag in UNREAD
        state["links"] += tag == "a"
        state["unseen"] += tag in UNSEEN
        state["foreign"] += tag in FOREIGN
    flush()
    return nodes


@functools.lru_cache(maxsize=20_000)
def element_features(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"tag:{tag}"]
    for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        name = name.lower()
        if name in ("class", "id", "role"):
            out += {f"name:{p.lower()}" for p in NAME_PART.findall("".join(values))}
        elif name in ("hidden", "aria-hidden") and "".join(values).lower() != "false":
            out.append("hidden")
    return tuple(out)


def leaf_features(node: Node, parent: Node) -> tuple[str, ...]:
    n = len(node.text)
    density = node.linked / n
    return (
        f"length:{min(7, n.bit_length() - 2)}", f"links:{0 if density < 0.1 else 1 if density < 0.5 else 2}", f"stop:{node.text[-1] in '.!?:;…'}",
        f"in:{parent.tag}", "text",
    )


def shape_features(node: Node, nodes: list[Node]) -> tuple[str, ...]:
    """What an element that holds other blocks holds directly: headings, paragraphs and lists."""
    tags = [nodes[k].tag for k in node.kids]
    paragraphs = tags.count("p")
    return (
        f"holds-h1:{'h1' in tags}", f"holds-p:{min(3, paragraphs.bit_length())}", f"holds-h:{not {'h2', 'h3'}.isdisjoint(tags)}", f"{node.tag}-holds-p:{paragraphs > 0}",
    )


#: Kinds of edges: text in its element, one element in another by the child's sort.
SECTION = frozenset("div section main article aside nav header footer form body html #root center td table fieldset".split())


def edge_kind(node: Node) -> int:
    return 0 if node.text is not None else 1 if node.tag in SECTION else 2


@dataclass
class Model:
    """Log potentials: of a node being content by its features; of (parent, child) labels by the edge's kind."""

    weights: dict[str, float]
    edges: list[list[list[float]]]
    by_element: dict = field(default_factory=dict)

    def unary(self, nodes: list[Node]) -> list[float]:
        known, w, out = self.by_element, self.weights, []
        for x in nodes:
            if x.text is None:
                key = (x.tag, x.attrs)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = sum(w.get(f, 0.0) for f in element_features(*key))
                own = known[key]
                if x.tag in SECTION:
                    own += sum(w.get(f, 0.0) for f in shape_features(x, nodes))
                out.append(own)
            else:
                out.append(sum(w.get(f, 0.0) for f in leaf_features(x, nodes[x.parent])))
        return out


def more(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(nodes: list[Node], model: Model) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on the tree: each node's log odds of being content; and, for training, the upward messages and what comes from above."""
    up, message = model.unary(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        x = nodes[i]
        e = model.edges[edge_kind(x)]
        message[i] = more(e[1][0], e[1][1] + up[i]) - more(e[0][0], e[0][1] + up[i])
        up[x.parent] += message[i]
    down = [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        x = nodes[i]
        e = model.edges[edge_kind(x)]
        above = up[x.parent] + down[x.parent] - message[i]
        down[i] = more(e[0][1], e[1][1] + above) - more(e[0][0], e[1][0] + above)
    return [a + b for a, b in zip(up, down, strict=True)], up, [up[x.parent] + down[x.parent] - message[i] if i else 0.0 for i, x in enumerate(nodes)]


def truth(nodes: list[Node], labels: list[bool]) -> list[int]:
    """Labels of all nodes: a block's own, an element's by most of its blocks."""
    good, count = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.text is not None:
            good[i], count[i] = int(x.own >= 0 and labels[x.own]), 1
        if i:
            good[x.parent] += good[i]
            count[x.parent] += count[i]
    return [int(2 * g > c) for g, c in zip(good, count, strict=True)]


def fit(pages: list[tuple[str, list[bool]]], epochs: int = 8) -> Model:
    """Maximum likelihood by stochastic gradient: what the labels have of each feature and label pair, less what marginals expect, averaged over the later steps."""
    model = Model({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)])
    trees = [(nodes, truth(nodes, labels)) for nodes, labels in ((parse(p, labelled=True), y) for p, y in pages)]
    total: dict[str, float] = {}
    edge_total, steps = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)], 0
    odds = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    for epoch in range(epochs):
        rate = 0.2 / (1 + epoch / 3)
        for nodes, y in trees:
            model.by_element.clear()
            both, up, above = marginals(nodes, model)
            for i, x in enumerate(nodes):
                gap = y[i] - odds(both[i])
                features = leaf_features(x, nodes[x.parent]) if x.text is not None else element_features(x.tag, x.attrs)
                for f in features + shape_features(x, nodes) if x.text is None and x.tag in SECTION else features:
                    model.weights[f] = model.weights.get(f, 0.0) * (1 - 1e-5) + rate * gap
                if i:
                    e = model.edges[edge_kind(x)]
                    joint = [[e[a][b] + a * above[i] + b * up[i] for b in (0, 1)] for a in (0, 1)]
                    top = max(map(max, joint))
                    share = [[math.exp(v - top) for v in row] for row in joint]
                    norm = sum(map(sum, share))
                    for a in (0, 1):
                        for b in (0, 1):
                            e[a][b] += rate * 0.2 * ((y[x.parent] == a and y[i] == b) - share[a][b] / norm)
            if epoch >= epochs // 2:
                steps += 1
                for f, v in model.weights.items():
                    total[f] = total.get(f, 0.0) + v
                for k in range(3):
                    for a in (0, 1):
                        for b in (0, 1):
                            edge_total[k][a][b] += model.edges[k][a][b]
    return Model({f: v / steps for f, v in total.items()}, [[[v / steps for v in row] for row in e] for e in edge_total])


@functools.lru_cache(maxsize=1)
def trained(pages: int = 250) -> Model:
    """The model of the default labelled pages; the same everywhere."""
    return fit(labelled_pages(pages))


#: Elements that are furniture whatever they are called.
FURNITURE = frozenset("nav aside header footer form button fieldset menu dialog".split())


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def plain(nodes: list[Node], model: Model) -> list[bool]:
    """Of a page in which nothing looks like an article (short posts, bare paragraphs, text without markup), the blocks to take: those that aren't mostly links and stand in nothing that shows a sign of furniture, such an element, a name that speaks against content, or being hidden."""

    @functools.cache
    def sign(tag: str, attrs: str) -> bool:
        return tag in FURNITURE or any(f == "hidden" or f.startswith("name:") and model.weights.get(f, 0.0) < 0 for f in element_features(tag, attrs))

    clear = [True] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        clear[i] = clear[x.parent] and (2 * x.linked < len(x.text) if x.text is not None else not sign(x.tag, x.attrs))
    return clear


def main_blocks(page: str | None, model: Model) -> list[str]:
    """The article's blocks of text in page order; where none but headings look like one, those as well that show no sign of furniture."""
    if not page:
        return []
    nodes = parse(page)
    content = [odds > 0 for odds in marginals(nodes, model)[0]]
    if not any(good and x.text is not None and nodes[x.parent].tag not in HEADINGS for x, good in zip(nodes, content, strict=True)):
        content = [a or b for a, b in zip(content, plain(nodes, model), strict=True)]
    return [x.text for x, good in zip(nodes, content, strict=True) if x.text is not None and good]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url and blocks, the main text of each whole page as an array. One pass without a shuffle; the model (a few KB) goes with the tasks.

    Null and empty pages have no blocks; malformed markup is read as browsers do, in time that follows the page's
    length; white space is what Unicode calls so, no-break spaces included; repeated rows each have a row;
    an empty table gives none; other columns are ignored.
    """

    def found(batch: pa.RecordBatch):
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "blocks": [main_blocks(h, model) for h in batch.column("html").to_pylist()]}

    return map_arrow(pages.select("page_id", "url", "html"), found, "page_id long, url string, blocks array<string>")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points."""
    found = extract(table(spark, sf_dir, "pages"), trained())
    return found.selectExpr("page_id", "url", "array_join(blocks, '\\n') as text", "cast(char_length(array_join(blocks, '\\n')) as long) as n_chars")
