"""HTML extraction (operator 4) by union-free regular-expression inference.

A page becomes a stream of tags and texts, read as nested lists. Neighbouring lists with the same
label, or repeated sequences of up to four labels, fold into one repeated group. The pages of a host
are aligned one after the other with the host's wrapper: labels in common (the longest rising run of
matches, the kth of a label with the kth) are aligned in turn, what only one side has becomes
optional, and texts that differ become slots; equal ones stay part of the template. A wrapper is a
union-free expression, so two wrappers align like a page and a wrapper: tasks fold their own pages
first, and a hot host's partial wrappers meet in SALTS groups and then in one, whose rows are as many
as groups, whatever the pages.

The wrapper says where a host's pages hold their text: from the root, it goes down to the last part
that holds nearly all of the slots' text, outside menus, adverts and other furniture; marks (article, main, names
like content) add weight, and end the way down. It also says which texts inside are template: those
that TEMPLATE_PAGES pages or more have, all the same, at that place. Extraction walks each page's nodes
at the region, and leaves out what matches the template. Where the host's region has little of a
page's text, the page's own wrapper is asked, and the larger text taken. Furniture (by tag, role, or
words in class and id) is skipped; a title in an article's header stays. Words and forms do not hide
the only article of a page, nor nearly all of its text. Regions are joined to pages by host; html is
not shuffled unless there are too many hosts to broadcast.

Nodes with more than KIDS optional parts of one tag have these folded into one, of any class, so a
wrapper loses no part. Nesting beyond DEPTH levels is read as siblings, as browsers do. Null html is
empty and gives an empty text; null urls share one wrapper. Unclosed comments, scripts and tags reach
to the page's end. Repeated rows are extracted each; extra columns are ignored; pages are read whole.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .url_filter import host_of

SALTS = 16
KIDS = 128
DEPTH = 120
#: Pages that must agree on a text before it counts as template, and the share of all text that the region must hold.
TEMPLATE_PAGES, SHARE = 5, 0.85
#: The weight of text under marks 0 to 3.
WEIGHTS = (1.0, 2.0, 10.0, 20.0)
HOSTS_HELD = 20_000

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/]).*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]).*?(?:>|\Z)", re.S | re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table select article section div main body html aside nav form".split())
_FURNITURE = frozenset("head script style noscript template iframe nav footer aside form button select textarea menu dialog svg canvas object audio video title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form note".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus respond replies reply related recommended recommendations widget toolbar pagination pager paywall disclaimer copyright skip".split()
)
_HEADER = frozenset("header".split())
_BODY_WORDS = frozenset("article post entry content story main body text".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td".split())
_ROOTS = frozenset("html body article main".split())


class Node:
    __slots__ = ("hidden", "kids", "label", "marked", "soft", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.kids = tag, []
        # Hidden by its form or names alone (soft), a node may turn out to hold the page.
        self.label, self.hidden, self.soft, self.marked = tag, tag in _FURNITURE, tag == "form", 3 if tag == "article" else 2 if tag == "main" else 0
        if attributes and not attributes.isspace():
            found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            named = f"{found.get('class', '')} {found.get('id', '')}".strip()
            role = found.get("role", "").lower()
            if named:
                self.label = f"{tag}.{re.sub(r'[0-9]+', '#', ' '.join(sorted(named.split())))}"
            words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", named)} if named else set()
            if tag not in _ROOTS:
                firm = role in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
                self.soft = not firm and (self.soft or bool(words & _WORDS) and not self.hidden)
                self.hidden = self.hidden or firm or self.soft
            if words & _HEADER and tag not in _ROOTS:
                self.tag = "header"
            if not self.marked and tag not in _INLINE:
                self.marked = 2 if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" else 1 if words & _BODY_WORDS else 0


def parse(page: str) -> Node:
    """The page's tree; texts are kids that are strings."""
    root = Node("", "")
    stack, at = [root], 0
    match, size = _TOKEN.search, len(page)
    while m := match(page, at):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].label.partition(".")[0] == tag:
                    del stack[depth:]
                    break
                if tag in _INLINE and stack[depth].label.partition(".")[0] not in _INLINE:
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Node("p", ""))
            continue
        if tag not in _INLINE:
            ends = _CLOSES.get(tag)
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth].label.partition(".")[0]
                if name == "p" and ends is None and tag != "br" or ends and name in ends:
                    del stack[depth:]
                    if not ends or tag not in ("tr", "tbody", "tfoot"):
                        break
                elif name in _SCOPE:
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID and not (m[3] or "").rstrip().endswith("/"):
            if len(stack) > DEPTH:
                del stack[DEPTH:]
            stack.append(node)
        elif tag not in _VOID and tag in _INLINE | {"div", "p", "section", "article"}:
            stack.append(node)  # the slash means nothing on such tags
        if len(stack) > DEPTH:
            del stack[DEPTH:]
    if at < size:
        stack[-1].kids.append(page[at:])
    return shown(root)


def shown(root: Node) -> Node:
    """The tree, with softly hidden nodes shown if they hold all of its articles, or nearly all of its text."""
    seen = away = 0
    marked, wrapping, outer = False, [], []
    stack: list[tuple[Node, tuple[Node, ...]]] = [(root, ())]
    while stack:
        node, soft = stack.pop()
        if node.hidden:
            if not node.soft:
                continue
            if not soft:
                outer.append(node)
            soft = (*soft, node)
        if node.marked >= 2:
            marked = marked or not soft
            wrapping += soft
        for k in node.kids:
            if not isinstance(k, str):
                stack.append((k, soft))
            elif soft:
                away += len(k.strip())
            else:
                seen += len(k.strip())
    if wrapping and not marked:
        show = wrapping
    else:
        show = outer if away > 9 * seen and not marked else []
    for node in show:
        node.hidden = node.soft = False
    return root


# A wrapper node: [label, flags, text, mass, pages, kids]; flags: 1 optional, 2 repeated, 4 furniture, 8.. mark;
# text: None without, a number that stands for the template's text, or True for a slot.
LABEL, FLAGS, TEXT, MASS, PAGES, SUBS = range(6)
OPTIONAL, REPEATED, HIDDEN, MARK = 1, 2, 4, 8


def wrapped(node: Node) -> list:
    """A page's own wrapper."""
    kids, texts = [], []

    def gather(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                texts.append(k)
            elif k.tag in _INLINE and not k.hidden and k.label == k.tag:
                gather(k)
            elif k.tag != "br":
                kids.append(wrapped(k))

    if not (node.tag in _RAW):
        gather(node)
    text = "".join(texts).strip()
    flags = HIDDEN * node.hidden + MARK * node.marked
    return [node.label, flags, hash_text(text) if text else None, len(text), 1, squashed(kids)]


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def squashed(kids: list) -> list:
    """Runs of the same label, and of the same sequence of labels, folded into repeated nodes."""
    for period in range(1, 5):
        at, out = 0, []
        while at < len(kids):
            group = kids[at : at + period]
            labels = [k[LABEL] for k in group]
            end = at + period
            while len(group) == period and [k[LABEL] for k in kids[end : end + period]] == labels:
                group = [folded(a, b) for a, b in zip(group, kids[end : end + period], strict=True)]
                for k in group:
                    k[FLAGS] |= REPEATED
                end += period
            if end > at + period:
                out += group
                at = end
            else:
                out.append(kids[at])
                at += 1
        kids = out
    return kids


def folded(a: list, b: list) -> list:
    """Two repetitions of a node on one page."""
    out = merged(a, b)
    out[PAGES] = max(a[PAGES], b[PAGES])
    return out


def merged(a: list, b: list) -> list:
    """The alignment of two wrappers with the same label."""
    text = a[TEXT] if a[TEXT] == b[TEXT] and a[TEXT] is not True else True if a[TEXT] is not None or b[TEXT] is not None else None
    return [a[LABEL], a[FLAGS] | b[FLAGS], text, a[MASS] + b[MASS], a[PAGES] + b[PAGES], aligned(a[SUBS], b[SUBS])]


def matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of places, rising in both: of those that match the kth of a label with the kth, a longest run."""
    at: dict[tuple[str, int], int] = {}
    seen: Counter = Counter()
    for j, label in enumerate(y):
        at[label, seen[label]] = j
        seen[label] += 1
    seen.clear()
    ends: list[int] = []  # the least last place of runs of each length
    runs: list[tuple] = []
    for i, label in enumerate(x):
        j = at.get((label, seen[label]))
        seen[label] += 1
        if j is not None:
            k = bisect_left(ends, j)
            run = (i, j, runs[k - 1] if k else None)
            ends[k : k + 1], runs[k : k + 1] = [j], [run]
    out, run = [], runs[-1] if runs else None
    while run:
        out.append(run[:2])
        run = run[2]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    out, i, j = [], 0, 0
    for m, n in [*matched([k[LABEL] for k in a], [k[LABEL] for k in b]), (len(a), len(b))]:
        out += [optional(k) for k in a[i:m]] + [optional(k) for k in b[j:n]]
        if m < len(a):
            out.append(merged(a[m], b[n]))
        i, j = m + 1, n + 1
    return generalised(squashed(out))


def generalised(kids: list) -> list:
    """Kids whose optional parts of one tag, if more than KIDS, are one repeated part of any class."""
    tags = Counter(tag_of(k) for k in kids if k[FLAGS] & OPTIONAL and not k[FLAGS] & HIDDEN)
    many = {t for t, n in tags.items() if n > KIDS}
    if not many:
        return kids
    out, any_of = [], {}
    for k in kids:
        t = tag_of(k)
        if t in many and k[FLAGS] & OPTIONAL and not k[FLAGS] & HIDDEN:
            k = [f"{t}.*", k[FLAGS] | REPEATED, *k[TEXT:]]
            if t in any_of:
                any_of[t][:] = folded(any_of[t], k)
                continue
            any_of[t] = k
        out.append(k)
    return out


def tag_of(wrapper: list) -> str:
    return wrapper[LABEL].partition(".")[0]


def optional(node: list) -> list:
    return [node[LABEL], node[FLAGS] | OPTIONAL, *node[TEXT:]]


def weight(node: list, mark: int, alone: bool) -> float:
    """Text in slots under a node, weighted by marks; on a single page all text counts."""
    if node[FLAGS] & HIDDEN:
        return 0.0
    mark = max(mark, node[FLAGS] // MARK)
    own = node[MASS] if node[TEXT] is True or alone or node[FLAGS] & REPEATED else node[MASS] * 0.01
    return own * WEIGHTS[mark] + sum(weight(k, mark, alone) for k in node[SUBS])


def region(wrapper: list) -> dict:
    """Where the text is: path, labels from the root; and template, hashes of texts under it by their labels."""
    node, path, alone, mark = wrapper, [], wrapper[PAGES] == 1, 0
    total = weight(node, 0, alone)
    while total and mark < 2:
        best = max(((weight(k, mark, alone), -i) for i, k in enumerate(node[SUBS])), default=(0.0, 0))
        # Blocks of text belong to the part that holds them; only parts of parts are gone into.
        if best[0] < SHARE * total or tag_of(node[SUBS][-best[1]]) in _TEXTUAL:
            break
        node = node[SUBS][-best[1]]
        mark = max(mark, node[FLAGS] // MARK)
        path.append(node[LABEL])
    template: dict[str, int] = {}

    def visit(n: list, key: str) -> None:
        if n[PAGES] >= TEMPLATE_PAGES and isinstance(n[TEXT], int) and n[TEXT] is not True and not n[FLAGS] & (HIDDEN | REPEATED):
            template[key] = n[TEXT]
        for k in n[SUBS]:
            visit(k, f"{key}/{k[LABEL]}")

    visit(node, "")
    # Pages that are all alike have no slots: then nothing tells template from text.
    return {"path": path, "template": template if any_slot(node) else {}}


def any_slot(node: list) -> bool:
    return node[TEXT] is True or any(any_slot(k) for k in node[SUBS])


def text_of(page: str, place: dict | None) -> str:
    """The page's text at the host's region without its template; where that is little of the page, that of its own wrapper if it is more."""
    root = parse(page)
    text = "" if place is None else region_text(root, place)
    if place is None or len(text) < 0.5 * visible(root):
        own = region_text(root, region(wrapped(root)))
        if len(own) > 2 * len(text):
            return own
    return text


def visible(root: Node) -> int:
    total, stack = 0, [root]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                total += len(k.strip())
            elif not k.hidden:
                stack.append(k)
    return total


def region_text(root: Node, place: dict) -> str:
    blocks: list[str] = []
    for node in places(root, place["path"]):
        walk(node, blocks, place["template"])
    return " ".join(blocks)


def places(root: Node, path: list[str]) -> list[Node]:
    level = [root]
    for label in path:
        tag, _, name = label.partition(".")
        fits = (lambda k, tag=tag: k.label.partition(".")[0] == tag) if name == "*" else (lambda k, label=label: k.label == label)
        level = [k for n in level for k in solid(n) if fits(k)]
    return level


def solid(node: Node) -> Iterator[Node]:
    """Kids, with those of plain inline tags in their place, as wrappers see them."""
    for k in node.kids:
        if not isinstance(k, str):
            if k.tag in _INLINE and not k.hidden and k.label == k.tag:
                yield from solid(k)
            else:
                yield k


def own_text(node: Node) -> str:
    """What a wrapper takes as the node's own text."""
    texts: list[str] = []

    def gather(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                texts.append(k)
            elif k.tag in _INLINE and not k.hidden and k.label == k.tag:
                gather(k)

    gather(node)
    return "".join(texts).strip()


def walk(node: Node, blocks: list[str], template: dict[str, int]) -> None:
    """Appends the texts of the blocks under a node, but for those of the template; of a header only its first-level headings."""
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    def inside(n: Node, titles: bool, key: str, silent: bool) -> None:
        for k in n.kids:
            if isinstance(k, str):
                if not titles and not silent:
                    run.append(html.unescape(k) if "&" in k else k)
            elif k.tag in ("br", "hr"):
                end()
            elif k.hidden:
                if k.tag not in _INLINE:
                    end()
            elif k.tag in _INLINE:
                plain = k.label == k.tag
                at = key if plain else f"{key}/{k.label}"
                inside(k, titles, at, silent if plain else known(k, at))
            else:
                end()
                at = f"{key}/{k.label}"
                inside(k, (titles or k.tag == "header") and k.tag != "h1", at, known(k, at))
                end()

    def known(k: Node, key: str) -> bool:
        return key in template and hash_text(own_text(k)) == template[key]

    inside(node, False, "", known(node, ""))
    end()


_WRAPPERS = "host string, salt int, wrapper string"


def regions(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and region (JSON, as region() has it) from the wrappers of all pages."""
    own = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held = TaskContext.get().partitionId() % SALTS, {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "salt", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wrapper = wrapped(parse(page or ""))
                held[host] = merged(held[host], wrapper) if host in held else wrapper
            if len(held) > HOSTS_HELD:
                yield rows()
        yield rows()

    def join(texts: pd.Series) -> list:
        both = None
        for text in sorted(texts):
            wrapper = json.loads(text)
            both = wrapper if both is None else merged(both, wrapper)
        return both

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "salt": [key[1]], "wrapper": [json.dumps(join(frame["wrapper"]))]})

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "region": [json.dumps(region(join(frame["wrapper"])))]})

    partial = own.mapInArrow(infer, _WRAPPERS).groupBy("host", "salt").applyInPandas(meet, _WRAPPERS)
    return partial.groupBy("host").applyInPandas(choose, "host string, region string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for each row."""
    known = stored(regions(pages, url_col, html_col), "regions")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # A region's size is that of its JSON; hosts beyond the bound are joined by a shuffle.
    widest = known.agg(F.max(F.octet_length("region") + F.octet_length("host"))).first()[0] or 0
    own = own.join(small(known, widest + 64), "host", "left").select("page_id", "url", "html", "region")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[str | None, list | None] = {None: None}
        for batch in batches:
            texts = []
            for page, where in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if where not in paths:
                    if len(paths) > HOSTS_HELD:
                        paths.clear()
                    paths[where] = json.loads(where) if where else None
                texts.append(text_of(page, paths[where]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return own.mapInArrow(read, "page_id long, url string, text string")
