"""Main text of web pages by wrapper induction.

Pages of one host are made by one wrapper. Every page becomes a DOM tree whose
siblings of one label (tag and classes) are folded into a repeated node; the
tree of the host's pivot page (the least hash of the html) is aligned with
that of every other page by simple tree matching, so that nodes of different
pages meet in the pivot's slots. A slot is judged by its variety: of the texts
that it takes on the host, how many stand on several pages. Menus, adverts and
footers draw from few texts, which come again; headings and paragraphs are a
page's own. A page is known by its title and first heading, so that versions
of one article count once and their text does not look like a template. Slots
where ``RECURRING`` of the texts come again are template. Inside ``article``
and ``main`` no slot is: section headings, table heads and bylines come again
there and are content all the same, so a page's article has the same text
whether its host has one page or a million.

What varies as content does and still is none (reader comments, related
links) is told by the elements' meaning: menus, headers, footers, side bars,
notices, adverts, forms, scripts, styles and reader comments are never
content, and where a page has ``article`` or ``main`` elements its content
lies in them. Class words of elements within ``code`` and ``pre`` mean nothing.

Three passes, none of which gathers a host: pages to slot hashes; hashes to
counts per host and slot (pre-aggregated, so a host with a third of all pages
is no hot key); pages with their host's wrapper to text. A wrapper is as large
as one folded tree. The last join is on the host: adaptive execution
broadcasts the wrappers where they are small and splits hot hosts where not.

Defined results: null or empty html, and pages without content, give an empty
text. A host of fewer than ``MIN_PAGES`` distinct pages has no template:
meaning decides alone, and so it does on a page of which the template would
leave nothing. A null url, or one without ``://``,
belongs to the host ''. White space in a block becomes one space, blocks are
joined in page order by one line feed, ``br`` is a space. Elements deeper than
``DEEPEST`` are read as if they were children of that depth.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.storage import written
from terrashift.llm.url_filter import url_host

DEEPEST = 100
MIN_PAGES = 5  # distinct pages on which a slot must have a text to be judged
RECURRING = 0.2  # share of a slot's texts that must stand on several pages for the slot to be template

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
NEVER = set(
    "head title meta link script style noscript template nav footer aside form button select option textarea input iframe "
    "svg canvas object embed audio video map dialog menu noembed noframes".split()
)
CLOSED_BY_BLOCK = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = set("ul ol dl table tbody thead select article section div body".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that tell what a part of a page is for.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended recommendations share sharing social "
    "comment comments discussion replies reply respond disqus cookie cookies consent notice notices gdpr newsletter subscribe "
    "signup login popup modal dialog alert overlay toolbar pagination pager search complementary contentinfo".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*+)", re.S)
TAG_REST = re.compile(r"((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)")
QUOTE_OR_END = re.compile(r"[\"'>]|\Z")
ATTRIBUTE = re.compile(r"([a-zA-Z_:\-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLANKS = re.compile(r"\s+")


class TagEnds:
    """Where the tags of one page end; a ``>`` within quotes ends none, and a quote that is never closed is no tag's.

    After the first tag that fails, quotes that lead nowhere and the distance to
    the next special character are remembered, so that a page full of broken
    tags is still read in time proportional to its length.
    """

    def __init__(self, html: str):
        self.html, self.broken = html, False
        self.dead: set[int] = set()
        self.known = (0, -1)  # no quote and no end from the first to before the second

    def _special(self, at: int) -> int:
        if not self.known[0] <= at <= self.known[1]:
            self.known = (at, QUOTE_OR_END.search(self.html, at).start())
        return self.known[1]

    def end(self, at: int) -> int | None:
        """The place of the ``>`` (or of the page's end) that ends the attributes which begin at ``at``."""
        html = self.html
        if not self.broken:
            m = TAG_REST.match(html, at)
            if m is not None:
                return m.end(1)
            self.broken = True
        passed = []
        while True:
            at = self._special(at)
            if at == len(html) or html[at] == ">":
                return at
            passed.append(at)
            close = -1 if at in self.dead else html.find(html[at], at + 1)
            if close < 0:
                self.dead.update(passed)
                return None
            at = close + 1


class Node:
    __slots__ = ("tag", "label", "children", "hidden")

    def __init__(self, tag: str, label: str, hidden: bool):
        self.tag, self.label, self.hidden = tag, label, hidden
        self.children: list[Node | str] = []


def described(tag: str, attributes: str) -> tuple[str, bool]:
    """The label of an element, and whether its meaning rules it out."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = sorted(set(re.sub(r"\d+", "#", got.get("class", "")).split()))
    words = {w.lower() for k in ("class", "id", "role") for w in WORDS.findall(got.get(k, ""))}
    style = got.get("style", "").replace(" ", "").lower()
    unseen = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return ".".join([tag, *classes]), tag in NEVER or unseen or bool(words & MARKS and tag not in ("body", "html", "main", "article"))


@lru_cache(20_000)
def marked_header(label: str) -> bool:
    """Whether the classes of a label call the element a header, and nothing else that rules it out."""
    return {w.lower() for w in WORDS.findall(label.partition(".")[2])} & MARKS == {"header"}


def parse(html: str, describe: Callable[[str, str], tuple[str, bool]] = described) -> Node:
    """The DOM of a page; unclosed and misnested tags are repaired as browsers do in the simple cases.

    ``describe`` may be a remembering form of ``described``, made in the task.
    """
    root = Node("#root", "#root", False)
    stack, at, n = [root], 0, len(html)
    ends, look = TagEnds(html), 0
    while at < n:
        m = TOKEN.search(html, look)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        end = m.end()
        if m[2] is not None and (end := ends.end(m.end())) is None:
            look = m.start() + 1  # no tag: the text goes on
            continue
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        if m[2] is None:
            at = look = end
            continue
        attributes = html[m.end() : end]
        at = look = min(n, end + 1)
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSED_BY_BLOCK:
            _close(stack, {"p"}, SCOPES)
        if tag in SIBLINGS:
            _close(stack, SIBLINGS[tag], SCOPES)
        label, hidden = describe(tag, attributes.rstrip("/ "))
        if hidden and tag in INLINE and any(above.tag in ("pre", "code") for above in stack):
            hidden = False  # highlighted source text
        node = Node(tag, label, hidden)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
            at = look = close.end() if close else n
        elif tag not in VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scopes: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scopes:
            return


class Folded:
    """The folded tree of a page: one node for each label among siblings, in preorder."""

    def __init__(self, root: Node):
        self.slot_of: dict[int, int] = {}
        self.texts: list[list[str]] = []
        self.shape = self._fold([root])

    def _fold(self, same: list[Node]) -> list:
        slot = len(self.texts)
        self.texts.append([])
        groups: dict[str, list[Node]] = {}
        for node in same:
            self.slot_of[id(node)] = slot
            self._scan(node, slot, groups)
        return [same[0].label, [self._fold(group) for group in groups.values()]]

    def _scan(self, node: Node, slot: int, groups: dict[str, list[Node]]) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not child.isspace():
                    self.texts[slot].append(child.strip())
            elif child.tag in INLINE:
                self.slot_of[id(child)] = slot
                self._scan(child, slot, groups)
            else:
                groups.setdefault(child.label, []).append(child)

    def hashes(self) -> list[int | None]:
        from xxhash import xxh64_intdigest

        return [xxh64_intdigest("\n".join(t).encode("utf-8", "surrogatepass")) >> 1 if t else None for t in self.texts]


def simple_tree_matching(a: list, b: list) -> dict[int, int]:
    """The alignment of two shapes with the most node pairs: slot of ``a`` -> slot of ``b``."""
    sizes: dict[int, int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def size(x: list) -> int:
        if id(x) not in sizes:
            sizes[id(x)] = 1 + sum(map(size, x[1]))
        return sizes[id(x)]

    def places(x: list, at: int) -> list[int]:
        out = [at + 1]
        for child in x[1]:
            out.append(out[-1] + size(child))
        return out

    def score(x: list, y: list, i: int, j: int) -> int:
        """Pairs of the best alignment of two nodes with one label; its table of scores is kept for the way back."""
        xs, ys, at_x, at_y = x[1], y[1], places(x, i), places(y, j)
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for p in range(1, len(xs) + 1):
            row, above = best[p], best[p - 1]
            for q in range(1, len(ys) + 1):
                top = max(above[q], row[q - 1])
                if xs[p - 1][0] == ys[q - 1][0]:
                    top = max(top, above[q - 1] + score(xs[p - 1], ys[q - 1], at_x[p - 1], at_y[q - 1]))
                row[q] = top
        tables[i, j] = best
        return 1 + best[-1][-1]

    out: dict[int, int] = {}

    def back(x: list, y: list, i: int, j: int) -> None:
        out[i] = j
        xs, ys, at_x, at_y, best = x[1], y[1], places(x, i), places(y, j), tables[i, j]
        p, q = len(xs), len(ys)
        while p and q:
            if best[p][q] == best[p - 1][q]:
                p -= 1
            elif best[p][q] == best[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                back(xs[p], ys[q], at_x[p], at_y[q])

    if a[0] == b[0]:
        score(a, b, 0, 0)
        back(a, b, 0, 0)
    return out


class Aligner:
    """Alignments of shapes, remembered: a site has few of them."""

    def __init__(self):
        self.held = lru_cache(5_000)(lambda a, b: simple_tree_matching(json.loads(a), json.loads(b)))

    def __call__(self, shape: str, pivot: str) -> dict[int, int]:
        return self.held(shape, pivot)


def main_text(root: Node, template: set[int], slot_of: dict[int, int]) -> str:
    """The blocks of the page that are neither ruled out by meaning nor by the wrapper."""
    mains: list[Node] = []
    _find_mains(root, mains)
    for parts in (mains, [root]):
        for skip in (template, set()) if template else (set(),):
            blocks: list[str] = []
            for part in parts:
                run: list[str] = []
                _blocks(part, blocks, run, skip, slot_of, part.tag in ("article", "main"))
                _flush(run, blocks)
            if blocks:
                return "\n".join(blocks)
    return ""


def _find_mains(node: Node, out: list[Node]) -> None:
    for child in node.children:
        if isinstance(child, str) or child.hidden:
            continue
        if child.tag in ("article", "main"):
            out.append(child)
        else:
            _find_mains(child, out)


def _flush(run: list[str], blocks: list[str]) -> None:
    if run:
        text = BLANKS.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()


def _blocks(node: Node, blocks: list[str], run: list[str], skip: set[int], slot_of: dict[int, int], inside: bool, heads: bool = False) -> None:
    skipped = slot_of.get(id(node)) in skip
    for child in node.children:
        if isinstance(child, str):
            if not skipped and (not heads or node.tag in HEADINGS):
                run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in INLINE:
            if not child.hidden:
                _blocks(child, blocks, run, skip, slot_of, inside, heads and node.tag not in HEADINGS)
        else:
            _flush(run, blocks)
            header = child.tag == "header" or child.hidden and marked_header(child.label)
            if header and inside:  # an article's own header: only its headings
                _blocks(child, blocks, run, skip, slot_of, inside, True)
            elif not child.hidden and child.tag != "header":
                _blocks(child, blocks, run, skip, slot_of, inside, heads)
            _flush(run, blocks)


# --- the passes ---------------------------------------------------------------


def page_identity(html: Column) -> Column:
    """Hash of the title and the first heading, or of the whole html where there is neither."""
    title, heading = (F.trim(F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}", 1)) for tag in ("title", "h1"))
    named = (title != "") | (heading != "")
    return F.when(named, F.xxhash64(title, heading)).otherwise(F.xxhash64(html))


def inside_main(shape: list) -> list[bool]:
    """For each slot of a shape whether it lies in an ``article`` or ``main`` element."""
    out: list[bool] = []

    def walk(node: list, inside: bool) -> None:
        inside = inside or node[0].split(".")[0] in ("article", "main")
        out.append(inside)
        for child in node[1]:
            walk(child, inside)

    walk(shape, False)
    return out


def page_slots(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, page (its identity), shape (the folded tree) and slots (a hash for each, null without text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = lru_cache(20_000)(described)
        for batch in batches:
            shapes, slots = [], []
            for x in batch.column(2):
                folded = Folded(parse(x.as_py(), describe))
                shapes.append(json.dumps(folded.shape, separators=(",", ":")))
                slots.append(folded.hashes())
            cols = [batch.column(0), batch.column(1), pa.array(shapes, pa.string()), pa.array(slots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "page", "shape", "slots"])

    rows = pages.select(url_host(F.col(url)).alias("host"), page_identity(F.col(html)).alias("page"), F.col(html).alias("html"))
    rows = rows.where("html is not null")
    return rows.mapInArrow(run, "host string, page bigint, shape string, slots array<bigint>")


def wrappers(slots: DataFrame, min_pages: int = MIN_PAGES, recurring: float = RECURRING) -> DataFrame:
    """host, pivot (its shape) and template (the pivot's slots whose texts are not the pages' own; null if none)."""
    pivots = slots.groupBy("host").agg(F.min(F.struct("page", "shape")).alias("least")).select("host", F.col("least.shape").alias("pivot"))
    distinct = slots.groupBy("host", "page").agg(F.min(F.struct("shape", "slots")).alias("s")).select("host", "s.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        within = lru_cache(5_000)(lambda shape: inside_main(json.loads(shape)))
        for batch in batches:
            row, slot, inside, text = [], [], [], []
            for k, (shape, hashes, pivot) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                main = within(pivot)
                for mine, theirs in align(shape, pivot).items():
                    if hashes[mine] is not None:
                        row.append(k)
                        slot.append(theirs)
                        inside.append(main[theirs])
                        text.append(hashes[mine])
            hosts = batch.column(0).take(pa.array(row, pa.int64()))
            cols = [hosts, pa.array(slot, pa.int32()), pa.array(inside, pa.bool_()), pa.array(text, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "slot", "inside", "text"])

    aligned = distinct.join(pivots, "host").select("host", "shape", "slots", "pivot")
    found = aligned.mapInArrow(run, "host string, slot int, inside boolean, text bigint").groupBy("host", "slot", "inside", "text").agg(F.count(F.lit(1)).alias("n"))
    variety = found.groupBy("host", "slot", "inside").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > 1).alias("again"))
    judged = variety.where(~F.col("inside") & (F.col("n") >= min_pages) & (F.col("again") >= recurring * F.col("texts")))
    template = judged.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))  # at most the pivot's slots
    return pivots.join(template, "host", "left")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``key``, ``url`` and text of every row of ``pages``."""
    wrapper = written(wrappers(written(page_slots(pages, url, html), "slots"), min_pages), "wrappers")
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"), url_host(F.col(url)).alias("host"))
    joined = rows.join(wrapper, "host", "left").select("k", "u", "h", "pivot", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        describe = lru_cache(20_000)(described)
        for batch in batches:
            texts = []
            for source, pivot, template in zip(*batch.columns[2:]):
                root = parse(source.as_py() or "", describe)
                slots = template.as_py()
                if slots:
                    folded = Folded(root)
                    held = align(json.dumps(folded.shape, separators=(",", ":")), pivot.as_py())
                    wanted = set(slots)
                    texts.append(main_text(root, {mine for mine, theirs in held.items() if theirs in wanted}, folded.slot_of))
                else:
                    texts.append(main_text(root, set(), {}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k", "u", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"k {kind}, u string, text string").select(F.col("k").alias(key), F.col("u").alias(url), "text")
