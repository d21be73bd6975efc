"""Main text of web pages by wrapper induction per host.

1. A page becomes a tree of its block elements (tag and class), with the
   text of every block in it, menus and footers included; neighbours with the same label
   are one node, as lists have any length.
2. A host's references are the first pages of its ``REFERENCES`` most frequent
   layouts among the pages with text. Every page of the host is aligned with
   each by simple tree matching: the largest number of nodes that correspond
   in order, level by level. No step recurses, and children are
   matched by a heaviest increasing run over pairs of equal labels, so deep
   and wide pages take time and memory by their size.
3. Over all pages (equal trees of a host count once), a block of text in a
   node of the reference counts how often the node was matched and how often
   the page's node had the block too. Blocks found on nearly all pages
   (``CONSTANT``) are template; the others fill slots.
4. A page's content is the text of its slots: inside ``article`` (or
   ``main``) where the page has one, else of all slots. Template is left out
   everywhere; only an article that is template from end to end stays, as its
   host holds copies of one article. What varies from page to page and still
   is no content (adverts, comments, forms, ...) is known by its tag, role or class.
   Inside an article a class or id counts as a widget's only as a whole
   (``widget``), and ids of headings, sections and the like never do.
   ``n_template`` and ``n_listed`` tell how many blocks the wrapper and those
   lists have left out; ``lists=False`` leaves the lists aside.

Only the small trees are compared; a host that holds a third of all pages is
counted by partial aggregates, and its wrapper is one short row.

Null or empty html gives an empty text. Pages without a host have no wrapper
and are read by tags and classes alone. Rows of a repeated page id are read
one by one; further columns play no part.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semweave.llm.common import as_batch, map_batches
from semweave.session import drop_materialized, materialize

#: A block is template if this share of at least so many matched pages has it.
CONSTANT, LEAST_PAGES = 0.9, 4
#: Reference pages of a host: one of each of its most frequent layouts.
REFERENCES = 3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
                   r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                   r"|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt "
             "s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
KEEP_P = INLINE | {"script", "style", "noscript", "template"}
SCOPE = set("ul ol dl table tbody thead tfoot div article section main body td aside nav form".split())
# Elements, roles and class words that hold no article text.
NO_TAGS = set("head script style noscript template nav footer aside form button select option input textarea iframe "
              "object embed svg canvas audio video dialog menu title map".split())
NO_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
               "toolbar".split())
NO_WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
               "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
               "subscription social share sharing sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
               "footer masthead comment comments commentlist reply replies respond disqus related recommended "
               "widget pagination pager toolbar login signup search copyright disclaimer skip".split())
# Words that stand beside those in class names of widgets, and elements whose ids name their text.
WIDGET_WORDS = set("area bar block box btn button buttons container form group icon icons inner item items js left link "
                   "links list outer panel right section slot unit user wrap wrapper".split())
NAMED = set("h1 h2 h3 h4 h5 h6 section p dt dd li td th tr table figure".split())
#: Left out without ending the block around them.
INSIDE = INLINE | set("button select svg canvas map object audio video".split())


class Node:
    __slots__ = ("label", "tag", "out", "main", "texts", "children", "path")

    def __init__(self, label: str, tag: str, out: bool, main: bool, path: int):
        self.label, self.tag, self.out, self.main, self.path = label, tag, out, main, path
        self.texts: list[str] = []
        self.children: list[Node] = []


def widget(name: str) -> bool:
    """Whether a class or id is made of widget words only, one of NO_WORDS among them."""
    words = {x for x in re.split(r"[^a-z0-9]+", CAMEL.sub(" ", name).lower()) if x and not x.isdigit()}
    return not words.isdisjoint(NO_WORDS) and words <= NO_WORDS | WIDGET_WORDS or name.lower() in NO_WORDS


def _out(tag: str, attrs: str, in_main: bool) -> tuple[bool, str]:
    """Whether an element never holds content; its class for the label."""
    if tag in NO_TAGS or tag == "header" and not in_main:
        return True, ""
    if not attrs or tag in ("html", "body"):
        return False, ""
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
    name = got.get("class", "")
    if tag == "main":
        return False, name
    own_id = "" if in_main and (tag in NAMED or "section" in name.split()) else got.get("id", "")
    names = name + " " + own_id
    words = set(re.split(r"[^a-z0-9]+", (names + " " + CAMEL.sub(" ", names)).lower()))
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
    if in_main:  # an article's own names may hold such a word: only a name that is a widget's as a whole counts
        no = any(widget(x) for x in names.split())
    else:
        no = bool(words & NO_WORDS)
    no = no or got.get("role", "").lower() in NO_ROLES or hidden
    return no or (not in_main and "header" in words), name


def parse(page: str) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree of block elements and the blocks of text, in page order, with their nodes."""
    root = Node("", "", False, False, ROOT)
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, its block node, left out from here
    blocks: list[tuple[str, Node]] = []
    parts: list[str] = []

    def end_block():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = stack[-1][1]
                blocks.append((text, node))
                node.texts.append(text)

    def pop_to(k: int):
        if any(t not in INSIDE for t, _, _ in stack[k:]):
            end_block()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:  # a tag that is never closed: its sign is text
            parts.append("&lt;")
            at += 1
            continue
        at = m.end()
        if m["text"] is not None:
            if not stack[-1][2] or stack[-1][1].out:  # a left-out block is a block; a left-out piece of a line is none
                parts.append(m["text"] if m["text"] != "<" else "&lt;")
            continue
        if m["cdata"] is not None or m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                end_block()
            elif not stack[-1][2]:
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag not in KEEP_P and tag not in INSIDE:  # a block element ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE and not (tag in ("tr", "body")):
                    break
        node, out = stack[-1][1], stack[-1][2]
        no, name = _out(tag, m["attrs"], node.main)
        if tag in INSIDE:
            stack.append((tag, node, out or no))
            continue
        end_block()
        label = tag + ("." + ".".join(sorted(name.split())) if name else "")
        child = Node(label, tag, out or no, node.main or tag in ("article", "main") and not (out or no),
                     below(node.path, label))
        node.children.append(child)
        stack.append((tag, child, out or no))
    end_block()
    return root, blocks


def name_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


ROOT = name_of("")


def below(path: int, label: str) -> int:
    """The path of a node: a hash of its parent's path and its label, of one size at any depth."""
    return xxhash.xxh64_intdigest(label, path) >> 1


def shape(root: Node) -> list:
    """``[label, hashes of the blocks, children]``; children of a node with the same label are one, in order of first sight."""
    tree: list = [root.label, [name_of(t) for t in root.texts], []]
    made, stack = {root.path: tree}, [(c, tree) for c in reversed(root.children)]
    while stack:
        node, parent = stack.pop()
        entry = made.get(node.path)
        if entry is None:
            entry = made[node.path] = [node.label, [], []]
            parent[2].append(entry)
        entry[1] += [name_of(t) for t in node.texts]
        stack += [(c, entry) for c in reversed(node.children)]
    return tree


def flatten(tree: list) -> list[list]:
    """``[number of the parent, label, hashes]`` per node, parents first."""
    out, queue = [], [(tree, -1)]
    for node, parent in queue:  # the queue grows as it is read
        queue += [(c, len(out)) for c in node[2]]
        out.append([parent, node[0], node[1]])
    return out


def unflatten(rows: list[list]) -> list:
    nodes = [[label, texts, []] for _, label, texts in rows]
    for node, (parent, _, _) in zip(nodes, rows, strict=True):
        if parent >= 0:
            nodes[parent][2].append(node)
    return nodes[0]


def heaviest(pairs: list[tuple[int, int, int]], weight: list[int]) -> list[int]:
    """Of pairs ``(i, j, number)`` sorted by i, those that increase in i and j with the largest sum of weights."""
    if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False)):
        return [p for _, _, p in pairs]
    places = {j: k + 1 for k, j in enumerate(sorted({j for _, j, _ in pairs}))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)  # prefix maxima over j: (sum, last pair)
    order = sorted(range(len(pairs)), key=lambda x: (pairs[x][0], -pairs[x][1]))  # of one i, none can follow another
    before = [-1] * len(pairs)
    best = (0, -1)
    for x in order:
        _, j, p = pairs[x]
        k, top = places[j] - 1, (0, -1)
        while k:
            top = max(top, tree[k])
            k &= k - 1
        before[x] = top[1]
        own = (top[0] + weight[p], x)
        best = max(best, own)
        k = places[j]
        while k < len(tree):
            tree[k] = max(tree[k], own)
            k += k & -k
    out, x = [], best[1]
    while x >= 0:
        out.append(pairs[x][2])
        x = before[x]
    return out


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the number of matched nodes and the matched pairs of two trees with equal labels."""
    if a[0] != b[0]:
        return 0, []
    pairs, kids = [(a, b)], []
    for x, y in pairs:  # grows as it is read: pairs of equal paths, parents first
        at: dict[str, list[int]] = {}
        for j, c in enumerate(y[2]):
            at.setdefault(c[0], []).append(j)
        own = []
        for i, c in enumerate(x[2]):
            for j in at.get(c[0], ()):
                own.append((i, j, len(pairs)))
                pairs.append((c, y[2][j]))
        kids.append(own)
    weight = [1] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        kids[k] = heaviest(kids[k], weight)
        weight[k] += sum(weight[p] for p in kids[k])
    taken, stack = [], [0]
    while stack:
        k = stack.pop()
        taken.append(pairs[k])
        stack += kids[k]
    return weight[0], taken


def numbered(tree: list) -> list[tuple[list, int]]:
    """Nodes of a shape with their paths; the first is the root."""
    out = [(tree, ROOT)]
    for node, path in out:  # grows as it is read
        out += [(c, below(path, c[0])) for c in node[2]]
    return out


def host_of(url: str):
    """Lower-case host of the url column ('' if none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(host, template array<struct<path, text>>)`` (hashes) from ``(id, host, html)``: constant nodes of each host."""
    shapes = pa.schema([("id", pa.int64()), ("host", pa.string()), ("tree", pa.string()), ("layout", pa.int64())])

    def draw(b: pa.RecordBatch) -> pa.RecordBatch:
        trees = [shape(parse(h or "")[0]) for h in b.column(2).to_pylist()]
        layouts = [name_of(" ".join(str(path) for _, path in n)) if any(x[1] for x, _ in n) else None
                   for n in map(numbered, trees)]  # null: a page without text shows nothing
        return as_batch({"id": b.column(0), "host": b.column(1), "layout": layouts,
                         "tree": [json.dumps(flatten(t), separators=(",", ":")) for t in trees]}, shapes)

    drawn = materialize(map_batches(pages.where("host <> ''").select(id_col, "host", "html"), draw,
                                    "id long, host string, tree string, layout long"), "wi_trees")
    trees = (drawn.where("layout is not null").groupBy("host", "layout", "tree")
             .agg(F.min("id").alias("id")))  # copies of a page are one witness
    layouts = trees.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"),
                                                  F.min_by("tree", F.struct("id", "tree")).alias("reference"))
    frequent = Window.partitionBy("host").orderBy(F.desc("n"), "id", "layout")
    first = layouts.withColumn("k", F.row_number().over(frequent)).where(F.col("k") <= REFERENCES)
    both = trees.join(first.select("host", "k", "reference"), "host").select("host", "tree", "reference", "k")
    names = ["host", "path", "k", "text", "matched", "same"]
    counted = pa.schema([("host", pa.string())] + [(c, pa.int64()) for c in names[1:]])

    def align(b: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple, list[int]] = {}
        read: dict[str, tuple[list, dict]] = {}
        for host, tree, reference, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if reference not in read:
                ref = unflatten(json.loads(reference))
                read[reference] = ref, {id(node): path for node, path in numbered(ref)}
            ref, paths = read[reference]
            found: dict[int, tuple[set, set]] = {}
            for mine, theirs in match(ref, unflatten(json.loads(tree)))[1]:
                if mine[1] and theirs[1]:
                    x, y = found.setdefault(paths[id(mine)], (set(), set()))
                    x.update(mine[1])
                    y.update(theirs[1])
            for path, (x, y) in found.items():
                for text in x:
                    n = sums.setdefault((host, path, k, text), [0, 0])
                    n[0] += 1
                    n[1] += text in y
        cols = list(zip(*((*key, *n) for key, n in sums.items()), strict=True)) if sums else [[]] * len(names)
        return as_batch(dict(zip(names, cols, strict=True)), counted)

    counts = map_batches(both, align, "host string, path long, k long, text long, matched long, same long").groupBy(
        "host", "path", "k", "text").agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))
    fixed = counts.where((F.col("matched") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("matched")))
    out = materialize(fixed.groupBy("host").agg(F.collect_set(F.struct("path", "text")).alias("template")),
                      "wi_templates")
    drop_materialized(drawn)
    return out


def parted(page: str | None, template: list[dict] | None, lists: bool = True) -> tuple[str, int, int]:
    """``(content, blocks left out by the wrapper, blocks left out by the lists alone)`` of a page."""
    blocks = parse(page or "")[1]
    fixed = {(x["path"], x["text"]) for x in template} if template else set()
    constant = [(node.path, name_of(t)) in fixed for t, node in blocks] if fixed else [False] * len(blocks)
    live = [(t, node, c) for (t, node), c in zip(blocks, constant, strict=True) if not (node.out and lists)]
    main = [x for x in live if x[1].main]
    slots = [x for x in main or live if not x[2]] or main
    return ("\n\n".join(t for t, _, _ in slots), sum(constant),
            sum(node.out and lists and not c for (_, node), c in zip(blocks, constant, strict=True)))


def content(page: str | None, template: list[dict] | None) -> str:
    """The blocks of a page that are content, joined by empty lines."""
    return parted(page, template)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            lists: bool = True) -> DataFrame:
    """``(id, url, text, n_chars, n_template, n_listed)`` per page."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html")).withColumn("host", host_of("url"))
    found = wrappers(own)
    joined = own.join(found, "host", "left").select("page_id", "url", "html", "template")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()),
                        ("n_template", pa.int64()), ("n_listed", pa.int64())])

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [parted(h, t, lists) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        return as_batch({"page_id": b.column(0), "url": b.column(1), "text": [t for t, _, _ in got],
                         "n_chars": [len(t) for t, _, _ in got], "n_template": [n for _, n, _ in got],
                         "n_listed": [n for _, _, n in got]}, schema)

    out = map_batches(joined, read, "page_id long, url string, text string, n_chars long, n_template long, n_listed long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
