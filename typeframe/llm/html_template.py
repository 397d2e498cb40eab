"""Main text of web pages by template deduction.

The tokens of a page are its tag occurrences, told apart by their path and
their turn on it, and its text nodes.  Over the pages of one host, tokens with
the same occurrence vector (in which pages, and how often in each) form an
equivalence class.  A class is valid when it is frequent, large enough,
ordered (its tokens come in one order on every page) and nested (on every page
it lies in one and the same gap of the host's root class).  Valid classes make
up the host's template; what lies in the gaps between template tokens are the
slots, and constant texts belong to the template.

The template also tells which slots are the article: the deepest container of
the template that holds most of the host's slot text outside marked furniture
is the main element, and the page's text is the slots in it, less furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments).  The
mark of an article is a hint that decides only where the template cannot: on a
host of too few pages, and in a main element that is mostly template, since
then near copies of a page fill its host.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Least pages of a valid class, least tokens, and the share of its host's pages.
MIN_PAGES, MIN_TOKENS, MIN_SHARE = 3, 3, 0.5
#: Share of a host's slot text outside furniture that its main element holds.
MAIN_SHARE = 0.8

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg annotation annotation-xml textarea select object canvas".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: An open paragraph ends before these.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that hold text of their own rather than blocks, and so are no main element.
LINES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr caption figcaption option".split())
#: An open element of the first kind ends before one of its second.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
FURNITURE = set("nav header footer aside form button menu dialog head title".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id values that mark furniture, by themselves or together.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer foot sidebar aside related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr "
    "notice notices alert popup modal overlay comment comments disqus respond reply replies pagination pager widget toolbar copyright legal form search".split()
)
#: What else may stand before and after marks in a compound, as in site-header and ad-slot-2.
BEFORE = set("site page main global top bottom left right primary secondary mobile desktop sticky fixed floating".split())
AFTER = set("bar box block list item items link links button buttons btn wrapper wrap container area panel slot unit inner outer icons posts articles stories".split())
COMPOUNDS = {"post-comments", "article-comments", "entry-comments", "post-share", "article-share", "share-this", "share-post", "post-nav", "post-navigation"}
#: Elements that no class or id makes furniture.
WHOLE = {"html", "body", "main", "article"}
ARTICLE_MARKS = {"articlebody", "article-body", "article-content", "post-content", "entry-content", "post-body", "main-content", "story-body"}


@dataclass
class Node:
    """A tag's start, or a text: what the page's tokens are made of."""

    token: int
    text: str | None
    #: Inside furniture, inside the article, and whether a block border lies before it.
    skip: bool
    inside: bool
    border: bool
    #: The place of the enclosing element's start among the nodes, and whether the node starts a container.
    parent: int
    container: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    has_article: bool = False


def _furniture(word: str) -> bool:
    """Whether a class or id is a furniture mark or a listed compound of marks."""
    if word in MARKS or word in COMPOUNDS:
        return True
    parts = re.split(r"[-_]+", word)
    while parts and parts[0] in BEFORE:
        del parts[0]
    while parts and (parts[-1] in AFTER or parts[-1].isdigit()):
        del parts[-1]
    return bool(parts) and all(p in MARKS for p in parts)


def _marks(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether an element is furniture by role or hidden, whether by class or id, and whether it holds the article."""
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    body = bool(ARTICLE_MARKS.intersection(words)) or "articlebody" in attributes.get("itemprop", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    named = name not in WHOLE and any(map(_furniture, words))
    return not body and (bool(ROLES.intersection(attributes.get("role", "").lower().split())) or hidden), not body and named, body or attributes.get("role", "").lower() == "main"


def _id(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 1


def _size(nodes: list[Node]) -> int:
    return sum(len("".join(n.text.split())) for n in nodes if n.text is not None)


def parse(source: str, wrappers: frozenset[int] = frozenset()) -> Page:
    """The page's tokens in order; unclosed and misnested tags close as browsers close them.

    A form, or an element that is furniture by its class or id, is a mere
    wrapper if the page's only articles are in it and hold more text than is
    outside; ``wrappers`` are the places of such elements.
    """
    page = Page()
    # Name, path, furniture, article, furniture that could be a wrapper, and the start's place.
    stack: list[tuple[str, str, bool, bool, tuple[int, ...], int]] = []
    enclosing: set[int] = set()
    turn: Counter[str] = Counter()
    at, border, end = 0, True, len(source)

    def add_text(raw: str) -> None:
        nonlocal border
        if not raw:
            return
        text = entities.unescape(raw)
        path, skip, inside = (stack[-1][1], stack[-1][2] or bool(stack[-1][4]), stack[-1][3]) if stack else ("", False, False)
        if text.strip():
            page.nodes.append(Node(_id("text", path, text.strip()), text, skip, inside, border, stack[-1][5] if stack else -1))
            border = False
        elif page.nodes and page.nodes[-1].text is not None and not border:
            page.nodes[-1].text += " "

    while at < end:
        m = TAG.search(source, at)
        if not m:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add_text(entities.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        border = border or name not in INLINE
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # An inline end tag does not close the blocks that were opened inside it.
            if depth is not None and not (name in INLINE and any(s[0] not in INLINE for s in stack[depth + 1 :])):
                del stack[depth:]
            continue
        while stack and ((stack[-1][0] == "p" and name in ENDS_P) or name in SIBLINGS.get(stack[-1][0], ())):
            stack.pop()
        if name in ENDS_P and any(s[0] == "p" for s in stack):
            last = max(i for i, s in enumerate(stack) if s[0] == "p")
            if all(s[0] in INLINE for s in stack[last + 1 :]):
                del stack[last:]
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        furniture, named, body = _marks(name, attributes) if attributes else (False, False, False)
        skip, inside, soft, parent = stack[-1][2:] if stack else (False, False, (), -1)
        article = name in ("article", "main") or body
        # A header or form inside the article is furniture too.
        path = f"{stack[-1][1]}/{name}" if stack else name
        turn[path] += 1
        skip = skip or furniture or (name in FURNITURE and name != "form") or name in RAW
        if (named or name == "form") and len(page.nodes) not in wrappers:
            soft = (*soft, len(page.nodes))
        if article and not skip:
            enclosing.update(soft)
            inside = inside or not soft
            page.has_article |= not soft
        page.nodes.append(Node(_id("tag", path, turn[path]), None, skip or bool(soft), inside, border, parent, name not in INLINE and name not in LINES))
        if name in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
        elif name not in VOID:
            stack.append((name, path, skip, inside, soft, len(page.nodes) - 1))
    if enclosing and not page.has_article and not wrappers:
        opened = parse(source, frozenset(enclosing))
        if _size([n for n in opened.nodes if n.inside and not n.skip]) > _size([n for n in page.nodes if not n.skip]):
            return opened
    return page


def extract(page: Page, template: frozenset[int] = frozenset(), main: int | None = None) -> str:
    """The text of the page's slots in its main element, white space collapsed, blocks joined by one space."""
    texts = [n for n in page.nodes if n.text is not None and not n.skip]
    own = _within(page, main)
    held = [n for n in texts if own[n.parent]]
    kept = [n for n in held if n.token not in template]
    if not template or 2 * _size(kept) < _size(held):
        # Nothing tells slots from the rest, and the mark of the article decides.
        kept = [n for n in held if n.inside or not page.has_article]
    chosen = set(map(id, kept))
    blocks: list[list[str]] = []
    for n in page.nodes:
        if n.border or not blocks:
            blocks.append([])
        if id(n) in chosen:
            blocks[-1].append(n.text)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _within(page: Page, main: int | None) -> list[bool]:
    """Whether each node starts the main element or lies in it, and last, for nodes without a parent, whether all do."""
    everything = main is None or all(n.token != main or n.text is not None for n in page.nodes)
    own: list[bool] = []
    for n in page.nodes:
        own.append(everything or (n.text is None and n.token == main) or (n.parent >= 0 and own[n.parent]))
    return [*own, everything]


def _sums(rows: dict[tuple, list[int]], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, body, html) as their tokens, the text that counts at each, the parent's place and whether it is a container."""
    for batch in batches:
        pages = [parse(x or "").nodes for x in batch.column(2).to_pylist()]
        size = lambda n: 0 if n.text is None or n.skip else len("".join(n.text.split()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([[n.token for n in p] for p in pages], pa.list_(pa.int64())), pa.array([[size(n) for n in p] for p in pages], pa.list_(pa.int32())),
                pa.array([[n.parent for n in p] for p in pages], pa.list_(pa.int32())), pa.array([[n.container for n in p] for p in pages], pa.list_(pa.bool_())),
            ],
            ["host", "body", "tokens", "sizes", "parents", "containers"],
        )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors over the batch's pages: each page adds its mark to the tokens it holds."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for h, body, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for t, c in Counter(tokens).items():
                mark = _id(body, c)
                s = sums.setdefault((h, t), [0, 0, 0])
                s[0] += 1
                # Two 31-bit sums stand for the vector; they cannot overflow a long.
                s[1] += mark & 0x7FFFFFFF
                s[2] += mark >> 32
        yield _sums(sums, ["host", "token", "n", "v1", "v2"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and class, the least and greatest order (a hash) and gap of the root on any page of the batch."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for h, tokens, names, classes, root in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            of, turns, gap = dict(zip(names, classes, strict=True)), {}, 0
            for t in tokens:
                c = of.get(t)
                if c is None:
                    continue
                gap += c == root
                turns.setdefault(c, []).append((t, gap))
            for c, seen in turns.items():
                order = _id(*(t for t, _ in seen))
                gaps = [0] if c == root else [g for _, g in seen]
                f = found.setdefault((h, c), [order, order, min(gaps), max(gaps)])
                f[:] = min(f[0], order), max(f[1], order), min(f[2], *gaps), max(f[3], *gaps)
        yield _sums(found, ["host", "class", "order_lo", "order_hi", "gap_lo", "gap_hi"])


def _volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and template container, the slot text in it, and its place; -1 stands for the whole page."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for h, tokens, sizes, parents, containers, template in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            known = set(template)
            inside = [0] * len(tokens)
            total = 0
            for i in range(len(tokens) - 1, -1, -1):
                inside[i] += sizes[i] if tokens[i] not in known else 0
                if parents[i] >= 0:
                    inside[parents[i]] += inside[i]
                else:
                    total += inside[i]
            for k, size, place in [(-1, total, 0), *((t, inside[i], i) for i, t in enumerate(tokens) if containers[i] and t in known)]:
                f = found.setdefault((h, k), [0, 0])
                f[0] += size
                f[1] = max(f[1], place)
        yield _sums(found, ["host", "token", "volume", "place"])


def deduce(different: DataFrame) -> DataFrame:
    """(host, template, main): the template tokens and the main element of hosts whose different pages (host, body, html) share one."""
    pages = materialise(different.select("host", "body", "html").mapInArrow(_tokens, "host long, body long, tokens array<long>, sizes array<int>, parents array<int>, containers array<boolean>"), "page-tokens")
    vectors = pages.select("host", "body", "tokens").mapInArrow(_vectors, "host long, token long, n long, v1 long, v2 long")
    vectors = vectors.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("n", "v1", "v2")))
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    # Only tokens of enough pages can be in a valid class; a page has few of those.
    frequent = vectors.filter(F.col("n") >= MIN_PAGES).join(counts, "host").filter(F.col("n") >= F.col("pages") * MIN_SHARE)
    frequent = materialise(frequent.withColumn("class", F.xxhash64("n", "v1", "v2")).select("host", "token", "n", "class"), "template-tokens")
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("tokens"), F.first("n").alias("n")).filter(F.col("tokens") >= MIN_TOKENS)
    root = large.groupBy("host").agg(F.max(F.struct("n", "tokens", "class")).getField("class").alias("root"))
    classes = frequent.join(large.select("host", "class"), ["host", "class"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class"))).alias("x"))
    classes = materialise(classes.join(root, "host").select("host", "x.token", "x.class", "root"), "template-classes")
    tried = pages.join(classes, "host").select("host", "tokens", "token", "class", "root")
    orders = tried.mapInArrow(_orders, "host long, class long, order_lo long, order_hi long, gap_lo long, gap_hi long")
    valid = orders.groupBy("host", "class").agg(F.min("order_lo").alias("a"), F.max("order_hi").alias("b"), F.min("gap_lo").alias("c"), F.max("gap_hi").alias("d")).filter("a = b and c = d")
    members = classes.select("host", F.explode(F.arrays_zip(F.col("token"), F.col("class"))).alias("x")).select("host", "x.token", "x.class")
    template = members.join(valid.select("host", "class"), ["host", "class"]).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("template"))
    template = materialise(template, "template-valid")
    volumes = pages.join(template, "host").select("host", "tokens", "sizes", "parents", "containers", "template").mapInArrow(_volumes, "host long, token long, volume long, place long")
    volumes = volumes.groupBy("host", "token").agg(F.sum("volume").alias("volume"), F.max("place").alias("place"))
    # Elements that hold more than half of one volume lie in each other, so the least of them is the deepest.
    whole = F.max(F.when(F.col("token") == -1, F.col("volume"))).alias("whole")
    elements = F.collect_list(F.when(F.col("token") != -1, F.struct("volume", (-F.col("place")).alias("turn"), "token"))).alias("elements")
    main = volumes.groupBy("host").agg(whole, elements)
    held = F.filter("elements", lambda e: (F.col("whole") > 0) & (e.volume >= F.col("whole") * MAIN_SHARE))
    return materialise(template.join(main.select("host", F.array_min(held).getField("token").alias("main")), "host"), "templates")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract every page's main text.

    Returns ``id_col``, ``url_col``, ``text``, ``n_chars`` (code points) and
    ``n_template``, the page's tokens that belong to its host's template.

    A null or empty html has an empty text; a null or odd url has its own
    host, the empty one; pages of a host below the least count have no
    template and are cut by their marks alone; copies of a page count once, so
    that they do not turn its own text into template;
    very long pages are parsed whole; an empty table gives no rows; other
    columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).cast("string").alias("html"))
    bodies = source.withColumn("body", F.xxhash64("html")).select("host", "body", "html")
    # Where the list of copies can be broadcast, only the pages on it are shuffled whole.
    copies = materialise(bodies.groupBy("host", "body").agg(F.count("*").alias("n")).filter("n > 1").select("host", "body"), "page-copies")
    once = bodies.join(copies, ["host", "body"], "left_anti")
    first = bodies.join(copies, ["host", "body"], "left_semi").groupBy("host", "body").agg(F.any_value("html").alias("html"))
    different = once.unionByName(first)

    template = deduce(different)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, frozenset[int]] = {}
        for batch in batches:
            texts, used = [], []
            for source, tokens, main in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                values = tokens.values.to_numpy() if tokens.is_valid else np.zeros(0, "i8")
                key = values.tobytes()
                if key not in known:
                    known.clear() if len(known) >= 64 else None
                    known[key] = frozenset(values.tolist())
                page = parse(source or "")
                texts.append(extract(page, known[key], main))
                used.append(sum(n.token in known[key] for n in page.nodes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(used, pa.int64())], ["page", "url", "text", "n_template"])

    placed = source.join(template, "host", "left").select("page", "url", "html", "template", "main")
    out = placed.mapInArrow(cut, "page long, url string, text string, n_template long")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_template")
