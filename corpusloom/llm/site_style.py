"""HTML main text by site style trees.

Pages of a host are merged into one tree: a node is a path of elements with their class and id; a node's styles are the
sequences of children it has on different pages. Two entropies over the host's pages make a node important: that of its
presentation (styles that differ from page to page) and that of its content (blocks that few pages share). A node's composite
importance joins its presentation with that of what lies in it, taken along the page's own branch; branches all of whose
nodes are of low importance are cut, and so are single blocks that the host's pages share, within articles too.

What an element is (nav, footer, form, comments, ...) cuts it as well. Names of classes and ids only hint: an element that
would take most of a page's text with it stays in spite of its name."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, small_enough, stored, unused

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea option datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that aren't main text by what they are (`header` only outside of articles).
CHROME_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("head title style script meta link base noscript template".split())
#: Words of class, id and role names that speak against main text, for reader comments, and for main text.
_WORD = r"(?:^|[-_])(?:{})(?=$|[-_])"
CHROME = re.compile(_WORD.format(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|related|share|sharing|social|widgets?|search|login|signup|pagination|pager|toolbar|contentinfo|complementary|navigation|alert"), re.I)
COMMENTS = re.compile(_WORD.format(r"comments?|disqus|replies|respond"), re.I)
MAIN = re.compile(_WORD.format(r"article|main|post|entry|content|story"), re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none")
#: Weight of presentation falls by this factor with each style of a node, as in the published method.
GAMMA = 0.9
#: Pages added to a node's, so that few pages are little evidence.
SMOOTH = 2


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(style of an element; -2 for chrome, -1 for names that speak for it, 1 for an article or main element, 0 else; hidden)."""
    kind = -2 if tag in CHROME_TAGS else 1 if tag in ("article", "main") else 0
    if not attributes or attributes.isspace():
        return tag, kind, False
    named, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            named.append(_DIGITS.sub("0", value.strip()))
    words = " ".join(named)
    if kind == 0 and tag not in ("html", "body"):
        each = words.split()
        if any(COMMENTS.search(w) for w in each):
            kind = -2
        elif sum(bool(CHROME.search(w)) for w in each) > sum(bool(MAIN.search(w)) for w in each):
            kind = -1
    return f"{tag}.{words}" if words else tag, kind, hidden


class Page:
    """A page's tree of elements that aren't inline, and its blocks of text in order.

    Node i has parent up[i] (before it), key[i] (a hash of host and path, the same on all pages of a host), kind[i] (see
    _element) and children[i], the styles of its children and `#` for its blocks. Blocks are (node, text)."""

    def __init__(self, where: str, page: str):
        self.up, self.key, self.kind, self.children, self.blocks = [-1], [xxhash.xxh64_intdigest(where)], [0], [[]], []
        self.title = ""
        if page:
            self._parse(page)

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, silent
        opened: Counter = Counter()
        parts: list[str] = []
        silent, at, n = 0, 0, len(page)

        def text(lo: int, hi: int):
            if hi > lo and stack[-1][0] == "head" and not page[lo:hi].isspace():
                pop(len(stack) - 1)  # text ends a head
            if not silent:
                parts.append(page[lo:hi])

        def flush():
            if parts:
                found = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if found:
                    node = stack[-1][1]
                    self.children[node].append("#")
                    self.blocks.append((node, found))

        def pop(k: int):
            nonlocal silent
            while len(stack) > k:
                tag, _, quiet = stack.pop()
                opened[tag] -= 1
                silent -= quiet

        def close(tags, until) -> None:
            """Close the innermost of these elements unless one that `until` tells lies within."""
            if any(opened[t] for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in tags:
                        pop(k)
                        return
                    if until(stack[k][0]):
                        return

        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                text(at, n)
                break
            if m.start() > at:
                text(at, m.start())
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            block = tag not in INLINE
            if m.group(1):
                if opened[tag]:
                    if block:
                        flush()
                    close((tag,), lambda t: not block and t not in INLINE)  # noqa: B023
                continue
            if opened["head"] and tag not in IN_HEAD:
                close(("head",), lambda t: False)
            if block:
                flush()
            if tag in VOID:
                continue
            if tag in _ENDS_P:
                close(("p",), lambda t: t not in INLINE)
            elif tag in _ENDS_SELF:
                close(_ENDS_SELF[tag], lambda t: t in ("ul", "ol", "dl", "table", "tbody", "select"))
            style, kind, hidden = _element(tag, m.group(3))
            if m.group(3).endswith("/") and tag not in ("p", "div", "span"):
                continue
            node = stack[-1][1]
            if block:
                self.children[node].append(style)
                self.up.append(node)
                self.key.append(xxhash.xxh64_intdigest(style, self.key[node]))
                self.kind.append(-2 if tag == "header" and not opened["article"] and not opened["main"] else kind)
                self.children.append([])
                node = len(self.up) - 1
            quiet = hidden or tag in SILENT
            stack.append((tag, node, quiet))
            opened[tag] += 1
            silent += quiet
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag == "title" and not self.title:
                    self.title = page[at : end.start() if end else n].strip()
                at = end.start() if end else n
        flush()

    def features(self):
        """(node's key, feature, sort) of all that is counted: 0 for a block, 1 for a node's style (what its children are), 2 for the node."""
        for node, found in self.blocks:
            yield self.key[node], xxhash.xxh64_intdigest(found, self.key[node]), 0
        for key, children in zip(self.key, self.children, strict=True):
            yield key, xxhash.xxh64_intdigest(" ".join(children), key), 1
            yield key, key, 2

    def identity(self) -> int:
        """The page as the tree counts it: its longest block outside of chrome and its title, or else its second longest one.
        So copies of one article count once, near copies for little more."""
        chrome = self.inherited(lambda kind: kind < 0)
        own = {t for node, t in self.blocks if not chrome[node]} or {t for _, t in self.blocks}
        longest = nlargest(2, own, key=lambda t: (len(t), t))
        return xxhash.xxh64_intdigest("\0".join([self.title, *longest[:1]] if self.title else longest))

    def inherited(self, test) -> list[bool]:
        """For each node whether it or one above it passes."""
        out: list[bool] = []
        for up, kind in zip(self.up, self.kind, strict=True):
            out.append(test(kind) or up >= 0 and out[up])
        return out

    def noisy(self, known) -> list[bool]:
        """For each node whether it lies in a branch of low importance, all of whose nodes are so.

        known: for each node None, or (presentation, weight of content, content) as importance() has them. A node's composite
        importance is presentation + weight * the mean importance of its text and children, weighted by their length."""
        n = len(self.up)
        inside, total, low = [0.0] * n, [0] * n, [True] * n
        for node, found in self.blocks:
            total[node] += len(found)
            inside[node] += len(found) * (known[node][2] if known[node] else 1.0)
        for i in range(n - 1, -1, -1):
            if total[i]:
                shown, weight, _ = known[i] or (0.0, 1.0, 1.0)
                own = shown + weight * inside[i] / total[i]
                low[i] = low[i] and own < self.cut
                if i:
                    up = self.up[i]
                    total[up] += total[i]
                    inside[up] += own * total[i]
                    low[up] = low[up] and low[i]
        for i in range(1, n):
            low[i] = low[i] or low[self.up[i]]
        return low

    cut = 0.3

    def main_text(self, known, cut_blocks) -> str:
        """known: see noisy(). cut_blocks(feature, inside an article) tells blocks that the host's pages share."""
        noisy, chrome = self.noisy(known), self.inherited(lambda kind: kind == -2)
        article = self.inherited(lambda kind: kind > 0)
        kept = [(node, t) for node, t in self.blocks if not chrome[node] and not noisy[node] and not cut_blocks(xxhash.xxh64_intdigest(t, self.key[node]), article[node])]
        # Names that speak against main text are overruled where they would take most of it.
        while kept and any(kind == -1 for kind in self.kind):
            outer: list[int] = []  # for each node its outermost element with such a name, or -1
            for i, (up, kind) in enumerate(zip(self.up, self.kind, strict=True)):
                above = outer[up] if up >= 0 else -1
                outer.append(above if above >= 0 else i if kind == -1 else -1)
            share: Counter = Counter()
            for node, t in kept:
                share[outer[node]] += len(t)
            top, most = max(share.items(), key=lambda x: (x[1], -x[0]))
            if top < 0 or 3 * most < 2 * sum(share.values()) or any(article[node] and outer[node] != top for node, _ in kept):
                kept = [(node, t) for node, t in kept if outer[node] < 0]
                break
            self.kind[top] = 0
        within = [(node, t) for node, t in kept if article[node]]
        if 4 * sum(len(t) for _, t in within) >= sum(len(t) for _, t in kept):
            kept = within or kept
        return "\n".join(t for _, t in kept)


def host(url: str | None) -> str:
    """Lower-cased host of a url; '' without one, so such pages share a tree."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def importance(pages: DataFrame, url: str = "url", page: str = "html", cut: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts (stored): nodes of at least two distinct pages (node, pages, shown, weight, content), and
    blocks (feature, importance) whose importance is below `cut`.

    With n the pages of a block and m those of its node, a block's importance is 1 - log n / log(m + SMOOTH), and a node's content
    is the mean of its blocks'. Presentation is the entropy of a node's styles over its pages, to the same base. weight is GAMMA
    to the power of the number of styles, and shown is presentation times 1 - weight. Pages are counted by their identity().

    All are counts by (node, feature, page), then by (node, feature), then by node, aggregated before each shuffle, so
    a host with most of the pages meets in no task."""

    def run(batches):
        for b in batches:
            rows = set()
            for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = Page(host(u), p or "")
                own = tree.identity()
                rows.update((*f, own) for f in tree.features())
            node, feature, sort, own = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(_signed(node)), pa.array(_signed(feature)), pa.array(sort, pa.int32()), pa.array(_signed(own))], names=["node", "feature", "sort", "page"])

    seen = pages.select(F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{page}`").cast("string").alias("p")).mapInArrow(run, "node long, feature long, sort int, page long")
    seen = seen.groupBy("node", "feature", "sort", "page").agg(F.lit(1).alias("one")).groupBy("node", "feature", "sort").agg(F.count("*").cast("double").alias("n"))
    seen = stored(seen, "style-features")
    is_, spread = lambda k: F.col("sort") == k, F.col("n") * F.log("n")
    by_node = seen.groupBy("node").agg(
        F.max(F.when(is_(2), F.col("n"))).alias("pages"),
        F.count(F.when(is_(1), 1)).alias("styles"),
        *[F.coalesce(F.sum(F.when(is_(k), x)), F.lit(0.0)).alias(f"{name}{k}") for k in (0, 1) for name, x in (("n", F.col("n")), ("spread", spread))],
    )
    base = F.log(F.col("pages") + SMOOTH)
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    content = F.when(F.col("n0") > 0, F.greatest(F.lit(0.0), 1 - F.col("spread0") / F.col("n0") / base)).otherwise(1.0)
    presentation = F.least(F.lit(1.0), (F.log("n1") - F.col("spread1") / F.col("n1")) / base)
    nodes = stored(by_node.where("pages > 1").select("node", "pages", ((1 - weight) * presentation).alias("shown"), weight.alias("weight"), content.alias("content")), "style-nodes")
    low = seen.where(is_(0) & (F.col("n") > 1)).join(nodes.select("node", "pages"), "node").select("feature", (1 - F.log("n") / F.log(F.col("pages") + SMOOTH)).alias("importance"))
    low = stored(low.where(F.col("importance") < cut), "style-blocks")
    dropped(seen)
    return nodes, low


class _Known:
    """The trees' figures by key, in sorted arrays."""

    def __init__(self, key: np.ndarray, figures: np.ndarray, block: np.ndarray, worth: np.ndarray):
        order = np.argsort(key)
        self.key, self.figures = key[order], figures[order]
        order = np.argsort(block)
        self.block, self.worth = block[order], worth[order]

    def text(self, page: Page, cut: float) -> str:
        keys = _signed(page.key)
        at = np.minimum(np.searchsorted(self.key, keys), max(len(self.key) - 1, 0))
        hit = self.key[at] == keys if len(self.key) else np.zeros(len(keys), bool)
        known = [tuple(self.figures[a].tolist()) if h else None for a, h in zip(at.tolist(), hit.tolist(), strict=True)]

        def shared(feature: int, article: bool) -> bool:
            """Whether a block goes; within articles the evidence must be twice as clear."""
            want = np.uint64(feature).view(np.int64)
            at = int(np.searchsorted(self.block, want))
            return at < len(self.block) and self.block[at] == want and bool(self.worth[at] < (cut / 2 if article else cut))

        page.cut = cut
        return page.main_text(known, shared)


def extract(pages: DataFrame, url: str = "url", page: str = "html", cut: float = 0.3, most_nodes: int = 1_000_000) -> DataFrame:
    """Add `text` (the main text, blocks joined by line ends) and `n_chars` (its code points), replacing columns of their names.

    Branches of the host's style tree whose nodes all have a composite importance under `cut` go, and blocks of lower importance
    (half of it within articles). So does what calls itself chrome; where article or main elements hold a quarter of the rest,
    only they stay. The trees' figures are broadcast if there are at most most_nodes, else joined to the pages by their own keys.
    Null and empty pages have the empty text; null urls share a tree; repeated pages get equal texts and count once; an empty table
    gives none; pages are read whole, however long or deep; other columns of any name pass through."""
    nodes, low = importance(pages, url, page, cut)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in names])
    fits = small_enough(nodes, most_nodes) and small_enough(low, most_nodes)
    if fits:
        n, b = nodes.select("node", "shown", "weight", "content").toArrow(), low.toArrow()
        figures = np.stack([n.column(c).to_numpy() for c in ("shown", "weight", "content")], 1)
        shared = pages.sparkSession.sparkContext.broadcast(_Known(n.column("node").to_numpy(), figures, b.column("feature").to_numpy(), b.column("importance").to_numpy()))
    else:
        source = _with_figures(source, nodes, low, url, page)
    at_url, at_page, schema = names.index(url), names.index(page), source.schema

    def run(batches):
        for b in batches:
            texts, own = [], None if fits else (b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())
            for i, (u, p) in enumerate(zip(b.column(at_url).to_pylist(), b.column(at_page).to_pylist(), strict=True)):
                if fits:
                    known = shared.value
                else:
                    ns, bs = own[0][i] or [], own[1][i] or []
                    known = _Known(np.array([x["node"] for x in ns], np.int64), np.array([[x["shown"], x["weight"], x["content"]] for x in ns]).reshape(-1, 3), np.array([x["feature"] for x in bs], np.int64), np.array([x["importance"] for x in bs]))
                texts.append(known.text(Page(host(u), p or ""), cut))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return source.mapInArrow(run, T.StructType([*schema.fields[: len(names)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def _with_figures(pages: DataFrame, nodes: DataFrame, low: DataFrame, url: str, page: str) -> DataFrame:
    """Add each page's own figures as two last columns; pages are matched by 128 bits of url and html."""
    names = pages.columns
    h, p = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(h, p).alias("a"), F.xxhash64(p, F.lit("|"), h).alias("b"))

    def run(batches):
        for b in batches:
            rows = set()
            for k, u, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows.update((k["a"], k["b"], f, sort) for _, f, sort in Page(host(u), p).features() if sort != 1)
            a, z, f, sort = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(_signed(f)), pa.array(sort, pa.int32())], names=["a", "b", "feature", "sort"])

    own = pages.select(key.alias("k"), h.alias("u"), p.alias("p")).mapInArrow(run, "a long, b long, feature long, sort int").distinct()
    by = ["a", "b"]
    ns = own.where("sort = 2").join(nodes.withColumnRenamed("node", "feature"), "feature").groupBy(*by).agg(F.collect_list(F.struct(F.col("feature").alias("node"), "shown", "weight", "content")).alias("ns"))
    bs = own.where("sort = 0").join(low, "feature").groupBy(*by).agg(F.collect_list(F.struct("feature", "importance")).alias("bs"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("k")).select("row", "k.a", "k.b")
    rows = rows.join(ns, by, "left").join(bs, by, "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("ns").alias(unused("ns", names)), F.col("bs").alias(unused("bs", names)))
