"""Main text of web pages by the style trees of their sites."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.llm.words import batch_slices
from rectide.session import cut_lineage

#: Elements without content, and those whose content is not text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
#: Elements that stand inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button select option input svg math".split()
)
#: Elements that hold no part of an article.
NOISE_TAGS = frozenset(
    "nav footer aside form button select option datalist fieldset legend input noscript template object embed canvas svg "
    "audio video dialog menu head map applet frameset".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class names and ids that mark menus, headers, sidebars, notices, adverts, forms and reader comments.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup signin login "
    "sidebar sidebars aside nav navbar navigation menu menus footer header masthead topbar toolbar breadcrumb breadcrumbs "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations "
    "popular trending widget widgets popup modal overlay pagination pager search copyright skip teaser outbrain taboola".split()
)
#: Words of page headers: inside an article they name its own heading.
HEADER_WORDS = frozenset("header masthead banner".split())
#: An opening tag of the key ends an open element of the value, unless one of ``_SCOPE`` lies between.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPE = frozenset("table ul ol dl select html body td th".split())

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^<>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PIECE = re.compile(r"[^A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)

_SHAPE = "k1 long, k2 long, host string, family long, paths array<struct<path: long, form: long>>, feats array<struct<path: long, feat: long>>"
OUT = "page_id long, url string, text string, n_chars long"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else None


@dataclass
class Page:
    """The DOM of a page as arrays over its elements, and its runs of text in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    sign: list[bool] = field(default_factory=list)
    header: list[bool] = field(default_factory=list)  # signed as a header only
    path: list[int] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # block, element, decoded text

    def chain(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parent[node]

    def blocks(self, dropped: list[bool]) -> list[tuple[int, str]]:
        """(element that holds the block, text) of the blocks that keep text, white space made one space."""
        texts: dict[int, list[str]] = {}
        holder: dict[int, int] = {}
        for block, node, text in self.runs:
            if not dropped[node]:
                texts.setdefault(block, []).append(text)
                holder.setdefault(block, node)
        out = []
        for block, parts in texts.items():
            text = " ".join("".join(parts).split())
            if text:
                node = holder[block]
                while self.parent[node] >= 0 and self.tag[node] in INLINE:
                    node = self.parent[node]
                out.append((node, text))
        return out


def _signs(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """(marks noise, marks a header only, label of the element in a style tree)."""
    sign, header, label = tag in NOISE_TAGS, tag == "header", tag
    if "=" in attributes:
        for name, *values in _NAMES.findall(attributes):
            value = next((v for v in values if v), "")
            if name.lower() == "role":
                sign |= value.lower() in NOISE_ROLES
                continue
            if name.lower() == "class":
                label += "." + ".".join(sorted(_DIGITS.sub("#", value).split()))
            words = {w.lower() for w in _PIECE.split(_CAMEL.sub(" ", value))} & NOISE_WORDS
            header |= bool(words & HEADER_WORDS)
            sign |= bool(words - HEADER_WORDS)
    return sign, header, label


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, label: str) -> int:
    found = _paths.get((parent, label))
    if found is None:
        if len(_paths) > 1 << 16:
            _paths.clear()
        found = _paths[parent, label] = _hash(f"{parent}>{label}")
    return found


def parse(html: str) -> Page:
    """Forgiving parse: unclosed, misnested and cut off markup gives a tree, nothing raises."""
    page = Page()

    def open_element(tag, attributes):
        sign, header, label = _signs(tag, attributes)
        if tag in ("html", "body", "main"):
            sign = header = False
        up = stack[-1] if stack else -1
        page.tag.append(tag)
        page.parent.append(up)
        page.sign.append(sign)
        page.header.append(header)
        page.path.append(page.path[up] if tag in INLINE and up >= 0 else _path(page.path[up] if up >= 0 else 0, label))
        return len(page.tag) - 1

    def close(tags, limit):
        for at in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[at]]
            if tag in tags:
                del stack[at:]
                return True
            if tag in limit:
                break
        return False

    stack: list[int] = []
    stack.append(open_element("html", ""))
    block = 0
    for found in _TOKEN.finditer(html):
        tag = found.group(3) or found.group(6)
        if tag is None:
            text = found.group()
            if text[0] != "<" or len(text) == 1:
                page.runs.append((block, stack[-1], unescape(text) if "&" in text else text))
            elif found.group(1):
                block += 1  # scripts and the like part blocks
            continue
        tag = tag.lower()
        if found.group(2) or found.group(5):
            if close({tag}, _SCOPE if tag in INLINE else frozenset()) or tag == "p":
                block += tag not in INLINE
            continue
        block += tag not in INLINE
        if tag in ("html", "body") and any(page.tag[n] == tag for n in stack):
            continue
        if tag == "br":
            page.runs.append((block, stack[-1], " "))
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPE - _CLOSES[tag])
        elif tag not in INLINE:
            close({"p"}, _SCOPE | {"div", "section", "article", "main", "blockquote"})
            if tag == "body":
                close({"head"}, frozenset())
        attributes = found.group(4) if found.group(3) else found.group(7)
        node = open_element(tag, attributes)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            stack.append(node)
    return page


def _marked(page: Page) -> list[int]:
    """Elements marked as the main part: articles (of main, if there is one), else main; those inside one of them left out."""
    noisy = _noisy(page, set())
    main = [n for n, tag in enumerate(page.tag) if tag == "main"]
    inside = set(main[:1])
    articles = [
        n
        for n, tag in enumerate(page.tag)
        if tag == "article" and not page.sign[n] and not any(page.tag[a] == "article" for a in page.chain(page.parent[n]))
    ]
    if main:
        articles = [n for n in articles if any(a in inside for a in page.chain(n))]
    clear = [n for n in articles if not noisy[n]]
    if clear:
        return clear
    if main:
        return main[:1]
    if not articles:
        return []
    # all lie in branches marked as noise, such as a menu that is never closed: the longest is the page's
    size = dict.fromkeys(articles, 0)
    for _, node, text in page.runs:
        for a in page.chain(node):
            if a in size:
                size[a] += len(text)
    return [max(articles, key=lambda n: (size[n], -n))]


def _noisy(page: Page, shielded: set[int]) -> list[bool]:
    """Elements in a branch marked as noise; ``shielded`` ones are not marked, headers are in articles only kept."""
    out: list[bool] = []
    article: list[bool] = []
    for n, up in enumerate(page.parent):
        in_article = up >= 0 and article[up]
        article.append(in_article or page.tag[n] in ("article", "main"))
        own = n not in shielded and (page.sign[n] or (page.header[n] and not in_article))
        out.append(own or (up >= 0 and out[up]))
    return out


def _menus(page: Page, dropped: list[bool], marked: set[int]) -> None:
    """Drop lists outside the marked part whose text is nearly all links."""
    text, linked, links = [0] * len(page.tag), [0] * len(page.tag), [0] * len(page.tag)
    for n, tag in enumerate(page.tag):
        if tag == "a":
            for a in page.chain(n):
                links[a] += 1
    for _, node, run in page.runs:
        size = len(run.strip())
        in_link = False
        for a in page.chain(node):
            in_link |= page.tag[a] == "a"
            text[a] += size
            linked[a] += size * in_link
    for n, up in enumerate(page.parent):
        menu = page.tag[n] in ("ul", "ol", "dl", "table", "div", "p") and links[n] >= 3 and linked[n] >= 0.8 * text[n]
        menu = menu and not any(a in marked for a in page.chain(n))
        dropped[n] |= menu or (up >= 0 and dropped[up])


def structure(html: str) -> tuple[Page, list[bool]]:
    """The page and the elements that their marks alone make noise."""
    page = parse(html)
    marked = _marked(page)
    shielded = {a for n in marked for a in page.chain(n)}
    dropped = _noisy(page, shielded)
    _menus(page, dropped, set(marked))
    if marked:
        kept = page.blocks(dropped)
        inside = [any(a in set(marked) for a in page.chain(n)) for n, _ in kept]
        sizes = [sum(len(t) for (_, t), i in zip(kept, inside) if i == side) for side in (True, False)]
        if sizes[0] * 2 >= sizes[1]:  # a marked part of a third of the text or more is the article
            within = [False] * len(page.tag)
            for n, up in enumerate(page.parent):
                within[n] = n in marked or (up >= 0 and within[up])
            dropped = [d or not w for d, w in zip(dropped, within)]
    return page, dropped


def shape(page: Page, dropped: list[bool]) -> tuple[int, dict[int, int], set[tuple[int, int]]]:
    """(family, presentation of each style path, (style path, content) of each branch): the page's part of a site style tree.

    The family is the page's longest block, so copies of an article are one.
    """
    kept = page.blocks(dropped)
    longest = max(kept, key=lambda b: (len(b[1]), b[1]), default=(0, ""))[1]
    children: dict[int, set[int]] = {}
    feats: set[tuple[int, int]] = set()
    for node, text in kept:
        feature = _hash(text)
        below = None
        for a in page.chain(node):
            if page.tag[a] in ("body", "html"):
                break
            if page.tag[a] not in INLINE:
                feats.add((page.path[a], feature))
                children.setdefault(page.path[a], set())
                if below is not None:
                    children[page.path[a]].add(below)
                below = page.path[a]
    forms = {path: _hash(" ".join(map(str, sorted(kids)))) for path, kids in children.items()}
    return _hash(longest), forms, feats


def page_text(page: Page, dropped: list[bool], noise: set[int], least: float) -> str:
    """Blocks in page order without the branches of the style paths in ``noise``.

    If less than ``least`` of the text stays, the page repeats others of its site
    as a whole, and the style tree says nothing about it.
    """
    kept = page.blocks(dropped)
    if noise:
        low: list[bool] = []
        for n, up in enumerate(page.parent):
            low.append(page.path[n] in noise or (up >= 0 and low[up]))
        rest = page.blocks([d or x for d, x in zip(dropped, low)])
        if sum(len(t) for _, t in rest) >= least * sum(len(t) for _, t in kept):
            kept = rest
    return "\n\n".join(t for _, t in kept)


def _pages(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, str]]:
    """(row, html) with a bounded number of texts decoded at a time; null as empty."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    for begin, end in batch_slices(sizes, 4 << 20):
        yield from enumerate((x or "" for x in values.slice(begin, end - begin).to_pylist()), begin)


def site_style_trees(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, path, families, importance): the style nodes of the merged DOMs of each host.

    ``pages``: the shapes.  A style path is the chain of element names and classes
    below the body.  Content importance: 1 less the mean over the distinct block
    texts of a branch of their entropy over the m page families that have the
    path (a text in n families: log n / log m).  Presentation importance: the
    entropy of its child forms over the families.  Composite: (1 - gamma^l) times
    presentation plus gamma^l times content, for l forms.
    """
    held = pages.filter("host IS NOT NULL")
    node = held.select("host", "family", F.inline("paths")).distinct()
    forms = (
        node.groupBy("host", "path", "form").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host", "path")
        .agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("n") * F.log("n")).alias("s"))
    )
    feats = (
        held.select("host", "family", F.inline("feats")).distinct()
        .groupBy("host", "path", "feat").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host", "path").agg(F.avg(F.log("n")).alias("spread"))
    )
    weight = F.pow(F.lit(gamma), F.col("l"))
    size = F.log("m")
    presentation = F.when(F.col("m") > 1, (size - F.col("s") / F.col("m")) / size).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.least(F.col("spread") / size, F.lit(1.0))).otherwise(1.0)
    return forms.join(feats, ["host", "path"]).select(
        "host", "path", F.col("m").alias("families"), ((1 - weight) * presentation + weight * content).alias("importance")
    )


def _site_code(host: str, path: int) -> int:
    return _hash(f"{path} {host}")


def _broadcast_noise(low: DataFrame, limit: int) -> np.ndarray | None:
    """Sorted codes of (host, path), 8 bytes each, if there are at most ``limit``; else None."""
    code = F.udf(_site_code, "long")
    rows = low.select(code("host", "path").alias("code")).limit(limit + 1).toArrow()  # limit + 1 longs at most
    return None if rows.num_rows > limit else np.sort(np.array(rows.column(0), dtype=np.int64))


def extract_main_text(
    pages: DataFrame,
    importance: float = 0.2,
    families: int = 5,
    gamma: float = 0.9,
    least: float = 0.5,
    broadcast_paths: int = 1 << 20,
) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars (code points).

    Blocks in page order joined by an empty line; character references decoded,
    white space in a block made one space.  Left out are
    - by their marks: menus, headers, footers, sidebars, notices, adverts, forms,
      scripts, styles and reader comments, known by element, role or words of
      class and id, and lists of links; if articles (or main) are marked and hold
      a third of the other text, all outside them.  A branch that holds the marked
      article is not noise, so a menu that is never closed takes nothing along;
    - by the style tree of the host (``site_style_trees``): branches whose
      composite importance is below ``importance``, judged on paths that
      ``families`` page families have.  Copies of an article are one family, and
      a page that would lose more than 1 - ``least`` of its text keeps it: shared
      articles and passages are content.

    Each page gives the tree one row per style path and distinct block text,
    combined before the shuffle.  Up to ``broadcast_paths`` low branches go to the
    tasks as a sorted array of 8 bytes each, and the pages are not shuffled; more
    go back by joins on (host, path) and on the page, which Spark splits where a
    host is hot.  Both ways give the same texts.

    Null or empty html: no text.  Null or relative url: no host, marks alone.
    Repeated rows give a row each; an empty table gives none; other columns are
    not read.  Markup that is cut off or never closed is read as far as it goes;
    pages of any length are read whole.
    """
    mark = [F.col("page_id").isNull(), F.col("url").isNull()]
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keyed = slim.select(
        F.xxhash64(*mark, "page_id", "url", "html").alias("k1"),
        F.xxhash64(F.lit(1), *mark, "html", "url", "page_id").alias("k2"),
        "*",
    )

    def shapes(batches):
        for batch in batches:
            urls = batch.column("url").to_pylist()
            rows = []
            for i, html in _pages(batch, "html"):
                family, forms, feats = shape(*structure(html))
                rows.append((host_of(urls[i]), family, [{"path": p, "form": f} for p, f in forms.items()],
                             [{"path": p, "feat": f} for p, f in sorted(feats)]))
            host, family, paths, feats = zip(*rows) if rows else ([], [], [], [])
            pair = [pa.field("path", pa.int64()), pa.field("form", pa.int64())]
            other = [pa.field("path", pa.int64()), pa.field("feat", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array(host, pa.string()),
                    pa.array(family, pa.int64()),
                    pa.array(paths, pa.list_(pa.struct(pair))),
                    pa.array(feats, pa.list_(pa.struct(other))),
                ],
                names=["k1", "k2", "host", "family", "paths", "feats"],
            )

    def rendered(batch, noise_of):
        out = []
        for i, html in _pages(batch, "html"):
            page, dropped = structure(html)
            out.append(page_text(page, dropped, noise_of(i, page), least))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    def texts(batches):
        for batch in batches:
            noise = batch.column("noise").to_pylist()
            yield rendered(batch, lambda i, _: set(noise[i] or ()))

    def texts_by_codes(batches):
        codes = held.value

        def noise_of(host, page):
            paths = sorted(set(page.path)) if host is not None and len(codes) else []
            own = np.array([_site_code(host, p) for p in paths], dtype=np.int64)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            return {p for p, found in zip(paths, codes[at] == own) if found} if paths else set()

        for batch in batches:
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            yield rendered(batch, lambda i, page: noise_of(hosts[i], page))

    shaped = cut_lineage(keyed.mapInArrow(shapes, _SHAPE))
    low = cut_lineage(
        site_style_trees(shaped, gamma)
        .filter((F.col("families") >= families) & (F.col("importance") < importance))
        .select("host", "path")
    )
    codes = _broadcast_noise(low, broadcast_paths)
    if codes is not None:
        held = pages.sparkSession.sparkContext.broadcast(codes)
        return slim.mapInArrow(texts_by_codes, OUT)
    noise = (
        shaped.filter("host IS NOT NULL").select("k1", "k2", "host", F.explode("paths.path").alias("path"))
        .join(low, ["host", "path"]).groupBy("k1", "k2").agg(F.collect_set("path").alias("noise"))
    )
    return keyed.join(noise, ["k1", "k2"], "left").select("page_id", "url", "html", "noise").mapInArrow(texts, OUT)
