"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged by presentation: an element is known by its
path of block tags with their classes. Paragraphs, headings, lists and tables belong to the element around them
(their *home*: an article, section, division, menu ...). Of each home the tree holds on how many distinct
pages each of its contents and of its styles occurs:

* A *content* is a block's outline: links, numbers and stretches of words are each one mark, punctuation stays. A
  menu whose links differ on every page has the same outlines everywhere, and so has a footer.
* A *style* is the sequence of the blocks (with the magnitude of their lengths) and elements in a home.

With m pages, a content importance is one less the mean of log_m(pages) over the occurrences of contents, a
style importance is the entropy of the styles to base m, and a home's importance mixes both by its number of children.
What tags, roles and class names say (menu, footer, outside the article ...) is a prior; the more pages a host has,
the less it counts beside the tree. What stays below ``THRESHOLD`` goes; for elements named as adverts or comments, whose texts
differ like the article's, below ``NAMED``. Beside that, whole paths whose very texts the pages repeat go, but for homes that also hold
texts of their own and for articles; where they are nearly all that is left, the pages are versions of each other and nothing goes for that.
Only for hosts without a tree, of a single page, does markup decide.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialise

#: Least importance that stays: of a home with its prior, and of a path's exact texts.
THRESHOLD = 0.4
REPEATED = 0.15
#: The same for homes named as adverts or comments; what is said of others if nothing is; the share of a page's text that may go as repeated.
NAMED = 0.7
NEUTRAL = 0.6
MOST_REPEATED = 0.8
#: What the tree counts beside the prior with very many pages, and the further pages with which it counts half of that.
TRUST = 0.85
HALFWAY = 3
#: Weight of a home's contents against its own styles, to the power of its children.
DAMPING = 0.9
#: Verdicts on paths are sent to all executors up to so many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Elements below so many others are counted with the last one above them.
MAX_DEPTH = 64
#: Pages parsed together.
GROUP = 256

#: Names of HTML elements and of common classes.
BLOCK_TAGS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary hr menu dialog title noscript template iframe button select option textarea svg center".split()
)
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figcaption summary hr".split())
DEAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
VARIED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsense adunit advertorial promo promotion sponsor sponsored related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion feedback responses reactions teaser teasers".split()
)
TEMPLATE_NAMES = frozenset(
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert share sharing social popup modal overlay "
    "newsletter subscribe subscription signup login register search pagination pager widget toolbar topbar footer masthead skip copyright legal disclaimer "
    "submenu dropdown sidenav aside".split()
)
#: Names that headings and chapters of an article have as well: on a section or a text element within one they say nothing.
TOPIC_NAMES = frozenset("discussion feedback responses reactions respond reply replies legal disclaimer copyright notices related recommended recommendations".split())
#: Names that say what an element is even as the first part of a longer one (``ad-slot``, but not ``legal-history``).
PLAIN_NAMES = frozenset("ad ads advert adverts advertisement adsense comment comments disqus cookie cookies gdpr sidebar navbar nav newsletter sponsored".split())
DEAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE_TAGS = frozenset(("article", "main"))
PAGE_TAGS = frozenset(("html", "body"))
STATES = frozenset("has no not with without hide show".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table thead tbody tfoot".split())

_next_tag = re.compile(r"<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S).search
_attribute = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))").findall
_hidden = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", re.I).search
_names = re.compile(r"[a-z]+").findall
_number = re.compile(r"[0-9]+")
_stretch = re.compile(r"[^\W\d_]++(?:[\s'’,-]*+[^\W\d_]++)*+")
LINK = "@"


class _Element:
    __slots__ = ("tag", "path", "home", "unseen", "dead", "named", "article", "children")

    def __init__(self, tag: str, path: str, home: _Element | None, unseen: bool, dead: bool, named: tuple[int, ...], article: bool) -> None:
        self.tag, self.path, self.unseen, self.dead, self.named, self.article = tag, path, unseen, dead, named, article
        self.home = home or self
        self.children: list[str] = []

    def add(self, child: str) -> None:
        """A child's name; neighbours of one name count once."""
        if not self.children or self.children[-1] != child:
            self.children.append(child)


def _said(label: str) -> set[str]:
    """What classes and ids say an element is: the last part of each, or the first if it is plain.

    ``has-sidebar`` and ``no-comments`` say something about the element, not what it is.
    """
    parts = [names for names in map(_names, label.split()) if names and names[0] not in STATES]
    return {names[-1] for names in parts} | {names[0] for names in parts if names[0] in PLAIN_NAMES}


def _opened(tag: str, attributes: str, parent: _Element, depth: int, number: int) -> _Element:
    values = {k.lower(): (a or b or c).lower() for k, a, b, c in _attribute(attributes)} if attributes else {}
    label = f"{values.get('class', '')} {values.get('id', '')}".strip()
    # The id of a text element is a place to jump to.
    said = _said(values.get("class", "") if tag in TEXT_TAGS else label)
    if parent.article and (tag == "section" or tag in TEXT_TAGS or "legal" in said):
        said -= TOPIC_NAMES
    article = tag in ARTICLE_TAGS or values.get("role") == "main"
    named, dead = parent.named, parent.dead or tag in DEAD_TAGS or values.get("role") in DEAD_ROLES or (tag == "header" and not parent.article)
    if not (article or tag in PAGE_TAGS):
        if said & VARIED_NAMES:
            named = (*named, number)
        if said & TEMPLATE_NAMES or ("header" in said and not parent.article):
            named = (*named, -number)
    unseen = parent.unseen or tag == "head" or (attributes is not None and bool(_hidden(attributes))) or "display:none" in values.get("style", "").replace(" ", "")
    name = tag + ("." + _number.sub("0", "-".join(label.split())) if label else "")
    path = f"{parent.path}>{name}" if depth <= MAX_DEPTH else parent.path
    element = _Element(tag, path, parent.home if tag in TEXT_TAGS else None, unseen, dead, named, parent.article or article)
    if tag not in TEXT_TAGS:
        parent.home.add(name)
    return element


def outline(text: str) -> str:
    """The text with each link, number and stretch of words as one mark."""
    return _stretch.sub("w", _number.sub("0", text)).replace(" ", "")


class Block(NamedTuple):
    """A block of text; ``home`` is the path of the element that it belongs to, ``named`` numbers the elements around it
    that are named as side matter (negative: as a part of the page's frame)."""

    path: str
    home: str
    text: str
    outline: str
    dead: bool
    named: tuple[int, ...]
    article: bool


def parse(source: str) -> tuple[list[Block], dict[str, list[str]]]:
    """The blocks in page order, without hidden ones, and the styles by path."""
    root = _Element("", "", None, False, False, (), False)
    stack, blocks, styles, pending, marked, links, opened = [root], [], {}, [], [], 0, 0

    def add(text: str) -> None:
        text = entities.unescape(text)
        pending.append(text)
        marked.append(LINK if links and not text.isspace() else text)

    def flush() -> None:
        if pending:
            top, text = stack[-1], " ".join("".join(pending).split())
            if text and not top.unseen:
                found = outline(" ".join("".join(marked).split()))
                blocks.append(Block(top.path, top.home.path, text, found, top.dead, top.named, top.article))
                top.home.add(f"{top.tag if top.tag in TEXT_TAGS else ''}:{len(text).bit_length() if found.strip(LINK) else LINK}")
            pending.clear(), marked.clear()

    def close() -> None:
        done = stack.pop()
        if done.home is done:
            styles.setdefault(done.path, []).append("|".join(done.children))

    at, end = 0, len(source)
    while at < end:
        m = _next_tag(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at, closing, tag = m.end(), m[1], (m[2] or "").lower()
        if not tag:
            continue
        if not closing and (tag in RAW_TAGS or tag == "script"):
            stop = re.compile(rf"</{tag}[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            add(" ")
        elif tag not in BLOCK_TAGS:
            if tag == "a":
                links = 0 if closing else 1
            continue
        elif closing:
            flush()
            if stack[-1].tag == tag or any(x.tag == tag for x in stack):
                while stack[-1].tag != tag:
                    close()
                close()
        else:
            flush()
            if stack[-1].tag == "p":
                close()
            ends, keeps = CLOSED_BY.get(tag, ()), HOLDERS | {"tr"} if tag in ("td", "th") else HOLDERS
            near = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in keeps), 0) if ends else 0
            if near and stack[near].tag in ends:
                while len(stack) > near or stack[-1].tag in ends:
                    close()
            opened, links = opened + 1, 0
            element = _opened(tag, m[3], stack[-1], len(stack), opened)
            if tag not in VOID_TAGS:
                stack.append(element)
    flush()
    while len(stack) > 1:
        close()
    return blocks, styles


def sided(blocks: list[Block]) -> list[int]:
    """For each block, what markup says: 2 where a name of varied side matter rules it out, 1 where a tag, a name or its place speaks against it, else 0.

    A block outside the articles has its place against it if those hold the larger part of what nothing else speaks against.
    Where nothing would be left in an article, names and tags don't count for an element that holds most of the page's text.
    """
    found = [2 if any(n > 0 for n in b.named) else 1 if b.dead or b.named else 0 for b in blocks]
    if not any(b.article and not side for b, side in zip(blocks, found, strict=True)):
        sizes: dict[int, int] = {}
        for b in blocks:
            for number in () if b.dead else b.named:
                sizes[number] = sizes.get(number, 0) + len(b.text)
        half = sum(len(b.text) for b in blocks if not b.dead) / 2
        small = [[n for n in b.named if sizes.get(n, 0) <= half] for b in blocks]
        found = [1 if b.dead else 2 if any(n > 0 for n in left) else 1 if left else 0 for b, left in zip(blocks, small, strict=True)]
    left = [b for b, side in zip(blocks, found, strict=True) if not side]
    inside = sum(len(b.text) for b in left if b.article)
    if inside and 2 * inside >= sum(len(b.text) for b in left):
        found = [side or (0 if b.article else 1) for b, side in zip(blocks, found, strict=True)]
    return found


BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("home", pa.string()), ("text", pa.string()), ("stance", pa.int32())]))
FEATURES = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64()), ("children", pa.int32())]))
STYLE, OUTLINE, TEXT = range(3)


def _signed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def features_of(blocks: list[Block], styles: dict[str, list[str]]) -> list[tuple[str, int, int, int]]:
    """What a page adds to its host's tree: (path, kind, hash, children), each once."""
    homes = {b.home for b in blocks}
    own = {(b.home, OUTLINE, _signed(b.outline), 0) for b in blocks} | {(b.path, TEXT, _signed(b.text), 0) for b in blocks}
    own |= {(home, STYLE, _signed(style), style.count("|") + 1) for home in homes for style in styles.get(home, ())}
    return sorted(own)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, page`` (a hash of the html), ``row`` (a number of its own), all ``blocks`` with their stances, and ``features``.

    A block's stance is what ``sided`` says, or -1 where that is nothing and the block is in an article.
    """
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.xxhash64("html").alias("page"), F.monotonically_increasing_id().alias("row"), F.coalesce("html", F.lit("")).alias("_html"))
    schema = (
        f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, page long, row long, "
        "blocks array<struct<path string, home string, text string, stance int>>, features array<struct<path string, kind int, feature long, children int>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            blocks, features = [], []
            for source in batch["_html"].to_pylist():
                found, styles = parse(source)
                stances = [-1 if not side and b.article else side for b, side in zip(found, sided(found), strict=True)]
                blocks.append([{"path": b.path, "home": b.home, "text": b.text, "stance": stance} for b, stance in zip(found, stances, strict=True)])
                features.append([{"path": p, "kind": kind, "feature": f, "children": n} for p, kind, f, n in features_of(found, styles)])
            columns = [*(batch[c] for c in ("page_id", "url", "host", "page", "row")), pa.array(blocks, BLOCKS), pa.array(features, FEATURES)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "page", "row", "blocks", "features"])

    return rows.mapInArrow(run, schema)


def importance(rows: DataFrame) -> DataFrame:
    """``host, path, kind, m, importance``: of every home (``kind`` OUTLINE) and of every path's exact texts (TEXT) on hosts with two or more distinct pages.

    Copies of a page count once. All groupings are by (host, path, feature) first, so the
    pages of a large host are spread and then only counts are combined.
    """
    hosted = rows.where(F.col("host").isNotNull())
    seen = hosted.select("host", "page", F.inline("features")).distinct()
    pages = hosted.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    counted = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.max("children").alias("children"))
    c = F.col("c").cast("double")
    summed = counted.groupBy("host", "path", "kind").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.log(c)).alias("logs"), F.sum(c).alias("total"), F.sum(c * F.log(c)).alias("weighted"), F.sum(c * F.col("children")).alias("children")
    )
    parts = summed.join(pages, "host").withColumn("mean", F.col("weighted") / F.col("total"))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    base = F.log("m")
    homes = parts.where(F.col("kind") != TEXT).groupBy("host", "path").agg(
        F.first("m").alias("m"), of(OUTLINE, 1 - F.col("mean") / base).alias("content"), of(STYLE, (F.log("total") - F.col("mean")) / base).alias("style"), of(STYLE, F.col("children") / F.col("total")).alias("children")
    )
    weight = F.pow(F.lit(DAMPING), F.col("children"))
    mixed = F.coalesce((1 - weight) * F.col("style") + weight * F.col("content"), F.col("content"))
    texts = parts.where(F.col("kind") == TEXT).select("host", "path", "kind", "m", (1 - F.col("logs") / F.col("kinds") / base).alias("importance"))
    return homes.select("host", "path", F.lit(OUTLINE).alias("kind"), "m", mixed.alias("importance")).unionByName(texts)


def verdicts(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, key``: what the tree decides, a letter and a path.

    ``g``: blocks of this home go, though markup says nothing against them; ``s``: they go if it does; ``c``: they go if it names them adverts or
    comments; ``r``: the texts at this path are repeated by the host's pages. ``t`` alone: the host has a tree.
    """
    trust = TRUST * (F.col("m") - 1) / (F.col("m") - 1 + HALFWAY)
    against = trust * F.col("importance")
    inner = ~F.col("path").rlike("^>html[^>]*(>body[^>]*)?$|^>body[^>]*$")
    letters = F.array(
        F.when(F.col("kind") == TEXT, F.when((F.col("importance") < REPEATED) & inner, "r")).when((against + (1 - trust) * NEUTRAL < threshold) & inner, "g"),
        F.when((F.col("kind") == OUTLINE) & (against < threshold), "s"), F.when((F.col("kind") == OUTLINE) & (against < threshold + NAMED - THRESHOLD), "c"),
    )
    said = tree.select("host", F.explode(F.filter(letters, lambda x: x.isNotNull())).alias("letter"), "path")
    return said.select("host", F.concat("letter", "path").alias("key")).unionByName(tree.select("host", F.lit("t").alias("key")).distinct())


def judged(rows: DataFrame, found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the ``keys`` of the written table ``found`` that concern them."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("key") + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(found.groupBy("host").agg(F.collect_set("key").alias("keys"))), "host", "left")
    own = F.flatten(F.transform("blocks", lambda b: F.array(*[F.concat(F.lit(x), b["home"]) for x in "gsc"], F.concat(F.lit("r"), b["path"]), F.lit("t"))))
    asked = rows.where(F.col("host").isNotNull()).select("row", "host", F.explode(F.array_distinct(own)).alias("key"))
    return rows.join(asked.join(found, ["host", "key"]).groupBy("row").agg(F.collect_set("key").alias("keys")), "row", "left")


def extract(pages: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES, markup: bool = True, tree: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null and empty html gives an empty text; pages without a host, or alone on theirs, are judged by
    markup only. The home with most of what other pages don't repeat goes only if its markup says so; if nothing would be left, the blocks
    that only the tree speaks against stay. Repeated rows come back each; an empty table gives an empty result; other columns are ignored. Blocks are joined by two line ends.
    Without ``markup`` all elements are judged as if nothing were said of them; without ``tree`` none of its verdicts holds.
    """
    rows = materialise(parsed(pages), "pages")
    if not markup:
        rows = rows.withColumn("blocks", F.transform("blocks", lambda b: b.withField("stance", F.lit(0))))
    found = verdicts(importance(rows), threshold)
    found = materialise(found if tree else found.where("key = 't'"), "verdicts")
    joined = judged(rows.drop("features"), found, broadcast_bytes).withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    said = lambda letter, path: F.array_contains("keys", F.concat(F.lit(letter), path))
    treeless = ~F.array_contains("keys", F.lit("t"))
    unsaid = F.filter("blocks", lambda b: b["stance"] < 1)
    own = F.filter("blocks", lambda b: (b["stance"] < 1) & ~said("r", b["path"]))
    homes = F.array_distinct(F.transform(own, lambda b: b["home"]))
    length = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    sizes = F.transform(homes, lambda h: F.struct(length(F.filter(own, lambda b: b["home"] == h)).alias("size"), h.alias("home")))
    main = F.array_max(sizes)["home"]
    goes = lambda b: F.when(b["stance"] == 1, treeless | said("s", b["home"])).when(b["stance"] == 2, treeless | said("c", b["home"])).otherwise((b["stance"] == 0) & said("g", b["home"]) & ~b["home"].eqNullSafe(F.col("_main")))
    judged_ = joined.withColumn("_main", main).withColumn("_left", F.filter("blocks", lambda b: ~goes(b)))
    # Homes with texts of their own, beside those that the pages repeat.
    fresh = judged_.withColumn("_fresh", F.array_distinct(F.transform(F.filter("_left", lambda b: ~said("r", b["path"])), lambda b: b["home"])))
    repeated = lambda b: said("r", b["path"]) & (b["stance"] >= 0) & ~F.array_contains("_fresh", b["home"])
    full = F.filter("_left", lambda b: ~repeated(b))
    versions = length(full) < (1 - MOST_REPEATED) * length(F.col("_left"))
    blocks = F.when(versions, F.col("_left")).when(F.size(full) > 0, full).otherwise(unsaid)
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    return fresh.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
