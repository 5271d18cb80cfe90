"""Main text of web pages by a site style tree: branches that a site repeats carry little information and go."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, split_members, store

MIN_PAGES = 5
IMPORTANCE = 0.3
ARTICLE_PRIOR = 0.2
CONTENT_SHARE = 0.9
#: Fixed values of HTML: elements without an end tag, elements whose content is no text, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template iframe svg canvas audio video select option button textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never are the article, and whole class, id or role values that say the same; see ``PageBlocks.finish``.
ASIDE = frozenset("nav footer aside menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navigation navbar menu sidebar breadcrumb "
    "breadcrumbs footer cookie cookies consent notice notices banner popup newsletter subscribe comment comments respond disqus "
    "share social related contentinfo complementary search login".split()
)
#: Implied ends: a start tag ends an open element of these kinds.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
P_ENDERS = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dt", "dd", "li", "legend", "summary", "figcaption"}
SCOPES = frozenset("article section div table ul ol dl td th main body html aside nav footer form blockquote".split())
SPACE = re.compile(r"\s+")
DIGIT = re.compile(r"\d")
UNFINISHED = re.compile(r"<[/!a-zA-Z][^<>]*\Z")


class Node:
    __slots__ = ("tag", "path", "plain", "silent", "content", "children", "flags", "weak", "within", "chars", "holds")

    def __init__(self, tag: str, path: int, plain: int, silent: bool, content: bool, flags: tuple[Node, ...] = ()) -> None:
        self.tag, self.path, self.plain, self.silent, self.content = tag, path, plain, silent, content
        self.children = []  # (style, tag) of each
        self.flags = flags  # this and outer elements that by their name are no article
        self.weak = self.within = False  # flagged by a value or as a form; lies in an article
        self.chars, self.holds = 0, set()  # text below a flagged element, and which of article and main


class PageBlocks(HTMLParser):
    """Text blocks of a page in order, each with its style path and whether it lies in an article element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", 0, 0, False, False)]
        self.found: list[tuple[Node, list[tuple[tuple[Node, ...], str]]]] = []
        self.blocks: list[tuple[int, str, bool, int]] = []  # path, text, inside an article, path of tags alone
        self.styles: dict[int, int] = {}  # path -> hash of the styles of its children
        self.pieces: list[tuple[tuple[Node, ...], str]] = []
        self.chars, self.articles = 0, 0  # text outside ASIDE elements; articles outside flagged ones

    def flush(self) -> None:
        if self.pieces:
            block = next(n for n in reversed(self.stack) if n.tag in BLOCKS or not n.tag)
            self.found.append((block, self.pieces))
            self.pieces = []

    def finish(self) -> None:
        """Drop what lies in flagged elements, once it is known what they hold.

        A flag by a value, or of a form, does not count around an article or main, or around most of a text
        that has no article elsewhere. Other flags do not count around a main, or the page's only articles.
        """
        live: dict[int, bool] = {}

        def counts(node: Node) -> bool:
            if id(node) not in live:
                around = "main" in node.holds or (node.holds and (not self.articles or (node.weak and not node.within)))
                most = node.weak and (node.within or not self.articles) and 2 * node.chars > self.chars
                live[id(node)] = not (around or most)
            return live[id(node)]

        for block, pieces in self.found:
            text = SPACE.sub(" ", "".join(t for flags, t in pieces if not any(map(counts, flags)))).strip()
            if text:
                self.blocks.append((block.path, text, block.content, block.plain))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1].tag in BLOCKS:
                self.flush()
            node = self.stack.pop()
            if node.children:
                for path, names in ((node.plain, [t for _, t in node.children]), (node.path, [s for s, _ in node.children])):
                    self.styles[path] = xxhash.xxh3_64_intdigest("\n".join(names)) - (1 << 63)

    def implied_ends(self, tag: str) -> None:
        enders = ENDS.get(tag, set()) | ({"p"} if tag in P_ENDERS else set())
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[depth].tag
            if open_tag in enders:
                self.close_to(depth)
                return
            if open_tag in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.implied_ends(tag)
        parent = self.stack[-1]
        if tag in VOID:
            if not parent.silent:
                self.pieces.append((parent.flags, " "))
            return
        values = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split() if attrs else []
        # an id, or a value with a digit, is a page's own
        classes = " ".join(v or "" for k, v in attrs if k in ("class", "role")).lower().split() if attrs else []
        style = ".".join([tag, *sorted({c for c in classes if not DIGIT.search(c)})])
        parent.children.append((style, tag))
        silent, body = parent.silent or tag in SILENT, tag in ("article", "main")
        path = xxhash.xxh3_64_intdigest(f"{parent.path}/{style}") - (1 << 63)
        plain = path if parent.path == parent.plain and style == tag else xxhash.xxh3_64_intdigest(f"{parent.plain}/{tag}") - (1 << 63)
        node = Node(tag, path, plain, silent, parent.content or body, parent.flags)
        if body and not silent:
            self.articles += not parent.flags
            for outer in parent.flags:
                outer.holds.add(tag)
        sure = tag in ASIDE or (tag == "header" and not parent.content)
        named = tag == "form" or (tag not in ("html", "body", "article", "main") and not ASIDE_WORDS.isdisjoint(values))
        if sure or named:
            node.weak, node.within, node.flags = not sure, parent.content, (*parent.flags, node)
        self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        if not node.silent:
            self.pieces.append((node.flags, data))
            size = len(data.strip())
            self.chars += size if all(n.weak for n in node.flags) else 0
            for outer in node.flags:
                outer.chars += size


def page_blocks(html: str | None) -> tuple[list[tuple[int, str, bool, int]], dict[int, int]]:
    parser = PageBlocks()
    parser.feed(UNFINISHED.sub("", html or ""))
    parser.close()
    parser.flush()
    parser.close_to(1)
    parser.finish()
    return parser.blocks, parser.styles


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row per page: its site, its blocks, the child styles of the paths the blocks stand in, and a hash of its texts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("path", pa.int64()), ("style", pa.int64()), ("plain", pa.int64()), ("plain_style", pa.int64())]
        block = pa.struct([*fields, ("text", pa.string()), ("inside", pa.bool_())])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out, copies = [], []
                for html in part.column("html").to_pylist():
                    blocks, styles = page_blocks(html)
                    out.append(
                        [
                            {"path": p, "style": styles.get(p, 0), "plain": q, "plain_style": styles.get(q, 0), "text": t, "inside": i}
                            for p, t, i, q in blocks
                        ]
                    )
                    texts = "\n".join(t for _, t, *_ in blocks).encode("utf-8", "replace")
                    copies.append(xxhash.xxh3_64_intdigest(texts) - (1 << 63))
                numbers = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [numbers, *[part.column(c) for c in ("id", "url", "site")], pa.array(copies, pa.int64()), pa.array(out, pa.list_(block))],
                    names=["row", "id", "url", "site", "page", "blocks"],
                )

    site = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), site.alias("site"), F.col(html_col).alias("html"))
    return rows.mapInArrow(
        parse,
        f"row long, id {dict(rows.dtypes)['id']}, url string, site string, page long, "
        "blocks array<struct<path:bigint,style:bigint,plain:bigint,plain_style:bigint,text:string,inside:boolean>>",
    )


def unimportant(open_blocks: DataFrame, min_pages: int, importance: float, content_share: float, article_prior: float) -> DataFrame:
    """``(row, place)`` of the blocks whose branch of the site style tree says little.

    For a path of a site that ``m`` pages have: the presentation importance is the entropy, to base ``m``, of the
    styles that pages have there; the content importance of a text is one less the entropy of its
    spread over pages, ``1 - log(c) / log(m)`` with ``c`` pages showing it. They are added in the shares
    ``1 - content_share`` and ``content_share``, with ``article_prior`` on top in an ``article`` or ``main``.
    Paths of fewer than ``min_pages`` pages are left alone. Pages of a site with the same texts count as one. A block
    has two paths, of tags with their classes and of tags alone, and goes if it is low in either: classes tell
    a site's templates apart, and tags bring together pages whose classes are their own.
    """
    levels = F.array_distinct(F.array(F.struct("path", "style"), F.struct(F.col("plain").alias("path"), F.col("plain_style").alias("style"))))
    blocks = open_blocks.select("row", "place", "page", "site", "inside", F.explode(levels).alias("at"), F.xxhash64("text").alias("content"))
    blocks = blocks.select("row", "place", "page", "site", "inside", "at.*", "content")
    total = blocks.count()

    def counted(*keys: str) -> DataFrame:
        """``c`` different pages and ``n`` blocks of each key."""
        return blocks.groupBy(*keys, "page").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("c"), F.sum("n").alias("n"))

    pages = counted("site", "path").withColumnRenamed("c", "m").filter(F.col("m") >= min_pages)
    styles = counted("site", "path", "style").drop("n")
    share = F.col("c") / F.col("m")
    looks = join_hot(styles, pages, ["site", "path"], "n", total).filter("m IS NOT NULL").groupBy("site", "path").agg(
        F.sum(-share * F.log(share) / F.log(F.col("m").cast("double"))).alias("presentation"), F.max("m").alias("m"), F.max("n").alias("n")
    )
    texts = counted("site", "path", "content", "inside").withColumnRenamed("n", "n_text")
    rated = join_hot(texts, looks, ["site", "path"], "n", total).filter("m IS NOT NULL")
    value = (1 - content_share) * F.col("presentation") + content_share * (1 - F.log(F.col("c").cast("double")) / F.log(F.col("m").cast("double")))
    low = rated.filter(value + F.when(F.col("inside"), article_prior).otherwise(0.0) < importance)
    low = low.select("site", "path", "content", "inside", F.col("n_text").alias("n"))
    return join_hot(blocks, low, ["site", "path", "content", "inside"], "n", total).filter("n IS NOT NULL").select("row", "place")


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    importance: float = IMPORTANCE,
    content_share: float = CONTENT_SHARE,
    article_prior: float = ARTICLE_PRIOR,
) -> DataFrame:
    """``(id, url, text)``: the main text of every whole page, its blocks joined by an empty line.

    Elements that by tag, or a whole class, id or role value, are menus, headers, footers, sidebars, notices, adverts,
    forms, scripts or comments have importance 0 (exceptions: :meth:`PageBlocks.finish`). Every other block of every page
    stays unless :func:`unimportant` finds its branch low over all pages of the host; an ``article`` or
    ``main`` only adds ``article_prior``. Hosts are compared by counts, so a hot host's pages never meet in one task.

    Null and empty pages have an empty text. Pages without a host form one site. Rows with null or repeated ids are
    pages like any others; other columns are left out. An empty table gives an empty result.
    Unfinished tags at a page's end are dropped; unclosed elements end with their parent.
    """
    found = store(parsed(pages, id_col, url_col, html_col), "html-blocks")
    each = found.select("row", "page", "site", F.posexplode("blocks").alias("place", "b")).select("row", "page", "site", "place", "b.*")
    low = unimportant(each, min_pages, importance, content_share, article_prior).groupBy("row").agg(F.collect_set("place").alias("low"))
    low = store(low, "html-low")
    whole, marked = split_members(found, "row", low)
    # only pages that lose a block meet their marks; the others stay where they are
    none = F.array().cast("array<int>")
    cleaned = marked.join(low, "row", "left").withColumn("low", F.coalesce("low", none))
    kept = F.filter("blocks", lambda b, i: ~F.array_contains(F.col("low"), i))
    names = [F.col("id").alias(id_col), F.col("url").alias(url_col)]
    return whole.select(*names, F.array_join(F.col("blocks.text"), "\n\n").alias("text")).unionByName(
        cleaned.select(*names, F.array_join(kept["text"], "\n\n").alias("text"))
    )


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
