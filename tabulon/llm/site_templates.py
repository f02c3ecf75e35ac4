"""Main text of web pages: subtrees that recur across a host's pages are its template and go."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import staged

LEAST_PAGES = 3  # pages of a host, with different texts, on which a subtree recurs at least
LEAST_SHARE = 0.01  # of the host's pages
BROADCAST_TEMPLATES = 1_000_000  # 8 MB; more are joined by a shuffle

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^<>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th option img".split())
#: Elements whose content is no text of the page; what is inside the first four is not even markup.
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("head script style template noscript iframe svg canvas object audio video title textarea".split())
#: Elements that are never main text, and the words in class, id or role that say so.
OUTSIDE = frozenset("nav menu aside footer form dialog button select".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside complementary footer colophon contentinfo header masthead cookie cookies consent notice notices notification alert popup modal "
    "overlay newsletter subscribe form search comment comments respond reply replies disqus share sharing social".split()
)
ROOTS = frozenset("html body article main".split())
#: A start tag of these ends an open element of the same kind (or a paragraph).
ENDS_PARAGRAPH = BLOCKS - {"body", "html"}
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "option": "option"}


@dataclass
class Block:
    """A block of text: 2 in an article, 1 in the main element, 0 elsewhere; whether it is outside by its markup; its subtrees."""

    text: str
    region: int
    outside: bool
    subtrees: list[int]


@dataclass
class Open:
    tag: str
    start: int
    outside: bool
    candidate: bool
    blocks: list[int] = field(default_factory=list)


def is_outside(tag: str, rest: str, in_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if tag in ROOTS and tag != "article" or "=" not in rest:
        return False
    words = {w for _, value in ATTRIBUTE.findall(rest) for w in re.split(r"[^a-z0-9]+", value.lower())}
    found = words & OUTSIDE_WORDS
    # An article may be called after its header or share buttons; only a comment in the form of an article goes.
    return bool(found & {"comment", "comments", "reply"}) if tag == "article" else bool(found)


def blocks_of(page: str | None, host: str) -> list[Block]:
    """The blocks of a page in order, each with hashes of the subtrees around it that lie outside articles and the main element.

    Character references are decoded, white space is one space, a broken tag at the end is no text.
    """
    out: list[Block] = []
    pieces: list[str] = []
    stack: list[Open] = []
    articles = mains = outside = skipped = 0
    source, at = page or "", 0

    def flush():
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                number = len(out)
                out.append(Block(text, 2 if articles else 1 if mains else 0, outside > 0, []))
                for element in stack:
                    if element.candidate:
                        element.blocks.append(number)

    def close(depth: int, end: int):
        nonlocal articles, mains, outside, skipped
        while len(stack) > depth:
            flush_needed = stack[-1].tag in BLOCKS
            if flush_needed:
                flush()
            element = stack.pop()
            articles -= element.tag == "article" and not element.outside
            mains -= element.tag == "main"
            outside -= element.outside
            skipped -= element.tag in SKIPPED
            if element.candidate and element.blocks:
                shape = " ".join(source[element.start : end].split())
                subtree = xxhash.xxh64_intdigest(f"{host}\n{shape}".encode("utf-8", "surrogatepass"))
                for number in element.blocks:
                    out[number].subtrees.append(subtree)

    def text(piece: str):
        if piece and not skipped:
            pieces.append(entities.unescape(piece) if "&" in piece else piece)

    while True:
        found = MARKUP.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == tag:
                    close(depth, at)
                    break
                if stack[depth].tag in ("article", "main", "body") and tag not in ROOTS:
                    break
            if tag in BLOCKS:
                flush()
            continue
        if tag in SPACED:
            pieces.append(" ")
        if tag in BLOCKS:
            flush()
        closing = set(SIBLINGS.get(tag, "").split()) | ({"p"} if tag in ENDS_PARAGRAPH else set())
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].tag in closing:
                close(depth, found.start())
                break
            if stack[depth].tag in BLOCKS and stack[depth].tag not in closing:
                break
        if tag in VOID or found["rest"].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        away = is_outside(tag, found["rest"], articles > 0)
        if tag in ("article", "main") and not away:
            for element in stack:
                element.candidate = False  # it holds the article, so it's no part of the template
        element = Open(tag, found.start(), away, tag in BLOCKS and tag not in ROOTS and not articles)
        articles += tag == "article" and not away
        mains += tag == "main"
        outside += away
        skipped += tag in SKIPPED
        stack.append(element)
    flush()
    close(0, len(source))
    return out


def main_text(blocks: list[Block], template) -> tuple[str, int]:
    """The text of a page, and how many blocks the template takes away.

    Blocks outside by their markup and blocks in a recurring subtree go; of the rest, those in articles
    are the text if there are any, else those in the main element, else all.
    """
    recurring = [any(template(s) for s in b.subtrees) for b in blocks]
    left = [b for b, gone in zip(blocks, recurring, strict=True) if not gone and not b.outside]
    region = max((b.region for b in left), default=0)
    return "\n".join(b.text for b in left if b.region == region), sum(recurring)


def host_column(url: str) -> str:
    """SQL for the host of a url: after the first :// up to /, ?, # or the end, A-Z lower-cased; without :// (or null) empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}')"


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """The subtrees that are templates (``subtree``), and the subtrees of each page (``page_key``, ``subtree``).

    A subtree counts once for each different text of its host's pages: copies of one page are no reason to take it for a template.
    ``pages`` has ``page_key``, ``host`` and ``html``.
    """

    def subtrees(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                keys, hosts, own, texts = [], [], [], []
                for key, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_key", "host", "html")), strict=True):
                    blocks = blocks_of(page, host)
                    keys.append(key)
                    hosts.append(host)
                    own.append(np.array(sorted({s for b in blocks for s in b.subtrees}), np.uint64).view(np.int64))
                    inside = "\n".join(b.text for b in blocks if not b.outside)
                    texts.append(xxhash.xxh64_intdigest(inside.encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(hosts), pa.array(np.array(texts, np.uint64).view(np.int64)), pa.array(own, pa.list_(pa.int64()))],
                    ["page_key", "host", "page_text", "subtrees"],
                )

    found = pages.select("page_key", "host", "html").mapInArrow(subtrees, "page_key long, host string, page_text long, subtrees array<long>")
    found = staged(found, "subtrees")
    size = found.groupBy("host").agg(F.count_distinct("page_text").alias("pages"))
    each = found.select("page_key", "host", "page_text", F.explode("subtrees").alias("subtree"))
    # Partial counts by page first, so that a menu on a third of all pages is a few rows when it is shuffled.
    recurring = each.groupBy("host", "subtree", "page_text").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    many = F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * least_share))
    return recurring.join(size, "host").where(F.col("n") >= many).select("subtree"), each.select("page_key", "subtree")


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``template_blocks`` (blocks in recurring subtrees) of every page.

    ``pages`` has ``page_id``, ``url`` and ``html``. A null or empty page has an empty text; pages without a host share the empty
    one; repeated rows each give a row; an empty table gives no rows.
    """
    spark = pages.sparkSession
    keyed = pages.select(
        "page_id", "url", "html", F.expr(f"{host_column('url')} AS host"), F.xxhash64("page_id", "url", "html").alias("page_key")
    )
    found, own = templates(keyed, least_pages, least_share)
    found = staged(found, "templates")
    shared = None
    if found.count() <= BROADCAST_TEMPLATES:
        known = np.sort(np.array([r[0] for r in found.toLocalIterator()], np.int64))
        shared = spark.sparkContext.broadcast(known)
        given = keyed.withColumn("drop", F.lit(None).cast("array<long>"))
    else:
        drop = own.join(found, "subtree").groupBy("page_key").agg(F.collect_set("subtree").alias("drop"))
        given = keyed.join(drop, "page_key", "left")

    def texts(batches):
        recurring = None if shared is None else frozenset(np.asarray(shared.value).view(np.uint64).tolist())
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                rows = []
                for host, page, drop in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "drop")), strict=True):
                    gone = recurring if recurring is not None else frozenset(x & 0xFFFFFFFFFFFFFFFF for x in drop or ())
                    rows.append(main_text(blocks_of(page, host), gone.__contains__))
                found_texts = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        pa.array(found_texts, pa.string()),
                        pa.array([len(t) for t in found_texts], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                    ],
                    ["page_id", "url", "text", "n_chars", "template_blocks"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return given.select("page_id", "url", "host", "html", "drop").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long, template_blocks int")
