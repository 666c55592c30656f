"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its element paths and its text blocks at their paths. All
tokens of a host that occur equally often on every page (that share their
occurrence vector) form an equivalence class; classes that stand on enough
pages are valid. Paths nest, so valid classes nest into the host's template:
an element path of one class lies inside the nearest path of another. What a
page holds between template tokens are its slots.

The template says where the main text is: of the elements that stand once on
each page, the slot that holds more than half of the host's text. Whatever its
name, what lies outside is left out, and so is text that belongs to the
template itself. Only where that cannot tell (inside the slot, on pages of
another layout, and on hosts with too few pages) tag and class names decide.

Occurrence vectors are never gathered: a class is told by two linear
fingerprints, the sums over pages of count times page hash, which Spark adds
up with map-side combining however many pages a host has.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize

#: A valid class stands on at least so many pages of its host, and so large a share of them.
MIN_PAGES, MIN_PERCENT = 3, 60
#: The main slot holds more than such a share of the text that stands outside elements without main text.
SLOT_PERCENT = 50
#: Template tokens of all hosts that are broadcast, at most; beyond, templates travel to their pages.
BROADCAST_TOKENS = 1_000_000
#: Pages of a host that share one copy of its template then.
HOT_PAGES = 20_000

# Element kinds of HTML.
BLOCKS = frozenset(
    "html head body title nav header footer aside main article section div p ul ol li dl dt dd table thead tbody tfoot tr td th "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset address hr details summary".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title")
#: Elements without main text, and words in class, id or role that tell the same of any element.
NO_TEXT = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe svg canvas object menu dialog label".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer masthead sidebar aside widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments reply replies disqus discussion share sharing social related recommended pagination pager toolbar copyright".split()
)
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s>/]*)[^>]*>?|<([a-zA-Z][^\s>/]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>?|([^<]+|<)""", re.DOTALL)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")


def label(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in paths, and whether it has no main text."""
    if "=" not in attributes:
        return tag, tag in NO_TEXT
    words = [w for m in MARKS.finditer(attributes) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    name = f"{tag}.{words[0]}" if words else tag
    return name, tag in NO_TEXT or (tag not in ("html", "body", *MAIN) and not NO_TEXT_WORDS.isdisjoint(words))


class Element(NamedTuple):
    """A closed element: its path's token, depth, characters inside (outside tags without main text), whether it is article or main, and holds elements."""

    token: int
    depth: int
    chars: int
    main: bool
    holds: bool


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Block(NamedTuple):
    """A text block: its element's token, its text, whether that is no main text, inside article or main, inside the main slot, a first heading, and any heading."""

    element: int
    text: str
    off: bool
    inside: bool
    slot: bool
    heading: bool
    title: bool


def child(parent: int, name: str) -> int:
    """The token of an element called ``name`` in the element of ``parent`` (signed 64-bit hash of its path)."""
    return xxhash.xxh64_intdigest(name, parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def text_token(element: int, text: str) -> int:
    """The token of a text block."""
    return xxhash.xxh64_intdigest("\n" + text, element & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


#: The token of the page itself.
ROOT = 0


def token_of(path: str, text: str | None) -> int:
    """A token: an element path, or a text block at its path."""
    at = ROOT
    for name in path.split("/")[1:]:
        at = child(at, name)
    return at if text is None else text_token(at, text)


class Page:
    """The elements and text blocks of a page, in order of their ends.

    Character references are decoded and white space is one space; inline
    elements don't end a block, block elements and line breaks do. Work and
    memory are linear in the source, however deep it nests: paths are hashed
    on from their parents, and characters are added up as elements close.
    """

    def __init__(self, source: str | None, slot: int | None = None):
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.slot = slot
        # tag, token, tag without main text, no main text, inside main, inside the slot, characters, holds elements
        self.stack: list[list] = [["", ROOT, False, False, False, slot == ROOT, 0, False]]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.read(source or "")
        self.end_block()
        while len(self.stack) > 1:
            self.close()
        self.chars = self.stack[0][6]

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                tag, token, bare, off, inside, slot, _, _ = at = self.stack[-1]
                self.blocks.append(Block(token, text, off, inside, slot, tag == "h1", tag in HEADINGS))
                if not bare:
                    at[6] += len(text)

    def close(self) -> None:
        tag, token, _, _, _, _, chars, holds = self.stack.pop()
        self.open[tag] -= 1
        self.stack[-1][6] += chars
        self.elements.append(Element(token, len(self.stack), chars, tag in MAIN, holds))

    def start(self, tag: str, attributes: str) -> None:
        name, named = label(tag, attributes)
        above = self.stack[-1]
        above[7] = True
        token = child(above[1], name)
        here = token == self.slot
        off = not here and (named or above[3])  # where the template puts the main text, names don't count
        self.stack.append([tag, token, tag in NO_TEXT or above[2], off, above[4] or tag in MAIN, here or above[5], 0, False])
        self.open[tag] += 1

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            if m[4] is not None:
                self.parts.append(m[4])
                continue
            tag = (m[1] or m[2] or "").lower()
            if not tag:
                continue
            closing = m[1] is not None
            if not closing and tag in RAW:  # their content is no markup
                stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag != "br" and tag not in BLOCKS and tag not in NO_TEXT:
                continue
            self.end_block()
            if tag in VOID:
                continue
            if closing:
                if self.open[tag]:
                    while self.stack[-1][0] != tag:
                        self.close()
                    self.close()
                continue
            last = self.stack[-1][0]
            if tag in BLOCKS and last == "p" and tag != "p" or tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and last == tag:
                self.close()
            self.start(tag, m[3])


TOKENS = "host string, token long, element boolean, main boolean, pages long, total long, f1 long, f2 long, chars long, depth long, holds long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 7]
    names = [f.split()[0] for f in TOKENS.split(", ")]
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for number, url, name, source in zip(*(batch.column(i).to_pylist() for i in range(4))):
            h = xxhash.xxh64_intdigest(f"{number}\n{url}")
            a, b = h & 0x3FFFFFFF, h >> 33
            page = Page(source)
            counts = {(ROOT, True, False): [1, page.chars, 0, 1]}
            for e in page.elements:
                row = counts.setdefault((e.token, True, e.main), [0, 0, e.depth, 0])
                row[0] += 1
                row[1] += e.chars
                row[3] |= e.holds
            for block in page.blocks:
                counts.setdefault((text_token(block.element, block.text), False, False), [0, 0, 0, 0])[0] += 1
            for (token, element, main), (n, chars, depth, holds) in counts.items():
                row = found.setdefault((name, token, element, main), [0] * 7)
                for i, v in enumerate((1, n, n * a, n * b, chars)):
                    row[i] += v
                row[5] = max(row[5], depth)
                row[6] += holds
        rows = [(*k, *v) for k, v in found.items()]
        cols = zip(*rows) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, _tm_host (in lower case, empty if the url names none) and html."""
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1))
    return pages.select("page_id", "url", name.alias("_tm_host"), "html")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(host, n, has_main, elements, constants, texts): the tokens of each host's valid classes.

    ``elements`` has element paths with their class (a fingerprint) and what
    tells the main slot, ``constants`` text blocks with their class, ``texts``
    the text blocks alone; ``n`` counts pages. A token on the required share of
    a host's pages is as long a list as a page at most, so a host's template is
    bounded by its pages' size.
    """
    counts = with_host(pages).mapInArrow(_tokens, TOKENS).groupBy("host", "token", "element", "main")
    counts = materialize(counts.agg(*(F.sum(c).alias(c) for c in ("pages", "total", "f1", "f2", "chars", "holds")), F.max("depth").alias("depth")))
    whole = counts.where((F.col("token") == ROOT) & F.col("element")).select("host", F.col("pages").alias("n"))
    held = counts.join(whole, "host").where((F.col("pages") >= min_pages) & (F.col("pages") * 100 >= F.col("n") * min_percent))
    cls = F.xxhash64("pages", "total", "f1", "f2").alias("cls")
    found = held.groupBy("host").agg(
        F.max("n").alias("n"),
        F.bool_or(F.col("main") & F.col("element")).alias("has_main"),
        F.collect_list(F.when(F.col("element"), F.struct("token", cls, "pages", "total", "chars", "depth", "main", "holds"))).alias("elements"),
        F.collect_list(F.when(~F.col("element"), F.struct("token", cls))).alias("constants"),
    )
    return found.withColumn("texts", F.col("constants.token"))


def main_slot(elements: list) -> tuple[int | None, bool]:
    """(token, article or main) of the main slot among a template's element rows, None if there is none.

    Of the elements that stand once on every page that has them, those with
    more than SLOT_PERCENT of the text lie inside one another. If some are
    article or main, the outermost of these is the slot, otherwise the
    innermost that holds elements on most pages.
    """
    whole = next((e["chars"] for e in elements if e["token"] == ROOT), 0)
    chain = sorted((e for e in elements if e["total"] == e["pages"] and e["chars"] * 100 > whole * SLOT_PERCENT), key=lambda e: e["depth"])
    for e in chain:
        if e["main"]:
            return e["token"], True
    holders = [e["token"] for e in chain if e["holds"] * 2 >= e["pages"]]
    return (holders[-1], False) if holders else (None, False)


class Template:
    """A host's nested classes: for every element path of the template its class, its text blocks, with their classes where given, and its main slot."""

    def __init__(self, has_main: bool, elements: dict[int, int], texts: frozenset[int], constants: dict[int, int] | None = None, content: int | None = None, main: bool = False):
        self.has_main, self.classes, self.texts, self.constants, self.content, self.main = has_main, elements, texts, constants or {}, content, main

    @classmethod
    def of(cls, row) -> Template:
        """From a row of ``templates``."""
        constants = {e["token"]: e["cls"] for e in row["constants"]}
        return cls(bool(row["has_main"]), {e["token"]: e["cls"] for e in row["elements"]}, frozenset(constants), constants, *main_slot(row["elements"]))

    def fixed(self, element: int, text: int) -> bool:
        """Whether a text block of the template has the class of its element: it stands wherever the element does."""
        own = self.constants.get(text)
        return own is not None and own == self.classes.get(element)

    def slot(self, path: str) -> str:
        """The innermost template path that holds ``path``: the slot that a block fills."""
        while path and token_of(path, None) not in self.classes:
            path = path.rpartition("/")[0]
        return path

    def nested(self, paths: list[str]) -> dict[int, int | None]:
        """class -> the class that it is nested in, for the template paths among ``paths``."""
        out: dict[int, int | None] = {}
        for p in sorted(paths, key=lambda p: p.count("/")):
            own = self.classes.get(token_of(p, None))
            if own is not None and own not in out:
                outer = self.slot(p.rpartition("/")[0])
                out[own] = self.classes.get(token_of(outer, None)) if outer else None
        return out


EMPTY = Template(False, {}, frozenset())
#: A main slot that is the whole page tells nothing of what lies in it.
WHOLE = {token_of("/html", None), token_of("/html/body", None)}


def main_text(source: str | None, template: Template = EMPTY) -> str:
    """The blocks in the main slot, joined by one space.

    Where the page has the template's main slot, only blocks inside it count
    (and a first heading beside it, if the slot is no article or main);
    otherwise, on a page with article or main elements, only blocks inside
    these. A block does not count if its path has an element without main text
    (below the slot, if there is one). Text blocks of the template fill no slot
    and are left out; inside article or main only those that have their
    element's class, as an element that also holds other text is a slot there.
    So it is with headings inside a main slot below the body: those that all
    recipes of a host share are part of each recipe.
    Where all blocks are text of the template, the page is a copy of other
    pages of its host, which tell no slots, and keeps them.
    """
    page = Page(source, template.content)
    found = [b for b in page.blocks if not b.off]
    main = any(b.inside for b in found)
    if template.content is not None and any(b.slot for b in found):
        main = template.main
        found = [b for b in found if b.slot or b.heading and not main]
    else:
        found = [b for b in found if b.inside or not main]
    inner = template.content is not None and template.content not in WHOLE
    told = [(b.element, text_token(b.element, b.text), b.text, main or inner and b.slot and b.title) for b in found]
    if all(t in template.texts for _, t, _, _ in told):
        return " ".join(text for _, _, text, _ in told)
    return " ".join(text for e, t, text, firm in told if not (template.fixed(e, t) if firm else t in template.texts))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text and n_chars per row of ``pages`` (page_id, url, html).

    A null html counts as empty and gives an empty text; pages without a host
    share one template. Repeated rows give repeated results; other columns are
    ignored.
    """
    keyed = with_host(pages)
    found = materialize(templates(pages, min_pages, min_percent).drop("texts"))
    size = found.agg(F.sum(F.size("elements") + F.size("constants"))).first()[0] or 0
    kind = keyed.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"

    def answer(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= broadcast_tokens:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: Template.of(r) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield answer(batch, [main_text(source, shared.value.get(name, EMPTY)) for name, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])

        return keyed.mapInArrow(run, out)

    # a template is a row that goes before its host's pages; hosts of many pages are dealt out with copies of it.
    # The broadcast side has at most a row for every HOT_PAGES pages.
    hot = F.broadcast(found.where(F.col("n") > HOT_PAGES).select(F.col("host").alias("_tm_host"), F.ceil(F.col("n") / HOT_PAGES).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = keyed.join(hot, "_tm_host", "left").select("page_id", "url", "_tm_host", "html", F.pmod(F.xxhash64("page_id", "url", "html"), parts).cast("int").alias("part"), F.lit(1).alias("order"))
    known = found.withColumnRenamed("host", "_tm_host").join(hot, "_tm_host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    known = known.select("_tm_host", "part", F.lit(0).alias("order"), F.struct("has_main", "elements", "constants").alias("template"))
    mixed = rows.unionByName(known, allowMissingColumns=True).repartition("_tm_host", "part").sortWithinPartitions("_tm_host", "part", "order")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, template = None, EMPTY
        for batch in batches:
            texts, kept = [], []
            for i, (own, source, order) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if not order:
                    name, template = own, Template.of(batch.column(5)[i].as_py())
                    continue
                kept.append(i)
                texts.append(main_text(source, template if own == name else EMPTY))
            yield answer(batch.take(pa.array(kept, pa.int64())), texts)

    return mixed.select("page_id", "url", "_tm_host", "html", "order", "template").mapInArrow(follow, out)
