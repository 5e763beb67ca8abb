"""Main text of web pages by template deduction from the pages of one host.

Pages are cut into tokens: opening block tags, each standing for its path of open elements, and
text blocks, each standing for its path and its words. (Blocks are dropped or kept whole, so the
words inside one need not be told apart.) Per host, every token's occurrence vector (how often it
occurs on which page) is reduced to sums of hashes that add up over any split of the pages, so no
task ever holds a host. Frequent tokens with equal vectors form an equivalence class; it is valid
if it is large enough and has a tag of its own. Valid classes nest into a template by their paths.
Its slots are the elements that every page with them has once. The main slot is found from the
root down: a slot is left for the one inside it that holds most of its words outside the
template; ``article`` and ``main`` need a smaller share of them, but do not decide alone. A page's
text is what lies in its host's main slot, without the template's blocks and without elements
whose kind or name says that they are no part of an article (an advert with new words on every
page cannot be told by repetition).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import map_arrow, materialised, slices

#: A class counts from this many pages of different text and this share of its host's.
MIN_PAGES, MIN_SHARE = 3, 0.5
#: Tags and words in a valid class, at least.
MIN_CLASS = 3
#: A slot is left for one inside it with this share of its free words, and for an article or main element with the second.
INNER_SHARE, HINTED_SHARE = 2 / 3, 1 / 4
#: Blocks in a path.
DEPTH = 128

#: Fixed values of HTML: elements without an end, with raw text, and those that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new block of the same kind ends.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "caption"}
#: Elements and names of classes, ids and roles that are not part of an article.
OUTSIDE = set("nav header footer aside form menu button select textarea input script style noscript template iframe svg math object embed canvas audio video dialog head title".split())
OUTSIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "pager pagination footer header masthead toolbar comment comments commentlist disqus respond reply replies discussion "
    "related recommended share sharing social widget skip complementary contentinfo search".split()
)
INSIDE = ("article", "main")
#: Elements that can be slots.
SLOTS = {"html", "body", "article", "main", "section", "div", "td", "center", "blockquote"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAMES = re.compile(r"[^\s_\-\"'/.:]+")
_DIGIT = re.compile(r"\d")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _labels(attributes: str) -> tuple[str, ...]:
    """Class, id and role values of a tag, cut into names."""
    if "=" not in attributes:
        return ()
    return tuple(n.lower() for _, value in _ATTRIBUTE.findall(attributes) for n in _NAMES.findall(_CAMEL.sub(" ", value)))


def events(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """("text", text, ()), ("open", name, labels) and ("close", name, ()) in page order.

    Comments, declarations and raw text are dropped. What is cut off at the end of a page stays
    markup if it began as such.
    """
    at, end = 0, len(page)
    while at < end:
        hit = _TOKEN.search(page, at)
        if hit is None:
            yield "text", page[at:], ()
            return
        if hit.start() > at:
            yield "text", page[at : hit.start()], ()
        at = hit.end()
        if hit.group(2) is None:
            continue
        name = hit.group(2).lower()
        if hit.group(1):
            yield "close", name, ()
            continue
        yield "open", name, _labels(hit.group(3))
        if name in RAW and not hit.group(3).rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}[\s/>]|</{re.escape(name)}\Z", re.I).search(page, at)
            at = close.start() if close else end
        elif hit.group(3).rstrip().endswith("/") and name not in BLOCK:
            yield "close", name, ()


class Walk:
    """Open elements while the events of a page go by.

    Each step costs the same however deep the page is nested. Elements below ``DEPTH`` blocks
    share the path of the block at that depth; their text stays theirs.
    """

    def __init__(self):
        self.names: list[str] = []
        self.count: Counter = Counter()
        self.paths: list[str] = [""]
        self.blocks: list[int] = [0]

    def close(self, name: str) -> None:
        if self.count[name]:
            while True:
                last = self.names.pop()
                self.count[last] -= 1
                self.paths.pop()
                self.blocks.pop()
                if last == name:
                    return

    def open(self, name: str, labels: tuple[str, ...]) -> None:
        if name in ENDS_P and self.count["p"]:
            self.close("p")
        if name in IMPLIED and self.names and self.names[-1] in IMPLIED[name]:
            self.close(self.names[-1])
        if name not in VOID:
            path, blocks = self.paths[-1], self.blocks[-1]
            if name in BLOCK and blocks < DEPTH:
                own = ".".join((name, *(label for label in labels if not _DIGIT.search(label))))  # numbers are a page's own
                path, blocks = f"{path}/{own}" if path else own, blocks + 1
            self.names.append(name)
            self.count[name] += 1
            self.paths.append(path)
            self.blocks.append(blocks)

    def path(self) -> str:
        return self.paths[-1]


def is_outside(name: str, labels: tuple[str, ...]) -> bool:
    return name in OUTSIDE or (name not in ("html", "body", *INSIDE) and not OUTSIDE_NAMES.isdisjoint(labels))


def read(page: str) -> tuple[Counter, list[tuple[str, str]]]:
    """How often each path opens, and the text blocks as (path, text) in page order.

    Elements that are no part of an article have neither; a block's white space is single.
    """
    walk, tags, blocks = Walk(), Counter(), []
    run: list[str] = []
    place = ""  # path of the run's text
    skip = 0  # number of open elements when something outside the article began

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append((place, text))

    for kind, value, labels in events(page):
        if kind == "text":
            if not skip:
                if not run:
                    place = walk.path()
                run.append(html.unescape(value))
            continue
        if not skip:
            if value in BLOCK:
                flush()
            elif value == "br":
                run.append(" ")
        before = walk.path()
        if kind == "open":
            walk.open(value, labels)
        else:
            walk.close(value)
        if walk.path() != before and not skip:
            flush()
        if skip and len(walk.names) < skip:
            skip = 0
            if value in BLOCK:
                flush()
        if kind == "open" and value not in VOID and not skip:
            if is_outside(value, labels):
                skip = len(walk.names)
            elif value in BLOCK:
                tags[walk.path()] += 1
    flush()
    return tags, blocks


def parent(path: str) -> str | None:
    return None if not path else path.rpartition("/")[0]


def leaf(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def inside(path: str, slot: str) -> bool:
    return not slot or path == slot or path.startswith(slot + "/")


def block_hash(text: str) -> int:
    """Hash of a block's words; zero stands for tags."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h - (1 << 64) if h >> 63 else h) or 1


def weights(tags: Iterator[str], blocks: Iterator[tuple[str, int]]) -> dict[str, list[int]]:
    """Words, and words in first headings, inside every path; the page itself is the empty path."""
    sums = {path: [0, 0] for path in tags}
    sums[""] = [0, 0]
    for path, words in blocks:
        up = path
        heads = words if leaf(path) == "h1" else 0
        while up is not None and up not in sums:
            up = parent(up)
        sums[up or ""][0] += words
        sums[up or ""][1] += heads
    for path in sorted(sums, key=lambda p: -p.count("/") if p else 1):
        up = parent(path)
        while up is not None and up not in sums:
            up = parent(up)
        if up is not None:
            sums[up][0] += sums[path][0]
            sums[up][1] += sums[path][1]
    return sums


def main_slot(slots: dict[str, tuple[int, int]], here: str = "", only_hinted: bool = False) -> str:
    """The path of the main slot in ``here``; ``slots`` holds words and first-heading words of each.

    An article is never left, and neither is a slot with a first heading that the inner one lacks.
    """
    while leaf(here) != "article":
        inner = [p for p in slots if p and p != here and inside(p, here) and leaf(p) in SLOTS and slots[p][0]]
        hinted = [p for p in inner if leaf(p) in INSIDE and slots[p][0] >= slots[here][0] * HINTED_SHARE]
        best = max(hinted or (() if only_hinted else inner), key=lambda p: (slots[p][0], -p.count("/"), p), default=None)
        if best is None:
            break
        if not hinted and leaf(best) not in ("html", "body") and (slots[best][0] < slots[here][0] * INNER_SHARE or slots[best][1] < slots[here][1]):
            break
        here = best
    return here


def page_tokens(pages: DataFrame) -> DataFrame:
    """Columns host, page (hash of the page's text) and tokens, one row per host and text.

    Pages of one text, copies among them, are one page: they tell nothing about the template.
    Tokens are (path, text, times, words, heads); ``text`` is 0 for tags and the block's hash
    otherwise, words and heads are those inside a tag's element or in all the block's copies.
    """
    fields = {"path": pa.string(), "text": pa.int64(), "times": pa.int64(), "words": pa.int64(), "heads": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            columns: dict[str, list] = {name: [] for name in fields}
            prints, offsets = [], [0]
            for value in batch.column("html"):
                tags, blocks = read(value.as_py())
                whole = xxhash.xxh64()
                texts: dict[tuple[str, int], list[int]] = {}
                for path, text in blocks:
                    whole.update(f"{text}\n".encode("utf-8", "surrogatepass"))
                    n = text.count(" ") + 1
                    row = texts.setdefault((path, block_hash(text)), [0, 0])
                    row[0] += 1
                    row[1] += n
                sums = weights(iter(tags), ((path, n) for (path, _), (_, n) in texts.items()))
                rows = [(path, 0, tags[path] if path else 1, *sums[path]) for path in sums]
                rows += [(path, h, times, n, n if leaf(path) == "h1" else 0) for (path, h), (times, n) in texts.items()]
                for name, part in zip(columns, zip(*sorted(rows))):
                    columns[name].extend(part)
                offsets.append(offsets[-1] + len(rows))
                h = whole.intdigest()
                prints.append(h - (1 << 64) if h >> 63 else h)
            structs = pa.StructArray.from_arrays([pa.array(columns[name], kind) for name, kind in fields.items()], names=list(fields))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(prints, pa.int64()), tokens], names=["host", "page", "tokens"])

    schema = "host string, page long, tokens array<struct<path: string, text: long, times: long, words: long, heads: long>>"
    return map_arrow(pages.select("host", "html"), run, schema).groupBy("host", "page").agg(F.min("tokens").alias("tokens"))


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null and malformed addresses share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """Tokens of valid classes: host, path, text, pages, times, words, heads.

    ``tokens`` has one row per host, page and token. Every host keeps its root (the empty path).
    """
    vector = F.xxhash64("page", "times")
    counted = materialised(
        tokens.groupBy("host", "path", "text").agg(
            F.count(F.lit(1)).alias("pages"), F.sum("times").alias("times"), F.sum("words").alias("words"), F.sum("heads").alias("heads"),
            F.sum(vector.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))).alias("low"), F.sum(F.shiftrightunsigned(vector, 33)).alias("high"),
        ).where(f"pages >= {MIN_PAGES}"),
        "page-tokens",
    )
    hosts = counted.where("path = '' AND text = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = counted.join(hosts, "host").where(F.col("pages") >= F.col("host_pages") * MIN_SHARE)
    key = ["host", "pages", "times", "low", "high"]
    valid = frequent.groupBy(*key).agg(
        F.sum(F.when(F.col("text") == 0, F.col("times")).otherwise(F.col("words")) / F.col("times")).alias("size"),
        F.bool_or(F.col("text") == 0).alias("has_tag"),
    ).where(f"has_tag AND size >= {MIN_CLASS}")
    members = frequent.join(valid, key, "left").where("size IS NOT NULL OR (path = '' AND text = 0)")
    return members.select("host", "path", "text", "pages", "times", "words", "heads")


def nested(tokens: list[tuple]) -> tuple[str, list[int]]:
    """Main slot of a host, and the hashes of its template's blocks with their paths.

    ``tokens`` are (path, text, pages, times, words, heads). A tag nests if the element around
    it does, a block if its own or the next element does; the words of the template's own blocks do not count for the slots around them.
    """
    tags = {path: (pages == times, words, heads) for path, text, pages, times, words, heads in tokens if text == 0}
    tree: set[str] = set()
    for path in sorted(tags, key=lambda p: p.count("/") if p else -1):
        if parent(path) is None or parent(path) in tree:
            tree.add(path)
    own = [t for t in tokens if t[1] and (t[0] in tree or parent(t[0]) in tree)]
    fixed = weights(iter(tree), ((path, words) for path, _, _, _, words, _ in own))
    slots = {p: (tags[p][1] - fixed[p][0], tags[p][2] - fixed[p][1]) for p in tree if tags[p][0]}
    return main_slot(slots), sorted(in_place(path, text) for path, text, *_ in own)


def in_place(path: str, text: int) -> int:
    return block_hash(f"{path}\n{text}")


def template(pages: DataFrame) -> DataFrame:
    """Per host with enough pages: main (path of the main slot) and blocks (hashes, sorted).

    Columns of ``pages``: host and html. A host's frequent tokens come together in one row; each
    lies on half the pages or more, so they are at most twice those of an average page.
    """
    members = equivalence_classes(page_tokens(pages).select("host", "page", F.inline("tokens")))
    listed = members.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "text", "pages", "times", "words", "heads"))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nested([tuple(t.values()) for t in tokens.as_py()]) for tokens in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([m for m, _ in found], pa.string()), pa.array([b for _, b in found], pa.list_(pa.int64()))],
                names=["host", "main", "blocks"],
            )

    return materialised(map_arrow(listed, run, "host string, main string, blocks array<long>"), "templates")


def article_text(page: str, main: str | None, blocks: frozenset[int]) -> str:
    """Blocks in the main slot that are not the template's, joined by line feeds.

    Pages without a template or without its main slot are searched for a main slot of their own;
    an article whose place differs from page to page is looked for in the host's main slot. A slot
    that holds nothing but the template's blocks keeps them.
    """
    tags, found = read(page)
    known = main is not None and (not main or main in tags)
    if not known or leaf(main) != "article":
        sums = weights(iter(tags), ((path, text.count(" ") + 1) for path, text in found))
        own_slots = {path: tuple(total) for path, total in sums.items() if not path or path == main or tags[path] == 1}
        main = main_slot(own_slots, main if known else "", only_hinted=known)
    slot = [(path, text) for path, text in found if inside(path, main)]
    own = [text for path, text in slot if not blocks or in_place(path, block_hash(text)) not in blocks]
    return "\n".join(own or [text for _, text in slot])


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, url and text of every page.

    Null pages count as empty and have empty text; null or malformed addresses form a host of
    their own. Pages of hosts with fewer than ``MIN_PAGES`` different pages have no template and
    are read by their own elements. Repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    rows = pages.select(id_column, "url", host_of(F.col("url")).alias("_host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = template(rows.select(F.col("_host").alias("host"), "html"))
    schema = T.StructType([pages.schema[id_column], pages.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for batch in slices(batches, "html", 1 << 20):
            text = []
            for i, (host, main) in enumerate(zip(batch.column("_host").to_pylist(), batch.column("main").to_pylist())):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(batch.column("blocks")[i].as_py() or ())
                text.append(article_text(batch.column("html")[i].as_py(), main, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("url"), pa.array(text, pa.string())], names=[f.name for f in schema])

    joined = rows.join(templates, F.col("_host") == F.col("host"), "left")
    return map_arrow(joined.select(id_column, "url", "_host", "main", "blocks", "html"), run, schema)
