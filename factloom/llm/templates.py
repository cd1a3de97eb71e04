"""Main text of pages by deducing each host's template from equivalence classes of tokens.

A token is an element with the path it stands in. Its occurrence vector says how often it occurs in each page of the host; the vectors are
never gathered: a page adds one hash of itself and the count to the token's signature. Pages of one host with equal html count once. Tokens
of one host with equal signatures form a class. A class is valid if it has at least ``least_tokens`` tokens and stands in at least ``least_pages`` pages
and a share ``least_share`` of the host's, equally often in each. The valid classes are the template as far as they nest: a token belongs to it if the token
around it does, up to the root. A slot is the text of a template token outside of the template tokens within it, so elements that come and go or repeat
unevenly are text of the slot they stand in.

A slot whose text is the same in nearly all pages of the host (a share ``nearly``) is template text and dropped, inside an article as well. Only on a
host on which no slot varies it cannot be told from the text, and where such slots hold more text than all others it takes ``SURE`` times ``least_pages`` pages:
fewer may be variants of one page. Elements count for the template whatever their names, but what lies in an element that is named as menu, header, footer, sidebar,
notice, advert, form or comments is neither compared nor kept, unless the element is around the article or around most of the page. Of a page with an article (or main)
element what lies outside is dropped, and an article is kept even if it is the same on all pages. In other pages slots that are mostly links are dropped, and so are elements
outside of the template that are mostly links in the page itself. All other slots are the text; it may be empty. A page without a template of its host, because the host has
too few pages, is judged by its own elements in the same way.

A host's template holds at most (elements of a page / ``least_share``) tokens, however many pages the host has. A page is read twice, where it lies;
between the two its tokens are shuffled as numbers, once for pages of equal html, and the templates are joined to both by host.

Cases: a null or empty html gives an empty text; a null url or one without a host belongs to the host ''; unclosed, crossing or cut-off
elements end where their parents do; rows with one page_id stay apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.html import Block, Page, parse
from factloom.operators.stages import written

LEAST_PAGES = 3
LEAST_SHARE = 0.3
LEAST_TOKENS = 2
NEARLY = 0.9
#: So many times ``least_pages`` pages tell template text even where it is more than all other text.
SURE = 2
ROOT = 0

TOKEN = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("times", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64()), ("text_hash", pa.int64())])
Path = tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Ids of the template's tokens, of the slots with template text and of the slots with links."""

    tokens: frozenset[int] = frozenset()
    constant: frozenset[int] = frozenset()
    links: frozenset[int] = frozenset()


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


@lru_cache(1 << 16)
def path_id(path: Path) -> int:
    data = "\x1f".join(path).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True) if path else ROOT


def hash_text(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 | zlib.adler32(data) >> 1


def _container(block: Block) -> Path:
    """The element that holds a block's paragraph or heading."""
    path = block.path
    while len(path) > 1 and path[-1].split(".")[0].split("#")[0] in ("p", "b", "i", "em", "strong", "span", "a", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "th", "tr", "tbody", "thead", "table", "dd", "dt", "dl", "u", "font", "code", "small"):
        path = path[:-1]
    return path


def _around(path: Path, known) -> Path:
    """The longest part of a path, from the root on, that ``known`` holds; the root if none."""
    while path and path not in known:
        path = path[:-1]
    return path


def page_tokens(page: Page) -> list[tuple[int, int, int, int, int, int]]:
    """(path, parent, times, chars, linked, text_hash) of each token and of the root, with the text that no token within it holds."""
    held = defaultdict(lambda: [0, 0, 0])
    for block in page.blocks:
        if not block.left_out:
            got = held[_around(block.path, page.opened)]
            got[0], got[1], got[2] = got[0] + len(block.text), got[1] + block.linked, (got[2] + hash_text(block.text)) & (1 << 63) - 1
    rows = [(path_id(path), path_id(_around(path[:-1], page.opened)), times, *held.get(path, (0, 0, 0))) for path, times in page.opened.items()]
    return [*rows, (ROOT, ROOT, 0, *held[()])] if () in held else rows


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(TOKEN.names, t, strict=True)) for t in page_tokens(parse(source.as_py() or ""))] for source in batch.column("html")]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "page": batch.column("page"), "tokens": pa.array(found, pa.list_(TOKEN))})


def nested(tokens: list[tuple[int, int]]) -> set[int]:
    """The tokens, of (path, parent), that hang together from the root on."""
    within = defaultdict(list)
    for path, parent in tokens:
        within[parent].append(path)
    kept, todo = set(), [ROOT]
    while todo:
        found = [p for p in within.pop(todo.pop(), ()) if p != ROOT]
        kept.update(found)
        todo += found
    return kept


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(nested([(t["path"], t["parent"]) for t in row])) for row in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "pages": batch.column("pages"), "template": pa.array(found, pa.list_(pa.int64()))})


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, chars, linked, text_hash) of each slot of a page that has text."""
    for batch in batches:
        rows = []
        for host, tokens, template in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), batch.column("template").to_pylist(), strict=True):
            known, parents, held = {ROOT, *template}, {t["path"]: t["parent"] for t in tokens}, defaultdict(lambda: [0, 0, 0])
            for t in tokens:
                if t["chars"]:
                    slot = t["path"]
                    while slot not in known:
                        slot = parents[slot]
                    got = held[slot]
                    got[0], got[1], got[2] = got[0] + t["chars"], got[1] + t["linked"], (got[2] + t["text_hash"]) & (1 << 63) - 1
            rows += [(host, slot, *got) for slot, got in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4), strict=True)], ["host", "slot", "chars", "linked", "text_hash"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS, nearly: float = NEARLY) -> DataFrame:
    """(host, template, constant, links): the nested tokens of the host's valid classes, and its slots with template text and with links."""
    read = pages.select(host_of().alias("host"), F.xxhash64("html").alias("page"), "html")
    contents = read.mapInArrow(_contents, "host string, page long, tokens array<struct<path: long, parent: long, times: int, chars: long, linked: long, text_hash: long>>").where(F.size("tokens") > 0)
    contents = written(contents.dropDuplicates(["host", "page"]))
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    signature = F.sum(F.xxhash64("page", "times").bitwiseAND(F.lit((1 << 31) - 1))).alias("signature")  # no overflow below 2 ** 32 pages
    counted = contents.select("host", "page", F.inline("tokens")).where("times > 0").groupBy("host", "path").agg(
        F.min("parent").alias("parent"), signature, F.count(F.lit(1)).alias("support"), F.min("times").alias("least"), F.max("times").alias("most"))
    frequent = counted.join(sizes, "host").where((F.col("support") >= least_pages) & (F.col("support") >= F.col("pages") * least_share))
    classes = frequent.groupBy("host", "pages", "signature", "support").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(F.struct("path", "parent")).alias("tokens"))
    valid = classes.where((F.col("least") == F.col("most")) & (F.size("tokens") >= least_tokens))
    template = written(valid.groupBy("host", "pages").agg(F.flatten(F.collect_list("tokens")).alias("tokens")).mapInArrow(_nested, "host string, pages long, template array<long>"))
    held = contents.join(template, "host").select("host", "tokens", "template").mapInArrow(_slots, "host string, slot long, chars long, linked long, text_hash long")
    texts = held.groupBy("host", "slot", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    slots = texts.groupBy("host", "slot").agg(F.max("n").alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).join(template.select("host", "pages"), "host")
    judged = slots.select("host", "pages", "slot", "chars", (F.col("same") >= F.col("pages") * nearly).alias("constant"), (F.col("linked") * 2 > F.col("chars")).alias("links"))
    more = F.sum(F.when(F.col("constant"), F.col("chars")).otherwise(-F.col("chars"))) > 0
    told = F.bool_or(~F.col("constant")) & (~more | (F.max("pages") >= SURE * least_pages))
    named = judged.groupBy("host").agg(
        F.when(told, F.collect_list(F.when(F.col("constant"), F.col("slot")))).alias("constant"), F.collect_list(F.when(F.col("links"), F.col("slot"))).alias("links"))
    return template.join(named, "host", "left").select("host", "template", "constant", "links")


def _unlinked(blocks: list[Block], slots: list[int], template: Template) -> list[Block]:
    """The blocks outside of slots with links and of elements outside of the template that are mostly links in this page."""
    own = defaultdict(lambda: [0, 0])
    for block in blocks:
        got = own[_container(block)]
        got[0], got[1] = got[0] + len(block.text), got[1] + block.linked
    links = {path for path, (chars, linked) in own.items() if linked * 2 > chars and path_id(path) not in template.tokens}
    return [b for b, slot in zip(blocks, slots, strict=True) if slot not in template.links and _container(b) not in links]


def main_text(page: Page, template: Template) -> str:
    """The main text: the blocks of the slots that are neither template text nor, outside of an article, links."""
    known = {path[:k] for path in {b.path for b in page.blocks} for k in range(1, len(path) + 1) if path_id(path[:k]) in template.tokens} if template.tokens else set()
    slots = [path_id(_around(b.path, known)) for b in page.blocks]
    named = [(b, slot) for b, slot in zip(page.blocks, slots, strict=True) if not b.left_out]
    own = [(b, slot) for b, slot in named if slot not in template.constant]
    article = [(b, slot) for b, slot in own if b.in_main] or [(b, slot) for b, slot in named if b.in_main]
    found = [b for b, _ in article] or _unlinked([b for b, _ in own], [slot for _, slot in own], template)
    return "\n\n".join(b.text for b in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        parts = [batch.column(n) for n in ("template", "constant", "links")]
        texts = []
        for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
            if host not in known:
                if len(known) > 200:
                    known.clear()
                known[host] = Template(*[frozenset(p[i].as_py() or ()) for p in parts])
            texts.append(main_text(parse(source.as_py() or ""), known[host]))
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    found = written(templates(pages, least_pages, least_share))
    rows = pages.select("page_id", "url", host_of().alias("host"), "html").join(found, "host", "left")
    return rows.select("page_id", "url", "host", "html", "template", "constant", "links").mapInArrow(_extract, pages.select("page_id", F.col("url").cast("string"), F.lit("").alias("text")).schema).withColumn("n_chars", F.char_length("text").cast("long"))
