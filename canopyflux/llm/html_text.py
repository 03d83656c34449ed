"""Main text of web pages, by repeats over whole hosts and page structure.

Each page is cut into blocks (runs of text between block-level tags) with their element paths, and its token stream is
the words of all its blocks, each block headed by its path. Substrings of at least :data:`WINDOW` tokens that occur on
:data:`PAGES` or more distinct pages of a host cover the tokens they hold; a longer repeat is a union of repeated windows.

Whatever a host's size, its repeats are counted over all of its pages: tasks count the distinct pages of each window by
its hash (host, tokens), and the partial counts are added up. A second pass looks the windows of each page up and decides.
:func:`main_texts` does the same in memory, by a suffix array.

A block is boilerplate if it is covered and stands on more pages than the page's own text does; so the copies of an
article stay text, with all that is in them. Blocks on a path that carries the bulk of a page's text are never
boilerplate, nor are paragraphs, headings, lists, quotations and tables in what a page marks as its article: a passage
that articles share is text. What remains is held against the page's structure:
menus, footers, sidebars, notices, adverts, forms, comments and the like go, be they blocks or part of a line, and where a
page marks an article, so does all that stands outside of it.

Defined results: a null or empty page has empty text; broken markup is read as far as it goes (an open comment ends the
page, a ``<`` that starts no tag, or a tag that the next ``<`` cuts off, is text); a null url or one without a host belongs to the host ""; rows that repeat a page or its id
are pages of their own; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import core, cut, slices
from .url_parts import host_of

WINDOW = 8
PAGES = 3
#: Share of a block's tokens that must be covered before it can be boilerplate.
COVERED = 0.8
#: A path with at least this share of a page's tokens is the page's text. The number of pages that this share of its tokens stands on, at
#: most, is that of the page's own text.
BULK = 0.3
#: Bytes of pages that a task handles together where repeats go by shuffles.
SHARD_BYTES = 1_000_000
#: Bytes of pages whose windows are counted together.
BUCKET_BYTES = 16_000_000
#: Most repeated windows that are broadcast; beyond it each shard is given its own by shuffles.
BROADCAST_WINDOWS = 1_000_000
#: Windows that a task counts before it passes them on.
HELD_WINDOWS = 2_000_000
#: Bits of a window's hash.
HASH_BITS = 56

# Names of HTML elements, roles and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title xmp".split())
BLOCK = frozenset(
    "html head body title p div section article main header footer nav aside ul ol li dl dt dd table tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure "
    "figcaption form fieldset legend hr address details summary dialog menu center option select button label".split()
)
#: Elements that hold text by their meaning; others only group what is in them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th caption figure figcaption".split())
APART = frozenset("nav footer aside form head dialog menu select button label fieldset".split()) | RAW
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login sidebar rail widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended comment comments "
    "disqus commentlist reviews replies reply respond search copyright legal disclaimer".split()
)
#: A class with one of these words tells what an element goes without or stands beside, or that it holds all the rest.
NOT_APART = frozenset("has no not with without layout".split())
ARTICLE_WORDS = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content content-body".split())

# A tag whose quoted values hold no "<"; a scan that fails ends at the next "<", so that all scans together are linear.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)(>?)""", re.S)
_PLAIN, _ENDS = re.compile(r"""[^<>"']*"""), re.compile("[<>]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace() or raw == "/":
        return {}
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def _apart(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element holds something else than the article. inside: it stands in the article."""
    if tag in APART or (tag == "header" and not inside):
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")) or at.get("role", "").lower() in APART_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = re.split(r"[-_]+", _CAMEL.sub("-", name).lower())
        if NOT_APART.isdisjoint(parts) and (not APART_WORDS.isdisjoint(parts) or (parts[-1] == "header" and not inside)):
            return True
    return False


@dataclass(slots=True)
class Block:
    text: str
    path: str
    where: str  # the block-level element around it
    apart: bool
    article: bool


class _Tags:
    """Where tags end whose quoted values hold a ``<`` or aren't closed; what is known to lead to no end is remembered."""

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag from ``at`` on, outside of quotes; else of the next one before any ``<``; else -1."""
        page, been, i = self.page, [], at
        while i not in self.dead:
            been.append(i)
            i = _PLAIN.match(page, i).end()
            if i >= len(page) or page[i] == "<":
                break
            if page[i] == ">":
                return i
            close = page.find(page[i], i + 1)
            if close < 0:
                break
            i = close + 1
        self.dead.update(been)
        m = _ENDS.search(page, at)
        return m.start() if m and m[0] == ">" else -1


def blocks(page: str) -> list[Block]:
    """The page's runs of text in page order; white space within each is one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, str]] = []  # tag, apart, in a line and apart, article, path
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    tags = _Tags(page)
    apart = unseen = article = 0
    path = ""

    def flush() -> None:
        raw = "".join(parts)
        parts.clear()
        if text := " ".join((html.unescape(raw) if "&" in raw else raw).split()):
            out.append(Block(text, path, path.rpartition(">")[2].partition(".")[0], apart > unseen, article > 0))

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            if not unseen:
                parts.append(page[at:])
            break
        if m.start() > at and not unseen:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        values = m[3]
        if not m[4]:
            close = tags.end(m.end(2))
            if close < 0:  # no tag
                if not unseen:
                    parts.append(m[0])
                continue
            values, at = page[m.end(2) : close], close + 1
        tag = m[2].lower()
        if tag == "br" or tag not in BLOCK:
            if tag == "br" and not unseen:
                parts.append(" ")
            if tag in VOID:
                continue
        else:
            flush()
        if m[1]:
            while opened[tag]:
                name, a, u, b, _ = stack.pop()
                opened[name] -= 1
                apart, unseen, article = apart - a, unseen - u, article - b
                if name == tag:
                    break
            path = stack[-1][4] if stack else ""
            continue
        if tag in VOID or values.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = _closes(tag).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in BLOCK and not values:
            stack.append((tag, False, False, False, path))
            opened[tag] += 1
            continue
        found = _attributes(values)
        is_apart = _apart(tag, found, article > 0)
        is_article = not is_apart and not apart and (
            tag in ("article", "main") or found.get("role") == "main" or bool(ARTICLE_WORDS.intersection(f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".lower().split()))
        )
        if tag in ("p", "li") and stack and stack[-1][0] == tag:  # these close themselves
            stack.pop()
            opened[tag] -= 1
            path = stack[-1][4] if stack else ""
        in_line = is_apart and tag not in BLOCK
        apart, unseen, article = apart + is_apart, unseen + in_line, article + is_article
        if tag in BLOCK:  # a path is an element and the one around it, with their classes
            path = f"{path.rpartition('>')[2]}>{tag}" + "".join(f".{c}" for c in sorted(found.get("class", "").split()))
        stack.append((tag, is_apart, in_line, is_article, path))
        opened[tag] += 1
    flush()
    return out


@lru_cache(None)
def _closes(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def window_groups(tokens: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The place of each suffix among all, sorted by their first ``size`` tokens; suffixes that agree there share a place.

    Prefix doubling: the places by 1, 2, 4 ... tokens give those by twice as many.
    """
    place, width = tokens.astype(np.int64), 1
    while width < size:
        step = min(width, size - width)
        other = np.full(len(place), -1, np.int64)
        other[: len(place) - step] = place[step:]
        key = place * (len(place) + 2 + int(place.max(initial=0))) + other + 1
        place = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width += step
    return place


def repeats(tokens: np.ndarray, page: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """On how many distinct pages the window of ``size`` tokens that starts at each token occurs; 0 where none fits in the page.

    tokens: numbers; a negative one ends a page and is in no window. page: each token's page.
    """
    n = len(tokens) - size + 1
    out = np.zeros(len(tokens), np.int64)
    if n <= 0:
        return out
    ends = tokens < 0
    distinct = np.where(ends, tokens.max(initial=0) + 1 + np.cumsum(ends), tokens)
    place = window_groups(distinct, size)[:n]
    whole = page[:n] == page[size - 1 :]
    at = np.flatnonzero(whole & ~ends[:n] & ~ends[size - 1 :])
    order = at[np.lexsort((page[at], place[at]))]  # the suffix array: windows in order, equal ones by page
    if not len(order):
        return out
    p, q = place[order], page[order]
    first = np.r_[True, p[1:] != p[:-1]]
    group = np.cumsum(first) - 1
    fresh = first | np.r_[True, q[1:] != q[:-1]]
    out[order] = np.bincount(group, fresh)[group]
    return out


def spread(hit: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which tokens lie in a window that starts where ``hit`` is true."""
    edge = np.zeros(len(hit) + size + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge)[: len(hit)] > 0


def covered(tokens: np.ndarray, page: np.ndarray, size: int = WINDOW, pages: int = PAGES) -> np.ndarray:
    """Which tokens lie in a substring of ``size`` tokens or more that occurs on so many distinct pages or more."""
    return spread(repeats(tokens, page, size) >= pages, size)


_HASHES: dict[str, int] = {}


def _hash(x: str) -> int:
    """63 bits of a word, a path (headed by a zero character) or a host, the same in every process."""
    found = _HASHES.get(x)
    if found is None:
        if len(_HASHES) >= 400_000:
            _HASHES.clear()
        found = _HASHES[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
    return found


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pages:
    """Parsed pages and their token streams, one after the other."""

    def __init__(self, raw: list[str | None], hosts: list[str]) -> None:
        self.found, self.hosts = [blocks(x or "") for x in raw], hosts
        stream: list[int] = []
        lengths: list[int] = []  # of each block with its path token; each page ends with one more token
        owners: list[int] = []
        for own in self.found:
            before = len(stream)
            for b in own:
                words = b.text.split(" ")
                stream.append(_hash("\0" + b.path))
                stream += map(_hash, words)
                lengths.append(len(words) + 1)
            stream.append(-1)
            lengths.append(1)
            owners.append(len(stream) - before)
        self.tokens, self.lengths = np.array(stream, np.int64), lengths
        self.page = np.repeat(np.arange(len(owners)), owners)
        self.starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a window starts and the hash of its host and tokens."""
        n = len(self.tokens) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero((self.page[:n] == self.page[WINDOW - 1 :]) & (self.tokens[WINDOW - 1 :] >= 0))
        host = np.array([_hash("\1" + x) for x in self.hosts], np.uint64)
        out = host[self.page[at]]
        for k in range(WINDOW):
            out = out * _BASE + self.tokens[at + k].astype(np.uint64)
        return at, _mixed(out) >> np.uint64(64 - HASH_BITS)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of windows, in order, and the pages that hold each."""
        at, h = self.windows()
        page = self.page[at]
        order = np.argsort(h, kind="stable")  # pages stay in order among equal windows
        h, page = h[order], page[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (page[1:] != page[:-1])] if len(h) else np.zeros(0, bool)
        return _summed(h[fresh], np.ones(int(fresh.sum()), np.int64))

    def looked_up(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """As :func:`repeats` from counts by hash, which are in order; 0 for hashes that aren't there."""
        out = np.zeros(len(self.tokens), np.int64)
        at, h = self.windows()
        if len(hashes):
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out[at] = np.where(hashes[i] == h, counts[i], 0)
        return out

    def texts(self, seen: np.ndarray) -> list[str]:
        """The main text of each page. seen: on how many pages the window that starts at each token occurs."""
        pages = np.where(seen >= PAGES, seen, 1)  # on how many pages each token stands, with the windows around it
        wide = pages.copy()
        for k in range(1, WINDOW):
            wide[k:] = np.maximum(wide[k:], pages[:-k])
        lengths, hit = self.lengths, np.add.reduceat((wide >= PAGES).astype(np.int64), self.starts).tolist() if len(wide) else []
        out, i = [], 0
        for own in self.found:
            article = any(b.article for b in own)
            stay = [not b.apart and (b.article or not article) for b in own]
            if any(x and hit[i + k] >= COVERED * lengths[i + k] for k, x in enumerate(stay)):
                self._drop_boilerplate(own, stay, wide, hit, i)
            out.append("\n".join(b.text for b, x in zip(own, stay, strict=True) if x))
            i += len(own) + 1
        return out

    def _drop_boilerplate(self, own: list[Block], stay: list[bool], wide: np.ndarray, hit: list[int], i: int) -> None:
        """Takes from ``stay`` the blocks of a page, of which the first is block ``i``, that are boilerplate."""
        mass: dict[str, int] = defaultdict(int)
        tokens = []
        for k, b in enumerate(own):
            if stay[k]:
                mass[b.path] += self.lengths[i + k]
                tokens.append(wide[self.starts[i + k] : self.starts[i + k] + self.lengths[i + k]])
        counts = np.sort(np.concatenate(tokens))
        text = counts[int(BULK * (len(counts) - 1))]  # the page's own text stands on so many pages
        for k, b in enumerate(own):
            n = self.lengths[i + k]
            if not stay[k] or hit[i + k] < COVERED * n or mass[b.path] >= BULK * len(counts) or (b.article and b.where in TEXT):
                continue
            at = self.starts[i + k]
            stay[k] = bool(np.median(wide[at : at + n]) <= text)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts, of hashes in order."""
    if not len(hashes):
        return hashes, counts
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.add.reduceat(counts, first)


def _added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_summed`, of hashes in any order."""
    order = np.argsort(hashes, kind="stable")
    return _summed(hashes[order], counts[order])


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page of one host."""
    own = Pages(pages, [""] * len(pages))
    return own.texts(repeats(own.tokens, own.page))


_COUNTED = "bucket long, shard_ long, hashes binary, counts binary"


def _planes(x: np.ndarray, kind: str) -> bytes:
    """All first bytes, all second bytes and so on; those that are nothing but zeros shrink to nothing in a compressed shuffle."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes in order, by their differences, and counts."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)), "<u8"), _planes(counts, "<u4")


def _unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_numbers(hashes, "<u8"), dtype=np.uint64), _numbers(counts, "<u4").astype(np.int64)


def _dealt(hashes: np.ndarray, counts: np.ndarray, buckets: int, shard: int = -1) -> pa.RecordBatch:
    """Counts by hash, in order, as a row for each bucket that has some."""
    place = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, hashes, counts = place[order], hashes[order], counts[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    bounds = [*first.tolist(), len(place)]
    cols = [[], [], [], []]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for col, x in zip(cols, (int(place[a]), shard, *_packed(hashes[a:b], counts[a:b])), strict=True):
            col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard_", "hashes", "counts"])


def _joined(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all counts by hash, in order."""
    found = [_unpacked(h, n) for h, n in zip(hashes, counts, strict=True)]
    return _added(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES,
    most_windows: int = BROADCAST_WINDOWS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row for each row: id, url, text, n_chars. The sizes bound what a task holds; they change no result."""
    rows = core(pages, id_col, url_col, html_col).withColumn("host_", F.coalesce(host_of(F.col(url_col)), F.lit("")))
    size = rows.agg(F.sum(F.octet_length(html_col).cast("long"))).first()[0] or 0
    buckets, shards = size // bucket_bytes + 1, size // shard_bytes + 1
    schema = T.StructType([rows.schema[id_col], rows.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def parsed(part) -> Pages:
        return Pages(part.column(html_col).to_pylist(), part.column("host_").to_pylist())

    def answer(part, found: list[str]) -> pa.Table:
        own = pa.Table.from_batches([part]) if isinstance(part, pa.RecordBatch) else part
        return pa.table([own.column(id_col), own.column(url_col), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for part in slices(batches, 100):
            held.append(parsed(part).counted())
            n += len(held[-1][0])
            if n > HELD_WINDOWS:
                yield _dealt(*_added(*map(np.concatenate, zip(*held, strict=True))), buckets)
                held, n = [], 0
        if held:
            yield _dealt(*_added(*map(np.concatenate, zip(*held, strict=True))), buckets)

    def add(table: pa.Table) -> pa.Table:
        h, n = _joined(table.column("hashes").to_pylist(), table.column("counts").to_pylist())
        cells = (table.column("bucket")[0].as_py(), int((n >= PAGES).sum()), *_packed(h[n >= PAGES], n[n >= PAGES]))
        return pa.table([pa.array([x], t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "windows", "hashes", "counts"])

    common = cut(rows.mapInArrow(count, _COUNTED).groupBy("bucket").applyInArrow(add, "bucket long, windows long, hashes binary, counts binary"))

    if (common.agg(F.sum("windows")).first()[0] or 0) <= most_windows:
        found = common.select("hashes", "counts").collect()
        known = rows.sparkSession.sparkContext.broadcast(_joined([r["hashes"] for r in found], [r["counts"] for r in found]))

        def decide(batches) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 100):
                own = parsed(part)
                yield from answer(part, own.texts(own.looked_up(*known.value))).to_batches()

        return rows.mapInArrow(decide, schema)

    # Too much to broadcast: each shard of pages is given the repeated windows that it holds, and no others.
    sharded = rows.withColumn("shard_", F.pmod(F.xxhash64(id_col, url_col, F.octet_length(html_col)), F.lit(shards)))

    def list_windows(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_dealt(*parsed(table).counted(), buckets, table.column("shard_")[0].as_py())])

    def pick(own: pa.Table, all_: pa.Table) -> pa.Table:
        h, n = _joined(all_.column("hashes").to_pylist(), all_.column("counts").to_pylist())
        out = [[], [], [], []]
        for shard, *raw in zip(*(own.column(x).to_pylist() for x in ("shard_", "hashes", "counts")), strict=True):
            wanted, _ = _unpacked(*raw)
            i = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
            i = i[h[i] == wanted] if len(h) else i[:0]
            if len(i):
                for col, x in zip(out, (-1, shard, *_packed(h[i], n[i])), strict=True):
                    col.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard_", "hashes", "counts"])

    mine = sharded.groupBy("shard_").applyInArrow(list_windows, _COUNTED).groupBy("bucket").cogroup(common.groupBy("bucket")).applyInArrow(pick, _COUNTED)

    def shard_texts(part: pa.Table, facts: pa.Table) -> pa.Table:
        own = parsed(part)
        return answer(part, own.texts(own.looked_up(*_joined(facts.column("hashes").to_pylist(), facts.column("counts").to_pylist()))))

    return sharded.groupBy("shard_").cogroup(mine.groupBy("shard_")).applyInArrow(shard_texts, schema)
