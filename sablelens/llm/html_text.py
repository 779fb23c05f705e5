"""Main-text extraction with a suffix array per host.

A page is cut into blocks by its markup, read as HTML is read (attributes, raw texts, implied ends). Elements can be
other than the article: strongly by their names (menus, footers, asides, scripts), softly (forms and headers, which may
stand around an article) or weakly (a word of their class or id, a role). Blocks inside an article or main element are sure, as far
as nothing between the two is other; articles under nothing that is other come first, then those that only weak elements
hold, then those that forms or headers hold, so that no mark on an article's surroundings loses it. The other blocks of a host's
pages that nothing rules out are unsure.

All words of every page that nothing rules out, sure or not, page behind page, form the host's stream, whose suffixes are sorted
by prefix doubling. A run of at least RUN words that occurs on at least PAGES distinct pages of the host is repeated. Repeated words
go from unsure blocks of pages without sure ones, and from what stands in a main element beside its articles; of several articles on a page, those that consist of
repeated words alone go (teasers), but the longest stays. An article loses no part of itself: articles quote and share lines.
Pages of equal words are one page, however many rows or addresses they have: copies are no evidence against themselves.

Pages are parsed once and kept, and none is dealt out: each task sorts the suffixes of its own pages, host by host, in pieces of some BUNDLE pages. What a piece
finds on PAGES pages is repeated. Of its other runs it sends hashes, short ones with their counts, to tasks that each have a range
of a host's hashes; those whose counts reach PAGES may be repeated, and their pages are looked for again and counted by
64-bit hashes of the runs and 128-bit ones of the pages. BUNDLE thus bounds memory and decides no result.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablelens.llm.common import bounded_batches, lean, partitions, release, saved

RUN, PAGES, BUNDLE = 6, 3, 4096
#: Most code points of a piece.
PIECE = 8 << 20
#: Hosts of which the number of pages is told to tasks; smaller ones count as having the last one's.
HOSTS, SMALL_HOST = 100_000, 64
#: Packed bytes of hashes that tasks are told at once; of more, some hosts at a time.
TOLD = 32 << 20
# Element names of HTML by their part in a page.
STRONG = frozenset("head nav footer aside menu dialog template button select svg math canvas object audio video label option fieldset".split())
SOFT = frozenset(("form", "header"))
SURE = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
#: Elements whose end tags, if stray, don't close an article.
SMALL = frozenset("p b i li span a".split())
#: Elements that a new start of one of the second implicitly ends.
ENDED = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article aside footer header nav main form hr figure".split()), "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup"))}
ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
#: Words in a name of a class or an id that tell of other than the article, and how longer ones begin.
OTHER = frozenset(
    "ad ads banner cookie cookies consent gdpr notice alert popup modal overlay newsletter signup login menu menus breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar "
    "comment comments commentlist respond disqus replies related share sharing social widget widgets tags pagination pager search copyright legal disclaimer".split()
)
OTHER_STEMS = ("advert", "sponsor", "promo", "subscri", "recommend", "nav")
#: Words beside these that say that something has or lacks a part, or is laid out for it, and is not the part itself.
DESCRIBES = frozenset("has have no not with without show hide is layout enabled disabled active open closed visible page template theme".split())
#: A header of one of these is the article's own.
OWNERS = frozenset("article post entry story content".split())
WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
PLAIN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
GAP = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NONE, WEAK, SOFTLY, STRONGLY = range(4)


def _names_other(value: str) -> bool:
    """Whether a class or an id, name by name, is that of something other than the article."""
    for name in value.split():
        parts = [w.lower() for w in WORDS_OF.findall(name)]
        if DESCRIBES.intersection(parts):
            continue
        for w in parts:
            if (w in OTHER or w.startswith(OTHER_STEMS)) and not (w == "header" and OWNERS.intersection(parts)):
                return True
    return False


def _level(name: str, attributes: dict[str, str]) -> int:
    """How an element is other than the article: NONE to STRONGLY."""
    if name in STRONG:
        return STRONGLY
    if name in SOFT:
        return SOFTLY
    if not attributes or name in ("body", "html"):
        return NONE
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(attributes.get("style", "")):
        return STRONGLY
    if ROLE.intersection(attributes.get("role", "").lower().split()) or _names_other(attributes.get("class", "")) or _names_other(attributes.get("id", "")):
        return WEAK
    return NONE


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes that follow a tag's name, where the tag ends (-1 if the page ends first), and whether a slash ends it."""
    found: dict[str, str] = {}
    while True:
        begin, at = at, GAP.match(page, at).end()
        if at >= len(page):
            return found, -1, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/" and at > begin
        m = ATTRIBUTE.match(page, at)
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


@lru_cache(maxsize=32)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I)


class _Tree:
    """The open elements of a page, and its blocks with what their elements say of them."""

    def __init__(self):
        #: Name, level of it and of all around it, a bit for each of the levels up to SOFTLY at which it is in an article, and the number of the outermost article element.
        self.stack: list[tuple[str, int, int, int]] = [("", NONE, 0, 0)]
        self.articles = 0
        self.where: dict[str, list[int]] = {}
        self.block: list[int] = []  # places in the stack of elements that aren't inline
        self.sure: list[int] = []  # those of articles
        self.text: list[str] = []
        self.blocks: list[tuple[int, int, int, str]] = []

    def add(self, text: str) -> None:
        if self.stack[-1][1] != STRONGLY:
            self.text.append(html.unescape(text) if "&" in text else text)

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text = []
            if words:
                self.blocks.append((*self.stack[-1][1:], words))

    def open(self, name: str, level: int) -> None:
        _, above, inside, article = self.stack[-1]
        around = max(above, level)
        own = level == SOFTLY and name == "header"  # of the article itself
        bits = inside if level == NONE or own else 0
        if name in SURE:
            bits |= sum(1 << most for most in (NONE, WEAK, SOFTLY) if around <= most)
        self.where.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.block.append(len(self.stack))
        if name in SURE:
            self.sure.append(len(self.stack))
        if name == "article" and not article:
            self.articles += 1
            article = self.articles
        self.stack.append((name, around, bits, article))

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            name = self.stack.pop()[0]
            self.where[name].pop()
            for places in (self.block, self.sure):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def start(self, name: str, level: int) -> None:
        """Opens an element, after the ends that it implies."""
        while self.block and name in ENDED.get(self.stack[self.block[-1]][0], ()):
            self.close(self.block[-1])
        self.open(name, level)

    def end(self, name: str) -> None:
        places = self.where.get(name)
        if places and not (name in SMALL and self.sure and places[-1] < self.sure[-1]):
            self.close(places[-1])


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """The blocks of a page that markup doesn't rule out, in order: whether it is sure, and its text."""
    return [(sure, words) for sure, _, words in parts(page)]


def parts(page: str | None) -> list[tuple[bool, int, str]]:
    """The blocks with the number of the article element that holds them, 0 for none. Takes time in proportion to the page."""
    page, at, tree = page or "", 0, _Tree()
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0 or begin + 1 == len(page):
            tree.add(page[at:])
            break
        after = page[begin + 1]
        closing = after == "/" and page[begin + 2 : begin + 3].isalpha()
        if not (after in "!?/" or after.isascii() and after.isalpha()):
            tree.add(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            if tree.stack[-1][0] == "head" and not page[at:begin].isspace():
                tree.close(len(tree.stack) - 1)
            tree.add(page[at:begin])
        if page.startswith("<!--", begin):
            stop = begin + 5 if page.startswith("<!-->", begin) else page.find("-->", begin + 4) + 3
            at = stop if stop > begin else len(page)
            continue
        if not closing and after in "!?/":
            at = page.find(">", begin) + 1 or len(page)
            continue
        if m := PLAIN.match(page, begin + 1):
            name, attributes, at, empty = m[2].lower(), {}, m.end(), False
        else:
            m = NAME.match(page, begin + 1 + closing)
            name = m[0].lower() if m else ""
            attributes, at, empty = _attributes(page, m.end() if m else begin + 2)
            if at < 0:  # the page ends within a tag
                break
        if closing:
            if name in ("body", "html", ""):
                continue
            if name not in INLINE or tree.where.get(name) and tree.stack[tree.where[name][-1]][1] != tree.stack[tree.where[name][-1] - 1][1]:
                tree.flush()
            tree.end(name)
            continue
        if name not in HEAD and tree.stack[-1][0] == "head":
            tree.close(len(tree.stack) - 1)
        if name not in INLINE:
            tree.flush()
        if name in RAW:
            stop = _end_of(name).search(page, at)
            at = stop.end() if stop else len(page)
        elif name not in VOID and not (empty and name not in SURE):
            level = _level(name, attributes)
            if level != NONE:
                tree.flush()
            tree.start(name, level)
    tree.flush()
    for most in (NONE, WEAK, SOFTLY):
        if any(inside >> most & 1 for _, inside, _, _ in tree.blocks):
            return [(bool(inside >> most & 1), article, words) for around, inside, article, words in tree.blocks if inside >> most & 1 or around == NONE]
    return [(False, article, words) for around, _, article, words in tree.blocks if around == NONE]


def _runs(streams: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all runs of `run` words in the concatenated streams, sorted, the number of the run at each, and the distinct pages by number.

    Suffixes of the concatenated stream are ranked by their first `run` words, doubling the length ranked each
    time; equal ranks are neighbours in the sorted array, and the distinct pages among them are counted.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    none = np.zeros(0, np.int64)
    if not len(owner):
        return none, none, none
    names: dict[str, int] = {}
    rank = np.array([names.setdefault(w, len(names) + 1) for s in streams for w in s], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place, length = np.arange(len(rank)), 1
    whole, order = rank, np.argsort(rank, kind="stable")
    while length < run:
        step = min(length, run - length)
        later = np.where(place + step < ends, np.concatenate([whole[step:], np.zeros(min(step, len(whole)), np.int64)])[: len(whole)], 0)
        pair = whole * (int(whole.max()) + 2) + later + 1
        order = np.argsort(pair, kind="stable")
        whole = np.empty(len(pair), np.int64)
        whole[order] = np.cumsum(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
        length += step
    order = order[(place + run <= ends)[order]]  # of equal ranks, page by page
    if not len(order):
        return none, none, none
    group = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    fresh = group | np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
    number = np.cumsum(group) - 1
    return order, number, np.bincount(number, fresh).astype(np.int64)


def _covered(n: int, hit: np.ndarray, run: int) -> np.ndarray:
    """Which of n words lie in one of the runs that start at the places `hit`."""
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + run, -1)
    return np.cumsum(covered)[:-1] > 0


def repeated_words(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """Per page which of its words lie in a run of at least `run` words that is found on at least `pages` distinct pages.

    Longer repeats are unions of runs of `run` words.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    order, number, distinct = _runs(streams, run)
    hit = order[distinct[number] >= pages] if len(order) else order
    return np.split(_covered(int(sizes.sum()), hit, run), np.cumsum(sizes)[:-1])


NO_HASHES = np.zeros(0, np.uint64)
BASE = 0x9E3779B97F4A7C13
#: A number for each byte.
BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=8).digest() for k in range(256)), "<u8").astype(np.uint64)
#: Code points that are hashed at once; longer words count as their hashes.
AT_ONCE, LONG = 1 << 18, 1 << 16
LONG_WORD = re.compile(rf"[^ ]{{{LONG},}}")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE from the 0th, and their inverses modulo 2^64."""
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        some = np.full(n, base, np.uint64)
        some[0] = 1
        made.append(np.cumprod(some, dtype=np.uint64))
    return tuple(made)


def _hashes_of(data: bytes, run: int, pages: int) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((text == 32) | (text == 10))
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])
    owner = np.concatenate([[0], np.cumsum(text[gaps] == 10)])
    at = np.flatnonzero(owner[run - 1 :] == owner[: max(0, len(owner) - run + 1)])
    powers, inverses = _powers(1 << (len(text)).bit_length())
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTES[text] * powers[: len(text)], out=sums[1:])
    out = (sums[end[at + run - 1]] - sums[begin[at]]) * inverses[begin[at]]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)), np.bincount(owner[at], minlength=pages)


def _pieces(stream: str, run: int) -> Iterator[str]:
    """A page's words in pieces of some AT_ONCE code points, which overlap so that each run is in one."""
    words, at = stream.split(" "), 0
    while not at or at + run <= len(words):
        stop = size = 0
        for stop in range(at, len(words)):
            size += len(words[stop]) + 1
            if size >= AT_ONCE:
                break
        yield " ".join(words[at : stop + run])
        at = stop + 1


def run_hashes(streams: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the runs of `run` words of each page's words, at each place that has one, page after page, and how many each page has."""
    found, n, part, size = [NO_HASHES], [np.zeros(0, np.int64)], [], 0

    def add(texts: list[str]) -> np.ndarray:
        hashes, some = _hashes_of("\n".join(texts).encode("utf-8", "surrogatepass"), run, len(texts))
        found.append(hashes)
        return some

    for stream in streams:
        if len(stream) > LONG:
            stream = LONG_WORD.sub(lambda m: hashlib.blake2b(m[0].encode("utf-8", "surrogatepass")).hexdigest(), stream)
        if part and size + len(stream) > AT_ONCE:
            n.append(add(part))
            part, size = [], 0
        if len(stream) > AT_ONCE:
            n.append(np.array([sum(int(add([x])[0]) for x in _pieces(stream, run))]))
        else:
            part.append(stream)
            size += len(stream)
    if part:
        n.append(add(part))
    return np.concatenate(found), np.concatenate(n)


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as bytes: their differences, byte by byte of their width, compressed."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(values), width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return NO_HASHES
    n, width = struct.unpack_from("<QB", data)
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among some ascending ones."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _bits(pages: int) -> tuple[int, int]:
    """Of a host with so many pages: the bits of a hash that give its range, and the bits of it that are sent, those included."""
    ranges = max(min(-(-pages // 64), 64), -(-pages // 4096))
    return (ranges - 1).bit_length(), min(48, max(24, (pages - 1).bit_length() + 18))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to their blocks, a line each: s if sure or else u, its article's number, its text."""
    for batch in batches:
        made = ["\n".join(f"{'s' if sure else 'u'}{article} {text}" for sure, article, text in parts(page)) for page in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "url", "_host")), pa.array(made, pa.string())], names=["_id", "url", "_host", "_blocks"])


def _read(lines: str) -> list[tuple[bool, int, str]]:
    made = (line.split(" ", 1) for line in lines.split("\n") if line)
    return [(mark[0] == "s", int(mark[1:]), text) for mark, text in made]


def _stream(made: list[tuple[bool, int, str]]) -> str:
    """All words that markup doesn't rule out: those beside a page's article aren't output, but are evidence for other pages."""
    return " ".join(text for _, _, text in made)


def _sorted_runs(pages: dict[str, None], run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct runs of some distinct pages, and on how many of them each is."""
    streams = [s.split(" ") for s in pages]
    order, number, distinct = _runs(streams, run)
    if not len(order):
        return NO_HASHES, np.zeros(0, np.int64)
    first = order[np.concatenate([[True], number[1:] != number[:-1]])]
    hashes, n = run_hashes(list(pages), run)
    sizes = np.array([len(s) for s in streams])
    # Pages of `run` words or more have run - 1 places without a run before the next page.
    before = np.cumsum(sizes - n) - (sizes - n)
    return hashes[first - np.repeat(before, sizes)[first]], distinct


def _count(run: int, repeats: int, bundle: int, sizes: dict[str, int], rest: int):
    """Pages to the hashes of their runs by host and range: for each number of pages below `repeats` the bits that are sent of those on so many, and whole those on more."""

    def finished(piece: dict[str, dict[str, None]]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list, list] = ([], [], [])
        for host, pages in piece.items():
            hashes, n = _sorted_runs(pages, run)
            by, sent = _bits(sizes.get(host, rest))
            order = np.argsort(hashes)
            hashes, n = hashes[order], np.minimum(n[order], repeats)
            edges = np.searchsorted(hashes, np.arange(1, 1 << by, dtype=np.uint64) << np.uint64(64 - by)) if by else np.zeros(0, np.int64)
            for k, (part, m) in enumerate(zip(np.split(hashes, edges), np.split(n, edges), strict=True)):
                if len(part):
                    lists = [np.sort((part[m == c] << np.uint64(by)) >> np.uint64(64 - sent + by)) for c in range(1, repeats)]
                    for column, value in zip(rows, (host, k, [packed(x) for x in (*lists, part[m == repeats])]), strict=True):
                        column.append(value)
            if len(rows[0]) >= 1000:
                yield batch_of(rows)
                rows = ([], [], [])
        if rows[0]:
            yield batch_of(rows)

    def batch_of(rows: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.binary()))], names=["_host", "_range", "_lists"])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: dict[str, dict[str, None]] = {}  # the distinct pages of each host
        n = size = 0
        for batch in batches:
            for host, lines in zip(batch.column("_host").to_pylist(), batch.column("_blocks").to_pylist(), strict=True):
                stream, seen = _stream(_read(lines)), piece.setdefault(host, {})
                if stream and stream not in seen:
                    seen[stream] = None
                    n, size = n + 1, size + len(stream)
                    if n >= bundle or size >= PIECE:
                        yield from finished(piece)
                        piece, n, size = {}, 0, 0
        yield from finished(piece)

    return run_


def _total(repeats: int):
    """Rows sorted by host and range to the bits sent of hashes whose counts reach `repeats`, and the whole hashes that did in a piece."""

    def finished(at: tuple, lists: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        few = np.sort(np.concatenate([NO_HASHES, *(unpacked(x[c - 1]) for x in lists for c in range(1, repeats) for _ in range(c))]))
        maybe = np.unique(few[repeats - 1 :][few[repeats - 1 :] == few[: len(few) - repeats + 1]])
        known = np.unique(np.concatenate([NO_HASHES, *(unpacked(x[-1]) for x in lists)]))
        if len(maybe) or len(known):
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), pa.array([packed(maybe)], pa.binary()), pa.array([packed(known)], pa.binary())], names=["_host", "_range", "_maybe", "_known"])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, []
        for batch in batches:
            for host, k, some in zip(*(batch.column(c).to_pylist() for c in ("_host", "_range", "_lists")), strict=True):
                if lists and (host, k) != at:
                    yield from finished(at, lists)
                    lists = []
                at = (host, k)
                lists.append(some)
        if lists:
            yield from finished(at, lists)

    return run_


def _look(run: int, sizes: dict[str, int], rest: int, maybe: dict[str, list[tuple[int, bytes]]], known: dict[str, list[bytes]]):
    """Pages to their runs of which the bits sent may be repeated and that aren't known to be: host, hash of the run, hash of the page's words."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1000)
        def told(host: str) -> tuple[int, np.ndarray, np.ndarray]:
            by, sent = _bits(sizes.get(host, rest))
            some = np.concatenate([unpacked(x) | np.uint64(k << (sent - by)) for k, x in sorted(maybe[host])])
            return sent, some, _joined(known.get(host, []))

        for batch in batches:
            for host, lines in _by_host(batch):
                if host not in maybe:
                    continue
                sent, some, sure = told(host)
                streams = list({_stream(_read(x)): None for x in lines})
                hashes, n = run_hashes(streams, run)
                at = np.flatnonzero(_among(hashes >> np.uint64(64 - sent), some))
                at = at[~_among(hashes[at], sure)]
                owner = np.repeat(np.arange(len(n)), n)[at]
                digests = {k: hashlib.blake2b(streams[k].encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in np.unique(owner).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(at), pa.string()), pa.array(hashes[at].view(np.int64)), pa.array([digests[k] for k in owner.tolist()], pa.binary())], names=["_host", "_run", "_page"])

    return run_


def _by_host(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    lines: dict[str, list[str]] = {}
    for host, some in zip(batch.column("_host").to_pylist(), batch.column("_blocks").to_pylist(), strict=True):
        lines.setdefault(host, []).append(some)
    yield from lines.items()


def _joined(some: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([NO_HASHES, *map(unpacked, some)]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts and hashes to one row of packed hashes for each host of a task."""
    found: dict[str, list[int]] = {}
    for batch in batches:
        for host, value in zip(batch.column("_host").to_pylist(), batch.column("_run").to_pylist(), strict=True):
            found.setdefault(host, []).append(value)
    if found:
        data = [packed(np.sort(np.array(v, np.int64).view(np.uint64))) for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(data, pa.binary())], names=["_host", "_known"])


def _unrepeated(words: list[str], flags: np.ndarray, run: int) -> list[str]:
    """A block's words without those in repeats; a repeat that only reaches into the block with fewer than `run` words takes none."""
    if flags.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    gone = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= run]
    kept = np.ones(len(words), bool)
    for a, b in gone:
        kept[a:b] = False
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def _text(made: list[tuple[bool, int, str]], hit: np.ndarray, run: int) -> str:
    """A page's text, given the places of its words where a repeated run begins."""
    marked = any(sure for sure, _, _ in made)
    if not len(hit):
        return " ".join(text for sure, _, text in made if sure or not marked)
    flags = _covered(sum(text.count(" ") + 1 for _, _, text in made), hit, run)
    ends = np.cumsum([text.count(" ") + 1 for _, _, text in made]).tolist()
    blocks_ = [(sure, article, text, flags[a:b]) for (sure, article, text), a, b in zip(made, [0, *ends], ends, strict=False) if sure or not marked]
    if not marked:
        return " ".join(filter(None, (" ".join(_unrepeated(text.split(" "), f, run)) for _, _, text, f in blocks_)))
    size: dict[int, int] = {}
    own: dict[int, bool] = {}  # articles with words of their own
    for _, article, _, f in blocks_:
        if article:
            size[article] = size.get(article, 0) + len(f)
            own[article] = own.get(article, False) or not f.all()
    if not size:
        return " ".join(text for _, _, text, _ in blocks_)
    own[max(size, key=size.get)] = True
    out = []
    for _, article, text, f in blocks_:
        if own.get(article, not article):
            out.append(text if article else " ".join(_unrepeated(text.split(" "), f, run)))
    return " ".join(filter(None, out))


def _texts(run: int, known: dict[str, list[bytes]]):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = lru_cache(maxsize=1000)(lambda host: _joined(known.get(host, [])))
        for batch in batches:
            texts: dict[str, Iterator[str]] = {}
            for host, lines in _by_host(batch):
                made = [_read(x) for x in lines]
                hashes, n = run_hashes([_stream(x) for x in made], run)
                hit, ends = np.flatnonzero(_among(hashes, repeated(host))), np.cumsum(n)
                hits = np.split(hit, np.searchsorted(hit, ends[:-1]))
                texts[host] = iter([_text(x, at - end + k, run) for x, at, end, k in zip(made, hits, ends.tolist(), n.tolist(), strict=True)])
            out = [next(texts[host]) for host in batch.column("_host").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("url"), pa.array(out, pa.string())], names=["_id", "url", "text"])

    return run_


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", run: int = RUN, repeats: int = PAGES, bundle: int = BUNDLE) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null page counts as empty; a page without text has text "" and n_chars 0; null ids and urls are kept (all null
    urls are one host); repeated rows are rows of the result, but one page as evidence. An empty table gives an empty result; extra
    columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    kind = pages.schema[page_id].dataType
    rows = pages.select(F.col(page_id).cast("string").alias("_id"), F.col(url).alias("url"), F.col(page).alias("_html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = rows.withColumn("_host", host)
    rows = saved(rows.mapInArrow(lean(_parse), "_id string, url string, _host string, _blocks string"), "op7-pages")
    large = rows.groupBy("_host").count().where(F.col("count") > SMALL_HOST).orderBy(F.desc("count")).limit(HOSTS).collect()
    sizes = {r["_host"]: r["count"] for r in large}
    rest = large[-1]["count"] if len(large) == HOSTS else SMALL_HOST
    counts = rows.select("_host", "_blocks").mapInArrow(lean(_count(run, repeats, bundle, sizes, rest)), "_host string, _range int, _lists array<binary>")
    dealt = counts.repartition(partitions(spark), "_host", "_range").sortWithinPartitions("_host", "_range")
    found = saved(dealt.mapInArrow(lean(_total(repeats)), "_host string, _range int, _maybe binary, _known binary"), "op7-repeats")
    bytes_ = found.agg(F.sum(F.length("_maybe") + F.length("_known"))).first()[0] or 0
    rounds = -(-bytes_ // TOLD) or 1
    out = None
    for k in range(rounds):
        now = F.lit(True) if rounds == 1 else F.pmod(F.xxhash64("_host"), F.lit(rounds)) == k
        some = rows.where(now)
        made = some.mapInArrow(lean(_texts(run, _repeated(some, found.where(now), run, repeats, sizes, rest))), "_id string, url string, text string")
        out = made if out is None else out.unionByName(made)
    release(found)
    return out.select(F.col("_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _repeated(rows: DataFrame, found: DataFrame, run: int, repeats: int, sizes: dict[str, int], rest: int) -> dict[str, list[bytes]]:
    """By host the packed hashes of its repeated runs."""
    maybe: dict[str, list[tuple[int, bytes]]] = {}
    known: dict[str, list[bytes]] = {}
    for r in found.collect():
        if r["_maybe"]:
            maybe.setdefault(r["_host"], []).append((r["_range"], bytes(r["_maybe"])))
        if r["_known"]:
            known.setdefault(r["_host"], []).append(bytes(r["_known"]))
    if maybe:
        looked = rows.select("_host", "_blocks").mapInArrow(lean(_look(run, sizes, rest, maybe, known)), "_host string, _run long, _page binary")
        on = looked.groupBy("_host", "_run").agg(F.count_distinct("_page").alias("_n")).where(F.col("_n") >= repeats)
        for r in on.select("_host", "_run").mapInArrow(lean(_pack), "_host string, _known binary").collect():
            known.setdefault(r["_host"], []).append(bytes(r["_known"]))
    return known
