"""Main text of web pages: markup proposes blocks, a host suffix array says which of them
other pages of the host repeat.

A page becomes blocks of text in page order; markup tells the blocks of its article (else
of its main part, else of its body) from menus, headers, footers, sidebars, adverts, forms
and reader comments. The word streams of all blocks of a host's pages are concatenated and
their suffixes sorted by prefix doubling; where neighbours agree in ``RUN`` words or more (their
longest common prefix) they are one repeat, and its distinct pages are counted. A word lies in a
repeat of ``RUN`` words or more exactly if it lies in a repeated run of ``RUN`` words, so
the order is cut at that depth, and long repeats are the unions of overlapping runs. Whole blocks are
repeats of their own, from border to border and of any length (a menu's links are single words): each lot
counts the distinct pages that hold one.

Large hosts are dealt into lots by the hash of the stream, each with an array of its own; the
lots' counts are summed over the host. A lot tells a run from a quarter of the least
share on (7.5 % of its pages). By the binomial tail, a run on 30 % of a host's pages is missed by
a lot of 256 pages with less than 1e-20, so that lots decide nothing; blocks are told from one page on.

Where a page has no article or main part, repeats decide: a block goes if runs on 30 % of the host's pages cover it, or
if it stands outside the page's core (from the first to the last block of ``RUN`` words or more that is nowhere else
on the host, with the headings and paragraphs next to them) and a second page holds it. A page that repeats cover wholly is a copy and keeps its text. Where
there is an article, its blocks are main text: as many of them recur as of the boilerplate around them, so that
a repeat is told from a quotation by markup only; one on 80 % of at least ten pages goes all the same.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, run_hash, slices, text_bytes, word_hashes, word_runs, written

#: Elements whose content is never main text.
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe object embed svg canvas audio video map menu dialog button select textarea input label fieldset datalist".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
) | DROPPED
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements of running text: where repeats alone decide, those next to the core are part of it.
PROSE = HEADINGS | {"p", "blockquote", "pre"}
#: Names (of class, id or role) of menus, adverts, notices, sidebars and reader comments. A name is
#: one of these words, or is made of them and ``NEUTRAL`` ones only: ``share-buttons`` but not ``share-price``.
NAMES = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices "
    "popup popups modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead "
    "footer comments comment commentlist respond disqus replies share sharing social related recommended complementary contentinfo disclaimer login skiplink".split()
)
#: These name chrome only outside an article.
OUTER_NAMES = frozenset(["header", "search"])
NEUTRAL = frozenset(
    "site page main top bottom left right list box bar wrap wrapper container block section area panel links link item items unit slot global primary secondary reader user article articles "
    "post posts button buttons icons form side skip thread threads to".split()
)
#: Of an id inside an article only these names count: sections of an article are named by their subjects.
ID_NAMES = frozenset("ad ads adbox adslot adunit advert adverts advertisement comments comment commentlist respond disqus replies".split())
#: Elements that a name marks inside an article; headings and inline text never are.
CONTAINERS = frozenset("div section p ul ol dl table figure details".split())
#: A comment or declaration, or a tag: its attributes are names with, after an equals sign, a value in quotes or one that ends
#: at white space; quotes elsewhere are part of a name or value.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+|=)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
#: Starts that close an open ``p``: block elements. Lists, rows and cells close their own kind, see ``CLOSES``.
#: An open element of the key is closed by the start of one of the values.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

#: Words of a run: the shortest repeat that counts.
RUN = 5
#: Share of a host's distinct pages, and their least number, that must hold a run: outside an article, and inside
#: an article or main part, where a line that three or four pages share is as likely main text.
LEVELS = ((0.3, 2), (0.8, 10))
#: Share of a block's words that repeats must cover; a page of which they cover as much is a copy, and
#: its repeats are its own text unless nearly the whole host has them.
COVER = 0.9
#: Pages and bytes of a lot.
LOT_PAGES, LOT_BYTES = 256, 4 << 20
_FOLD = mix(np.arange(101, 101 + RUN, dtype=np.uint64)) | np.uint64(1)


def is_marked(value: str, within: bool, names: frozenset[str] = NAMES) -> bool:
    """Whether a class, id or role value names a menu, advert, notice, sidebar or comment list."""
    for token in value.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
        named = [p in names or not within and p in OUTER_NAMES for p in parts]
        if any(named) and all(n or p in NEUTRAL for n, p in zip(named, parts, strict=True)):
            return True
    return False


def _marked(attributes: str, name: str, within: bool) -> bool:
    """Whether an element ``name`` is no main text by its attributes; ``within`` an article."""
    words = ("class", "id", "role") if not within or name in CONTAINERS else ()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in words and is_marked(value, within, ID_NAMES if within and key == "id" else NAMES):
            return True
    return False


Block = tuple[str, bool, int, bool]


def all_blocks(source: str) -> list[Block]:
    """The page's blocks in order: text, whether markup takes it for chrome, its zone (2 in
    an article, 1 in a main part, else 0), and whether it is a heading or paragraph. An article's own header keeps its
    headings."""
    # open block elements, and inline ones that are chrome or inside chrome: name, and skip and zone around it
    stack: list[tuple[str, int, int]] = []
    open_now: Counter[str] = Counter()  # names on the stack: an end tag without a start costs nothing
    skip, zone = 0, 0  # how many chrome elements are open
    own_headers = 0  # open headers of articles
    out: list[Block] = []
    parts: list[str] = []
    place = 0

    def close() -> None:
        if parts:
            block = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if block:
                out.append((block, skip > 0, zone, bool(stack) and stack[-1][0] in PROSE))

    def pop(upto: int) -> None:
        nonlocal skip, zone, own_headers
        while len(stack) > upto:
            if stack[-1][0] in BLOCKS:
                close()
            name, skip, zone = stack.pop()
            open_now[name] -= 1
            own_headers -= name == "header" and not skip and zone == 2

    size = len(source)
    while place < size:
        m = _TOKEN.search(source, place)
        stop = m.start() if m else size
        if stop > place and not (stack and stack[-1][0] == "head"):
            parts.append(source[place:stop])
        if not m:
            break
        place = m.end()
        if m[2] is None:
            continue
        name, ending = m[2].lower(), bool(m[1])
        block = name in BLOCKS
        if ending:
            if open_now[name] > 0:
                # inline elements end inside the block that they stand in
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
                    if not block and stack[k][0] in BLOCKS:
                        break
            elif block:
                close()
            continue
        if name in RAW:
            end = _raw_end(name).search(source, place)
            stop = source.find(">", end.end()) if end else -1
            place = stop + 1 if stop >= 0 else size
            if block:
                close()
            continue
        if block:
            close()
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "head" and name == "body":
            pop(len(stack) - 1)
        if block and open_now["p"] > 0:
            for k in range(len(stack) - 1, -1, -1):  # a block ends the paragraph that it starts in
                if stack[k][0] in BLOCKS:
                    if stack[k][0] == "p":
                        pop(k)
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if name in CLOSES.get(stack[k][0], ()):
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if m[3].endswith("/") and not block:
            continue
        dropped = name in DROPPED or name not in ("html", "body", "main") and bool(m[3]) and _marked(m[3], name, zone == 2 and name != "article")
        if not block and not dropped and not skip:
            continue  # it changes nothing
        own_headers += name == "header" and not skip and zone == 2
        stack.append((name, skip, zone))
        open_now[name] += 1
        if dropped:
            skip += 1
        elif name in HEADINGS and skip == 1 and own_headers:
            skip = 0
        if not skip and name == "article":
            zone = 2
        elif not skip and name == "main":
            zone = max(zone, 1)
    pop(0)
    close()
    return out


@lru_cache(None)
def _raw_end(name: str) -> re.Pattern:
    """The end tag of an element of plain text (there are as many as ``RAW`` has names)."""
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def best_zone(blocks: list[Block]) -> int:
    return max((zone for _, chrome, zone, _ in blocks if not chrome), default=0)


def page_blocks(source: str) -> tuple[list[str], bool]:
    """What markup alone takes for main text, and whether an article or main part holds it."""
    blocks = all_blocks(source)
    best = best_zone(blocks)
    return [text for text, chrome, zone, _ in blocks if not chrome and zone >= best], best > 0


class Streams:
    """The blocks of a chunk of pages and their words as 24-bit hashes; ``edge`` is the first
    word of each block, ``first`` the first block of each page, ``keys`` a hash of each block."""

    def __init__(self, sources: list[str | None]):
        self.pages = [all_blocks(s or "") for s in sources]
        raw, offsets = text_bytes(pa.array([b[0] for p in self.pages for b in p], pa.large_string()))
        starts, ends, self.edge = word_runs(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        self.words = (hashes >> np.uint64(40)).astype(np.uint32)
        self.keys = run_hash(hashes, self.edge[:-1], self.edge[1:])  # of whole blocks
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in self.pages])]).astype(np.int64)

    def bounds(self, page: int) -> tuple[int, int]:
        return int(self.edge[self.first[page]]), int(self.edge[self.first[page + 1]])


def run_hashes(words: np.ndarray) -> np.ndarray:
    """A number for each run of ``RUN`` words."""
    n = max(len(words) - RUN + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            out += words[k : k + n].astype(np.uint64) * _FOLD[k]
        return mix(out)


def suffix_order(words: np.ndarray, page: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``words`` in the order of their first ``depth`` words, and the longest common
    prefix (``depth`` at most) of each with the one before it; suffixes end with their page."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.flatnonzero(np.append(page[1:] != page[:-1], True))
    room = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # words up to the page's end
    ranks = [(1, np.unique(words, return_inverse=True)[1].astype(np.int64) + 1)]
    while ranks[-1][0] < depth:
        width, rank = ranks[-1]
        step = min(width, depth - width)
        ahead = np.zeros(n, np.int64)  # 0 where the page ends before
        ahead[: n - step] = rank[step:]
        ahead[room <= step] = 0
        ranks.append((width + step, np.unique(rank * np.int64(n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1))
    order = np.argsort(ranks[-1][1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(room[a], room[b]), depth)
    got = np.zeros(n - 1, np.int64)
    for width, rank in reversed(ranks):  # the longest width that still fits and agrees, then what is left
        for _ in range(2):
            open_ = got + width <= most
            x, y = np.where(open_, a + got, 0), np.where(open_, b + got, 0)
            got += np.where(open_ & (rank[x] == rank[y]), width, 0)
    common[1:] = np.minimum(got, most)
    return order, common


def repeats(words: np.ndarray, page: np.ndarray, length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """One place of each run of ``length`` words that recurs, and the number of distinct pages that hold it."""
    order, common = suffix_order(words, page, length)
    group = np.cumsum(common < length) - 1
    size = np.bincount(group) if len(group) else np.empty(0, np.int64)
    own = np.flatnonzero(size[group] > 1) if len(group) else np.empty(0, np.int64)
    if not len(own):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pair = np.unique(group[own] * np.int64(page.max() + 1) + page[order[own]])
    held, pages = np.unique(pair // np.int64(page.max() + 1), return_counts=True)
    start = np.concatenate([[0], np.cumsum(size)])
    return order[start[held]], pages


def _lot(table: pa.Table) -> pa.Table:
    """Repeats of one lot: (run, distinct pages), its whole blocks likewise, and in a row without a run the lot's
    distinct pages."""
    host, lots = table.column("host")[0].as_py(), table.column("lots")[0].as_py()
    seen: dict[bytes, np.ndarray] = {}
    held: list[np.ndarray] = [np.empty(0, np.uint64)]
    for packed, sizes, keys, n_keys in zip(*(table.column(c).to_pylist() for c in ("words", "sizes", "keys", "n_keys")), strict=True):
        at = key_at = 0
        for n, k in zip(np.frombuffer(sizes, np.uint32).tolist(), np.frombuffer(n_keys, np.uint32).tolist(), strict=True):
            own = packed[at : at + 3 * n]
            at += 3 * n
            digest = hashlib.blake2b(own, digest_size=16).digest()
            if digest not in seen:
                seen[digest] = own
                held.append(np.frombuffer(keys[key_at : key_at + 8 * k], np.uint64))
            key_at += 8 * k
    flat = np.frombuffer(b"".join(seen.values()), np.uint8).reshape(-1, 3).astype(np.uint32)
    words = flat[:, 0] | flat[:, 1] << 8 | flat[:, 2] << 16
    page = np.repeat(np.arange(len(seen)), [len(x) // 3 for x in seen.values()])
    place, pages = repeats(words, page)
    share, least = LEVELS[0]
    keep = pages >= max(least, (share if lots == 1 else share / 4) * len(seen))
    place, pages = place[keep], pages[keep]
    runs = run_hashes(words)[place].view(np.int64) if len(place) else np.empty(0, np.int64)
    blocks, holders = np.unique(np.concatenate(held), return_counts=True)
    if lots == 1:
        blocks, holders = blocks[holders > 1], holders[holders > 1]
    k = len(runs) + 1 + len(blocks)
    return pa.table(
        {
            "host": pa.array([host] * k, pa.string()),
            "lots": pa.array([lots] * k, pa.int32()),
            "run": pa.array([None, *runs.tolist(), *blocks.view(np.int64).tolist()], pa.int64()),
            "pages": pa.array([len(seen), *pages.tolist(), *holders.tolist()], pa.int64()),
            "whole": pa.array([False] * (len(runs) + 1) + [True] * len(blocks)),
        }
    )


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word streams by (host, lot); a task ships equal streams of a host once."""
    known: set[tuple[str, bytes]] = set()
    for part in slices(batches, "html", 4 << 20):
        found = Streams(part.column("html").to_pylist())
        packed = found.words.view(np.uint8).reshape(-1, 4)[:, :3]
        rows: dict[tuple[str, int, int], list[tuple[bytes, np.ndarray]]] = {}
        for k, (host, lots) in enumerate(zip(part.column("host").to_pylist(), part.column("lots").to_pylist(), strict=True)):
            a, b = found.bounds(k)
            if a == b:
                continue
            own = packed[a:b].tobytes()
            digest = hashlib.blake2b(own, digest_size=16).digest()
            if (host, digest) in known:
                continue
            if len(known) < 1_000_000:  # beyond that a stream may be shipped again; the lot tells equal ones apart
                known.add((host, digest))
            blocks = np.unique(found.keys[found.first[k] : found.first[k + 1]])
            rows.setdefault((host, lots, int.from_bytes(digest[:8], "little") % lots), []).append((own, blocks))
        if rows:
            h, n, lot = zip(*rows, strict=True)
            binary = lambda parts: pa.array([b"".join(x) for x in parts], pa.binary())
            counts = lambda sizes: pa.array([np.array(x, np.uint32).tobytes() for x in sizes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h, pa.string()), pa.array(n, pa.int32()), pa.array(lot, pa.int32()),
                    binary([w for w, _ in x] for x in rows.values()), counts([len(w) // 3 for w, _ in x] for x in rows.values()),
                    binary([q.tobytes() for _, q in x] for x in rows.values()), counts([len(q) for _, q in x] for x in rows.values()),
                ],
                names=["host", "lots", "lot", "words", "sizes", "keys", "n_keys"],
            )


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, number of the block, key) of each block."""
    for part in slices(batches, "html"):
        found = Streams(part.column("html").to_pylist())
        row = np.repeat(np.arange(part.num_rows), np.diff(found.first))
        at = np.arange(len(row)) - found.first[:-1][row]
        cols = [part.column("row").take(pa.array(row)), part.column("host").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(found.keys.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "host", "at", "run"])


def _host_runs(table: pa.Table) -> pa.Table:
    """The runs of a host, sorted, with their levels."""
    run = table.column("run").to_numpy().view(np.uint64)
    order = np.argsort(run)
    return pa.table(
        {
            "host": table.column("host").slice(0, 1),
            "lots": table.column("lots").slice(0, 1),
            "runs": pa.array([run[order].tobytes()], pa.binary()),
            "levels": pa.array([table.column("level").to_numpy()[order].astype(np.uint8).tobytes()], pa.binary()),
        }
    )


def covered(level: np.ndarray, least: int) -> np.ndarray:
    """Of the words of a page, given the level of the run that starts at each, whether a run of ``least`` or more holds it."""
    change = np.zeros(len(level) + 1, np.int64)
    hit = np.flatnonzero(level >= least)
    change[hit] += 1
    np.subtract.at(change, np.minimum(hit + RUN, len(level)), 1)
    return np.cumsum(change[:-1]) > 0


def main_text(blocks: list[Block], edge: np.ndarray, level: np.ndarray, whole: list[int] | None = None) -> tuple[list[str], int]:
    """The main blocks of a page, and how many of markup's blocks its host's repeats removed. ``edge``: where
    each block's words begin in the page; ``level`` of the run that starts at each word (0: none); ``whole``:
    blocks that another page of the host holds, for pages without an article or main part."""
    best = best_zone(blocks)
    own = np.array([not chrome and zone >= best for _, chrome, zone, _ in blocks], bool)
    size = np.diff(edge)
    gone = np.zeros(len(blocks), bool)
    for least in (2,) if best else (1, 2):
        inner = np.concatenate([[0], np.cumsum(covered(level, least))])
        words = inner[edge[1:]] - inner[edge[:-1]]
        run = own & (words >= COVER * size) & (size > 0)
        held = np.zeros(len(blocks), bool)
        if whole and not best and least == 1:
            held[whole] = True
        if np.where(held, size, words)[own].sum() >= COVER * size[own].sum():
            continue  # a copy: its repeats are its own text
        core = np.flatnonzero(own & ~run & ~held & (size >= RUN))
        outside = np.ones(len(blocks), bool)
        if len(core):
            first, last = core[0], core[-1] + 1
            while first and own[first - 1] and blocks[first - 1][3]:
                first -= 1
            while last < len(blocks) and own[last] and blocks[last][3]:
                last += 1
            outside[first:last] = False
        gone = run | (own & held & outside)
        break
    return [b[0] for b, keep in zip(blocks, own & ~gone, strict=True) if keep], int(gone.sum())


def host_of(url):
    """The host of a URL as a Column: lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: ``page_id, url, text, n_chars, n_removed`` (of markup's blocks, those that the host's repeats removed).

    Null html counts as empty and has an empty text; blocks are joined by one newline, white
    space inside a block is one space. Rows are decided each by its own html, so repeated rows,
    and rows with equal or null ids, stay as they are. Pages with equal streams count
    once. Pages without a readable host form one host. Long pages are read whole; a lot has
    ``LOT_PAGES`` pages or ``LOT_BYTES`` bytes on average, whatever the host's size. Other columns are not
    read. An empty table gives an empty result.
    """
    table = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    lots = F.ceil(F.greatest(F.count(F.lit(1)) / LOT_PAGES, F.sum(F.octet_length("html")) / LOT_BYTES)).cast("int")
    large = written(table.groupBy("host").agg(lots.alias("lots")).where("lots > 1"), "hosts")
    # joins on a hot host are dealt by a salt: one row for each of 64 parts of a large host
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int")
    salted = large.select("host", "lots", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    table = table.withColumn("salt", salt).join(salted, ["host", "salt"], "left").withColumn("lots", F.coalesce("lots", F.lit(1)))

    streams = table.select("host", "lots", "html").mapInArrow(_ship, "host string, lots int, lot int, words binary, sizes binary, keys binary, n_keys binary")
    found = written(streams.groupBy("host", "lot").applyInArrow(_lot, "host string, lots int, run long, pages long, whole boolean"), "repeats")
    distinct = found.where("run is null").groupBy("host").agg(F.sum("pages").alias("distinct"))
    counts = found.where("run is not null and not whole").groupBy("host", "lots", "run").agg(F.sum("pages").alias("pages")).join(distinct, "host")
    level = sum(((F.col("pages") >= least) & (F.col("pages") >= share * F.col("distinct"))).cast("int") for share, least in LEVELS)
    frequent = counts.withColumn("level", level).where("level > 0").select("host", "lots", "run", "level")
    # at most words of a page / least share runs to a host
    frequent = written(frequent.groupBy("host").applyInArrow(_host_runs, "host string, lots int, runs binary, levels binary"), "frequent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = Streams(part.column("html").to_pylist())
            hashes = run_hashes(found.words)
            texts, removed = [], []
            for k, blocks in enumerate(found.pages):
                a, b = found.bounds(k)
                level = np.zeros(b - a, np.uint8)
                if part.column("runs")[k].is_valid and b - a >= RUN:
                    runs = np.frombuffer(part.column("runs")[k].as_buffer(), np.uint64)
                    own = hashes[a : b - RUN + 1]
                    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                    levels = np.frombuffer(part.column("levels")[k].as_buffer(), np.uint8)
                    level[: len(own)] = np.where(runs[at] == own, levels[at], 0)
                kept, gone = main_text(blocks, found.edge[found.first[k] : found.first[k + 1] + 1] - a, level, part.column("whole")[k].as_py())
                texts.append("\n".join(kept))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_removed"],
            )

    # as many parts of a host as it has lots, 64 at most
    parts = F.least("lots", F.lit(64))
    sides = frequent.select("host", "runs", "levels", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    table = table.withColumn("salt", F.pmod("salt", parts)).select("page_id", "url", "html", "host", "salt")
    # pages without article and main: which of their blocks a second page holds, joined by block
    plain = F.coalesce(~F.col("html").rlike(r"(?i)<(?:article|main)[\s/>]"), F.lit(False))
    keyed = written(table.where(plain).withColumn("row", F.monotonically_increasing_id()), "plain")
    second = found.where("whole").groupBy("host", "run").agg(F.sum("pages").alias("pages")).where("pages > 1").drop("pages")
    hits = keyed.mapInArrow(_block_keys, "row long, host string, at int, run long").join(second, ["host", "run"], "left_semi").groupBy("row").agg(F.collect_list("at").alias("whole"))
    both = table.where(~plain | F.col("html").isNull()).withColumn("whole", F.lit(None).cast("array<int>")).unionByName(keyed.join(hits, "row", "left").drop("row"))
    joined = both.join(sides, ["host", "salt"], "left").select("page_id", "url", "html", "whole", "runs", "levels")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_removed int")
