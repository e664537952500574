"""Main text of web pages by differencing pages of neighbouring URLs.

Pages are sorted by path within their host; each is aligned with its neighbours by a longest common subsequence of text lines, and what they share is
deleted: it is the site's, not the page's. Two things differencing alone gets wrong. Menus and notices that differ from page to page stay, so what the
markup itself names as such goes first. And mirrored articles are shared lines too, so lines inside an article element are never deleted. Of all other
lines, on every page, the differencing decides.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

_TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*)>?|(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*)(?:>|\Z))""", re.S)
# Element names, and words of class, id and role attributes.
_RAW = frozenset("script style noscript template textarea iframe svg math object canvas select title option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_SITE = frozenset("nav footer aside form button menu dialog head fieldset search audio video".split())
_NAMED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|dropdown|footer|gdpr|login|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|widgets?)(?=$|[\s_-])"
)
_HEADER = re.compile(r"(?i)(?:^|[\s_-])(?:header|topbar|site-header)(?=$|[\s_-])")
_HELD = re.compile(r"""(?i)\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_MAIN = re.compile(r"(?i)(?:^|\s)(?:main|article|articlebody)(?=$|\s)")
SITE, PLAIN, MAIN, WRAP = 0, 1, 2, 3


def lines(page: str) -> list[tuple[int, str]]:
    """The text blocks of a page in order, each with where it stands: in the site's furniture, in none of these, in an article element, or in what is only named the main part."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside
    zone, parts, at, n = PLAIN, [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    zone = stack[-1][1] if stack else PLAIN
                    break
            continue
        if name in _VOID or m["rest"].endswith("/"):
            continue
        if name in _RAW:
            end = re.compile(rf"(?i)</{name}(?![A-Za-z0-9-])[^>]*>?").search(page, at)
            at = end.end() if end else n
            continue
        inner = zone
        held = " ".join(a or b or c for a, b, c in _HELD.findall(m["rest"])) if "=" in m["rest"] else ""
        inside = zone in (MAIN, WRAP)
        if name in ("article", "main") or (held and not inside and _MAIN.search(held)):
            # An article inside an unclosed menu is the page's; one inside comments is a reader's.
            if zone != SITE or not any(z == SITE and k in ("div", "section", "ol", "ul", "li") for k, z in stack):
                inner = MAIN if name == "article" or zone == MAIN else WRAP
        if name in _SITE or (name == "header" and not inside) or (held and (_NAMED.search(held) or (not inside and _HEADER.search(held)))):
            inner = SITE
        if inner != zone or name in _BLOCK:
            if inner != zone:
                flush()
            stack.append((name, inner))
            zone = inner
        else:
            stack.append((name, zone))
    flush()
    return out


#: Bits that a comparison keeps at once: longer pages are split first.
KEPT = 1 << 28


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Bit j of a row is 0 where one more element of b[: j + 1] joins a longest common subsequence with the elements of a so far; the last row, or every one."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, kept = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
        if every:
            kept.append(row)
    return kept if every else [row]


def _lengths(row: int, n: int) -> list[int]:
    """The length of the common subsequence with each prefix, the empty one first."""
    out = [0]
    for bit in reversed(bin(row | 1 << n)[3:]) if n else ():
        out.append(out[-1] + (bit == "0"))
    return out


def _aligned(a: list[int], b: list[int], i: int, j: int) -> list[tuple[int, int]]:
    """Pairs of positions, from i and j on, of a longest common subsequence of a and b."""
    if not a or not b:
        return []
    if len(a) * len(b) > KEPT and len(a) > 1:
        half, n = len(a) // 2, len(b)
        head, tail = _lengths(_rows(a[:half], b, False)[0], n), _lengths(_rows(a[:half - 1 : -1], b[::-1], False)[0], n)
        cut = max(range(n + 1), key=lambda k: head[k] + tail[n - k])
        return _aligned(a[:half], b[:cut], i, j) + _aligned(a[half:], b[cut:], i + half, j + cut)
    rows, found = _rows(a, b, True), []
    r, c = len(a), len(b)
    while r and c:
        if rows[r - 1] >> (c - 1) & 1:
            c -= 1
        elif r > 1 and not rows[r - 2] >> (c - 1) & 1:
            r -= 1
        else:
            r, c = r - 1, c - 1
            found.append((i + r, j + c))
    return found[::-1]


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence in a and in b: bit-parallel rows, walked back; equal lines cost no more than others."""
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < top - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    pairs = [(i, i) for i in range(lo)] + _aligned(a[lo : len(a) - end], b[lo : len(b) - end], lo, lo) + [(len(a) - end + i, len(b) - end + i) for i in range(end)]
    return [i for i, _ in pairs], [j for _, j in pairs]


def _place(url: str | None) -> tuple[str, str]:
    """Host (without www. and m.) and path, as far as the URL can be split."""
    try:
        got = urlsplit(url or "")
        return re.sub(r"^(?:www|m)\.", "", (got.hostname or "").lower()), got.path
    except ValueError:
        return "", url or ""


def extract(pages: DataFrame, neighbours: int = 1) -> DataFrame:
    """page_id, url, text, n_chars of every row: the main text of the whole html.

    Text: blocks in page order, joined by a line feed, references decoded, white space inside a block one space. A null or empty html gives an empty
    text; a null url stands for a host without a name. n_chars counts code points. Pages are range-partitioned by host, path and page_id, so a host of
    many pages spreads over many tasks; the first and last pages of each task are compared with those of the tasks beside it on the driver, by their
    lines' hashes. What neighbours share goes, but for lines inside an article element (a main element, or main or article as a class, id or role, is no
    exception); if nothing would be left, as between mirrored pages, what is shared stays. Repeated rows are extracted each; a page of any length is
    read whole; an empty table gives no rows; columns other than page_id, url and html aren't read.
    """

    def parse(batches):
        for batch in batches:
            host, path, marks, zones, packed = [], [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                got = lines(page or "")
                h, p = _place(url)
                host.append(h)
                path.append(p)
                marks.append([zlib.crc32(t.encode("utf-8", "replace")) << 16 ^ len(t) for _, t in got])
                zones.append(bytes(z for z, _ in got))
                packed.append(zlib.compress("\n".join(t for z, t in got if z != SITE).encode("utf-8", "replace"), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(marks, pa.list_(pa.int64())), pa.array(zones, pa.binary()), pa.array(packed, pa.binary())],
                ["page_id", "url", "host", "path", "marks", "zones", "packed"],
            )

    fields = ("page_id", "url", "host", "marks", "zones", "packed")
    kinds = "page_id long, url string, host string, marks array<long>, zones binary, packed binary"

    def finished(zones, packed, shared):
        texts = zlib.decompress(packed).decode().split("\n") if zones else []
        kept = [i for i, z in enumerate(zones) if z != SITE]
        use = [t for i, t in zip(kept, texts, strict=False) if zones[i] == MAIN or i not in shared] or texts
        return "\n".join(use)

    def difference(batches):
        """Pages with their text; the first and last ones without it, for they have neighbours in other tasks, but with what it is made of."""
        part, held, place = TaskContext.get().partitionId(), [], 0
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        names = ["page_id", "url", "text", "n_chars", "part", "place", "host", "marks", "zones", "packed", "shared"]

        def batch(rows):
            out = []
            for (page_id, url, host, marks, zones, packed, shared, at), edge in rows:
                text = None if edge else finished(zones, packed, shared)
                out.append((page_id, url, None, None, part, at, host, marks, zones, packed, sorted(shared)) if edge else (page_id, url, text, len(text), *[None] * 7))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names)

        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in fields), strict=True):
                now = (*row, set(), place)
                place += 1
                for before in held:
                    if before[2] == now[2]:
                        i, j = common(before[3], now[3])
                        before[6].update(i)
                        now[6].update(j)
                held.append(now)
                if len(held) > neighbours:
                    out.append((first := held.pop(0), first[7] < neighbours))
            yield batch(out)
        yield batch([(row, True) for row in held])

    def finish(batches):
        for b in batches:
            text = [finished(z, p, {*s, *(m or ())}) for z, p, s, m in zip(*(b.column(c).to_pylist() for c in ("zones", "packed", "shared", "more")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    parsed = pages.select("page_id", "url", "html").mapInArrow(lean(parse), "page_id long, url string, host string, path string, marks array<long>, zones binary, packed binary")
    order = ["host", "path", "page_id"]
    found = parsed.repartitionByRange(*order).sortWithinPartitions(*order).select(*fields).mapInArrow(lean(difference), f"page_id long, url string, text string, n_chars long, part int, place long, {kinds.split(', ', 2)[2]}, shared array<int>")
    found = written(found, "differenced", "zstd")
    edges = found.where("part is not null")
    # At most 2 * neighbours rows of each task.
    rows = edges.select("part", "place", "host", "marks").orderBy("part", "place").collect() if neighbours else []
    more: list[set[int]] = [set() for _ in rows]
    for n, now in enumerate(rows):
        for k in range(max(0, n - neighbours), n):
            if rows[k]["part"] != now["part"] and rows[k]["host"] == now["host"]:
                i, j = common(rows[k]["marks"], now["marks"])
                more[k].update(i)
                more[n].update(j)
    add = [(r["part"], r["place"], sorted(m)) for r, m in zip(rows, more, strict=True) if m]
    add = pages.sparkSession.createDataFrame(add, "part int, place long, more array<int>")
    ends = edges.join(add.hint("merge"), ["part", "place"], "left").select("page_id", "url", "zones", "packed", "shared", "more").mapInArrow(lean(finish), "page_id long, url string, text string, n_chars long")
    return found.where("part is null").select("page_id", "url", "text", "n_chars").union(ends)
