"""Main text of web pages by markup zones and nearest-URL page differencing.

Every page is read once into blocks: runs of text between block-level tags,
with character references decoded. The markup puts a block into a zone: content
(inside an article or main element), chrome (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, by element, role, class or id) or
open (neither). Chrome goes.

Pages are then compared with their nearest page: within a host, pages are
sorted by URL path, and of the two neighbours the one with the longer common
path prefix is the partner (ties: the one before). The longest common
subsequence of the two pages' blocks aligns them, and what they share is
template: shared blocks in an open zone go. A shared block inside a content
zone stays, because copied articles share those; so do the blocks of a page
that shares all its open blocks with its partner, which is a copy and not a
template. A page without any open or content block has no text.

The table is range-partitioned by (host, path, page) at split points taken from
a bounded sample, so a host of any size spreads over tasks; each range also
gets copies of the one page before and after it, so every page meets its
partner. Tasks read their range in order and hold three pages at a time.

Defined cases: null and empty html give an empty text and 0; a null URL is a
host of its own, ordered by page_id; repeated rows are pages of their own; tags
that never end stop at the end of the page; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

CONTENT, OPEN, CHROME = 2, 1, 0
SPLIT_SAMPLE, PAGES_IN_RANGE = 20_000, 4_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b")
# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea select svg math object title canvas audio video".split())
_CHROME_TAGS = frozenset("nav header footer aside form button menu dialog fieldset label".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ROLES = {"navigation": CHROME, "banner": CHROME, "contentinfo": CHROME, "complementary": CHROME, "search": CHROME, "dialog": CHROME, "alert": CHROME, "alertdialog": CHROME, "form": CHROME, "menu": CHROME, "menubar": CHROME, "toolbar": CHROME, "main": CONTENT, "article": CONTENT}
# Words of class and id names; the second set counts outside content only.
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widgets?|related|recommend\w*|share|sharing|social|follow|subscribe|newsletter|signup|login|search"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|discussion|disqus|replies|respond|responses?|pagination|pager|toolbar|skip|tags|hidden|print|copyright)(?=$|[\s_-])",
    re.I,
)
_OUTER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|footer|foot|legal|side|aside|rail)(?=$|[\s_-])", re.I)
_INLINE_AD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*)(?=$|[\s_-])", re.I)
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|have|with|without|no|is|not|hide|show)[-_][\w-]*", re.I)  # names that tell of something else: has-sidebar
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CONTENT_NAME = re.compile(r"^(?:article|main|content|main-?content|article-?(?:body|content|text)|post-?(?:body|content|text)?|entry-?(?:body|content|text)?|story-?(?:body|text)?|body-?text)$", re.I)


def _zone(tag: str, attributes: str, outer: int) -> int:
    if outer == CHROME:
        return CHROME
    if tag in _CHROME_TAGS and not (tag == "header" and outer == CONTENT):
        return CHROME
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return CHROME
    role = _ROLES.get(found.get("role", "").lower())
    if role is not None:
        return role
    names = _STATE.sub("", _CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}")).strip()
    if names and tag not in ("html", "body", "article", "main"):
        if tag in _INLINE:
            return CHROME if _INLINE_AD.search(names) else outer
        if _CHROME_NAME.search(names):
            return CHROME
        if any(_CONTENT_NAME.match(n) for n in names.split()):
            return CONTENT
        if outer == OPEN and _OUTER_NAME.search(names):
            return CHROME
    if tag in ("article", "main"):
        return CONTENT
    return outer


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the page's non-empty blocks in order."""
    out: list[tuple[str, int]] = []
    part: list[str] = []
    zone_of = OPEN
    stack: list[tuple[str, int]] = []

    def flush():
        text = " ".join(html_lib.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append((text, zone_of))

    def pop(i: int):
        nonlocal zone_of
        if any(t not in _INLINE or z != zone_of for t, z in stack[i:]):
            flush()
        zone_of = stack[i][1]
        del stack[i:]

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            part.append(page[at:])
            break
        part.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            part.append(html_lib.escape(m[0][9:].removesuffix("]]>")))
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            continue
        if m[1] or m[5]:  # an end tag closes its element and all left open inside it
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                pop(i)
            elif tag not in _INLINE:
                flush()
            continue
        attributes = m[3] or m[7] or ""
        if tag in _RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                part.append(" ")
            continue
        if tag in _CLOSES_P:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), -1)
            if i >= 0 and stack[i][0] == "p":
                pop(i)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE and stack[i][0] != "p"), -1)
            if i >= 0 and stack[i][0] in same:
                pop(i)
        inner = _zone(tag, attributes, zone_of)
        if tag not in _INLINE or inner != zone_of:
            flush()
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, zone_of))
            zone_of = inner
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """The indices of ``a`` in a longest common subsequence of the lines ``a`` and ``b``."""
    out = set()
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out.add(lo)
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        out.add(len(a) - 1 - hi)
        hi += 1
    # Lines that one side lacks are in no common subsequence.
    left, right = set(a[lo : len(a) - hi]), set(b[lo : len(b) - hi])
    both = left & right
    own = [i for i in range(lo, len(a) - hi) if a[i] in both]
    other = [b[j] for j in range(lo, len(b) - hi) if b[j] in both]
    _split(a, own, other, out)
    return out


def _row(x: list[str], other: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequence of x with every prefix of other."""
    name: dict[str, int] = {}
    ys = np.array([name.setdefault(y, len(name)) for y in other])
    row = np.zeros(len(other) + 1, np.int64)
    for line in x:
        up = np.where(ys == name.get(line, -1), row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(up)
    return row


def _split(a: list[str], own: list[int], other: list[str], out: set[int]) -> None:
    """Divide and conquer over rows of lengths, so memory is linear in the lines."""
    if not own or not other:
        return
    if len(own) == 1:
        if a[own[0]] in other:
            out.add(own[0])
        return
    mid = len(own) // 2
    head = _row([a[i] for i in own[:mid]], other)
    tail = _row([a[i] for i in reversed(own[mid:])], other[::-1])[::-1]
    cut = int(np.argmax(head + tail))
    _split(a, own[:mid], other[:cut], out)
    _split(a, own[mid:], other[cut:], out)


def main_text(page: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> str:
    """The text of a page that is left after comparing it with its partner."""
    live = [(t, z) for t, z in page if z != CHROME]
    drop: set[int] = set()
    if partner is not None and any(z == OPEN for _, z in live):
        lines = [t for t, _ in live]
        common = shared(lines, [t for t, z in partner if z != CHROME])
        free = {i for i, (_, z) in enumerate(live) if z == OPEN}
        drop = common & free
        if not any(z == CONTENT for _, z in live) and drop == free:
            drop = set()  # a copy of its partner, not a page of a template
    if any(z == CONTENT for _, z in live):  # outside a marked article nothing is article
        return " ".join(t for t, z in live if z == CONTENT)
    return " ".join(t for i, (t, _) in enumerate(live) if i not in drop)


def _keyed(pages: DataFrame) -> DataFrame:
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    return pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")


def _ranges(keys: DataFrame, pages_in_range: int) -> tuple[list[tuple], list]:
    """Split points of the sorted keys, and for each range the keys just before and after it."""
    key = ["host", "path", "page_id"]
    n = keys.count()
    parts = max(1, -(-n // pages_in_range))
    sample = keys.orderBy(F.xxhash64(*key), *key).limit(SPLIT_SAMPLE).collect() if parts > 1 else []
    sample = sorted((r.host, r.path, r.page_id) for r in sample if r.page_id is not None)
    splits = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    return splits, key


def _range_of(splits: list[tuple], key: tuple) -> int:
    return bisect_right(splits, key)


def extract(pages: DataFrame, pages_in_range: int = PAGES_IN_RANGE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    spark = pages.sparkSession
    rows = _keyed(pages)
    keys = rows.select("host", "path", F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"))
    splits, key = _ranges(keys, pages_in_range)
    held = spark.sparkContext.broadcast(splits)

    def edges(it):
        low, high = {}, {}
        for b in it:
            for k in zip(*(b.column(c).to_pylist() for c in key), strict=True):
                r = _range_of(held.value, k)
                low[r], high[r] = min(low.get(r, k), k), max(high.get(r, k), k)
        for r in low:
            yield pa.RecordBatch.from_pylist([{"range": r, **{f"{c}_{n}": x for n, k in (("lo", low[r]), ("hi", high[r])) for c, x in zip(key, k, strict=True)}}])

    kind = "range bigint, host_lo string, path_lo string, page_id_lo bigint, host_hi string, path_hi string, page_id_hi bigint"
    found = keys.mapInArrow(edges, kind).groupBy("range").agg(F.min(F.struct("host_lo", "path_lo", "page_id_lo")).alias("lo"), F.max(F.struct("host_hi", "path_hi", "page_id_hi")).alias("hi"))
    ends = [(r.range, tuple(r.lo), tuple(r.hi)) for r in found.orderBy("range").collect()] if splits else []  # a row for each range
    also: dict[tuple, list[int]] = {}
    for (r, _, hi), (s, lo, _) in zip(ends, ends[1:], strict=False):
        also.setdefault(hi, []).append(s)
        also.setdefault(lo, []).append(r)
    state = spark.sparkContext.broadcast((splits, also))

    def read(it):
        splits, also = state.value
        schema = lambda id_type: pa.schema([("range", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("guest", pa.bool_()), ("page_id", id_type), ("url", pa.string()), ("texts", pa.list_(pa.string())), ("zones", pa.list_(pa.int8()))])
        for b in it:
            out = []
            for x in b.to_pylist():
                k = (x["host"], x["path"], -1 if x["page_id"] is None else int(x["page_id"]))
                own = [(t, z) for t, z in blocks(x["html"]) if z != CHROME]
                row = {"host": k[0], "path": k[1], "key": k[2], "page_id": x["page_id"], "url": x["url"], "texts": [t for t, _ in own], "zones": [z for _, z in own]}
                out.append(row | {"range": _range_of(splits, k), "guest": False})
                out += [row | {"range": r, "guest": True} for r in also.get(k, [])]
            yield pa.RecordBatch.from_pylist(out, schema(b.schema.field("page_id").type))

    id_kind = pages.schema["page_id"].dataType.simpleString()
    read_kind = f"range bigint, host string, path string, key bigint, guest boolean, page_id {id_kind}, url string, texts array<string>, zones array<tinyint>"
    spread = rows.mapInArrow(read, read_kind).repartition(max(1, len(splits) + 1), "range").sortWithinPartitions("range", "host", "path", "key", "url")

    def compare(it):
        before = this = None
        done = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for b in it:
            done = done.set(0, b.schema.field("page_id"))
            out = []
            for x in b.to_pylist():
                x["blocks"] = list(zip(x.pop("texts"), x.pop("zones"), strict=True))
                out += _finish(before, this, x)
                before, this = this, x
            if out:
                yield pa.RecordBatch.from_pylist(out, done)
        out = _finish(before, this, None)
        if out:
            yield pa.RecordBatch.from_pylist(out, done)

    return spread.mapInArrow(compare, f"page_id {id_kind}, url string, text string, n_chars bigint")


def _common(a: dict, b: dict | None) -> int:
    """The length of the common path prefix; -1 for another range or host."""
    if b is None or a["range"] != b["range"] or a["host"] != b["host"]:
        return -1
    n = 0
    for x, y in zip(a["path"], b["path"], strict=False):
        if x != y:
            break
        n += 1
    return n


def _finish(before: dict | None, page: dict | None, after: dict | None) -> list[dict]:
    if page is None or page["guest"]:
        return []
    x, y = _common(page, before), _common(page, after)
    partner = None if max(x, y) < 0 else before if x >= y else after
    text = main_text(page["blocks"], None if partner is None else partner["blocks"])
    return [{"page_id": page["page_id"], "url": page["url"], "text": text, "n_chars": len(text)}]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
