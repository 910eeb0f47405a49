"""Main text of web pages by differencing each page with the nearest page of its host.

Pages are sorted by host and URL path, so that those of one template adjoin. A page's lines (its blocks of text, in
order) are aligned with those of its nearer neighbour, the one whose path shares the longer beginning, by a longest
common subsequence; lines that both have are the template's and are deleted. Markup that names its part (menus,
footers, forms, adverts, ...) goes as well. Lines inside an article or main element stay although a neighbour has them
too: articles share passages and licence lines that belong to them. All other lines, whether the page has such an
element or not, stay where the neighbour lacks them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import on_executors

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*+>|[^<]++|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)")
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
#: Elements whose content is raw, elements that aren't the article, elements within a line, and what class, id or role call such parts.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
APART = frozenset("head nav header footer aside form button select dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CALLED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside comment comments disqus share sharing social related newsletter subscribe widget pagination pager toolbar complementary contentinfo search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends an open p; and which elements the start of another ends, with those that a search for them doesn't leave.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre section summary table ul".split())
_CELLS = frozenset("table td th caption".split())
_LISTS = frozenset("ul ol menu dl table td th caption section article main aside nav blockquote".split())
SIBLINGS = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _LISTS),
    "dd": (frozenset(["dt", "dd"]), _LISTS),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())

Line = tuple[str, bool, bool]  # the text, whether its markup names it no part of the article, whether it is in an article or main


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, references decoded, white space made one blank; empty ones are left out.

    A tag ends at the first `>` outside of quotes. After a tag that never ends so, tags end at the first `>` of all, and
    after the last `>` there are none: what looks like their beginning is text. So no place is read more than twice.
    """
    out: list[tuple[str, bool, bool, bool]] = []
    buffer: list[str] = []
    opened: list[str] = []  # the open elements, from the outermost
    count: defaultdict[str, int] = defaultdict(int)  # how often each is open
    # How many are open with the outermost that isn't the article, for pages that name their article and for those that don't; open articles; the raw element.
    apart, alone, main, raw = 0, 0, 0, ""

    def close() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, bool(apart), bool(alone), main > 0))

    def end(names: frozenset[str], within: frozenset[str]) -> None:
        """The innermost of these elements ends, and all in it, unless it is outside of one of the others."""
        nonlocal apart, alone, main
        if not any(count[n] for n in names):
            return
        at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i] in names or opened[i] in within), -1)
        if at < 0 or opened[at] not in names:
            return
        for name in opened[at:]:
            count[name] -= 1
        del opened[at:]
        apart, alone = apart if apart <= at else 0, alone if alone <= at else 0
        main = count["article"] + count["main"]

    at, pattern, last_end = 0, _TOKEN, page.rfind(">")
    while at < len(page):
        if raw:
            last = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw = (last.end() if last else len(page)), ""
            continue
        token = pattern.match(page, at)
        if token[0] == "<" and _TAG.match(page, at):  # a tag that doesn't end
            if pattern is _TOKEN and at < last_end:
                pattern = _PLAIN
                continue
            buffer.append(page[at:])
            break
        at = token.end()
        said = token[0]
        if said[0] != "<" or said == "<":
            buffer.append(said)
            continue
        tag = _TAG.match(said)
        if not tag:
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if name in RAW:
            if not closing and not said.endswith("/>"):
                raw = name
            continue
        if name in INLINE:
            continue
        close()
        if not closing and name in ENDS_P:
            end(frozenset(["p"]), _CELLS | {"button"})
        if name in VOID or said.endswith("/>") or name in ("html", "body"):
            continue
        if closing:
            end(HEADINGS if name in HEADINGS else frozenset([name]), frozenset(["table"]) if name in _TABLE else _LISTS if name == "li" else _CELLS)
            continue
        if name in SIBLINGS:
            end(*SIBLINGS[name])
        opened.append(name)
        count[name] += 1
        element, free = name in APART and not (main and name == "header"), name not in HEADINGS and name != "main"
        if not apart and (element or free and _called(said, main > 0 or name == "article")):
            apart = len(opened)
        if not alone and (element or free and _named(said)):
            alone = len(opened)
        if name in ("article", "main"):
            main += 1
    close()
    # Where an article is named, what lies outside and is called by such a word isn't it; elsewhere the article may be called so in part.
    named = any(x[3] for x in out)
    return [(text, apart if named else alone, main) for text, apart, alone, main in out]


def _called(tag: str, whole: bool) -> bool:
    """Whether class or role, or outside of articles id too, have one of the words; whole: whether a class or role is one."""
    if whole:
        return any(part.lower() in CALLED for m in _MARKED.finditer(tag) if m[0][:2].lower() != "id" for part in (m[1] or m[2] or m[3] or "").split())
    return any(part.lower() in CALLED for m in _MARKED.finditer(tag) for part in _PART.findall(m[1] or m[2] or m[3] or ""))


def _named(tag: str) -> bool:
    """Whether a class, id or role is one of the words or ends with one (`site-footer`, but not `related-work`)."""
    return any((_PART.findall(part) or [""])[-1].lower() in CALLED for m in _MARKED.finditer(tag) for part in (m[1] or m[2] or m[3] or "").split())


def common(one: list[str], other: list[str]) -> set[int]:
    """Places in `one` of a longest common subsequence with `other`.

    Equal beginnings and ends belong to it, and lines that only one has do not. Of the rest that subsequence is taken
    whose places in `one` come first: the first place that any longest one has, then the first after it, and so on. This
    holds for pages of any size. Bits of long integers stand for the lines of `other`.
    """
    begin, end = 0, 0
    least = min(len(one), len(other))
    while begin < least and one[begin] == other[begin]:
        begin += 1
    while end < least - begin and one[-1 - end] == other[-1 - end]:
        end += 1
    found = {*range(begin), *range(len(one) - end, len(one))}
    both = set(one[begin : len(one) - end]) & set(other[begin : len(other) - end])
    place = [i for i in range(begin, len(one) - end) if one[i] in both]
    return found | {place[i] for i in _first_places([one[i] for i in place], [line for line in other[begin : len(other) - end] if line in both])}


def _first_places(one: list[str], other: list[str]) -> set[int]:
    """The first places in `one` of a longest common subsequence.

    row(i) has a bit for each line of `other`, from the last: it is 0 if the line makes the common subsequence of one[i:]
    and what follows in `other` longer. Rows are made from the last on; each so many-th is kept, and those between
    are made again when they are needed, so that memory grows with the root of the page.
    """
    n, m = len(one), len(other)
    if not n or not m:
        return set()
    where: defaultdict[str, int] = defaultdict(int)
    places: defaultdict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(other):
        where[line] |= 1 << (m - 1 - j)
        places[line].append(j)
    full, step = (1 << m) - 1, isqrt(n) + 1

    def before(row: int, line: str) -> int:
        hit = row & where[line]
        return (row + hit | row - hit) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = before(row, one[i])
        if i % step == 0:
            kept[i] = row
    longest = lambda row, j: m - j - (row & ((1 << (m - j)) - 1)).bit_count()  # noqa: E731  of what row stands for and other[j:]
    found, j, left = set(), 0, longest(row, 0)
    for first in range(0, n, step):
        last = min(first + step, n)
        rows = [kept[last]]
        for i in range(last - 1, first, -1):
            rows.append(before(rows[-1], one[i]))
        for i in range(first, last):
            if not left:
                return found
            after = rows.pop()  # row(i + 1)
            own = places[one[i]]
            k = bisect_left(own, j)
            if k < len(own) and longest(after, own[k] + 1) == left - 1:
                found.add(i)
                j, left = own[k] + 1, left - 1
    return found


def main_text(page: list[Line], neighbour: list[Line] | None) -> str:
    """The page's own lines: those in its article or main elements, and of the others those that its neighbour lacks. If nothing would be left, as for two copies of a page, its unnamed lines stay."""
    shared = common([x[0] for x in page], [x[0] for x in neighbour]) if neighbour else set()
    kept = [text for i, (text, apart, main) in enumerate(page) if not apart and (main or i not in shared)]
    if not kept:
        kept = [text for text, apart, _ in page if not apart]
    return " ".join(kept)


def _beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by host and path; each is answered when the next is known, but for guests, which are neighbours only."""

    def rows():
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True)

    def answered():
        before = now = None
        for row in rows():
            after = (*row[:4], row[5], lines_of(row[4]))
            if now and not now[4]:
                yield now, before, after
            before, now = now, after
        if now and not now[4]:
            yield now, before, None

    out: list[list] = [[], [], []]
    for now, before, after in answered():
        near = [x for x in (before, after) if x and x[0] == now[0] and x[5] != now[5]]  # a copy has the page's own lines too
        best = max(near, key=lambda x: _beginning(x[1], now[1]), default=None)
        for column, value in zip(out, (now[2], now[3], main_text(now[5], best and best[5])), strict=True):
            column.append(value)
        if len(out[0]) >= 256:
            yield _batch(out)
            out = [[], [], []]
    if out[0]:
        yield _batch(out)


def _batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html).

    A null html is an empty one, whose text is empty. A null url counts as one of an unnamed host. Pages are dealt to
    tasks by ranges of (host, path, page_id), so a host of any size is spread; the first and the last page of a range
    are also guests of the ranges before and after it, so that the ranges' number and cuts change no row. Other columns
    are ignored.
    """
    spark = pages.sparkSession
    on_executors(spark)
    part = lambda i: F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", i), F.lit(""))
    rows = pages.select(F.lower(part(1)).alias("host"), part(2).alias("path"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    # Without nulls, so that it is compared alike everywhere; rows with equal keys have equal pages.
    key = F.struct("host", "path", F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("url", F.lit("")).alias("at"), F.xxhash64("html").alias("print"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    edges = _edges(rows.select(key.alias("key")), parts)
    e = F.get("edges", F.col("range"))
    before = F.when(e["first"].eqNullSafe(F.col("key")) & e["after_own"], F.array(F.col("range") - 1))
    after = F.when(e["last"].eqNullSafe(F.col("key")) & e["before_own"], F.array(F.col("range") + 1))
    none = F.array().cast("array<int>")
    to = F.concat(F.array("range"), F.coalesce(before, none), F.coalesce(after, none))
    rows = rows.withColumn("key", key).crossJoin(F.broadcast(edges)).withColumn("range", _range_of(F.col("key"), F.col("edges")))
    dealt = rows.select("key", "page_id", "url", "html", "range", F.explode(to).alias("to"))
    near = dealt.repartitionById(parts, "to").sortWithinPartitions("key")
    near = near.select("key.host", "key.path", "page_id", "url", "html", (F.col("to") != F.col("range")).alias("guest"))
    found = near.mapInArrow(_extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def _edges(keys: DataFrame, parts: int) -> DataFrame:
    """One row, edges: by range, in order, an array of its first and its last key and whether the range before or after it has pages of the same host there."""
    ranged = keys.repartitionByRange(parts, "key").select(F.spark_partition_id().alias("part"), "key")
    # One row for each of the ranges, of which there are no more than tasks.
    found = sorted(ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect(), key=lambda r: r["part"])
    row = []
    for i, r in enumerate(found):
        after = i > 0 and found[i - 1]["last"]["host"] == r["first"]["host"]
        before = i + 1 < len(found) and found[i + 1]["first"]["host"] == r["last"]["host"]
        row.append((tuple(r["first"]), tuple(r["last"]), after, before))
    kind = "struct<host:string,path:string,id:bigint,at:string,print:bigint>"
    return keys.sparkSession.createDataFrame([(row,)], f"edges array<struct<first:{kind},last:{kind},after_own:boolean,before_own:boolean>>")


def _range_of(key: Column, edges: Column) -> Column:
    """The number of the last range whose first key is at most the key, by halving."""
    step = lambda low, width: F.when(F.get(edges, low + width)["first"] <= key, low + width).otherwise(low)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.call_function("shiftright", F.lit(1 << 20), i)), F.lit(0), step)
