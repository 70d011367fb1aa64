"""Main text of web pages by nearest-URL page differencing.

Pages are dealt and sorted by (host, path, query), so every page lies next to the
pages of its host with the nearest urls; a host of any size spreads over parts.
A page's neighbour is the nearest page before it with another url and other lines,
or without one the nearest such page after it; copies never face each other.
All lines of a page (its blocks, menus and footers too) are aligned with its
neighbour's by longest common subsequence, and shared lines are deleted as template
text.  Shared lines of a main element stay: neighbours may carry near copies of one
article or repeat a sentence, and a list of links beside one article names another's title.
From what is left, lines go that markup itself declares as menu, header, footer,
sidebar, notice, advert, form or comment, as these may differ from page to page.

Defined results: null html gives an empty text; pages without a usable url have
no neighbour; pages of one url lie in order of page_id and are not each other's
neighbours, nor are pages without lines anyone's; repeated rows give
repeated results; unclosed elements end where an enclosing or a main
element says so, and a skipped one that neither ends is not skipped; an article
or main element outside another, and an element that holds one, is not skipped
for its class, id, role or label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.session import materialise, ship_package

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|select|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text, and words in class, id, role or label that say the same of any element.
SKIPPED = frozenset("head nav header footer aside form button menu dialog fieldset".split())
_WORD = (
    r"ads?|advert(?:s|ise[a-z]*|ising)?|banner|sponsor(?:s|ed|ship)?|promo(?:s|tions?|ted)?|cookies?|consent|notices?|alert|gdpr|sidebar|side|widget|nav(?:s|bar|box|igation|menu|list|links?)?|menu|breadcrumbs?|"
    r"footer|header|masthead|toolbar|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search(?:box|form|bar)?|form|popup|modal|overlay|pagination|pager|tags|"
    r"contentinfo|complementary"
)
#: A token made only of such words and of words for place or shape: it names the element, unlike has-sidebar,
#: search-results, side-by-side or entry-header.
SKIPPED_NAME = re.compile(
    r"(?!search[-_](?:list|items?|posts|articles|stories))(?!side(?:bar)?[-_](?:container|wrapper|wrap))"
    r"(?:(?:site|global|main|primary|secondary|top|bottom|left|right|mobile|desktop)[-_]|(?:post|article|entry|page)[-_](?!header|masthead|side|form|alert|notice|banner))*"
    rf"(?:{_WORD})(?:[-_](?:{_WORD}|left|right|top|bottom|primary|secondary|bar|box|block|list|items?|container|wrapper|wrap|section|area|panel|slot|unit|links?|buttons?|icons?|posts|articles|stories|inner|body|toggle|\d+))*\Z",
    re.I,
)
#: Words that say it behind any word before them but these, and names in one word.
LOUD = r"ads?|advert(?:s|isements?|ising)?|sponsored|promos?|cookies?|sidebar|nav|navigation|menu|breadcrumbs?|comments?|disqus|replies|share|sharing|social|related|recommended|newsletter"
LOUD_NAME = re.compile(rf"(?!(?:[a-z0-9]+[-_])*(?:has|with|without|no|not|layout|cols?|columns?)[-_])[a-z0-9]+(?:[-_][a-z0-9]+)*?[-_](?:{LOUD})\Z|comment(?:list|s?area|form)|adsby[a-z]+|ad(?:box|slot|unit|block)\Z", re.I)
#: Elements whose end authors may leave out: the start tags that end them, and the elements such a tag does not reach across.
SELF_CLOSING = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
_CELLS, _PARTS, _TERMS = (("td", "th"), ("tr", "table")), (("thead", "tbody", "tfoot"), ("table",)), (("dt", "dd"), ("dl",))
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": _TERMS, "dd": _TERMS, "option": (("option",), ("datalist",)), "td": _CELLS, "th": _CELLS,
    "tr": (("tr",), ("table",)), "thead": _PARTS, "tbody": _PARTS, "tfoot": _PARTS, "body": (("head",), ()),
}
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())


def _attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag by name; the first of a name counts."""
    out: dict[str, str] = {}
    if len(tag.split(None, 1)) > 1:
        for k, v in ATTRIBUTE.findall(tag, TAG.match(tag).end()):
            out.setdefault(k.lower(), v.strip("\"'"))
    return out


def _named(name: str, attributes: dict[str, str]) -> bool:
    """Whether a whole class, id or role token, or the whole label, names an element that is never main text."""
    tokens = [t for k in ("class", "id", "role") for t in attributes.get(k, "").split()]
    return any(SKIPPED_NAME.match(t) or LOUD_NAME.match(t) for t in [*tokens, "-".join(attributes.get("aria-label", "").split())])


class _Element:
    """A start tag: place of the tag and of its end among the page's tags, and whether its own end tag or an enclosing one gave it."""

    __slots__ = ("name", "start", "end", "own", "enclosed", "named", "hidden", "in_main")

    def __init__(self, name: str, start: int, attributes: dict[str, str], in_main: bool):
        self.name, self.start, self.end, self.own, self.enclosed = name, start, -1, False, False
        self.named = bool(attributes) and name not in ("body", "html") and _named(name, attributes)
        self.hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        self.in_main = in_main


class _Open:
    """The stack of open elements, with the places of each name for steps of constant cost."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, *names: str) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def push(self, e: _Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        if e.name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def cut(self, place: int, step: int, enclosed: bool) -> None:
        """End every element from ``place`` on."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.places[e.name].pop()
            if e.name not in INLINE:
                self.blocks.pop()
            e.end, e.enclosed = step, enclosed

    def end(self, name: str, step: int) -> None:
        at = self.last(name)
        wall = (self.blocks[-1] if self.blocks else -1) if name in INLINE else -1 if name in TABLE else self.last("td", "th", "caption")
        if at > wall or (at >= 0 and name in ("body", "html")):
            self.stack[at].own = True
            self.cut(at, step, name not in ("body", "html"))

    def start(self, name: str, step: int) -> None:
        """End what a start tag of this name ends without an end tag."""
        if name in ENDS_P and self.blocks and self.stack[self.blocks[-1]].name == "p":
            self.cut(self.blocks[-1], step, True)
        if (like := IMPLIED.get(name)) and (at := self.last(*like[0])) > self.last(*like[1]):
            self.cut(at, step, True)


def page_lines(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """Blocks of a page in order, whether each lies in a main element, and whether markup declares it no main text."""
    texts: list[str] = []
    breaks: list[bool] = []
    started: dict[int, _Element] = {}
    opened, at = _Open(), 0
    for step, m in enumerate(PART.finditer(page)):
        texts.append(page[at : m.start()])
        at = m.end()
        tag = TAG.match(m.group())
        if tag is None or m.group(1):
            breaks.append(False)
            continue
        name = tag.group(2).lower()
        breaks.append(name not in INLINE)
        if tag.group(1):
            opened.end(name, step)
        else:
            opened.start(name, step)
            if name not in VOID:
                e = started[step] = _Element(name, step, _attributes(m.group()), opened.last("article", "main") >= 0)
                opened.push(e)
    opened.cut(0, len(texts), False)
    tail = page[at:]
    texts.append(tail[: tail.rfind("<")] if re.search(r"<[!/a-zA-Z][^<>]*\Z", tail) else tail)

    mains = [s for s, e in started.items() if e.name in ("article", "main") and not (e.named and e.in_main)]
    lines, inside, declared, buffer = [], [], [], []
    #: End, skipped and in a main element, of the elements around this step that decide it.
    around = [(len(texts), False, False)]

    def close() -> None:
        if buffer:
            if line := " ".join(entities.unescape("".join(buffer)).split()):
                lines.append(line)
                inside.append(around[-1][2])
                declared.append(around[-1][1])
            buffer.clear()

    for step, text in enumerate(texts):
        buffer.append(text)
        if step == len(breaks):
            break
        if breaks[step] or (around[-1][0] <= step and around[-1][1]):
            close()
        while around[-1][0] <= step:
            around.pop()
        if (e := started.get(step)) is None:
            continue
        _, skipped, in_main = around[-1]
        if e.name in ("article", "main") and not (e.named and e.in_main) and not e.hidden:
            around.append((e.end, False, True))
            continue
        following = bisect.bisect(mains, step)
        main_at = mains[following] if following < len(mains) else len(texts)
        of_kind = e.name in SKIPPED and not (e.name == "header" and in_main)
        if skipped or not (of_kind or e.hidden or (e.named and not (e.own and main_at < e.end))):
            continue
        end = e.end if e.own else min(e.end, main_at)
        if e.own or e.enclosed or main_at < e.end or e.name in SELF_CLOSING:
            close()
            around.append((end, True, in_main))
    close()
    return lines, inside, declared


def aligned(a: list[str], b: list[str]) -> list[int]:
    """Per line of ``a`` its line of ``b`` in a longest common subsequence, or -1.

    Bit-parallel rows over the lines that occur in both: bit i of a row is 0 where
    line i of ``a`` raises the length reached so far.
    """
    both = set(a) & set(b)
    out = [-1] * len(a)
    places, others = ([i for i, x in enumerate(c) if x in both] for c in (a, b))
    masks: dict[str, int] = {}
    for bit, i in enumerate(places):
        masks[a[i]] = masks.get(a[i], 0) | 1 << bit
    full, row, rows = (1 << len(places)) - 1, (1 << len(places)) - 1, []
    for k in others:
        hit = row & masks[b[k]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(places), len(others)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> (i - 1) & 1):
                i -= 1
                out[places[i]] = others[j]
    return out


def shared(page: tuple, neighbour: tuple) -> list[bool]:
    """Which lines of a page its neighbour shows to be template text."""
    lines, inside, declared = page
    return [p >= 0 and (d or not m) for p, m, d in zip(aligned(lines, neighbour[0]), inside, declared)]


def decisions(page: tuple, neighbour: tuple | None) -> list[str]:
    """Per line: ``shared`` (deleted by differencing), then ``markup`` (declared no main text), or ``main``."""
    common = shared(page, neighbour) if neighbour else [False] * len(page[0])
    return ["shared" if c else "markup" if d else "main" for c, d in zip(common, page[2])]


def main_text(page: tuple, neighbour: tuple | None) -> str:
    """Lines that neither differencing nor markup takes away."""
    return " ".join(x for x, why in zip(page[0], decisions(page, neighbour)) if why == "main")


def digest(page: tuple) -> str | None:
    """Digest of the lines that markup leaves; None without any."""
    lines = [x for x, d in zip(page[0], page[2]) if not d]
    return hashlib.blake2b("\n".join(lines).encode("utf-8", "replace"), digest_size=16).hexdigest() if lines else None


class Near:
    """Pages of one host on one side of a place in the order, as far as a page there can need them.

    ``latest`` holds the nearest page and the nearest one with other lines, ``outside`` the same
    from before the nearest url's run.  Pages are (digest, anything).
    """

    def __init__(self):
        self.host, self.url, self.latest, self.outside = "", None, [], []

    def add(self, host: str, url: str, page: tuple) -> None:
        if host != self.host:
            self.host, self.url, self.latest, self.outside = host, None, [], []
        if url != self.url:
            self.url, self.outside = url, self.latest
        if not self.latest or self.latest[0][0] != page[0]:
            self.latest = [page, *self.latest[:1]]

    def absorb(self, host: str, url: str, latest: list[tuple], outside: list[tuple]) -> None:
        """Add a part of the order by what another ``Near`` kept of it."""
        for page in reversed(outside):
            self.add(host, f"not {url}", page)
        for page in reversed(latest):
            self.add(host, url, page)

    def other(self, host: str, url: str, its_digest: str) -> tuple | None:
        """The nearest page of the host with another url and other lines."""
        if not host or host != self.host:
            return None
        return next((x for x in (self.outside if url == self.url else self.latest) if x[0] != its_digest), None)

    def kept(self) -> tuple:
        return self.host, self.url, self.latest, self.outside


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per part of the order: its first key and what its last and first host leave to the parts after and before."""
    tail, first, head = Near(), None, None
    for b in batches:
        for host, path, query, page, tie, text in zip(b["_host"], b["_path"], b["_query"], b["_id"], b["_tie"], b["_digest"]):
            first = first or [host, path, query, page, tie]
            if not host or text is None:
                continue
            url, ref = path + query, (text, page, tie)
            tail.add(host, url, ref)
            head = head or (host, url, [], [])
            if host == head[0]:
                for kept in (head[2], head[3]) if url != head[1] else (head[2],):
                    if not kept or len(kept) == 1 and kept[0][0] != text:
                        kept.append(ref)
    if first:
        yield pd.DataFrame([(TaskContext.get().partitionId(), json.dumps([first, tail.kept() if tail.host else None, head]))], columns=["part", "kept"])


def _around(rows: list) -> list[tuple[tuple, tuple]]:
    """What lies before and after each part of the order."""
    def walk(kept: list) -> list[tuple]:
        near, out = Near(), []
        for x in kept:
            out.append(near.kept())
            if x:
                near.absorb(*x)
        return out

    return list(zip(walk([x[1] for x in rows]), reversed(walk([x[2] for x in reversed(rows)]))))


def _texts(around: dict[int, tuple[tuple, tuple]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of whole parts in order; the pages around a part come before its own."""
    columns = ["page_id", "url", "text", "n_chars"]
    part, edge, out = None, {}, []
    before, after, waiting, urls, digests = Near(), Near(), [], set(), set()

    def put(row: tuple, neighbour: tuple | None) -> None:
        text = main_text(row[4], neighbour and neighbour[1])
        out.append((row[0], row[1], text, len(text)))

    def settle(neighbour) -> None:
        """Write the waiting pages for which ``neighbour`` gives a page; keep the others."""
        kept = []
        for row in waiting:
            found = neighbour(row)
            put(row, found or None) if found is not None else kept.append(row)
        waiting[:] = kept
        urls.clear(), digests.clear()
        urls.update(r[2] for r in kept), digests.update(r[3] for r in kept)

    def side(kept: tuple) -> Near:
        near = Near()
        near.host, near.url = kept[:2]
        near.latest, near.outside = ([(x[0], edge[x[0]]) for x in pages] for pages in kept[2:])
        return near

    def close() -> None:
        if waiting:
            last = side(around[part][1])
            settle(lambda r: last.other(before.host, r[2], r[3]) or ())

    for b in batches:
        for page_id, address, page, host, path, query, its_part, context in zip(*(b[c] for c in ("page_id", "url", "html", "_host", "_path", "_query", "_part", "_context"))):
            if its_part != part:
                close()
                part, edge, before = its_part, {}, None
            lines = page_lines(page or "")
            its_digest = digest(lines)
            if context:
                edge[its_digest] = lines
                continue
            before = before or side(around[part][0])
            url = path + query
            if before.latest and before.latest[0][1] == lines:
                lines = before.latest[0][1]
            row = (page_id, address, url, its_digest, lines)
            if not host or its_digest is None:
                put(row, None)
                continue
            if waiting and host != before.host:
                settle(lambda r: ())
            # What waits has one url or one digest, so that a page with it settles nothing.
            if waiting and not (urls == {url} or digests == {its_digest}):
                settle(lambda r: (its_digest, lines) if r[2] != url and r[3] != its_digest else None)
            if (found := before.other(host, url, its_digest)) is not None:
                put(row, found)
            else:
                waiting.append(row)
                urls.add(url), digests.add(its_digest)
            before.add(host, url, (its_digest, lines))
        yield pd.DataFrame(out, columns=columns)
        out.clear()
    close()
    yield pd.DataFrame(out, columns=columns)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  Action: digests of all pages in order.

    The digests tell which pages lie around each part of the order; those are sent along with
    the part, so neighbours do not depend on where parts begin.
    """
    spark = pages.sparkSession
    ship_package(spark)
    url, place = F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?"
    near = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(url, place, 1)).alias("_host"),
        F.regexp_extract(url, place, 2).alias("_path"),
        F.regexp_extract(url, place, 3).alias("_query"),
        F.xxhash64(html_col).alias("_tie"),
    )
    id_type = near.schema["page_id"].dataType
    keys = ("_host", "_path", "_query", "page_id", "_tie")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [digest(page_lines(page or "")) for page in b["html"]]
            yield b.drop(columns="html").assign(_digest=pd.Series(texts, index=b.index, dtype=object))

    small = near.select("_host", "_path", "_query", F.col("page_id").cast("string").alias("_id"), "_tie", "html")
    small = materialise(small.mapInPandas(digests, "_host string, _path string, _query string, _id string, _tie bigint, _digest string"))
    order = ["_host", "_path", "_query", F.col("_id").cast(id_type), "_tie"]
    parts = small.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = [json.loads(r.kept) for r in sorted(parts.mapInPandas(_edges, "part int, kept string").collect(), key=lambda r: r.part)]
    around = dict(enumerate(_around(rows)))

    whole = isinstance(id_type, IntegralType)

    def place_of(host: str, path: str, query: str, page: object, tie: object) -> tuple:
        """A key in Spark's order, nulls first; strings lie in code-point order in both."""
        page = None if page is None or page != page else int(page) if whole else str(page)
        return host, path, query, page is not None, page if page is not None else 0 if whole else "", tie is not None, 0 if tie is None else int(tie)

    firsts = [place_of(*x[0]) for x in rows[1:]]

    @F.pandas_udf("int")
    def part_of(host: pd.Series, path: pd.Series, query: pd.Series, page: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect(firsts, place_of(*k)) for k in zip(host, path, query, page, tie)], dtype="int32")

    part = part_of("_host", "_path", "_query", F.col("page_id").cast("string"), "_tie")
    near = near.withColumn("_part", part).withColumn("_context", F.lit(False))
    sent = {(ref[1], ref[2], k) for k, sides in around.items() for x in sides for pages_ in x[2:] for ref in pages_}
    wanted = spark.createDataFrame(sorted(sent, key=str), "_id string, _tie bigint, _to int")
    extra = (
        near.join(F.broadcast(wanted), (F.col("page_id").cast("string").eqNullSafe(F.col("_id"))) & (near["_tie"] == wanted["_tie"]))
        .drop(wanted["_tie"])
        .select(*(c for c in near.columns if c not in ("_part", "_context")), F.col("_to").alias("_part"), F.lit(True).alias("_context"))
        .dropDuplicates(["_part", "page_id", "_tie"])
    )
    fields = f"page_id {dict(near.dtypes)['page_id']}, url string, text string, n_chars bigint"
    dealt = near.unionByName(extra).repartitionById(max(len(rows), 1), F.col("_part"))
    return dealt.sortWithinPartitions("_part", F.col("_context").desc(), *keys).mapInPandas(partial(_texts, around), fields)
