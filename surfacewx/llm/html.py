"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, and each page is compared with the
page before and the page after it that are not copies of it. Pages become lines (the blocks of text
that a browser would set apart); the lines of two neighbours are aligned by a
longest common subsequence, and what both share is template: shared lines are
deleted.

That decides only on pages without text in an ``article`` or ``main`` element.
Where a page has some, markup replaces differencing: all lines in it that the
markup does not name as menus, headers, footers, adverts and the like are its
text, even if a neighbour quotes them, and all other lines go, even if no
neighbour shares them. Lines named so go on every page.

Only hashes of lines are compared. Pages are dealt to tasks in ranges of the
order, cut by rows and not by host, so a host with a third of all pages is
many tasks; the rows at a cut go to both sides, and every page meets both its
neighbours wherever the cuts are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import mapped, slices

ROWS_PER_RANGE = 2000
MAX_RANGES = 4096

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script search section select style summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
#: A start tag that ends an open element: tag to the tags it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Start tags that do not end an open paragraph.
INSIDE_P = VOID - {"hr"} | frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp script small span strike strong style sub sup time tt u var svg".split())
HIDDEN = frozenset("head title script style template noscript iframe object svg math canvas audio video select textarea button datalist".split())
CHROME = frozenset("nav aside footer dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar alertdialog".split())
#: Whole tokens of a class or id.
NAMES = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|ad[_-](?:banner|box|container|slot|unit|wrapper)|sponsor\w*|promo\w*|banner|cookies?|cookie[_-](?:banner|bar|consent|notice)|consent|notices?|alert|side-bar|(?:(?:site|page|main|top|bottom|left|right|global)[_-])?"
    r"(?:sidebar|menu|navbar|nav|navigation|footer)|breadcrumbs?|comments?|replies|respond|disqus|share|sharing|social|newsletter|subscribe|related|recommended|popup|modal|overlay|pagination|"
    r"pager|skip-link|toolbar|login|signup)(?:$|\s)",
    re.I,
)
#: As above, but an article may have a header of its own.
HEADERS = re.compile(r"(?:^|\s)(?:masthead|(?:site|page|main|top|global)[_-]header|header)(?:$|\s)", re.I)
# What makes an element chrome: nothing, a form round it, a class or id, its tag or role.
BY_FORM, BY_NAME, BY_TAG = 1, 2, 3
# Whether inside an article: one in its own right, or one inside something that a class or id names as chrome.
OWN, NAMED = 1, 2
#: Marked sections that the standard parser takes.
KNOWN_SECTION = re.compile(r"<!\[(temp|cdata|ignore|include|rcdata|if|else|endif)(?![a-z0-9_.-])\s*\S", re.I)
#: What ends a comment, a marked section and a conditional one.
COMMENT_END, SECTION_END, CONDITION_END = re.compile(r"--!?\s*>"), re.compile(r"\]\s*\]\s*>"), re.compile(r"\]\s*>")
#: Character references with more digits than Python reads: leading zeros, and numbers beyond Unicode.
ZEROS, BEYOND = re.compile(r"&#0{8,}(?=[0-9])"), re.compile(r"&#0*[1-9][0-9]{7,};?")
# Line flags.
TEXT, CHROME_LINE, LOOSE, NAMED_TEXT = 0, 1, 2, 3
#: Pages that share this part of their characters, either way, are copies.
COPY = 0.9
LENGTH = np.uint64(0xFFFF)


class Lines(HTMLParser):
    """Lines of a page: ``(text, flag)``; ``LOOSE`` is neither inside an article nor named as something else.

    An article or main element starts afresh inside a form, and main inside
    anything that is chrome only by class or id; an article there gives
    ``NAMED_TEXT``, the page's text if no other article has any.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, and whether inside: hidden, chrome, article
        self.at: dict[str, list[int]] = {}  # tag to its places in ``open``
        self.last: dict[tuple, int] = {}  # where a pattern last matches
        self.parts: list[str] = []

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            hidden, chrome, article = self.state()
            if text and not hidden:
                self.lines.append((text, CHROME_LINE if chrome else (LOOSE, TEXT, NAMED_TEXT)[article]))

    def end(self, tags: set | frozenset, stop: frozenset) -> None:
        """Close the innermost open element of ``tags`` that no element of ``stop`` encloses."""
        i = max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)
        if i < 0 or (i < len(self.open) - 1 and any(self.at[t][-1] > i for t in stop if self.at.get(t))):
            return
        outside = self.open[i - 1][1:] if i else (False, 0, 0)
        if self.state() != outside or any(x[0] in BLOCKS for x in self.open[i:]):
            self.cut()
        while len(self.open) > i:
            self.at[self.open.pop()[0]].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INSIDE_P:
            self.end({"p"}, CONTAINERS)
        if tag in ENDS:
            self.end(ENDS[tag], CONTAINERS - ENDS[tag])
        if tag in BLOCKS:
            self.cut()
        if tag in VOID:
            return
        hidden, chrome, article = self.state()
        given = {k: v or "" for k, v in attrs}
        role = given.get("role", "").strip().lower()
        hidden = hidden or tag in HIDDEN or "hidden" in given
        main = tag == "main" or role == "main"
        if main or tag == "article" or role == "article":
            if chrome == BY_NAME and not main:
                article = NAMED
            elif chrome < BY_TAG:
                article = article or OWN
            chrome = chrome if chrome == BY_TAG else 0
        names = (given.get("class", ""), given.get("id", ""))
        named = tag not in ("html", "body", "article", "main") and any(NAMES.search(x) or (not article and HEADERS.search(x)) for x in names)
        if tag in CHROME or role in ROLES or (tag == "header" and not article):
            chrome = BY_TAG
        chrome = max(chrome, BY_NAME * named, BY_FORM * (tag == "form" or role == "form"))
        if (hidden, chrome, article) != self.state() and tag not in BLOCKS:
            self.cut()
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hidden, chrome, article))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        if tag == "br":
            return
        self.end({tag}, CONTAINERS - {tag} if tag not in BLOCKS else frozenset())

    def ends(self, pattern: re.Pattern, i: int) -> bool:
        """Whether ``pattern`` matches at or after ``i``; the page is searched once, not once per opening."""
        key = pattern, len(self.rawdata)
        if key not in self.last:
            self.last[key] = max((m.start() for m in pattern.finditer(self.rawdata)), default=-1)
        return self.last[key] >= i

    def parse_comment(self, i: int, report: int = 1) -> int:
        return COMMENT_END.search(self.rawdata, i + 4).end() if self.ends(COMMENT_END, i + 4) else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` up to ``>`` (or the end of the page) is a comment, as in browsers; the base class raises on unknown ones."""
        if m := KNOWN_SECTION.match(self.rawdata, i):
            end = CONDITION_END if m[1].lower() in ("if", "else", "endif") else SECTION_END
            return end.search(self.rawdata, i + 3).end() if self.ends(end, i + 3) else -1
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


#: Elements whose content an end tag or a paragraph's end does not reach out of.
CONTAINERS = frozenset("article aside body button div footer form header main nav section table td th ul ol dl blockquote".split())


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The lines of a whole page in order, white space folded, character references decoded.

    No tag ends behind the last ``>``: what stands there is text, however many tags it opens.
    The time is in proportion to the page's length, malformed pages included."""
    if not html:
        return []
    html = BEYOND.sub("\ufffd", ZEROS.sub("&#", html))
    end = html.rfind(">") + 1
    parser = Lines()
    parser.feed(html[:end])
    parser.close()
    rest = html[end:]
    section = next((m.start() for m in re.finditer(r"<!\[", rest) if not KNOWN_SECTION.match(rest, m.start())), len(rest))
    parser.handle_data(unescape(rest[:section]))
    parser.cut()
    named = CHROME_LINE if any(f == TEXT for _, f in parser.lines) else TEXT
    return [(x, named if f == NAMED_TEXT else f) for x, f in parser.lines]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` are in a longest common subsequence with ``b``.

    Equal ends are cut off first. The rest is split in halves of ``a`` until
    a table of the parts is small, so memory stays bounded for long pages."""
    out = np.zeros(len(a), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out[j] = True
        if i == j or k == m:
            continue
        if j - i == 1:
            out[i] = bool((b[k:m] == a[i]).any())
            continue
        if (j - i) * (m - k) <= 1 << 22:
            table = np.zeros((j - i + 1, m - k + 1), np.int32)
            for r in range(i, j):
                table[r - i + 1] = _row(table[r - i], b[k:m] == a[r])
            r, c = j - i, m - k
            while r and c:
                if table[r, c] == table[r - 1, c]:
                    r -= 1
                elif table[r, c] == table[r, c - 1]:
                    c -= 1
                else:
                    r, c = r - 1, c - 1
                    out[i + r] = True
            continue
        half = (i + j) // 2
        fore, back = np.zeros(m - k + 1, np.int32), np.zeros(m - k + 1, np.int32)
        for r in range(i, half):
            fore = _row(fore, b[k:m] == a[r])
        for r in range(j - 1, half - 1, -1):
            back = _row(back, b[k:m][::-1] == a[r])
        at = k + int(np.argmax(fore + back[::-1]))
        todo += [(i, half, k, at), (half, j, at, m)]
    return out


def _row(above: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The next row of a table of common subsequence lengths."""
    row = above.copy()
    row[1:] = np.maximum(above[1:], np.where(same, above[:-1] + 1, 0))
    return np.maximum.accumulate(row)


class Page:
    """A page's line hashes (the low 16 bits are the line's length) and flags; ``lines`` are those not marked as chrome."""

    def __init__(self, hashes: bytes, flags: bytes, lines: list[str] | None = None):
        self.raw, self.lines = (hashes, flags), lines
        self.hashes, self.flags = np.frombuffer(hashes, np.uint64), np.frombuffer(flags, np.uint8)
        self.body = self.hashes[self.flags != CHROME_LINE]
        self.members: list[tuple] = []  # (id, url) of equal pages

    def copies(self, other: Page) -> bool:
        """Whether the pages are equal, or each one's characters are in lines of the other but for less than ``1 - COPY``."""
        if self.raw == other.raw:
            return True
        both = []
        for one, two in ((self.body, other.body), (other.body, self.body)):
            size = one & LENGTH
            both.append(0 < COPY * size.sum() <= size[np.isin(one, two)].sum())
        return all(both)

    def without(self, others: list[Page | None]) -> Page:
        """The page with its loose lines that one of ``others`` shares marked as chrome; a copy takes none."""
        away = np.zeros(len(self.hashes), bool)
        if (self.flags == LOOSE).any():
            for other in others:
                if other is not None and not self.copies(other):
                    away |= shared(self.hashes, other.hashes)
        away &= self.flags == LOOSE
        gone = away[self.flags != CHROME_LINE]
        return Page(self.raw[0], np.where(away, CHROME_LINE, self.flags).astype(np.uint8).tobytes(), [x for x, g in zip(self.lines, gone, strict=True) if not g])


def with_place(pages: DataFrame, url: str) -> DataFrame:
    """``pages`` with ``host`` and ``path`` (query included) of the URL; empty where there is none."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)``: the main text of every page, its lines joined by one space.

    Null or empty html gives the empty text; a null URL counts as the empty
    host and path. Repeated rows come back as often as they stand there. Pages
    of which each is a copy or near copy (``COPY``) of the one before are a run;
    they meet the page before and the page after the run, and a host that is
    one run is not differenced. Ties in
    the order are broken by id and a hash of the html. Other columns are not
    read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    source = with_place(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), "url")
    source = source.withColumn("tie", F.concat_ws(" ", F.lpad(F.coalesce(F.col("id").cast("string"), F.lit("")), 20, "0"), F.hex(F.xxhash64("html"))))
    order = ["host", "path", "tie"]

    n = pages.count()
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE)))
    ends = source.select(order).repartitionByRange(ranges, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).select("low", "high")
    cuts = sorted((tuple(r.low), tuple(r.high)) for r in ends.collect())  # at most MAX_RANGES rows
    sent = spark.sparkContext.broadcast(([low for low, _ in cuts], [high for _, high in cuts]))
    schema = f"part int, emit boolean, id {kind}, url string, host string, path string, tie string, lines array<string>, flags binary, hashes binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = sent.value
        names = ["part", "emit", "id", "url", "host", "path", "tie", "lines", "flags", "hashes"]
        for b in slices(batches):
            keys = list(zip(*(b.column(c).to_pylist() for c in order), strict=True))
            rows, part, emit, lines, flags, hashes = [], [], [], [], [], []
            for i, (key, html) in enumerate(zip(keys, b.column("html").to_pylist(), strict=True)):
                found = page_lines(html)
                article = any(f == TEXT for _, f in found)
                # The text of a line that goes in any case is not carried on, only its hash is.
                kept = np.array([f == TEXT or (f == LOOSE and not article) for _, f in found], bool)
                p = bisect_right(lows, key) - 1
                at = [(p, True)] + [(p - 1, False)] * (p > 0 and key == lows[p]) + [(p + 1, False)] * (p + 1 < len(lows) and key == highs[p])
                hashed = np.array([xxhash.xxh64_intdigest(x.encode()) & ~0xFFFF | min(len(x), 0xFFFF) for x, _ in found], np.uint64).tobytes()
                mark = np.where(kept, [f for _, f in found], CHROME_LINE).astype(np.uint8).tobytes() if found else b""
                for q, own in at:
                    rows.append(i)
                    part.append(q)
                    emit.append(own)
                    lines.append([x for (x, _), k in zip(found, kept, strict=True) if k] if own else [])
                    flags.append(mark)
                    hashes.append(hashed)
            same = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "url", "host", "path", "tie")]
            made = [pa.array(part, pa.int32()), pa.array(emit, pa.bool_())], [pa.array(lines, pa.list_(pa.string())), pa.array(flags, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*made[0], *same, *made[1]], names=names)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished pages (kind 0); pages of a run that goes on beyond the range on the left or
        right (1); and for the ranges beside, the page after such a run (2) or before it (3)."""

        def rows() -> Iterator[dict | None]:
            for b in slices(batches):
                yield from b.to_pylist()
            yield None

        def close(run: list[Page], before: Page | None, after: Page | None, part: int, first: bool, last: bool) -> Iterator[tuple]:
            if not any(page.members for page in run):
                return
            # A row of the range beside that begins or ends the run: the run goes on there.
            left, right = not first, not last
            for page in run:
                if page.members:
                    rest = page.without([before, after])
                    wait = (left or right) and (rest.flags == LOOSE).any()
                    for id_, url in page.members:
                        yield (1, part, left, right, id_, url, None, rest.lines, rest.raw[1], rest.raw[0]) if wait else (0, part, False, False, id_, url, " ".join(rest.lines), None, None, None)
            for kind, here, there, page in ((2, left, right, after), (3, right, left, before)):
                if here:
                    yield (kind, part, kind == 3 and there, kind == 2 and there, None, None, None, None, *(page.raw[::-1] if page else (None, None)))

        def made() -> Iterator[tuple]:
            run: list[Page] = []
            before, at, first, last = None, None, True, True
            for row in rows():
                page, place = None, None
                if row is not None:
                    page, place = Page(row["hashes"], row["flags"], row["lines"]), (row["part"], row["host"])
                if run and place == at and page.copies(run[-1]):
                    if page.raw != run[-1].raw:
                        run.append(page)
                    elif row["emit"] and not run[-1].members:
                        run[-1].lines = page.lines
                else:
                    if run:
                        yield from close(run, before, page if place == at else None, at[0], first, last)
                    before = run[-1] if run and place == at else None
                    run, at = [page], place
                    first = row is not None and row["emit"]
                if row is not None:
                    last = row["emit"]
                    if row["emit"]:
                        run[-1].members.append((row["id"], row["url"]))

        held: list[tuple] = []
        names = ["kind", "part", "left", "right", "id", "url", "text", "lines", "flags", "hashes"]
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), id_type, pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        for one in made():
            held.append(one)
            if len(held) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range, the pages that end a run on its left and right, through ranges that are one run."""
        found = {(r["kind"], r["part"]): r for b in batches for r in b.to_pylist()}  # at most two for each range
        out = {}
        for kind, on, step in ((2, "right", 1), (3, "left", -1)):
            for part in sorted((p for k, p in found if k == kind), reverse=kind == 2):
                row = found[kind, part]
                page = out.get((kind, part), (None, None)) if row[on] else (row["flags"], row["hashes"])
                out[kind, part - step] = page
        parts = sorted({p for _, p in out})
        columns = [[out.get((kind, p), (None, None))[i] for p in parts] for kind in (2, 3) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["at", "flags2", "hashes2", "flags3", "hashes3"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = []
            for r in b.to_pylist():
                others = [Page(r[f"hashes{k}"], r[f"flags{k}"]) for k, on in ((2, "right"), (3, "left")) if r[on] and r[f"hashes{k}"] is not None]
                texts.append(" ".join(Page(r["hashes"], r["flags"], r["lines"]).without(others).lines))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(pages.schema[id_col].dataType)
    parsed = mapped(source.select("id", "url", "host", "path", "tie", "html"), parse, schema)
    parts = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))) if ranges > 1 else 1
    dealt = parsed.repartition(parts, "part").sortWithinPartitions("part", *order)
    made = mapped(dealt, difference, f"kind int, part int, left boolean, right boolean, id {kind}, url string, text string, lines array<string>, flags binary, hashes binary")
    done = made.filter("kind = 0").select("id", "url", "text")
    if len(cuts) > 1:  # the three readers of ``dealt`` share its shuffle
        ends = mapped(made.filter("kind >= 2").select("kind", "part", "left", "right", "flags", "hashes").repartition(1), beyond, "at int, flags2 binary, hashes2 binary, flags3 binary, hashes3 binary")
        wait = made.filter("kind = 1").join(F.broadcast(ends), F.col("part") == F.col("at"), "left")
        done = done.union(mapped(wait.select("id", "url", "left", "right", "lines", "flags", "hashes", "flags2", "hashes2", "flags3", "hashes3"), finish, f"id {kind}, url string, text string"))
    return done.toDF(id_col, url_col, "text")
