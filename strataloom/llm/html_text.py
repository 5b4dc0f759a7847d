"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in order of their URL path (with its query), and each is
paired with the neighbour whose path shares the longest beginning with its own.
The text lines of a pair are aligned by a longest common subsequence; lines that
both have are the site's, not the page's, and are deleted.  Every page with a URL
is differenced so.  Menus, notices and footers that change from page to page
cannot be told that way, so elements that say what they are (``nav``, ``footer``,
``class="ad"`` ...) are left out too, and where a page marks its article, only
lines of the article are text.  A sentence that two articles share is part of
both, so a shared line of a marked article stays, unless the block around it is
called a part of the site (``class="share"``): such a name alone deletes nothing
in an article, nor does sharing, but both together do.  Elements that cannot be an
article's text (``nav``, ``aside``, ``footer``, forms, adverts, comments) go in any
case.  A form, or another frame told by its class, that holds the only article or
most of the text is neither.

Ordering uses ranges of (host, path), so a host with a third of all pages is
spread over tasks; what is ordered is line hashes.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, small_batches, stored, table

RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements that are never the article, wherever they stand.
SKIPPED = frozenset("head nav footer aside menu dialog button select svg object video audio canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary svg table tbody "
    "td tfoot th thead tr ul button object video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind closes, if no other block is between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: End tags that do not leave an article.
LOOSE = frozenset("p li td tr th dd dt".split())
#: Words of a class or id that say what an element is.  A token counts if all its
#: words are here or in PLACES: ``site-footer`` is a footer, ``life-form`` no form.
COMMENTS = frozenset("comment comments disqus respond".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion".split())
NOTICES = frozenset("cookie cookies gdpr consent".split())
KINDS = COMMENTS | ADVERTS | NOTICES | frozenset(
    "banner notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer header masthead pagination pager toolbar login form".split()
)
PLACES = frozenset("site page main global top bottom left right side primary secondary bar box list slot unit area block container wrapper section thread wrap inner outer".split())
#: Words that delete a block of an article if its pair has the same lines.
HINTS = KINDS - COMMENTS - ADVERTS - NOTICES - {"header", "masthead"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER = frozenset("html body article main".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<[/A-Za-z!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?|^([^?#]*)(\?[^#]*)?")


def _named(token: str, kinds: frozenset) -> bool:
    words = {w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()}
    return bool(words & kinds) and words <= KINDS | PLACES


def _told(name: str, attributes: str, in_article: bool) -> int:
    """2 if the attributes say that an element is hidden or holds comments, 1 if they say that it is another part of the site."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if name[0] == "h" and name[1:].isdigit():
                continue  # a heading
            tokens = value.split()
            if any(_named(t, COMMENTS) for t in tokens):
                return 2
            # Inside an article only what cannot be its text: adverts, cookie notices and what calls itself the site's.
            kinds = ADVERTS | NOTICES if in_article and key == "class" else ADVERTS if in_article else KINDS
            if name not in NEVER and any(_named(t, kinds) or in_article and t.startswith("site-") and _named(t, KINDS) for t in tokens):
                found = 1
        elif name in NEVER:
            continue
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        elif key == "role" and value in ROLES:
            found = 1
    return found


def _hinted(attributes: str) -> bool:
    """Whether a class or id calls an element of an article a part of the site."""
    return any(_named(t, HINTS) for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id") for t in (m[2] or m[3] or m[4] or "").lower().split())


class Page:
    """The elements of a page, each after its parent, and its blocks of text.

    ``kind`` is 2 for an element that is not the article, 1 for one that is told
    so by its class, role or by being a form, and may prove to hold the article.
    ``hint`` marks blocks of an article that go if the page's pair has them too.
    A tag costs the same however many elements are open.
    """

    def __init__(self, page: str):
        self.parent, self.name, self.kind, self.opens, self.inside, self.ended, self.hint = [-1], [""], [0], [False], [False], [True], [False]
        self.blocks: list[tuple[str, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, rows, parts = [0], [], []  # open elements, places of the open blocks among them, text
        scopes: list[dict[str, int]] = [{}]  # open elements by name, since the last html, body, article or main
        everywhere: dict[str, int] = {}

        def flush():
            if parts:
                if text := " ".join(html.unescape("".join(parts)).split()):
                    self.blocks.append((text, stack[-1]))
                parts.clear()

        def close(depth: int):
            while len(stack) > depth:
                name = self.name[stack.pop()]
                if rows and rows[-1] == len(stack):
                    rows.pop()
                everywhere[name] -= 1
                if name in NEVER:
                    scopes.pop()
                scopes[-1][name] -= 1

        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                parts.append(page[at:])
                break
            if m.start() > at:
                parts.append(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            end, attributes = m[1] or m[4], m[3] or m[6] or ""
            if end:
                if name in BLOCKS:
                    flush()
                if not (scopes[-1] if name in LOOSE else everywhere).get(name):
                    continue  # nothing of that name is open
                depth = len(stack) - 1
                while self.name[stack[depth]] != name:
                    depth -= 1
                if self.kind[stack[depth]]:
                    flush()  # an inline element of the site ends
                self.ended[stack[depth]] = True
                close(depth)
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                gone = page.find(">", stop.start()) if stop else -1
                at = gone + 1 if gone >= 0 else n
                continue
            is_block = name in BLOCKS
            if is_block:
                flush()
            if name in VOID or attributes.endswith("/") and not is_block:
                continue
            # Between an element and the one that its tag closes there is at most an open paragraph.
            for depth in rows[:-3:-1] if name in CLOSES else ():
                if self.name[stack[depth]] in CLOSES[name]:
                    close(depth)
                    break
                if self.name[stack[depth]] != "p":
                    break
            top = stack[-1]
            in_article = self.inside[top]
            kind = 2 if name in SKIPPED or name == "header" and not in_article else max(_told(name, attributes, in_article), int(name == "form"))
            if kind and not is_block:
                flush()
            opens = kind < 2 and (name in ("article", "main") or re.search(r"""role\s*=\s*["']?main\b""", attributes, re.I) is not None)
            hint = in_article and is_block and not kind and bool(attributes) and name not in NEVER and not (name[0] == "h" and name[1:].isdigit()) and _hinted(attributes)
            for column, value in ((self.parent, top), (self.name, name), (self.kind, kind), (self.opens, opens), (self.inside, in_article or opens), (self.ended, False), (self.hint, hint)):
                column.append(value)
            if is_block:
                rows.append(len(stack))
            stack.append(len(self.parent) - 1)
            everywhere[name] = everywhere.get(name, 0) + 1
            scopes[-1][name] = scopes[-1].get(name, 0) + 1
            if name in NEVER:
                scopes.append({})
        flush()

    def _up(self, values: list) -> list:
        """Values summed over each element and all inside it."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def _down(self, flags: list) -> list:
        """Whether an element or one around it has the flag."""
        out = list(flags)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def lines(self) -> list[tuple[str, bool, int]]:
        """(text, of the site, in a marked article: 2 in a hinted block of it) for each block with text, in page order."""
        n = len(self.parent)
        held = self._up(self.opens)
        # What was never closed ends where the article begins, as far as the article is concerned.
        sure = self._down([k == 2 and (e or not h) for k, e, h in zip(self.kind, self.ended, held)])
        told = [k > 0 and not s for k, s in zip(self.kind, sure)]
        marks = [o and not s for o, s in zip(self.opens, sure)]
        text = [0] * n
        for t, i in self.blocks:
            if not sure[i]:
                text[i] += len(t)
        text, held = self._up(text), self._up(marks)
        around = self._down(told)
        home = [0] * n  # the article, or the page, that an element is part of
        for i in range(1, n):
            p = self.parent[i]
            home[i] = p if marks[p] else home[p]
        if any(m and not a for m, a in zip(marks, around)):
            lifted = [False] * n
        else:  # the only article, or most of the text, lies in a form or another frame: that is no form
            lifted = [t and (h > 0 if held[0] else 2 * x > text[0]) for t, h, x in zip(told, held, text)]
        lifted = [u or t and k == "form" and 2 * x > text[h] for u, t, k, x, h in zip(lifted, told, self.name, text, home)]
        site = self._down([s or t and not u for s, t, u in zip(sure, told, lifted)])
        article = self._down([m and not s for m, s in zip(marks, site)])
        hint = self._down([g and 2 * x <= text[h] for g, x, h in zip(self.hint, text, home)])  # most of an article is no part of the site
        return [(t, site[i], article[i] + (article[i] and hint[i])) for t, i in self.blocks]


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """(text, of the site, in a marked article: 2 in a hinted block of it) for each block with text, in page order."""
    return Page(page).lines()


def host_path(url: str | None) -> tuple[str | None, str | None]:
    """Host and path with query; no fragment, no slash at the path's end."""
    if url is None:
        return None, None
    m = _URL.match(url.strip())
    host, path, query = (m[1] or "").lower(), m[2] if m[4] is None else m[4], m[3] if m[4] is None else m[5]
    return host, ((path or "").rstrip("/") or "/") + (query or "")


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def common_lines(a: list, b: list) -> list[bool]:
    """Which items of ``a`` lie on a longest common subsequence with ``b``.

    Bit-parallel (Hyyrö, 2004) with a row of bits kept per item; beyond
    2^28 bits the problem is halved (Hirschberg), so memory stays bounded.
    """
    out = [False] * len(a)

    def solve(a0: int, a1: int, b0: int, b1: int):
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            return
        if n > 1 and n * m > 1 << 28:
            mid = (a0 + a1) // 2
            head = _lengths(a[a0:mid], b[b0:b1])
            tail = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])
            cut = max(range(m + 1), key=lambda j: head[j] + tail[m - j])
            solve(a0, mid, b0, b0 + cut)
            solve(mid, a1, b0 + cut, b1)
            return
        rows = [r.to_bytes(m // 8 + 1, "little") for r in _rows(a[a0:a1], b[b0:b1])]
        i, j = n, m
        while i and j:
            byte, bit = divmod(j - 1, 8)
            if rows[i - 1][byte] >> bit & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1][byte] >> bit & 1:
                    out[a0 + i] = True
                    j -= 1

    solve(0, len(a), 0, len(b))
    return out


def _rows(a: list, b: list):
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> list[int]:
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007  the last row counts
        pass
    out, k = [0], 0
    for j, c in enumerate(bin(v)[2:].zfill(len(b))[::-1] if b else ""):
        k += c == "0"
        out.append(k)
    return out


def marked(lines: list[tuple[str, bool, int]]) -> bool:
    """Whether the page marks an article that has text."""
    return any(a and not s for _, s, a in lines)


def main_text(lines: list[tuple[str, bool, int]], hashes: list[int], partner: list[int] | None) -> tuple[str, int]:
    """The text of a page and how many lines the pairing deleted that the tag rules had kept."""
    shared = common_lines(hashes, partner) if partner else [False] * len(lines)
    article = marked(lines)
    body = [i for i, (_, s, a) in enumerate(lines) if not s and (a or not article)]
    left = [i for i in body if not shared[i] or lines[i][2] == 1]
    if all(shared[i] for i in body):  # a mirror of its partner, not a template without text
        left = body
    return " ".join(lines[i][0] for i in left), len(body) - len(left)


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in lines]


def pack_lines(lines: list[tuple[str, bool, int]]) -> bytes:
    """Lines (which have no line ends) with their flags, compressed for the way."""
    return zlib.compress("\n".join(f"{3 * s + a}{t}" for t, s, a in lines).encode("utf-8", "surrogatepass"))


def unpack_lines(packed: bytes) -> list[tuple[str, bool, int]]:
    text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    return [(x[1:], x[0] >= "3", int(x[0]) % 3) for x in text.split("\n")] if text else []


def parse(pages: DataFrame, hashed: bool) -> DataFrame:
    """(page_id, url, host, path, text, lines) of (page_id, url, html), or with ``hashed`` (page_id, host, path, hashes).

    A page without a URL, which has no partner, has its text, and no lines;
    another has its lines, and no text.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "host", "path", "hashes"] if hashed else ["page_id", "url", "host", "path", "text", "lines"]
    kinds = (pa.string(), pa.string(), pa.list_(pa.int64())) if hashed else (pa.string(), pa.string(), pa.string(), pa.binary())

    def run(batches):
        for b in slices(batches, 2):
            rows = []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = blocks(page or "")
                host, path = host_path(url)
                if hashed:
                    rows.append((host, path, line_hashes([t for t, _, _ in lines])))
                elif host is None:
                    rows.append((host, path, main_text(lines, [], None)[0], None))
                else:
                    rows.append((host, path, None, pack_lines(lines)))
            own = [b.column(0)] if hashed else [b.column(0), b.column(1)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, zip(*rows), kinds)], names=names)

    rest = "host string, path string, hashes array<bigint>" if hashed else "url string, host string, path string, text string, lines binary"
    return pages.mapInArrow(run, f"page_id {kind}, {rest}")


NEAR = "host string, path string, before struct<path:string,hashes:array<bigint>>, after struct<path:string,hashes:array<bigint>>"


def nearer(path: str, before: dict | None, after: dict | None) -> dict | None:
    """The neighbour whose path shares the longest beginning with ``path``; of equals the one before."""
    return max((x for x in (before, after) if x), key=lambda x: shared_prefix(x["path"], path), default=None)


def neighbours(paths: DataFrame) -> DataFrame:
    """(host, path, before, after) for the rows of ``paths`` (host, path, hashes); the side that is not nearer may be null.

    Paths are sorted in ranges, and each task knows the neighbours of all its
    rows but the first and the last.  These two come to the driver, which puts
    the ends of the ranges together: two rows a task, whatever the input.
    """
    spark = paths.sparkSession
    hashes = pa.list_(pa.int64())
    side = pa.struct([("path", pa.string()), ("hashes", hashes)])
    names = ["part", "edge", "host", "path", "hashes", "before", "after"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), hashes, side, side)
    schema = "part int, edge int, host string, path string, hashes array<bigint>, before struct<path:string,hashes:array<bigint>>, after struct<path:string,hashes:array<bigint>>"

    def beside(row, other):
        return {"path": other[1], "hashes": other[2]} if other is not None and other[0] == row[0] else None

    def run(batches):
        part = TaskContext.get().partitionId()
        last = row = None
        edge, out = 1, []
        for b in batches:
            for now in zip(*(b.column(i).to_pylist() for i in range(3))):
                if row is not None:
                    before, after = beside(row, last), beside(row, now)
                    if edge:
                        out.append((part, edge, *row, before, after))
                    else:  # nothing of the row but its partner is needed any more
                        near = nearer(row[1], before, after)
                        out.append((part, edge, *row[:2], None, before if near is before else None, after if near is after else None))
                    edge = 0
                last, row = row, now
            if len(out) > 256:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), kinds)), names=names)
                out = []
        if row is not None:
            out.append((part, edge | 2, *row, beside(row, last), None))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), kinds)), names=names)

    ordered = paths.select("host", "path", "hashes").repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    found = stored(ordered.mapInArrow(run, schema), "neighbours")
    ends = sorted(found.where("edge > 0").select("part", "edge", "host", "path", "hashes", "before", "after").collect(), key=lambda r: (r.part, r.edge & 2))
    fixed = []
    for i, r in enumerate(ends):
        before, after = r.before, r.after
        if r.edge & 1 and i and ends[i - 1].host == r.host:
            before = (ends[i - 1].path, ends[i - 1].hashes)
        if r.edge & 2 and i + 1 < len(ends) and ends[i + 1].host == r.host:
            after = (ends[i + 1].path, ends[i + 1].hashes)
        fixed.append((r.host, r.path, before, after))
    inner = found.where("edge = 0").select("host", "path", "before", "after")
    return inner.unionByName(spark.createDataFrame(fixed, NEAR))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_deleted) per row of ``pages``.

    Null and empty pages have an empty text.  Pages without a URL have no
    partner.  Rows that repeat a URL share their partner, the page of the
    nearest *other* path (of several rows with that path, the one with the
    smallest id, then lines).  Ties between neighbours go to the earlier path.
    n_deleted counts lines that the pairing alone removed.  Repeated rows and
    null ids stay; no rows give no rows; other columns are ignored; pages are
    parsed whole, whatever their length.  Pages are parsed twice, for their line
    hashes when this is called and for their lines later, which takes less than
    to store the lines of all pages: they are shuffled once, and only partners'
    hashes are stored.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    id_type = own.schema["page_id"].dataType.simpleString()
    placed, alone = own.where("url is not null"), own.where("url is null")
    paths = parse(placed, hashed=True).groupBy("host", "path").agg(F.min(F.struct("page_id", "hashes")).alias("w"))
    near = neighbours(paths.select("host", "path", F.col("w.hashes").alias("hashes")))

    def difference(batches):
        for b in slices(batches, 3):
            texts, deleted = [], []
            for path, packed, before, after in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                lines = unpack_lines(packed)
                partner = nearer(path, before, after)
                text, n = main_text(lines, line_hashes([t for t, _, _ in lines]), partner and partner["hashes"])
                texts.append(text)
                deleted.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_deleted"])

    paired = parse(placed, hashed=False).join(near, ["host", "path"], "left").select("page_id", "url", "path", "lines", "before", "after")
    whole = parse(alone, hashed=False).select("page_id", "url", "text", F.lit(0).cast("long").alias("n_deleted"))
    return whole.unionByName(paired.mapInArrow(difference, f"page_id {id_type}, url string, text string, n_deleted bigint"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    Null and empty pages have an empty text; repeated rows and URLs stay; an
    empty table gives no rows; pages of any length are parsed whole.
    """
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")
