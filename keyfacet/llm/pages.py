"""Main text of HTML pages by nearest-URL page differencing, with content containers as a guard.

A page is read into lines, one a block, without scripts, styles and other raw elements. Each page is paired with
the page of the nearest URL path on its host that has other lines, the lines of both are aligned by their
longest common subsequence, and the shared lines, the template, are deleted. Copies, pages with equal
lines that are neighbours by URL, are paired as one page: none is the template of another. Pages without lines are no neighbours.

Two guards correct what differencing alone gets wrong. Lines inside a content container (``article``, ``main``)
are protected: titles and paragraphs recur on neighbouring pages. Lines of elements that name
themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments go even where no other page
shares them, and so do lines outside the container of a page that has one. ``guard=False`` shows differencing alone.

Only numbers travel between pages: alignment compares hashes of lines.

Defined results: null or empty html gives the empty text; a page without container and without another
page of other lines on its host keeps all its lines but those of named elements; equal URLs pair with each
other if their lines differ; repeated rows give repeated rows; an empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import column, join_hot, materialize, sliced

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
ATTRS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside form header menu dialog button head".split())
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored banner promo promotion cookie cookies consent gdpr notice "
    "alert newsletter subscribe subscription popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended widget pagination pager toolbar toc skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SPLIT = re.compile(r"[^a-z0-9]+")


def _dropped(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element names itself as something other than content."""
    if name in DROP and not (name == "header" and inside):
        return True
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return False
    for key, *values in ATTRS.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role":
            if value in ROLES:
                return True
        elif not BOILER.isdisjoint(SPLIT.split(value)):
            return True
    return False


#: Where a line is: in an element that names itself as something other than content, nowhere special, in a container.
NAMED, PLAIN, INSIDE = 0, 1, 2


def page_lines(html: str) -> list[tuple[int, str]]:
    """Place and text of every line, in page order."""
    lines: list[tuple[int, str]] = []
    part: list[str] = []
    inside, at = 0, 0
    skip, depth = "", 0

    def flush() -> None:
        if part:
            line = " ".join("".join(part).split())
            part.clear()
            if line:
                lines.append((NAMED if skip else INSIDE if inside else PLAIN, line))

    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        end = m.start() if m else n
        if end > at:
            part.append(unescape(html[at:end]))
        if not m:
            break
        pos = at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not close:
            if attrs.endswith("/") and name not in ("script", "style", "textarea", "title"):
                continue
            stop = re.compile(f"</{name}[^>]*>", re.I).search(html, pos)
            pos = at = stop.end() if stop else n
            continue
        if skip:
            if name == skip and name not in VOID:
                depth += -1 if close else 1
            opens_content = name in ("article", "main") and not close and not _dropped(name, attrs, False)
            ends_paragraph = skip == "p" and not close and name in BLOCKS
            if depth <= 0 or opens_content or ends_paragraph or close and inside and name in ("article", "main"):
                flush()
                skip = ""
                if depth <= 0:
                    continue
            else:
                if name in BLOCKS:
                    flush()
                elif name == "br":
                    part.append(" ")
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            part.append(" ")
        if close:
            if name in ("article", "main") and inside:
                inside -= 1
        elif name not in VOID and not attrs.endswith("/") and _dropped(name, attrs, bool(inside)):
            flush()
            skip, depth = name, 1
        elif name in ("article", "main"):
            inside += 1
    flush()
    return lines


WHOLE = 1 << 28


def shared_lines(a: list, b: list) -> list[bool]:
    """Which lines of ``a`` belong to a longest common subsequence with ``b``.

    Up to ``WHOLE`` cells the table is kept, a bit a cell; beyond that ``a`` is halved where the halves' lengths
    fit together best, so memory stays linear.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > WHOLE:
        half = len(x) // 2
        sums = _lengths(x[:half], y) + _lengths(x[:half - 1 : -1], y[::-1])[::-1]
        at = int(np.argmax(sums))
        middle = shared_lines(x[:half], y[:at]) + shared_lines(x[half:], y[at:])
    else:
        middle = _whole(x, y)
    return [True] * head + middle + [True] * tail


def _rows(a: list, b: list):
    """Bit rows of the table: a clear bit j in a row marks a place of ``b`` where the length grows."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    v = mask = (1 << len(b)) - 1
    for line in a:
        u = v & places.get(line, 0)
        v = (v + u | v - u) & mask
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _whole(a: list, b: list) -> list[bool]:
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    out, j = [False] * len(a), len(b)
    length = lambda i, j: (~rows[i] & (1 << j) - 1).bit_count()
    for i in range(len(a), 0, -1):  # walk back along the places where the length grows
        here = length(i, j)
        if not here:
            break
        if length(i - 1, j) == here:
            continue
        while b[j - 1] != a[i - 1] or length(i - 1, j - 1) != here - 1:
            j -= 1
        out[i - 1] = True
        j -= 1
    return out


def guarded(places: list[int], shared: list[bool]) -> list[bool]:
    """Which lines are the text, given their places and which of them the nearest page shares."""
    if INSIDE in places:
        return [p == INSIDE for p in places]
    return [p == PLAIN and not s for p, s in zip(places, shared)]


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str, guard: bool = True) -> DataFrame:
    """Id and URL; ``text`` if no line is shared; hashes and places of all lines; the lines that sharing can change."""
    import xxhash

    schema = f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, hashes binary, places binary, lines array<string>"

    def run(batches):
        for b in sliced(batches):
            texts, hashes, places, open_lines = [], [], [], []
            for html in b.column("html").to_pylist():
                found = page_lines(html or "")
                at, lines = [p if guard else PLAIN for p, _ in found], [line for _, line in found]
                texts.append("\n".join(line for line, keep in zip(lines, guarded(at, [False] * len(at))) if keep))
                hashes.append(b"".join(xxhash.xxh3_64_digest(line.encode("utf-8", "surrogatepass")) for line in lines))
                places.append(bytes(at))
                open_lines.append(None if INSIDE in at or PLAIN not in at else lines)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(hashes, pa.binary()), pa.array(places, pa.binary()), pa.array(open_lines, pa.list_(pa.string()))],
                names=["id", "url", "text", "hashes", "places", "lines"],
            )

    return pages.select(column(id_col).alias("id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html")).mapInArrow(run, schema)


def url_key(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host, without ``www.``, and path, without query, fragment, suffix and closing slash."""
    rest = F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^www\.|:\d+$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"(\.html?|/+)$", "")
    return host, path


def _runs(keys: DataFrame) -> DataFrame:
    """Rows in the order of host and path with the number of their run, neighbours of one host with the same lines.

    Runs count from 0 in that order; no task sees more than its range.
    """

    def number(batches):
        part, at, run, last = TaskContext.get().partitionId(), 0, -1, None
        for b in batches:
            runs = []
            for here in zip(b.column("host").to_pylist(), b.column("same").to_pylist()):
                if here != last:
                    run, last = run + 1, here
                runs.append(run)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64()), pa.array(runs, pa.int64())],
                names=[*b.schema.names, "part", "at", "run"],
            )
            at += b.num_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", part int, at long, run long"
    ranged = materialize(keys.orderBy("host", "path", "same", "row").mapInArrow(number, schema), "url-order")
    page = F.struct("host", "same")
    ends = ranged.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"), F.max("run").alias("more"))
    start, before, rows = -1, None, []
    for r in ends.orderBy("part").collect():  # a row a range
        start += r["first"] != before  # else the range goes on with the run before it
        rows.append((r["part"], start))
        start, before = start + r["more"], r["last"]
    starts = keys.sparkSession.createDataFrame(rows, "part int, start long")
    return ranged.join(F.broadcast(starts), "part").select("row", "host", "path", (F.col("start") + F.col("run")).alias("run"))


def differenced(read: DataFrame) -> DataFrame:
    """``row`` and ``shared``, a byte a line: whether the nearest page of other lines on the host shares it.

    ``read``: row, url and hashes of pages with lines; written.
    """
    host, path = url_key()
    same = F.sha2("hashes", 256)
    rows = materialize(_runs(read.select("row", host.alias("host"), path.alias("path"), same.alias("same"))), "url-runs")
    page = F.struct("path", "row")
    runs = materialize(rows.groupBy("run").agg(F.min("host").alias("host"), F.min(page).alias("first"), F.max(page).alias("last")), "url-places")
    side = lambda name, step, end: runs.select(
        (F.col("run") + step).alias("run"), F.col("host").alias(f"{name}_host"), F.col(f"{end}.path").alias(f"{name}_path"), F.col(f"{end}.row").alias(f"{name}_row")
    )
    both = runs.join(side("up", 1, "last"), "run", "left").join(side("down", -1, "first"), "run", "left")
    prefix = lambda p, end: F.when(F.col(f"{p}_host") == F.col("host"), _common(F.col(f"{end}.path"), F.col(f"{p}_path"))).otherwise(-1)
    up, down = prefix("up", "first"), prefix("down", "last")
    near = F.when((up >= down) & (up >= 0), F.col("up_row")).when(down >= 0, F.col("down_row"))
    pairs = both.select("run", F.col("first.row").alias("row"), near.alias("near"))
    hashes = read.select("row", "hashes")
    paired = pairs.join(hashes, "row").join(hashes.select(F.col("row").alias("near"), F.col("hashes").alias("near_hashes")), "near", "left")

    def run(batches):
        for b in batches:
            out = [bytes(shared_lines(_cut(x), _cut(y or b""))) for x, y in zip(b.column("hashes").to_pylist(), b.column("near_hashes").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(out, pa.binary())], names=["run", "shared"])

    shared = materialize(paired.select("run", "hashes", "near_hashes").mapInArrow(run, "run long, shared binary"), "url-shared")
    return join_hot(rows.select("row", "run"), shared, "run").select("row", "shared")


def _cut(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + 8] for i in range(0, len(hashes), 8)]


def _common(a: F.Column, b: F.Column) -> F.Column:
    """How many leading path segments are equal, and 1 more for equal paths."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p.eqNullSafe(q), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same) + 1).otherwise(first - 1).cast("int")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", guard: bool = True) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of every page; without ``guard``, all lines that aren't shared.

    Texts stay where they are read, but those of pages without container that share lines.
    """
    read = materialize(parsed(pages, id_col, url_col, html_col, guard).withColumn("row", F.monotonically_increasing_id()), "pages")
    shared = differenced(read.filter(F.length("hashes") > 0).select("row", "url", "hashes"))
    cut = read.filter("lines is not null").select("row", "id", "url", "places", "lines").join(shared, "row")

    def run(batches):
        for b in batches:
            texts = []
            for lines, places, same in zip(*(b.column(c).to_pylist() for c in ("lines", "places", "shared"))):
                texts.append("\n".join(line for line, keep in zip(lines, guarded(list(places), list(same))) if keep))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    done = read.filter("lines is null").select("id", "url", "text")
    done = done.unionByName(cut.mapInArrow(run, done.schema))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def shared_share(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row: ``pages`` and ``touched``, how many of them share a line with the nearest page."""
    read = materialize(parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages")
    hit = F.col("shared").cast("binary") != F.expr("cast(repeat(char(0), length(shared)) as binary)")
    return differenced(read.filter(F.length("hashes") > 0).select("row", "url", "hashes")).agg(F.count("*").alias("pages"), F.sum(hit.cast("long")).alias("touched"))
