"""Main text of web pages by differencing pages with near addresses.

A page is read as a sequence of text lines, one per block element, each with
the zone its markup puts it in: *outside* (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments: by element, role, class or id),
*article* (inside an article or main element) or *open* (anything else).
Scripts, styles, comments and markup are no lines.

Pages of a host are sorted by address path and each is paired with the
neighbour whose path shares the longer beginning.  The line sequences of a
pair are aligned by longest common subsequence; lines the two share come from
the template and are deleted first, unless the markup calls them article (two
pages may carry the same article).  Lines that the markup calls outside go
next (template lines that vary from page to page cannot be found by
comparing).  A page whose every line is shared is a copy: nothing is deleted
by comparison.  If a page has article lines, its open lines go too.

An element that is outside by a class word only, or a form, may wrap a whole
page: a main element opens the article zone within it, and so does an article
element if the page has no article lines elsewhere.  Class names that state a
layout (``has-sidebar``, ``share-enabled``) say nothing of their element.

Plan: one scan writes the line hashes of each page (8 bytes a line); addresses
are sorted over range partitions, so a host with a third of all pages is split
over many tasks, and only the first and last row of every partition are
stitched on the driver; hashes travel to their pair, the deletions back to
their page: page texts are shuffled once.

Defined results: a null page is an empty text; a null or odd address is a host
and path of its own text; pages without an id have no partner; repeated rows
are compared like any two pages; an empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import freeze

# --- fixed values: elements, and words of class, id and role, by their meaning
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
OUTSIDE_ELEMENTS = frozenset("aside button dialog fieldset footer form head header label menu nav optgroup option select".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright discussion disqus dropdown footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "pager pagination paywall popup promo promos promotion recommended related reply replies respond search share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: of these, what holds text of others: an article element in it is a comment or a teaser
ALIEN_WORDS = frozenset("comment comments commentlist discussion disqus recommended related reply replies respond".split())
LAYOUT_NAME = r"(?:has|no|not|is|with|without|show|hide)-.*|.*-(?:enabled|disabled|on|off|active|left|right|none|layout)"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
COUNTS = ("n_chars", "n_lines", "shared_lines", "lines_by_pair", "lines_by_zone", "lines_by_article")
#: bits of alignment rows kept at once
KEPT_BITS = 1 << 28
ARTICLE_ELEMENTS = frozenset("article main".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_LAYOUT = re.compile(LAYOUT_NAME)

#: WEAK: outside by a class word or as a form; REOPENED: an article element in such
OUTSIDE, OPEN, ARTICLE, WEAK, REOPENED = 0, 1, 2, 3, 4


def _class_words(value: str) -> set[str]:
    return {w for name in value.split() if not _LAYOUT.fullmatch(name) for w in _WORD.findall(name)}


def _zone(name: str, marks: str, now: int) -> int:
    """Zone inside an element that opens in zone ``now``."""
    if now == OUTSIDE or (name in OUTSIDE_ELEMENTS and name != "form"):
        return OUTSIDE
    article, hit = name in ARTICLE_ELEMENTS, name == "form"
    within = now in (ARTICLE, REOPENED)
    if marks and not marks.isspace():
        for m in _MARKS.finditer(marks):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return OUTSIDE
            if key == "role":
                if value in OUTSIDE_ROLES:
                    return OUTSIDE
                article |= value in ("main", "article")
            elif key == "itemprop":
                article |= value == "articlebody"
            elif key in ("class", "id") and name not in ("html", "body") and (not article or now == WEAK):
                words = _class_words(value)
                if not article and not ALIEN_WORDS.isdisjoint(words):
                    return OUTSIDE
                hit |= not OUTSIDE_WORDS.isdisjoint(words)
    if article and not (now == WEAK and hit):
        return REOPENED if now == WEAK and name != "main" else now if within else ARTICLE
    if hit:
        return OUTSIDE if within else WEAK
    return now


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """Zone and text of every line of a page, in page order."""
    page = page or ""
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements and the zones around them
    zone, at = OPEN, 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append((OUTSIDE if zone == WEAK else zone, text))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS or any(name == s for s, _ in stack):
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        zone = stack[i][1]
                        del stack[i:]
                        break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if name in ("iframe", "object", "canvas", "svg", "math"):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            continue
        inside = _zone(name, m[3], zone)
        if name in BLOCKS:
            flush()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of their kind
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        zone = stack[i][1]
                        del stack[i:]
                        inside = _zone(name, m[3], zone)
                        break
                    if stack[i][0] not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                        break
            stack.append((name, zone))
            zone = inside
        elif inside != zone:  # an inline element that changes the zone
            flush()
            stack.append((name, zone))
            zone = inside
    parts.append(entities.unescape(page[at:]))
    flush()
    return lines


def line_hashes(lines: list[tuple[int, str]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in lines]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: equal ends
    are matched first.  Of the rest, few equal pairs are chained (the longest
    strictly increasing chain of places in ``b``); many of them, as lists of
    equal lines make, are aligned by rows of bits, 64 lines a step."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    mine, theirs = a[low:high_a], b[low:high_b]
    counts = Counter(theirs)
    pairs = sum(counts[x] for x in mine)
    inner = _chained(mine, theirs) if pairs <= 20 * (len(mine) + len(theirs)) + 1000 else _aligned(mine, theirs)
    return [*range(low), *(low + i for i in inner), *range(high_a, len(a))]


def _chained(a: list[int], b: list[int]) -> list[int]:
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)  # descending: one match per line of a
    tails: list[int] = []
    last: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(tails, j)
            node = (i, last[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                last.append(node)
            else:
                tails[k], last[k] = j, node
    chain, node = [], last[-1] if last else None
    while node:
        chain.append(node[0])
        node = node[1]
    return chain[::-1]


def _bit_rows(a: list[int], b: list[int]):
    """After each line of ``a``, a number whose zero bits are the places in
    ``b`` where the longest common subsequence grows."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a``; rows are kept while they are few bits, larger inputs
    are halved at the place in ``b`` where both halves match most."""
    if not a or not b:
        return []
    if len(a) * len(b) <= KEPT_BITS or len(a) == 1:
        rows, out, i, j = [(1 << len(b)) - 1, *_bit_rows(a, b)], [], len(a), len(b)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    out.append(i)
                    j -= 1
        return out[::-1]
    half = len(a) // 2
    *_, ahead = _bit_rows(a[:half], b)
    *_, behind = _bit_rows(a[half:][::-1], b[::-1])
    grown = lambda row: list(accumulate((c == "0" for c in reversed(f"{row:0{len(b)}b}")), initial=0))
    left, right = grown(ahead), grown(behind)
    cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
    return [*_aligned(a[:half], b[:cut]), *(half + i for i in _aligned(a[half:], b[cut:]))]


def judged_lines(lines: list[tuple[int, str]], shared: set[int]) -> tuple[list[str], int, int, int]:
    """The lines that stay, and how many go because the pair has them, because
    the markup puts them outside, and because they are open beside an article;
    ``shared``: places of the lines that the page's pair has as well."""
    article = ARTICLE if any(z == ARTICLE for z, _ in lines) else REOPENED
    has_article = any(z == article for z, _ in lines)
    copied = len(shared) == len(lines)
    kept, by_pair, by_zone, by_article = [], 0, 0, 0
    for i, (zone, text) in enumerate(lines):
        if zone == article:
            kept.append(text)
        elif i in shared and not copied:
            by_pair += 1
        elif zone != OPEN:
            by_zone += 1
        elif has_article:
            by_article += 1
        else:
            kept.append(text)
    return kept, by_pair, by_zone, by_article


def main_text(lines: list[tuple[int, str]], shared: set[int]) -> str:
    return "\n".join(judged_lines(lines, shared)[0])


def nearest_addresses(pages: DataFrame) -> DataFrame:
    """``id, sig, partner, partner_sig`` of rows ``id, sig, host, path``: the
    neighbour in (host, path) order whose path shares the longer beginning
    (of equal ones the one before)."""
    spark = pages.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "id", "sig"]
    ranged = pages.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)
    kind = pages.schema["id"].dataType.simpleString()

    def nearest(row, before, after):
        def shared(other):
            return -1 if other is None or other[0] != row[0] else _shared(row[1], other[1])

        p, q = shared(before), shared(after)
        best = before if p >= q else after
        return (best[2], best[3]) if max(p, q) >= 0 else (None, None)

    def pair(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = row = None
        edge = True
        out: list[tuple] = []

        def rows():
            cols = list(zip(*out)) if out else [[] for _ in range(8)]
            kinds = [pa.int32(), pa.string(), pa.string(), id_type, pa.int64(), id_type, pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.types[2]
            for after in zip(*(c.to_pylist() for c in batch.columns)):
                if row is not None:
                    out.append((part, *row, *nearest(row, before, after), edge))
                    edge = False
                    before = row
                row = after
            yield rows()
            out = []
        if row is not None:
            out.append((part, *row, *nearest(row, before, None), True))
            yield rows()

    names = ["part", "host", "path", "id", "sig", "partner", "partner_sig", "edge"]
    paired = freeze(ranged.mapInArrow(pair, f"part int, host string, path string, id {kind}, sig long, partner {kind}, partner_sig long, edge boolean"), "pairs")
    # first and last rows of the partitions see their neighbours across the bounds: two rows per partition
    edges = [tuple(r) for r in paired.where("edge").orderBy("part", *order).collect()]
    inner = paired.where("not edge").select("id", "sig", "partner", "partner_sig")
    if not edges:
        return inner
    inside = paired.where("edge").alias("e").join(paired.alias("p"), (F.col("e.partner") == F.col("p.id")) & (F.col("e.partner_sig") == F.col("p.sig")))
    inside_shared = {(r[0], r[1]): _shared(r[2], r[3]) for r in inside.select("e.id", "e.sig", "e.path", "p.path").collect()}
    near = {(e[3], e[4]): e[2] for e in edges}
    stitched = []
    for i, (part, host, path, id_, sig, inside, inside_sig, _) in enumerate(edges):
        row = (host, path, id_, sig)
        before = edges[i - 1][1:5] if i and edges[i - 1][0] != part else None
        after = edges[i + 1][1:5] if i + 1 < len(edges) and edges[i + 1][0] != part else None
        across, across_sig = nearest(row, before, after)
        # the partner inside the partition stays unless the one across the bound is nearer
        gain = -1 if across is None else _shared(path, near[(across, across_sig)])
        have = -1 if inside is None else inside_shared.get((id_, sig), 0)
        stitched.append((id_, sig, across, across_sig) if gain > have else (id_, sig, inside, inside_sig))
    return inner.union(spark.createDataFrame(stitched, f"id {kind}, sig long, partner {kind}, partner_sig long"))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, its lines, those it shares
    with its pair, and how many went by each rule (see ``judged_lines``)."""
    src = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    signed = src.withColumn("sig", F.xxhash64("html"))
    kind = src.schema["page_id"].dataType.simpleString()

    def hashes(batches):
        for batch in batches:
            lines = [line_hashes(page_lines(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64()))], names=["id", "sig", "url", "lines"])

    hashed = freeze(signed.select("page_id", "sig", "url", "html").mapInArrow(hashes, f"id {kind}, sig long, url string, lines array<long>"), "lines")
    known = hashed.where("id is not null").dropDuplicates(["id", "sig"])
    address = F.coalesce(F.col("url"), F.lit(""))
    where = known.select(
        "id",
        "sig",
        F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1).alias("path"),
    )
    pairs = nearest_addresses(where).where("partner is not null")
    own = known.select("id", "sig", F.col("lines").alias("mine"))
    theirs = known.select(F.col("id").alias("partner"), F.col("sig").alias("partner_sig"), F.col("lines").alias("other"))
    aligned = pairs.join(theirs, ["partner", "partner_sig"]).join(own, ["id", "sig"]).select("id", "sig", "mine", "other")

    def align(batches):
        for batch in batches:
            shared = [common_lines(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.list_(pa.int32()))], names=["id", "s", "shared"])

    deletions = aligned.mapInArrow(align, f"id {kind}, s long, shared array<int>")
    rows = signed.join(deletions, (F.col("page_id") == F.col("id")) & (F.col("sig") == F.col("s")), "left").select("page_id", "url", "html", "shared")

    def assemble(batches):
        for batch in batches:
            texts, counts = [], []
            for page, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = page_lines(page)
                kept, *gone = judged_lines(lines, set(shared or ()))
                texts.append("\n".join(kept))
                counts.append((len(texts[-1]), len(lines), len(shared or ()), *gone))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), *columns], names=["page_id", "url", "text", *COUNTS])

    return rows.mapInArrow(assemble, f"page_id {kind}, url string, text string, " + ", ".join(f"{c} long" for c in COUNTS))
