"""Main text of web pages: marked-up regions, and lines shared with the page of the nearest URL."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from listloom.llm.common import small_batches, stored
from listloom.llm.url_reputation import host_of, path_of

#: HTML element names and what words in class, id or role mark.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu math meter nav noembed noframes noscript object option output progress select svg template textarea title video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
MAIN = frozenset(("article", "main"))
#: An element of these ends at the start of another of its own kind, or of what is listed with it.
ENDS = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion related reply replies replylist share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(<)|([^<]+)", re.S)
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GAP = re.compile(r"\s+")


def _boilerplate(attributes: str) -> bool:
    for name, a, b, c in _MARK.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(w.lower() in BOILERPLATE for w in _WORDS.findall(value)):
            return True
    return False


def blocks(html: str) -> list[tuple[bool, str]]:
    """(certain, line) of every block of text outside boilerplate elements; certain inside article or main.

    White space inside a block becomes one space and references are decoded; markup that is cut off at
    the end of the page is left out.
    """
    out: list[tuple[bool, str]] = []
    text: list[str] = []
    stack: list[str] = []
    off = main = -1  # depth of the outermost boilerplate, and of the outermost article or main

    def flush() -> None:
        if text:
            if line := _GAP.sub(" ", unescape("".join(text))).strip():
                out.append((main >= 0, line))
            text.clear()

    def leave(depth: int) -> None:
        nonlocal off, main
        if any(tag in BLOCKS for tag in stack[depth:]):
            flush()
        del stack[depth:]
        off, main = (-1 if off >= depth else off), (-1 if main >= depth else main)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        if m[5] is not None or m[4] is not None:
            if off < 0:
                text.append(m[0])
            continue
        if m[2] is None:
            continue
        if not m[0].endswith(">"):
            break  # cut off inside a tag
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                leave(len(stack) - 1 - stack[::-1].index(tag))
            elif tag in BLOCKS and off < 0:
                flush()
            continue
        for depth in range(len(stack) - 1, -1, -1):
            if tag in ENDS.get(stack[depth], ()):
                leave(depth)
                break
            if stack[depth] in BLOCKS:
                break
        if off < 0:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW or tag == "script":
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if m[0].endswith("/>") and tag not in BLOCKS:
            continue
        stack.append(tag)
        if off < 0 and (tag in NEVER or tag == "header" and main < 0 or _boilerplate(m[3])) and tag not in ("html", "body"):
            off = len(stack) - 1
        if main < 0 and off < 0 and tag in MAIN:
            main = len(stack) - 1
    flush()
    return out


#: Bits of rows that are kept at once to trace an alignment back; longer lists are split in two.
TRACE_BITS = 1 << 27


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Bit j of row i is zero where a longest common subsequence of a[:i + 1] and b[:j + 1] is longer than without b[j]."""
    full, masks, out = (1 << len(b)) - 1, {}, []
    for j, h in enumerate(b):
        masks.setdefault(h, []).append(j)
    masks = {h: sum(1 << j for j in found) for h, found in masks.items()}
    row = full
    for h in a:
        met = row & masks.get(h, 0)
        row = (row + met | row - met) & full
        if every:
            out.append(row)
    return out if every else [row]


def _lengths(row: int, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes, however often lines repeat.

    Rows of lengths are bits of long integers: time grows with the product of both lengths over the width
    of a machine word, memory is bounded by TRACE_BITS and the lists themselves.
    """
    out: set[int] = set()
    known, other = set(b), set(a)
    left = [([i for i, h in enumerate(a) if h in known], [h for h in b if h in other])]  # places in a, lines of b
    while left:
        at, b = left.pop()
        start, least = 0, min(len(at), len(b))
        while start < least and a[at[start]] == b[start]:
            start += 1
        end = 0
        while end < least - start and a[at[-1 - end]] == b[-1 - end]:
            end += 1
        out.update(at[:start], at[len(at) - end:])
        at, b = at[start:len(at) - end], b[start:len(b) - end]
        own = [a[i] for i in at]
        if not at or not b:
            continue
        if len(at) > 1 and len(at) * len(b) > TRACE_BITS:
            half = len(at) // 2
            before, after = _rows(own[:half], b, False)[0], _rows(own[half:][::-1], b[::-1], False)[0]
            cut = int((_lengths(before, len(b)) + _lengths(after, len(b))[::-1]).argmax())
            left += [(at[:half], b[:cut]), (at[half:], b[cut:])]
            continue
        rows = _rows(own, b, True)
        i, j = len(own), len(b)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                out.add(at[i])
                j -= 1
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``: the main text, its blocks joined by blank lines.

    Pages of a host whose lines are all the same count as one, at the place of the first of them. These stand
    in the order of host, path and id; each is aligned with the one before and the one after it, if of the
    same host, and lines shared with one of them are deleted from all its copies. Lines inside article or
    main elements stay although a neighbour shares them: copies and quotes of an article are its text.
    Lines of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go
    by their elements and marks, shared or not.

    A null or empty html gives an empty text. A null url, or one without a host, has no neighbours; it is
    returned as it is. Repeated rows give a row each, all with the same text. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.coalesce(html, F.lit("")).alias("html"))
    key = rows.schema["page_id"].dataType
    name = StructType().add("page_id", key).add("host", "string").add("path", "string").add("mark", "binary")
    cut, marks = to_arrow_schema(StructType([*name]).add("url", "string").add("certain", "string").add("lines", "string")), to_arrow_schema(StructType([*name]).add("open", "boolean").add("hashes", "binary"))

    def parsed(parts, texts):
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for part in parts:
            found = [blocks(h) for h in part.column("html").to_pylist()]
            hashes = [np.array([xxh64_intdigest(line) for _, line in f], "<u8").tobytes() for f in found]
            own = [*(part.column(c) for c in ("page_id", "host", "path")), pa.array([xxh3_128_digest(h) for h in hashes], pa.binary())]
            if texts:
                yield pa.RecordBatch.from_arrays([*own, part.column("url"), pa.array(["".join("1" if c else "0" for c, _ in f) for f in found], pa.string()),
                                                  pa.array(["\n\n".join(line for _, line in f) for f in found], pa.string())], schema=cut)
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array([not all(c for c, _ in f) for f in found], pa.bool_()), pa.array(hashes, pa.binary())], schema=marks)

    # parsed twice, for line hashes and for the texts, which is cheaper than a stored copy of all texts
    hashed = rows.where("host <> ''").mapInArrow(lambda parts: parsed(parts, False), from_arrow_schema(marks))
    first = F.min(F.struct("path", "page_id", "hashes")).alias("first")
    pages_once = stored(hashed.groupBy("host", "mark").agg(first, F.max("open").alias("open")).select("host", "first.path", "first.page_id", "mark", "open", "first.hashes"), "page-lines")
    lost = _lost(pages_once)
    out = to_arrow_schema(StructType().add("page_id", key).add("url", "string").add("text", "string").add("n_chars", "long"))

    def written(parts):
        for part in parts:
            found = []
            for certain, text, gone in zip(*(part.column(c).to_pylist() for c in ("certain", "lines", "gone"))):
                if gone:
                    gone = set(np.frombuffer(gone, "<i4").tolist())
                    text = "\n\n".join(line for k, line in enumerate(text.split("\n\n")) if certain[k] == "1" or k not in gone)
                found.append(text)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], schema=out)

    lines = rows.mapInArrow(lambda parts: parsed(parts, True), from_arrow_schema(cut))
    return lines.join(lost, ["host", "mark"], "left").select("page_id", "url", "certain", "lines", "gone").mapInArrow(written, from_arrow_schema(out))


def _lost(pages: DataFrame) -> DataFrame:
    """(host, mark, gone): for (host, path, page_id, mark, open, hashes), the places of lines that a page with open lines shares with a neighbour."""
    spark = pages.sparkSession
    bounds = spark.sparkContext.broadcast(_bounds(pages.select("host", "path", "page_id")))
    fields = to_arrow_schema(StructType([*pages.schema]).add("shard", "integer"))

    def dealt(parts):
        for part in parts:
            place = [bisect_right(bounds.value, _key(*k)) for k in zip(*(part.column(c).to_pylist() for c in ("host", "path", "page_id")))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place, pa.int32())], schema=fields)

    placed = pages.mapInArrow(dealt, from_arrow_schema(fields))
    order = ["host", "path", "page_id", "mark"]
    row = F.struct(*order, "hashes")
    # one row for each shard: what its neighbours need to know of its first and its last page
    ends = sorted(placed.groupBy("shard").agg(F.min(row), F.max(row)).collect(), key=lambda r: r[0])
    edge = spark.sparkContext.broadcast({now[0]: (before and (before[2][0], before[2][4]), after and (after[1][0], after[1][4])) for before, now, after in zip([None, *ends], ends, [*ends[1:], None])})
    out = pa.schema([("host", pa.string()), ("mark", pa.binary()), ("gone", pa.binary())])

    def differenced(parts):
        shard, before, now = None, None, None  # a page: host, hashes, mark, open
        done: list[tuple] = []

        def finish(after):
            host, hashes, mark, uncertain = now
            if not uncertain:
                return
            own, gone = np.frombuffer(hashes, "<u8").tolist(), set()
            for other in (before, after):
                if other is not None and other[0] == host:
                    gone |= shared(own, np.frombuffer(other[1], "<u8").tolist())
            if gone:
                done.append((host, mark, np.array(sorted(gone), "<i4").tobytes()))

        def batch():
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
            done.clear()
            return found

        for part in parts:
            for s, *page in zip(*(part.column(c).to_pylist() for c in ("shard", "host", "hashes", "mark", "open"))):
                if s != shard:
                    if now is not None:
                        finish(edge.value[shard][1])
                    shard, before = s, edge.value[s][0]
                else:
                    finish(page)
                    before = now
                now = page
            if done:
                yield batch()
        if now is not None:
            finish(edge.value[shard][1])
            if done:
                yield batch()

    ordered = placed.repartition("shard").sortWithinPartitions("shard", *order)
    return ordered.mapInArrow(differenced, from_arrow_schema(out))


def _key(host: str, path: str, page_id) -> tuple:
    return host, path, page_id is not None, page_id


def _bounds(keys: DataFrame, rows: int = 2000) -> list[tuple]:
    """Keys between shards of about ``rows`` pages in the order of host, path and id."""
    total = keys.count()
    shards = -(-total // rows)
    if shards < 2:
        return []
    share = min(1.0, 30 * shards / total)
    some = sorted(_key(*r) for r in (keys if share == 1 else keys.sample(fraction=share, seed=3)).collect())
    return sorted(set(some[k * len(some) // shards] for k in range(1, shards))) if some else []
