"""Main text of web pages: blocks by markup, boilerplate by suffix arrays over the pages of a host."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import read, register, stored, text_or_empty

#: Pages that a task parses before it passes them on.
_PAGES = 256

# Element names by their part in a page.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title"
SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN = {"article", "main"}
#: Skipped elements that may stand around a whole page.
AROUND = {"form"}
#: Class, id and role words of containers that hold no main text, outside and inside of an article.
ASIDE = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|side|cookie|user|reader|social|nav)[_-])?"
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?bar|bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"header|footer|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|"
    r"comments?|disqus|replies|respond|widget|toolbar|pagination|login)"
    r"(?:[_-](?:area|banner|bar|box|container|footer|form|inner|item|items|links?|list|menu|nav|notice|section|signup|slot|unit|wrapper))?",
    re.I,
)
INSIDE = {
    "ad", "ads", "advert", "advertisement", "sponsored", "sidebar", "side-bar", "comments", "comment-list", "disqus",
    "newsletter", "cookie-notice", "cookie-banner", "share", "share-buttons",
}
_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+"
#: Comments and raw elements with all they hold; tags, whole or broken off. What is read once is not read again.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][\w:-]*+)({_ATTRIBUTES})>|<(/?)([a-zA-Z][\w:-]*+)([^<>]*+)>|</?[a-zA-Z][^<>]*+|<[!?][^<>]*+>?",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass(frozen=True)
class Boilerplate:
    #: Tokens that a run needs to count as long.
    run: int = 20
    #: Tokens of the pieces that runs are first looked for by; every run of ``run`` tokens has one chosen by its content.
    anchor: int = 6
    #: Bytes of tokens that are laid end to end in one suffix array; those of more are dealt to several.
    array_bytes: int = 2_000_000
    #: Bytes of the tables that are broadcast instead of shuffling the pages.
    broadcast_bytes: int = 32_000_000


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, zone) per visible block, in page order: ``main`` in a declared main element, ``aside`` in
    a skipped element or a container named as one, else ``body``.

    Comments and raw elements give nothing; a header is an aside outside of a main element. A container
    is named as an aside by a whole word of its class, id or role; inside of a main element only a few words count.
    A main element inside of such a container, or of a form, is the main text if there is no other. Unclosed
    elements end with the one around them; a tag that breaks off ends before the next. Time is linear in the page.
    """
    out: list[tuple[str, str]] = []
    # An aside inside of a line does not end the line.
    pieces: list[str] = []
    asides: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # name, and what held around it
    opened: Counter[str] = Counter()
    zone, line_zone, hard = "body", "body", False  # hard: no main element counts in here

    def close() -> None:
        for parts, kind in ((asides, "aside"), (pieces, line_zone)):
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, kind))

    def enter(new: str) -> None:
        nonlocal zone, line_zone
        if new not in ("aside", line_zone):
            close()
            line_zone = new
        zone = new

    def pop(upto: int) -> None:
        nonlocal hard
        for name, _, _ in stack[upto:]:
            opened[name] -= 1
        _, before, hard = stack[upto]
        enter(before)
        del stack[upto:]

    at = 0
    for tag in _MARKUP.finditer(page):
        (asides if zone == "aside" else pieces).append(page[at : tag.start()])
        at = tag.end()
        name, end, attributes = (tag[3] or tag[6] or "").lower(), tag[2] or tag[5], tag[4] or tag[7] or ""
        if not name:
            continue
        if name == "br":
            (asides if zone == "aside" else pieces).append(" ")
            continue
        if name in BLOCKS or name in SKIPPED or name in MAIN:
            close()
        if end:
            if opened[name]:
                at_ = len(stack) - 1
                while stack[at_][0] != name:
                    at_ -= 1
                pop(at_)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            stack.append((name, zone, hard))
            opened[name] += 1
            new = zone
            if name in MAIN:
                new = {"body": "main", "aside": "aside" if hard else "inner"}.get(zone, zone)
            elif name in SKIPPED or (name == "header" and zone == "body"):
                new, hard = "aside", hard or name not in AROUND or zone in ("main", "inner")
            elif attributes and name not in ("html", "body") and zone != "aside":
                words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split()
                inside = zone in ("main", "inner")
                if any(w in INSIDE if inside else ASIDE.fullmatch(w) for w in words):
                    new, hard = "aside", hard or inside
            enter(new)
    (asides if zone == "aside" else pieces).append(page[at:])
    close()
    inner = "aside" if any(z == "main" for _, z in out) else "main"
    return [(text, inner if z == "inner" else z) for text, z in out]


def _tokens(found: Iterable[tuple[str, bool]]) -> np.ndarray:
    """Token hashes of the blocks; a break ends each, -2 for one of the main text's own, else -1."""
    tokens: list[int] = []
    for text, main in found:
        tokens += [zlib.crc32(t.encode("utf-8", "surrogatepass")) >> 1 for t in text.split()]
        tokens.append(-2 if main else -1)
    return np.array(tokens, "int32")


def shared_starts(tokens: np.ndarray, least: np.ndarray, most: np.ndarray, outside: np.ndarray, run: int) -> np.ndarray:
    """Where a run of that length starts that several pages have, once outside main text; in order.

    ``least`` and ``most`` are the pages that show a token, ``outside`` whether one does so outside of main
    text. The suffixes are ranked by their first ``run`` tokens, by doubling: equal ranks are equal runs. Each
    break, a negative token, has a rank of its own, so a shared run holds none.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64)
    breaks = np.flatnonzero(tokens < 0)
    unique = tokens.astype(np.int64)
    unique[breaks] = -1 - np.arange(len(breaks))
    rank, length = np.unique(unique, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    # Whole runs only: with a break in it, or cut by the end, none equals another.
    ends = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n))]
    order = np.argsort(rank, kind="stable")
    new = np.r_[True, np.diff(rank[order]) != 0]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = np.minimum.reduceat(least[order], starts) != np.maximum.reduceat(most[order], starts)
    shared = (several & np.maximum.reduceat(outside[order], starts))[group]
    return np.sort(order[shared & (ends[order] >= order + run)])


def repeated_runs(tokens: np.ndarray, page_of: np.ndarray, run: int) -> np.ndarray:
    """Which tokens stand in such a run, for the streams of several pages; -1 ends a block outside main text."""
    breaks = np.flatnonzero(tokens < 0)
    outside = tokens[breaks[np.searchsorted(breaks, np.arange(len(tokens)))]] == -1
    n, shared = len(tokens), shared_starts(tokens, page_of, page_of, outside, run)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, shared, 1)
    np.add.at(edges, np.minimum(shared + run, n), -1)
    return np.cumsum(edges[:-1]) > 0


def flat(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A page's stream with breaks only where main text begins or ends, and each token's place in the full one.

    So runs lie across blocks: a menu of short items is as long as all of them.
    """
    breaks = np.flatnonzero(codes < 0)
    zones = codes[breaks]
    keep = codes >= 0
    keep[breaks[np.r_[zones[1:] != zones[:-1], True][: len(breaks)]]] = True
    at = np.flatnonzero(keep)
    return codes[at], at


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def anchors(tokens: np.ndarray, rules: Boilerplate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, outside) of the least-hashed piece of ``anchor`` tokens of every run without a break.

    Equal runs choose equal pieces, and neighbouring runs mostly the same one.
    """
    n, wide = len(tokens) - rules.run + 1, rules.run - rules.anchor + 1
    if n <= 0:
        return np.zeros(0, "int32"), np.zeros(0, "int64"), np.zeros(0, bool)
    hashes, length = _mixed(tokens.astype("int64").view("uint64") + np.uint64(1)), 1
    while length < rules.anchor:
        step = min(length, rules.anchor - length)
        hashes = _mixed(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:])
        length += step
    breaks = np.flatnonzero(tokens < 0)
    ends = np.append(breaks, len(tokens))[np.searchsorted(breaks, np.arange(n))]
    starts = np.flatnonzero(ends >= np.arange(n) + rules.run)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    places = np.unique(starts + windows[starts].argmin(1)) if len(starts) else starts
    ends = np.append(breaks, len(tokens))[np.searchsorted(breaks, places)]
    return places.astype("int32"), hashes[places].view("int64"), tokens[np.minimum(ends, len(tokens) - 1)] == -1


def _covered(runs: Iterable[tuple[int, int]]) -> list[int]:
    """Starts and ends of what the (start, end) cover."""
    out: list[int] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _places(ranges: list[int] | None) -> set[int]:
    gone: set[int] = set()
    if ranges is not None:
        for start, end in zip(ranges[::2], ranges[1::2]):
            gone.update(range(start, end))
    return gone


def main_text(page: str) -> str:
    """The blocks of the declared main elements, or else of the body."""
    return _kept(blocks(page), None, Boilerplate().run)


def _kept(found: list[tuple[str, str]], starts: list[int] | None, run: int) -> str:
    """The wanted blocks without the runs that start at these tokens of the flat stream.

    Runs across blocks take whole blocks alone: the first words after a menu are not part of it.
    """
    wanted = "main" if any(zone == "main" for _, zone in found) else "body"
    if not starts:
        return "\n\n".join(" ".join(text.split()) for text, zone in found if zone == wanted)
    place = flat(_tokens((text, zone == "main") for text, zone in found))[1]
    runs = [(int(place[i]), int(place[i + run - 1]) + 1) for i in starts]
    gone, across = _places(_covered(r for r in runs if r[1] - r[0] == run)), _places(_covered(runs))
    out, at = [], 0
    for text, zone in found:
        tokens = text.split()
        if zone == wanted and not across.issuperset(range(at, at + len(tokens))):
            rest = [t for i, t in enumerate(tokens, at) if i not in gone]
            if rest:
                out.append(" ".join(rest))
        at += len(tokens) + 1
    return "\n\n".join(out)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, _PAGES) for at in range(0, batch.num_rows, _PAGES)):
            found = [blocks(x) for x in part.column("body").to_pylist()]
            texts = pa.array([[text for text, _ in page] for page in found], pa.list_(pa.string()))
            zones = pa.array([[zone for _, zone in page] for page in found], pa.list_(pa.string()))
            columns = [part.column(c) for c in ("key", "url", "host", "page")]
            yield pa.RecordBatch.from_arrays([*columns, texts, zones], ["key", "url", "host", "page", "texts", "zones"])


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(host, page, flat stream) of each row; tokens of different hosts differ."""
    names = ("host", "page", "texts", "zones")
    for host, page, texts, zones in zip(*(batch.column(c).to_pylist() for c in names)):
        tokens = flat(_tokens((text, zone == "main") for text, zone in zip(texts, zones)))[0]
        yield host, page, np.where(tokens < 0, tokens, tokens ^ (host & 0x7FFFFFFF)).astype("int32")


def _anchored(batches: Iterator[pa.RecordBatch], rules: Boilerplate) -> Iterator[pa.RecordBatch]:
    """(anchor, host, page, at, outside) of all pages."""
    for batch in batches:
        rows = []
        for host, page, tokens in _streams(batch):
            at, hashes, outside = anchors(tokens, rules)
            rows.append((hashes, np.full(len(at), host), np.full(len(at), page), at, outside))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*rows)], ["anchor", "host", "page", "at", "outside"]
            )


def _windows(batches: Iterator[pa.RecordBatch], rules: Boilerplate) -> Iterator[pa.RecordBatch]:
    """(anchor, window, host, page, start, outside): the tokens of all runs around the anchors at ``ats``."""
    for batch in batches:
        out: list[tuple] = []
        for (host, page, tokens), ats in zip(_streams(batch), batch.column("ats").to_pylist()):
            breaks = np.flatnonzero(tokens < 0)
            wanted, (places, hashes, outside) = set(ats), anchors(tokens, rules)
            for at, anchor, out_ in zip(places.tolist(), hashes.tolist(), outside.tolist()):
                if at in wanted:
                    i = np.searchsorted(breaks, at)
                    low = max(breaks[i - 1] + 1 if i else 0, at - rules.run + rules.anchor)
                    high = min(breaks[i] if i < len(breaks) else len(tokens), at + rules.run)
                    out.append((anchor, tokens[low:high].astype("<i4").tobytes(), host, page, int(low), out_))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "window", "host", "page", "start", "outside"]
        )


def _decided(batches: Iterator[pa.RecordBatch], rules: Boilerplate) -> Iterator[pa.RecordBatch]:
    """(anchor, window, starts): the repeated runs of each window; the windows of a group come one after another."""
    group, held = None, []

    def flush() -> pa.RecordBatch:
        streams = [np.append(np.frombuffer(piece, "<i4"), -1) for _, _, piece, *_ in held]
        sizes = [len(x) for x in streams]
        spread = lambda column, kind: np.repeat(np.array(column, kind), sizes)
        _, _, _, _, least, most, outside = zip(*held)
        shared = shared_starts(
            np.concatenate(streams), spread(least, "int64"), spread(most, "int64"), spread(outside, bool), rules.run
        )
        ends, rows = np.cumsum(sizes), []
        for (anchor, window, _, offset, *_), low, high in zip(held, ends - sizes, ends):
            own = shared[slice(*np.searchsorted(shared, [low, high]))] - low + offset
            if len(own):
                rows.append((anchor, window, own.tolist()))
        columns = list(zip(*rows)) or [()] * 3
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "window", "starts"])

    for batch in batches:
        names = ("group", "anchor", "window", "piece", "offset", "least", "most", "outside")
        for of, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if of != group and held:
                yield flush()
                held = []
            group = of
            held.append(row)
    if held:
        yield flush()


def _small(table: DataFrame, lists: str, rules: Boilerplate) -> DataFrame:
    """The table, broadcast if its rows and their lists are few enough, so that the pages aren't shuffled for it."""
    rows, items = table.agg(F.count("*"), F.sum(F.size(lists))).first()
    return F.broadcast(table) if 64 * rows + 4 * (items or 0) <= rules.broadcast_bytes else table


def _repeated(parsed: DataFrame, rules: Boilerplate) -> DataFrame:
    """(host, page, starts): where runs start, in flat streams, that several pages of a host have, once outside main text.

    Anchors travel narrow and folded; only those that several pages show meet their places again. The token
    windows around these, equal ones folded, are laid end to end in suffix arrays, each of about
    ``array_bytes``, which decide. An anchor of more than that has its windows dealt by run.
    """
    places = parsed.mapInArrow(lambda it: _anchored(it, rules), "anchor long, host long, page long, at int, outside boolean")
    kinds = places.groupBy("anchor").agg(
        F.min("page").alias("least"), F.max("page").alias("most"), F.max("outside").alias("outside")
    )
    shared = stored(kinds.filter("least != most AND outside").select("anchor"), "anchors")
    hits = places.join(shared, "anchor", "left_semi").groupBy("host", "page").agg(F.collect_set("at").alias("ats"))
    windows = parsed.join(_small(stored(hits, "hits"), "ats", rules), ["host", "page"]).select("host", "page", "texts", "zones", "ats").mapInArrow(
        lambda it: _windows(it, rules), "anchor long, window binary, host long, page long, start int, outside boolean"
    )
    windows = stored(windows, "windows")
    folded = windows.groupBy("anchor", "window").agg(
        F.min("page").alias("least"), F.max("page").alias("most"), F.max("outside").alias("outside")
    )
    folded = stored(folded, "window-kinds")
    size = F.octet_length("window") + 4
    sizes = folded.groupBy("anchor").agg(F.sum(size).alias("bytes"))
    groups = -(-(sizes.agg(F.sum("bytes")).first()[0] or 1) // rules.array_bytes)
    kept = ["anchor", "window", "least", "most", "outside"]
    dealt = folded.join(sizes, "anchor")
    whole = dealt.filter(F.col("bytes") <= rules.array_bytes).select(
        F.pmod("anchor", F.lit(groups)).alias("group"), *kept, F.col("window").alias("piece"), F.lit(0).alias("offset")
    )
    runs = dealt.filter(F.col("bytes") > rules.array_bytes).filter(F.octet_length("window") >= 4 * rules.run).select(
        *kept, F.explode(F.sequence(F.lit(0), (F.octet_length("window") / 4).cast("int") - rules.run)).alias("offset")
    )
    piece = F.substring("window", 4 * F.col("offset") + 1, 4 * rules.run)
    runs = runs.withColumn("piece", piece).select(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"), *kept, "piece", "offset")
    ordered = whole.union(runs).repartition("group").sortWithinPartitions("group")
    decided = ordered.mapInArrow(lambda it: _decided(it, rules), "anchor long, window binary, starts array<int>")
    each = windows.join(decided, ["anchor", "window"]).select("host", "page", F.explode("starts").alias("x"), "start")
    return each.groupBy("host", "page").agg(F.collect_set(F.col("x") + F.col("start")).alias("starts"))


def _texts(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("texts", "zones", "starts"))
        out = [_kept(list(zip(texts, zones)), starts, run) for texts, zones, starts in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(out, pa.string())], ["key", "url", "text"])


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", rules: Boilerplate = Boilerplate()
) -> DataFrame:
    """Per page: key, url, text, n_chars. Null pages are empty and have an empty text.

    Every page is parsed once. The token streams of a host's pages are searched for long runs that
    several of its pages have; equal pages count as one, and runs lie across blocks. A run that no page shows outside
    of a declared main element stays, so passages that articles share are kept. The result is the same however
    large a host is. Pages without a host make a host of their own; every row comes back; an empty table gives none.
    """
    body = text_or_empty(page)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.xxhash64(host).alias("host"), F.xxhash64(body).alias("page"), body.alias("body"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"key {kinds['key']}, url {kinds['url']}"
    parsed = rows.mapInArrow(_parsed, f"{schema}, host long, page long, texts array<string>, zones array<string>")
    parsed = stored(parsed, "pages", "zstd")
    ranges = stored(_repeated(parsed, rules), "repeated")
    found = parsed.join(_small(ranges, "starts", rules), ["host", "page"], "left").select("key", "url", "texts", "zones", "starts")
    texts = found.mapInArrow(lambda it: _texts(it, rules.run), f"{schema}, text string")
    result = texts.select(F.col("key").alias(key), F.col("url").alias(url), "text")
    return result.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op6_html_suffix_arrays")
def op6_html_suffix_arrays(spark: SparkSession, d: str) -> DataFrame:
    return extract(read(spark, d, "pages"))
