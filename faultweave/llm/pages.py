"""Main text of web pages: structure first, then a suffix array over each host's remaining text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments go by their markup;
what an article or main element holds is the article. Text outside of any such mark is judged by its
host: the token streams of the host's pages outside articles are laid end to end, a suffix array
finds substrings that repeat on distinct pages, and blocks that these cover are boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm._shared import Saved, shuffle_partitions, table
from faultweave.llm.leaks import _window_hashes

#: Tokens of a repeat at least, the part of a block that repeats must cover, tokens in one suffix array at most.
MIN_REPEAT, COVERED, ARRAY_TOKENS = 6, 0.8, 500_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select|object|button)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("nav aside form footer head menu dialog fieldset".split())
#: Class names and ids that are boilerplate, whole or as the last or first part of a name with hyphens.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr popup modal newsletter share sharing related recommended comment comments replies disqus pagination pager".split()
)
#: The same, but not as the first part, and inside an article only where the element has no other class.
_LOOSE_MARKS = frozenset("header notice notices banner search subscribe signup login social respond widget copyright".split())
#: Names of parts of the page's frame: an article inside is the article all the same.
_FRAME = frozenset("header masthead sidebar search banner menu nav navbar navigation widget notice notices login signup social".split())
_NOT_A_MARK = frozenset("has no with without is not".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
_SHUT = frozenset("article main nav aside footer header form section div table body html ul ol".split())
#: What an element is: dropped with all it holds; dropped but for articles, by a strong mark or a part of the frame; not marked; an article, one inside a part of the frame, one inside a strong mark.
_GONE, _MARKED, _FRAMED, _OPEN, _ARTICLE, _ARTICLE_IN_FRAME, _ARTICLE_IN_MARK = 0, -1, -2, 1, 2, 3, 4


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's text blocks in order; kind 0: boilerplate by markup, 1: not marked, 2: the article.

    Text of marked inline elements is no part of its block. Without an article, one inside a part of
    the page's frame counts as it, and if nothing else holds text, one inside any mark.
    """
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, held, at = _OPEN, [], 0

    def close() -> None:
        best = max((k for k, _ in held), default=_GONE)
        text = " ".join(entities.unescape("".join(t for k, t in held if k > 0 or best <= 0)).split())
        if not text and best > 0:
            best, text = _GONE, " ".join(entities.unescape("".join(t for _, t in held)).split())
        held.clear()
        if text:
            out.append((max(best, _GONE), text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append((kind, page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append((kind, " "))
            continue
        if name in _BLOCK:
            close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in _SHUT and name not in _SHUT:
                    break
        elif name not in _VOID and not m[4].endswith("/"):
            if name == "p" or name == "li":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in _SHUT:
                        break
            own = stack[-1][1] if stack else _OPEN
            if own != _GONE:
                own = _kind(name, m[4], own)
            stack.append((name, own))
        else:
            continue
        kind = stack[-1][1] if stack else _OPEN
    if at < len(page):
        held.append((kind, page[at:]))
    close()
    kinds = {k for k, _ in out}
    article = _ARTICLE if _ARTICLE in kinds else _ARTICLE_IN_FRAME if _ARTICLE_IN_FRAME in kinds else _GONE if _OPEN in kinds else _ARTICLE_IN_MARK
    return [(_ARTICLE if k == article and k else k if k <= _OPEN else _GONE, text) for k, text in out]


def _mark(value: str, inside: bool) -> int:
    """What class names or an id say: _OPEN, _FRAMED or _MARKED."""
    names, found = value.lower().split(), _OPEN
    for name in names:
        parts = re.split(r"[-_]+", name.strip("-_"))
        last = parts[-1]
        if parts[0] in _NOT_A_MARK:
            continue
        if last in _LOOSE_MARKS and not (inside and (last == "header" or len(names) > 1)):
            word = last
        elif last in _MARKS:
            word = last
        elif parts[0] in _MARKS:
            word = parts[0]
        else:
            continue
        if word not in _FRAME:
            return _MARKED
        found = _FRAMED
    return found


def _kind(name: str, attributes: str, own: int) -> int:
    inside = own >= _ARTICLE
    if name in _DROPPED or (name == "header" and not inside):
        return _GONE
    article, main, marked = name == "article", name == "main", _OPEN
    if "=" in attributes or "hidden" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return _GONE
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return _GONE
            elif key in ("class", "id"):
                if name not in ("html", "body"):
                    marked = min(marked, _mark(value, inside), key=(_MARKED, _FRAMED, _OPEN).index)
            elif key == "role":
                value = value.strip().lower()
                if value in _ROLES:
                    return _GONE
                article, main = article or value == "article", main or value == "main"
            elif key == "itemprop":
                article = article or value.strip().lower() == "articlebody"
    if article or main:
        if marked == _MARKED and not main:
            return _MARKED
        if own == _FRAMED or (own == _MARKED and main):
            return _ARTICLE_IN_FRAME
        return _ARTICLE_IN_MARK if own == _MARKED else own if inside else _ARTICLE
    return own if marked == _OPEN or own == _MARKED else marked


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of the common prefix of each with the one before) by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.ones(n, np.int64)
        new[0] = 0
        a, b = order[1:], order[:-1]
        new[1:] = (rank[a] != rank[b]) | (second[a] != second[b])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            break
    lcp = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(levels) - 1, -1, -1):
        width = 1 << level
        ok = (a + width <= n) & (b + width <= n)
        same = ok.copy()
        same[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        lcp[1:][same] += width
        a, b = np.where(same, a + width, a), np.where(same, b + width, b)
    return order, lcp


def repeated(streams: list[list[str]], owners: list[int], least: int = MIN_REPEAT, others: list[int] | None = None) -> list[float]:
    """For each token stream, the part of its tokens inside substrings of ``least`` tokens or more that another owner has too; ``others`` are second owners of the streams."""
    ids: dict[str, int] = {}
    codes, owner, other, stream, left = [], [], [], [], []
    for s, words in enumerate(streams):
        for w in words:
            codes.append(ids.setdefault(w, len(ids)))
        codes.append(-1 - s)  # a separator that repeats nowhere
        owner += [owners[s]] * (len(words) + 1)
        other += [(others or owners)[s]] * (len(words) + 1)
        left += range(len(words), -1, -1)
        stream += [s] * (len(words) + 1)
    order, lcp = suffix_array(np.array(codes))
    owner, other, stream, left, n = np.array(owner), np.array(other), np.array(stream), np.array(left), len(codes)
    # suffixes that share ``least`` tokens lie together: a run with two owners is a repeat for all of it
    run = np.cumsum(np.append(True, lcp[1:] < least))
    low, high = (np.full(run[-1] + 1, x) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(low, run, owner[order])
    np.maximum.at(high, run, other[order])
    hit = order[(low < high)[run] & (left[order] >= least)]
    edge = np.zeros(n + least + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    inside = np.cumsum(edge)[:n] > 0
    covered = np.bincount(stream, inside, len(streams))
    return [float(c / len(w)) if w else 0.0 for c, w in zip(covered, streams, strict=True)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REPEAT, array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by an empty line.

    Null, empty and textless pages give an empty text; null and repeated ids, null urls (one host of
    their own) and repeated rows stay rows; broken or cut markup is read as far as it goes; an empty
    table gives no rows; other columns are ignored. Article elements are never cut down. Pages with one
    token stream (but for what markup drops) are copies and count as one page; what has fewer than
    ``least`` tokens is no repeat. Hosts of more than ``array_tokens`` tokens have no suffix array:
    their windows of ``least`` tokens are grouped by hash over the whole host, with the same result.
    """
    spark = pages.sparkSession
    saved = Saved(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("page_id", "url", "html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))

    def outside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            out = []
            for h, page, source in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                found = blocks(source)
                content = " ".join(text for kind, text in found if kind)
                owner = int.from_bytes(hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                out += [(h, page, owner, kind, text, text.count(" ") + 1) for kind, text in found if kind < 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["host", "page", "owner", "kind", "block", "n"])

    loose = rows.select(host.alias("host"), "page", "html").mapInArrow(outside, "host string, page long, owner long, kind int, block string, n int")
    # one row a distinct block of a host: its least and greatest owner tell whether pages share it
    distinct = saved.save(loose.groupBy("host", "block", "n").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.max("kind").alias("kind")))
    # only hosts with unmarked text have anything to judge
    open_hosts = distinct.where("kind = 1").groupBy("host").agg(F.count("*").alias("open")).select("host")
    judged = distinct.join(open_hosts, "host", "left_semi")
    volume = judged.groupBy("host").agg(F.ceil(F.sum("n") / array_tokens).cast("int").alias("arrays"))
    judged = judged.join(volume, "host")

    def sift(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            shares = repeated([r["block"].split(" ") for r in held], [r["low"] for r in held], least, [r["high"] for r in held]) if held else []
            gone = [r["block"] for r, share in zip(held, shares, strict=True) if r["kind"] == 1 and share >= COVERED]
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(gone), pa.string()), pa.array(gone, pa.string())], names=["host", "block"])

        for rb in it:
            for r in rb.to_pylist():
                if r["host"] != key:
                    yield from done()
                    key, held = r["host"], []
                held.append(r)
        yield from done()

    gone = judged.where("arrays = 1").repartition(shuffle_partitions(spark), "host").sortWithinPartitions("host", "block").mapInArrow(sift, "host string, block string")
    wide = judged.where("arrays > 1").withColumn("site", F.xxhash64("host")).withColumn("spot", F.xxhash64("host", "block"))
    windows = wide.select("site", "spot", "kind", "low", "high", F.posexplode(_window_hashes(F.split("block", " ", -1), least)).alias("at", "window"))
    twice = windows.groupBy("site", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("site", "window")
    hits = windows.where("kind = 1").join(twice, ["site", "window"], "left_semi").groupBy("spot").agg(F.sort_array(F.collect_set("at")).alias("at"))
    steps = F.transform("at", lambda x, i: F.least(F.lit(least), F.get("at", i + 1) - x))  # the last one has no next: all its tokens
    hits = hits.select("spot", F.aggregate(steps, F.lit(0), lambda a, x: a + x).alias("covered"))
    gone = gone.union(wide.join(hits, "spot").where((F.col("kind") == 1) & (F.col("covered") / F.col("n") >= COVERED)).select("host", "block"))
    unmarked = loose.where("kind = 1").select("host", "page", "block").distinct()
    dropped = saved.save(unmarked.join(gone, ["host", "block"]).groupBy("page").agg(F.collect_set("block").alias("dropped")))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts = []
            for source, drop in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist(), strict=True):
                found = blocks(source)
                if any(kind == 2 for kind, _ in found):
                    texts.append("\n\n".join(t for kind, t in found if kind == 2))
                else:
                    gone = set(drop or ())
                    texts.append("\n\n".join(t for kind, t in found if kind == 1 and t not in gone))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(dropped, "page", "left").select("page_id", "url", "html", "dropped").mapInArrow(keep, "page_id long, url string, text string, n_chars long")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
