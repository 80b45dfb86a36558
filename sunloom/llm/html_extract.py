"""Main-text extraction by template deduction over the pages of a host.

Every page is read as tokens: its elements (path of tags with their classes) and
its text blocks (path and text).  A token's occurrence vector over the host's
pages is kept as one linear fingerprint, the sum of count * hash(page), so tokens
are grouped into equivalence classes by plain sums, without gathering pages.
Large and frequent classes make up the host's template: their elements nest as
the pages do, and a text of the class that always stands in one slot between
them is template text.  All other text lies in the slots.  The main text is
that of the article (all article and main elements; without one, of all slots)
less everything in it that is a menu, form, notice, advert, comment and so on.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import saved

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--|<[!?]""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
_DROP = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select option textarea input label fieldset dialog menu title noembed noframes map".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended widget pagination pager toolbar skip login search paywall disclaimer feedback".split())
#: Words that say nothing by themselves in a name like `ad-slot` or `comments-section`.
_NEUTRAL = frozenset("area article bar block body bottom box button buttons col column container content desktop dynamic entry fixed form group header holder inline inner item items js latest left link links list main message mobile module outer page panel popular post posts primary reader recent right row secondary section site slot small sticky text thread top unit user wrap wrapper x".split())
#: Elements whose id says what they are for; that of a heading or paragraph is a place to link to.
_BOXES = frozenset("div section ul ol dl table ins span details figure".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
_MAIN_NAMES = frozenset(("main", "articlebody"))
_WORDS = re.compile(r"[a-z]+")
#: Share of a host's distinct pages that a frequent class stands in.
SUPPORT = 0.5
#: Template rows up to which the template is sent to every task; beyond it pages are joined with their host's.
BROADCAST_ROWS = 200_000


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


class Block:
    __slots__ = ("at", "dropped", "main", "path", "text")

    def __init__(self, path: int, dropped: bool, main: bool, text: str, at: int):
        self.path, self.dropped, self.main, self.text, self.at = path, dropped, main, text, at


def _outside(tag: str, a: dict[str, str], in_main: bool) -> bool:
    """Whether an element is none of the article's text."""
    if tag in _DROP or tag == "header" and not in_main or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main") or not a:
        return False
    # A whole name must say so: `ad-slot` does, `search-results-table` and `related-work` do not.
    names = f"{a.get('class', '')} {a.get('id', '') if tag in _BOXES else ''}".split()
    for name in names:
        words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _NEUTRAL for w in words):
            return True
    return False


def parse(page: str) -> tuple[list[int], list[Block]]:
    """The paths (hashes) of a page's elements in order, and its text blocks.

    A block's `main` says whether it is in an article or main element, `at` is the number of elements that begin
    before it.  Unclosed and misnested tags are closed as browsers do for paragraphs, list items and table parts; stray
    end tags are ignored.
    """
    elements: list[int] = []
    blocks: list[Block] = []
    # open elements: (tag, path, dropped, main)
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    text: list[str] = []
    at, n, begun = 0, len(page), 0

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                top = stack[-1]
                k = len(stack) - 1
                while k and stack[k][0] not in _BLOCK:
                    k -= 1
                blocks.append(Block(stack[k][1], top[2], top[3], words, begun))

    def pop(k: int) -> None:
        if any(x[0] in _BLOCK or x[2] != stack[k - 1][2] for x in stack[k:]):
            flush()
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            begun = begun if text else len(elements)
            text.append(page[at:])
            break
        if m.start() > at:
            begun = begun if text else len(elements)
            text.append(page[at : m.start()])
        if m[2] is None:
            end = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        a = _attributes(m[3])
        if tag in _BLOCK:
            flush()
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag in _IMPLIED:
            closed, scope = _IMPLIED[tag]
            lowest = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in closed:
                    lowest = k
            if lowest:
                pop(lowest)
        _, path, dropped, main = stack[-1]
        path = xxhash.xxh64_intdigest(f"{path}/{tag}.{a.get('class', '')}") >> 1
        elements.append(path)
        if tag in _VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        out = _outside(tag, a, main)
        if out != dropped and out:
            flush()
        if not main and not dropped and not out and (tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() in _MAIN_NAMES):
            main = True
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, path, dropped or out, main))
    flush()
    return elements, blocks


def _text_token(b: Block) -> int:
    return xxhash.xxh64_intdigest(f"{b.path}|{b.text}") >> 1


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without user and port; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1), F.lit("")))


def main_text(page: str, template: Collection[int] = ()) -> str:
    """The main text of a page, given its host's template text tokens; nothing goes from an article for being common."""
    _, blocks = parse(page)
    kept = [b for b in blocks if not b.dropped]
    # Without text in them they say nothing about where the page has its own.
    if any(b.main for b in kept):
        return "\n".join(b.text for b in kept if b.main)
    return "\n".join(b.text for b in kept if not template or _text_token(b) not in template)


def _told(pages: DataFrame, rows: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[dict[int, int]]]]:
    """Pages (host first), and what gives each page of a batch its host's map of rows (host, token, value).

    Up to BROADCAST_ROWS rows go to every task; more are joined, as a last column.
    """
    if rows.count() <= BROADCAST_ROWS:
        known: dict[str, dict[int, int]] = {}
        for host, token, value in rows.collect():
            known.setdefault(host, {})[token] = value
        shared = pages.sparkSession.sparkContext.broadcast(known)  # BROADCAST_ROWS pairs of numbers at most
        return pages, lambda b: [shared.value.get(x, {}) for x in b.column(0).to_pylist()]
    per = rows.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_told"))
    at = len(pages.columns)
    return pages.join(per, "host", "left").select(*pages.columns, "_told"), lambda b: [dict(x or ()) for x in b.column(at).to_pylist()]


def _read(source: DataFrame) -> DataFrame:
    """(host, digest, elements, tokens, at, size): every distinct page of a host as its tokens, written once.

    elements: the paths of its elements in order; of its texts: token, elements before it, length (below 0: dropped).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, bytes]] = set()  # a group of copies is a row per task before the shuffle
        for b in batches:
            out: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = (host, xxhash.xxh3_128_digest((page or "").encode("utf-8", "surrogatepass")))
                if not page or key in done:
                    continue
                done.add(key)
                elements, blocks = parse(page)
                if elements or blocks:
                    out.append((*key, elements, [_text_token(x) for x in blocks], [x.at for x in blocks], [-len(x.text) if x.dropped else len(x.text) for x in blocks]))
            kinds = (pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["host", "digest", "elements", "tokens", "at", "size"])

    kinds = "host string, digest binary, elements array<long>, tokens array<long>, at array<int>, size array<int>"
    return saved(source.select("host", "_html").mapInArrow(run, kinds).dropDuplicates(["host", "digest"]))


def _classes(distinct: DataFrame) -> DataFrame:
    """(host, token, value): the tokens of the large and frequent classes of each host; value: the class.

    A class is the tokens of a host with one occurrence vector over its distinct pages: copies count once.  It is
    frequent if it stands in SUPPORT of the pages, in two at least, and large if it has elements and texts: a text whose
    vector is no element's belongs to no template, however common it is.  There are fewer such tokens than twice a
    page's, however many pages a host has.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, digest, elements, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = int.from_bytes(digest[:8], "little")
                for kind, found in ((0, Counter(elements)), (1, Counter(tokens))):
                    for token, count in found.items():
                        s = sums.setdefault((host, token), [0, 0, kind])
                        s[0] = (s[0] + count * mine) & 0xFFFFFFFF
                        s[1] += 1
                sums.setdefault((host, 0), [0, 0, 0])[1] += 1
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([sums[k][j] for k in keys], pa.int64()) for j in range(3))], names=["host", "token", "vector", "n", "kind"])

    counted = distinct.select("host", "digest", "elements", "tokens").mapInArrow(add, "host string, token long, vector long, n long, kind long").groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("n").alias("n"), F.max("kind").alias("kind"))
    counted = saved(counted.where("n > 1"))
    sizes = counted.where("token = 0").select("host", F.col("n").alias("pages"))
    frequent = counted.where("token <> 0").join(sizes, "host").where(F.col("n") >= SUPPORT * F.col("pages"))
    large = frequent.groupBy("host", "vector", "n").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).where("low = 0 AND high = 1")
    return saved(frequent.join(large, ["host", "vector", "n"]).select("host", "token", F.xxhash64("vector", "n").alias("value")))


def slots(elements: list[int], texts: list[tuple[int, int, int]], classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(slot, company) of each text token (token, at, size) of a page that is in a class and not dropped (size below 0).

    The slot: the elements of its class around it (after the last comes the first), -1 if it stands in several.  The
    company: the longest other text that is not dropped, 0 for none.
    """
    of: dict[int, list[int]] = {}
    for k, token in enumerate(elements):
        if token in classes:
            of.setdefault(classes[token], []).append(k)
    kept = [x for x in texts if x[2] > 0]
    longest = sorted({(-size, token) for token, _, size in kept})[:2]
    out: dict[int, tuple[int, int]] = {}
    for token, at, _ in kept:
        if token in classes:
            mine = of[classes[token]]
            k = bisect_left(mine, at)
            slot = xxhash.xxh64_intdigest(f"{elements[mine[k - 1]]}|{elements[mine[k % len(mine)]]}") >> 1
            company = next((t for _, t in longest if t != token), 0)
            out[token] = (slot if out.get(token, (slot,))[0] == slot else -1, company)
    return out


def templates(source: DataFrame) -> DataFrame:
    """(host, token): each host's template text, of rows (host, _html), for every host with two distinct pages or more.

    That is the text of large and frequent classes that stands in one slot of its class on all pages, in changing
    company: where the longest text beside it is always the same, the pages may be near copies, and nothing shows
    that their common text is a template's.
    """
    distinct = _read(source)
    joined, told = _told(distinct.drop("digest"), _classes(distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for host, elements, *texts, known in zip(*(c.to_pylist() for c in b.columns[:5]), told(b), strict=True):
                if known:
                    for token, (slot, company) in slots(elements, list(zip(*texts, strict=True)), known).items():
                        s = seen.setdefault((host, token), [slot, slot, company, company])
                        s[:] = min(s[0], slot), max(s[1], slot), min(s[2], company), max(s[3], company)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([seen[k][j] for k in keys], pa.int64()) for j in range(4))], names=["host", "token", "s0", "s1", "c0", "c1"])

    found = joined.mapInArrow(run, "host string, token long, s0 long, s1 long, c0 long, c1 long").groupBy("host", "token").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    return found.where("s0 = s1 AND s0 >= 0 AND c0 <> c1").select("host", "token")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text.

    text: the blocks of the main text in page order, each with its character references decoded, white space as one
    space and trimmed, joined by a newline; empty for null or empty html and for pages without text.  Nothing is cut.
    Pages without a host form one group.  Null and repeated ids and urls keep their rows; an empty table gives none;
    other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    source = pages.select(host_of(url).alias("host"), F.col(id_col).alias("_id"), url.alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = templates(source).withColumn("value", F.lit(1))
    joined, told = _told(source, saved(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, known in zip(b.column(3).to_pylist(), told(b), strict=True):
                out.append(main_text(page or "", known.keys()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.string())], names=["_id", "_url", "text"])

    return joined.mapInArrow(run, f"_id {kind}, _url string, text string").select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
