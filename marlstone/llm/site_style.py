"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by element path. Each node gets an importance from two entropies: of the
presentations that it has over the pages (its sequences of child elements), and of its contents (how evenly a text block is
spread over pages: one that all pages share tells nothing). The same tree over the pages of all hosts tells of layouts that hosts
share. What a few pages show counts less: a node's importance is drawn towards that in the tree of all hosts, and this one's towards
what is usual, the more so the fewer pages it is on. Names are part of the score: an element or class that may be an advert, a
teaser and so on has a lower importance and needs less repetition to go; one outside the page's article a slightly lower one. Text of one
line, such as a heading or a list item, is as important as what it stands in. A branch is removed where it and all below it are low.

Names that say plainly what is no main text decide alone, as a form, a script, a menu or readers' comments may differ on every page,
except around most of a page's text.

Only hashes and counts are shuffled to build the trees, summed in each task first. What the pages of a host must know is the list of its
topmost low paths. Where all these lists are small, tasks have them while they scan; else they are joined by host, a host's pages being dealt to
several tasks.

Null html is an empty page, a null url the host ''. Repeated rows are pages each. A page all of whose branches are low keeps them. Scripts,
styles, frames, drawings and players are left out, whether they are closed or not; formulas are text. Columns besides page_id, url and html
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages as which the expectation of a node's importance counts.
EXPECTED = 16
#: Branches below this importance are removed: outside, and inside an article or main element, which says of itself that it is no frame.
LOW, LOW_INSIDE = 0.6, 0.25
#: Share of its importance that a node keeps whose names hint at something else than main text, what is expected of it, and the share that text outside the article keeps.
HINTED, HINTED_EXPECTED, OUTSIDE = 0.66, 0.5, 0.93
#: What the paths of hinted blocks, and of those outside the article, end with.
HINT, OUT = ">~", ">^"
#: Bytes of low paths that each task may hold, and tasks that a host's pages are dealt to beyond that.
HELD_BYTES, DEALT = 4 << 20, 32
#: Stands for all hosts; no host has a slash.
ALL_HOSTS = "//"
#: Weight that a further presentation takes from a node's contents.
GAMMA = 0.9
#: Elements deeper than this share the path of their ancestor there.
DEPTH = 16

# Names of HTML elements and usual words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|svg|iframe|object|select|canvas|audio|video|title"
#: Of these, elements that may close themselves.
SELF_CLOSED = "svg|iframe|object|canvas|audio|video"
#: Elements that hold a line or so.
LINES = "h1|h2|h3|h4|h5|h6|p|li|dt|dd|td|th|tr|caption|blockquote|pre|figcaption|summary|address"
BLOCK = frozenset(
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset address details summary hgroup center dialog menu search".split()
)
NOISE = frozenset("head nav footer aside form fieldset button dialog menu search".split())
HEADER = frozenset("header".split())
WORDS = frozenset(
    "advert adverts advertisement advertising sponsor sponsored sponsors banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices notification modal newsletter subscribe signup share sharing "
    "pagination pager login hidden".split()
)
HINTS = frozenset("ad ads adv promo promotion alert popup overlay social related recommended recommendations widget toolbar search".split())
PAGE_WORDS = frozenset("header masthead top topbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: A comment, a declaration, a raw element that closes itself, one with its end tag, a script or style to the end of the page, or a tag, that of a raw element without an end too.
ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
MARKUP = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?:{SELF_CLOSED})(?=[\s/>]){ATTRIBUTES}(?<=/)>|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?</\1\s*>"
    rf"|<(?:script|style)(?=[\s/>]).*|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def described(tag: str, attributes: str, inside_main: bool) -> tuple[str, bool, bool, bool]:
    """The element's part of a path, whether it is no main text by its kind or hidden, and whether its names say so or hint at it."""
    found = {}
    if attributes.strip():
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
    part = ".".join([tag, *(re.sub(r"\d+", "0", x) for x in names[:3])])
    if tag in ("html", "body"):
        return part, False, False, False
    if tag in NOISE or tag in HEADER and not inside_main or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return part, True, False, False
    words = {w for x in names for w in re.split(r"[-_:]+", x)}
    said = bool(words & WORDS or words & PAGE_WORDS and not inside_main or found.get("role") in ("navigation", "banner", "contentinfo", "complementary"))
    return part, False, said, not said and bool(words & HINTS)


class Page:
    """The text blocks of a page in order, as (path, text, calls itself noise), and each path's sequences of child elements.

    What an element's names say or hint at does not count where it holds most of the text of the article or main element with the most text, or,
    on a page without these, most of the page's text. The path of a hinted block ends with HINT, of one outside the article or main elements with OUT.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, str, bool]] = []
        self.styles: dict[str, list[str]] = {}
        self.stack: list[tuple] = [("", "", False, 0, ())]  # tag, path, noise, number of the outermost article or main, (number, said) of named elements
        self.held: list[tuple[bool, int, tuple]] = []  # of each block: noise by kind, the two above
        self.made = 0
        self.text: list[str] = []
        at = 0
        source = source or ""
        for m in MARKUP.finditer(source):
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            if m[3]:
                self._tag(m[3].lower(), bool(m[2]), m[4])
        self.text.append(source[at:])
        self._end_block()
        self._judge()

    def _judge(self) -> None:
        mains: Counter = Counter()
        for block, (noise, main, _) in zip(self.blocks, self.held, strict=True):
            if main and not noise:
                mains[main] += len(block[1])
        scope = max(mains, key=mains.get) if mains else None
        total, by = 0, Counter()
        for block, (noise, main, names) in zip(self.blocks, self.held, strict=True):
            if not noise and (scope is None or main == scope):
                total += len(block[1])
                by.update(dict.fromkeys(names, len(block[1])))
        for k, ((path, text, noise), (_, main, names)) in enumerate(zip(self.blocks, self.held, strict=True)):
            counted = [said for name in names if 2 * by[name] <= total for said in name[1:]]
            headline = path.rpartition(">")[2].partition(".")[0] == "h1"
            path += OUT if scope is not None and not main and not headline else ""
            self.blocks[k] = (path + (HINT if False in counted else ""), text, noise or True in counted)

    def _end_block(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            _, path, noise, main, names = self.stack[-1]
            if text:
                self.blocks.append((path, text, noise))
                self.held.append((noise, main, names))

    def _pop(self, n: int) -> None:
        del self.stack[n:]

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in ("br", "hr"):
            self._end_block()
            return
        if closing:
            if tag in BLOCK:
                self._end_block()
            k = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag), 0)
            if k:
                self._end_block()
                self._pop(k)
            return
        if tag in VOID:
            return
        block = tag in BLOCK
        if block:
            self._end_block()
            if self.stack[-1][0] == "p":
                self._pop(len(self.stack) - 1)
            for other in CLOSES.get(tag, ()):
                if self.stack[-1][0] == other:
                    self._pop(len(self.stack) - 1)
        _, path, noise, main, names = self.stack[-1]
        part, mine, said, hinted = described(tag, attributes, bool(main))
        if not block and not mine and not said and not hinted:
            return  # inline elements are part of their block
        if not block:
            self._end_block()
        self.styles.setdefault(path, []).append(part)
        deep = path.count(">") >= DEPTH
        self.made += 1
        if tag in ("article", "main"):
            main = main or self.made
        self.stack.append((tag, path if deep else f"{path}>{part}", noise or mine, main, (*names, (self.made, said)) if said or hinted else names))


def ancestors(path: str) -> list[str]:
    parts = path.split(">")
    return [">".join(parts[:k]) for k in range(2, len(parts) + 1)]


def main_text(page: Page, low: frozenset[str]) -> str:
    """The blocks outside low branches, hinted ones only if `low` names their path as an exception. If all are low, the branches are kept."""
    blocks = [b for b in page.blocks if not b[2]]
    kept = [b for b in blocks if (b[0] in low and low.isdisjoint(ancestors(b[0])[:-1]) if b[0].endswith(HINT) else low.isdisjoint(ancestors(b[0])))]
    return "\n".join(b[1] for b in kept or blocks)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): in how many pages of the host, and of ALL_HOSTS, a path shows a content (kind c), a presentation (s), or itself (p)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*seen, strict=True)) or [()] * 4
            arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, ["host", "path", "kind", "value", "n"])

        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source)
                contents = {(p, "c", _hash(t)) for p, t, _ in page.blocks}
                shown = {(p, "s", _hash(" ".join(s))) for p, s in page.styles.items() if p}
                paths = {(p, "p", 0) for p in {q for x, _, _ in contents for q in ancestors(x)} | {p for p, _, _ in shown}}
                seen.update((host, *x) for x in contents | shown | paths)
            if len(seen) > 200_000:
                yield out()
        yield out()

    rows = pages.select(host_of("url").alias("host"), "html").mapInArrow(count, "host string, path string, kind string, value long, n long")
    twice = rows.withColumn("host", F.explode(F.array("host", F.lit(ALL_HOSTS))))
    return twice.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))


def nodes(counts: DataFrame) -> DataFrame:
    """One row a node of each tree: its pages, and the sums that the entropies of its contents and presentations are made of."""
    n, log = F.col("n"), F.log(F.col("n"))
    return counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "p", n)).alias("pages"),
        F.sum(F.when(F.col("kind") == "c", n)).alias("weight"),
        F.sum(F.when(F.col("kind") == "c", n * log)).alias("spread"),
        F.sum(F.when(F.col("kind") == "s", n)).alias("shown"),
        F.sum(F.when(F.col("kind") == "s", n * log)).alias("shown_log"),
        F.count(F.when(F.col("kind") == "s", 1)).alias("styles"),
    )


def importance(by: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the nodes that hold text, as their tree alone has it.

    A text block on c of a path's m pages has content entropy log c / log m. A node's contents are those of all blocks below it.
    """
    below = by.where("weight > 0").select("host", F.explode(_ancestors("path")).alias("path"), "weight", (F.col("spread") / F.log(F.greatest("pages", F.lit(2)))).alias("evenness"))
    content = below.groupBy("host", "path").agg((1 - F.sum("evenness") / F.sum("weight")).alias("content"))
    entropy = F.log("shown") - F.col("shown_log") / F.col("shown")
    presented = F.coalesce(F.least(entropy / F.log(F.nullif(F.col("pages"), F.lit(1))), F.lit(1.0)), F.lit(0.0))
    kept = F.pow(F.lit(GAMMA), F.col("styles"))
    score = (1 - kept) * presented + kept * F.col("content")
    named = by.join(content, ["host", "path"]).select("host", "path", "pages", score.alias("importance"))
    # a line is as important as what it stands in
    base = F.regexp_replace("path", r"(>[~^])+$", "")
    line = F.when(~base.rlike(r"^>html[^>]*(>body[^>]*)?>[^>]*$") & base.rlike(rf">(?:{LINES})(?:\.[^>]*)?$"), F.regexp_replace(base, r">[^>]*$", ""))
    held = named.select("host", F.col("path").alias("above"), F.col("importance").alias("around"))
    lines = named.withColumn("above", line).join(held, ["host", "above"], "left")
    return lines.select("host", "path", "pages", F.when(F.col("path").contains(HINT), F.col("importance")).otherwise(F.greatest("importance", "around")).alias("importance"))


def expected(scores: DataFrame) -> DataFrame:
    """(host, path, score): names and place in it, and drawn to the tree of all hosts, as this one's is to what is expected, by the pages that each is on; the lower of the two."""
    hinted = F.col("path").contains(HINT)
    share = F.when(hinted, HINTED).otherwise(1.0) * F.when(F.col("path").contains(OUT), OUTSIDE).otherwise(1.0)
    drawn = lambda towards, own: (EXPECTED * towards + F.col("pages") * own) / (EXPECTED + F.col("pages"))
    scores = scores.withColumn("importance", F.col("importance") * share)
    everywhere = scores.where(F.col("host") == ALL_HOSTS).select("path", drawn(F.when(hinted, HINTED_EXPECTED).otherwise(1.0), F.col("importance")).alias("everywhere"))
    own = scores.where(F.col("host") != ALL_HOSTS).join(everywhere, "path")
    return own.select("host", "path", F.least("everywhere", drawn(F.col("everywhere"), F.col("importance"))).alias("score"))


def low_branches(scores: DataFrame) -> DataFrame:
    """(host, path) of the nodes that are below their limit with every node beneath them, but not those in another such branch; and as exceptions the hinted nodes that are not below it."""
    limit = F.when(F.col("path").rlike(r">(article|main)(\.|>|$)"), LOW_INSIDE).otherwise(LOW)
    over = expected(scores).select("host", "path", (F.col("score") - limit).alias("over"))
    above = over.select("host", F.explode(_ancestors("path")).alias("path"), "over")
    low = above.groupBy("host", "path").agg(F.max("over").alias("over")).where(F.col("over") < 0).select("host", "path")
    inside = low.select("host", F.col("path").alias("above"))
    nested = low.where(~F.col("path").contains(HINT)).withColumn("above", F.regexp_replace("path", r">[^>]*$", ""))
    kept = over.where(F.col("path").contains(HINT) & (F.col("over") >= 0)).select("host", "path")
    return nested.join(inside, ["host", "above"], "left_anti").select("host", "path").union(kept)


def _ancestors(path: str) -> Column:
    parts = F.split(path, ">")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ">"))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def read_out(rows: DataFrame, low: dict[str, list[str]] | None) -> DataFrame:
    """The columns of EXTRACTED from rows page_id, url, html, host and, if `low` is None, the host's low paths."""
    shared = rows.sparkSession.sparkContext.broadcast(low)  # HELD_BYTES at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(4).to_pylist() if shared.value is None else map(shared.value.get, b.column(3).to_pylist())
            texts = [main_text(Page(h), frozenset(x or ())) for h, x in zip(b.column(2).to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, EXTRACTED)


def with_low_paths(pages: DataFrame, low: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The pages' text without the branches in low (host, path). html is shuffled only where low paths take more than held_bytes."""
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    if (low.agg(F.sum(F.length("path") + F.length("host") + 64)).first()[0] or 0) <= held_bytes:
        found: dict[str, list[str]] = {}
        for host, path in low.toLocalIterator():
            found.setdefault(host, []).append(path)
        return read_out(rows, found)
    lists = low.groupBy("host").agg(F.collect_list("path").alias("low")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(DEALT)).cast("int"))
    return read_out(dealt.join(lists, ["host", "deal"], "left").select("page_id", "url", "html", "host", "low"), None)


def extracted(pages: DataFrame, store, measured: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page. Unless `measured`, all nodes count as if no text were repeated: names alone decide then.
    `store` writes a DataFrame to the shared folder and reads it again."""
    scores = importance(store(nodes(style_counts(pages)), "style_nodes"))
    scores = store(scores if measured else scores.withColumn("importance", F.lit(1.0)), "style_scores")
    return with_low_paths(pages, store(low_branches(scores), "low_paths"))
