"""Main text of web pages by removal of site templates.

Every container element below ``body`` gets a hash of its subtree (tags and
words). Spark counts, for each host, on how many pages a subtree recurs; a
subtree that does so on ``LEAST`` pages or more and on at least the share
``SHARE`` of the host's pages is a template and is deleted from all of them. Pages
count by what they say: pages of one host with the same main text count once,
so copies of an article do not turn it into a template, and the paragraphs,
headings and list items of an article are no containers: a passage that many
articles quote stays.

Two rules stand beside the counting, since templates may change their words
from page to page and a host may have one page only: parts whose tag, role, class
or id names them (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts, styles) go, unless they hold the article; and where the page
marks an article, or else a main part, that alone is the text. ``n_template``
and ``n_named`` tell how many subtrees each rule deleted.

Text: character references are decoded once; white space (``str.split``) in a
block becomes one space, ``br`` and table cells count as white space; blocks are
joined by one newline. Nothing else is cut. Broken markup: tags left open are
closed by what cannot stand inside them, stray end tags are passed over.

Counting shuffles one narrow row for each container; counts are combined before
they move, so a host with a third of all pages costs partial sums. A host has at
most 1 / ``SHARE`` templates for each container of an average page; they are one
small row a host, written once and joined to the pages: Spark broadcasts them if
their size allows, or splits the rows of a hot host.

Cases: null and empty html give an empty text; a page without a host (null or
relative url) has no templates; repeated pages give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import frozen

LEAST = 3  # pages of different main text
SHARE = 0.5  # of the host's pages of different main text

# Element names of HTML by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CONTAINERS = frozenset(
    "article aside body center dd details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "address blockquote caption dt figcaption h1 h2 h3 h4 h5 h6 head hr html legend li option p pre search summary tbody tfoot thead tr".split()
)
_CLOSED_BY = {  # an open element of the key is closed by the start of these, up to the given holders
    "p": (_BLOCKS - frozenset("option tr tbody tfoot thead caption legend".split()), frozenset("button td th caption object template".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr tbody tfoot thead".split()), frozenset(["table"])),
    "td": (frozenset("td th tr tbody tfoot thead".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody tfoot thead".split()), frozenset(["table"])),
}
_NOT_TEXT = frozenset("head script style template noscript iframe object svg canvas math select textarea title noembed noframes".split())
_NAMED_TAGS = frozenset("nav footer aside form menu dialog button search".split())
_NAMED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMED_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
    breadcrumbs footer sidebar widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices
    newsletter subscribe subscription popup modal overlay pagination pager login signup skiplink toolbar masthead topbar""".split()
)
_HEADER_WORDS = frozenset("header siteheader pageheader".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
_MAIN_WORDS = frozenset("content article post entry story maincontent main".split())

_MARK = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Page:
    """A page as events in order: text, +node for its start, -node for its end
    (nodes count from 1), and by node: tag, parent, names, subtree hash."""

    def __init__(self, source: str):
        self.events: list[str | int] = []
        self.tags, self.parents, self.roles, self.words, self.hidden = [""], [0], [frozenset()], [frozenset()], [False]
        self.hashes: dict[int, int] = {}
        self._parse(source)
        self._choose()

    def _parse(self, source: str) -> None:
        events, tags, parents = self.events, self.tags, self.parents
        stack, open_tags, at = [0], {}, 0

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                open_tags[tags[node]] -= 1
                events.append(-node)

        while at < len(source):
            found = _MARK.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                events.append(html.unescape(text) if "&" in text else text)
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                if not open_tags.get(tag):
                    continue
                depth = len(stack) - 1
                while tags[stack[depth]] != tag:
                    if tag not in _BLOCKS and tags[stack[depth]] in _BLOCKS:
                        depth = 0  # the end of an inline element does not end a block
                        break
                    depth -= 1
                if depth:
                    close_to(depth)
                continue
            for name, (starts, holders) in _CLOSED_BY.items():
                if tag in starts and open_tags.get(name):
                    depth = len(stack) - 1
                    while depth and tags[stack[depth]] != name and tags[stack[depth]] not in holders:
                        depth -= 1
                    if depth and tags[stack[depth]] == name:
                        close_to(depth)
            node = len(tags)
            tags.append(tag)
            parents.append(stack[-1])
            self._names(found[3])
            events.append(node)
            if tag in _VOID:
                events.append(-node)
            elif tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                events.append(-node)
            else:
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        close_to(1)

    def _names(self, attributes: str) -> None:
        roles, words, hidden = frozenset(), frozenset(), False
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), html.unescape(value.strip("\"'"))
                if name == "role":
                    roles = frozenset(value.lower().split())
                elif name in ("class", "id"):
                    words |= {w.lower() for w in _WORD.findall(value)} | {w.lower() for w in value.split()}
                else:
                    hidden = hidden or name == "hidden" or value.lower() == "true"
        self.roles.append(roles)
        self.words.append(words)
        self.hidden.append(hidden)

    def _choose(self) -> None:
        """Named parts, and the nodes whose text is the main text."""
        n = len(self.tags)
        comment, inside, self.named = [False] * n, [False] * n, [False] * n
        self.inside = inside
        holds = [False] * n
        mains: dict[str, list[int]] = {"article": [], "main": [], "content": []}
        for i in range(1, n):
            tag, up = self.tags[i], self.parents[i]
            comment[i] = comment[up] or bool(self.words[i] & _COMMENT_WORDS and tag not in ("html", "body", "main"))
            own = "article" if tag == "article" else "main" if tag == "main" or "main" in self.roles[i] else None
            inside[i] = inside[up] or own is not None and not comment[i]
            if own and not comment[i]:
                mains[own].append(i)
                while i and not holds[i]:
                    holds[i] = True
                    i = self.parents[i]
            elif not own and self.words[i] & _MAIN_WORDS and tag in _CONTAINERS - {"body"}:
                mains["content"].append(i)
        for i in range(1, n):
            tag, words = self.tags[i], self.words[i]
            if tag in ("html", "body") or holds[i] and not comment[i]:
                continue
            self.named[i] = (
                tag in _NOT_TEXT
                or tag in _NAMED_TAGS
                or self.hidden[i]
                or comment[i] and not comment[self.parents[i]]
                or bool(self.roles[i] & _NAMED_ROLES)
                or bool(words & _NAMED_WORDS)
                or not inside[i] and (tag == "header" or bool(words & _HEADER_WORDS))
            )
        self.mains = next(([i for i in some if not self._gone(i)] for some in mains.values() if any(not self._gone(i) for i in some)), [0])

    def _gone(self, node: int) -> bool:
        while node:
            if self.named[node]:
                return True
            node = self.parents[node]
        return False

    def text(self, templates: frozenset[int] = frozenset()) -> tuple[str, int, int]:
        """(main text, subtrees deleted as templates, and by their names)."""
        mains, blocks, held = set(self.mains), [], []
        shown = 1 if 0 in mains else 0  # open main parts
        gone = 0  # open deleted subtrees
        deleted = [0, 0]
        if templates:
            self.hash_subtrees()
        cut: set[int] = set()

        def end_block() -> None:
            if held:
                line = " ".join("".join(held).split())
                held.clear()
                if line:
                    blocks.append(line)

        for event in self.events:
            if isinstance(event, str):
                if shown and not gone:
                    held.append(event)
                continue
            node = abs(event)
            tag = self.tags[node]
            if tag in _BLOCKS:
                end_block()
            elif tag in ("br", "td", "th"):
                held.append(" ")
            if event > 0:
                if node in mains:
                    shown += 1
                template = self.hashes.get(node) in templates if templates else False
                if template or self.named[node]:
                    if not gone:
                        deleted[0 if template else 1] += 1
                    gone += 1
                    cut.add(node)
            else:
                if node in mains:
                    shown -= 1
                if node in cut:
                    gone -= 1
        end_block()
        return "\n".join(blocks), deleted[0], deleted[1]

    def hash_subtrees(self) -> dict[int, int]:
        """Subtree hash of each container below ``body`` that may be a template:
        one with words, that neither is nor holds the article."""
        if self.hashes:
            return self.hashes
        protected, stack = {0}, [["", []]]
        for i in self.mains:
            while i not in protected:
                protected.add(i)
                i = self.parents[i]
        for event in self.events:
            if isinstance(event, str):
                text = " ".join(event.split())
                if text:
                    stack[-1][1].append(text)
            elif event > 0:
                stack.append([self.tags[event], []])
            else:
                tag, parts = stack.pop()
                node = -event
                digest = hashlib.blake2b("\x1f".join((tag, *parts)).encode("utf-8", "replace"), digest_size=8).digest()
                stack[-1][1].append(digest.hex())
                flows = self.tags[self.parents[node]] in ("ul", "ol", "dl") or tag in ("dd", "body")
                if tag in _CONTAINERS and parts and node not in protected and not flows:
                    self.hashes[node] = int.from_bytes(digest, "big", signed=True)
        return self.hashes


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url, or null."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def subtree_pages(pages: DataFrame) -> DataFrame:
    """host, subtree, says: one row for each different container of a page, and
    one with a null subtree for the page itself; ``says`` hashes its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, subtrees, says = [], [], []
            for host, source in zip(batch["host"].to_pylist(), batch["html"]):
                page = Page(source.as_py() or "")
                said = int.from_bytes(hashlib.blake2b(page.text()[0].encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                some = [None, *set(page.hash_subtrees().values())]
                hosts += [host] * len(some)
                subtrees += some
                says += [said] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(says, pa.int64())], ["host", "subtree", "says"])

    return pages.where(F.col("host").isNotNull()).select("host", "html").mapInArrow(run, "host string, subtree long, says long")


def site_templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host and the array of its templates' hashes."""
    counts = subtree_pages(pages).distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | F.col("subtree").isNull())
    some = F.struct("subtree", "n")
    by_host = counts.groupBy("host").agg(
        F.max(F.when(F.col("subtree").isNull(), F.col("n"))).alias("pages"),
        F.collect_list(F.when(F.col("subtree").isNotNull(), some)).alias("some"),
    )
    often = F.filter("some", lambda x: (x["n"] >= F.lit(share) * F.col("pages")))
    return by_host.select("host", F.transform(often, lambda x: x["subtree"]).alias("templates")).where(F.size("templates") > 0)


def extract(
    pages: DataFrame, least: int = LEAST, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_named for every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    templates = frozen(site_templates(rows, least, share), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                Page(source.as_py() or "").text(frozenset(some.as_py() or ())) for source, some in zip(batch["html"], batch["templates"])
            ]
            texts, cut, named = zip(*found) if found else ((), (), ())
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, pa.int64()), pa.array(named, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], *columns], ["page_id", "url", "text", "n_chars", "n_template", "n_named"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return (
        rows.join(templates, "host", "left")
        .select("page_id", "url", "html", "templates")
        .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_template long, n_named long")
    )
