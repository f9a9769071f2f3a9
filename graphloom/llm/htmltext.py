"""Main text of web pages by composite text density (operator 12).

A page becomes a tree of its block elements; inline elements count as tags of the block that they stand in. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are cut off first, by element, role, hidden state, and words of class and id.
For every node that is left, its composite density is its characters per tag, adjusted by the share of characters and tags that are links;
a node's density sum is the sum of its children's. The node of the largest sum is the article's heart. The least density on its path to the
body is the threshold: other nodes that reach it contribute their own subtree of the largest sum. Where the page names an article (or main) element
around the heart, or in it with half of its text, that element's bounds are the article's; else the heart grows to its parents while these hold no menu.

Parsing, densities and selection are each linear in the page. Defined results: a null or empty page has no text; unclosed comments and
raw elements last to the end of the page; a tag that never ends is dropped with the rest of its page, as browsers do; unclosed blocks end where their
parent does; line breaks and white space of any kind inside a block become one space; table cells are blocks; pages of repeated ids
are judged each by itself; extra columns don't matter.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import map_batches
from graphloom.session import table

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr li main menu nav ol optgroup option p pre search section summary "
    "table caption colgroup thead tbody tfoot tr td th ul".split()
)
#: What an opening tag ends when it is still open, and the elements at which the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements and roles that never belong to an article's text.
NOT_BLOCKS = frozenset("nav aside footer menu dialog head search optgroup option".split())
NOT_INLINE = frozenset("button select svg object audio video canvas template datalist input label".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark what isn't the article; a token with a word of LAYOUT says something about the page, not about the element.
NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar "
    "navigation navi menu submenu breadcrumb breadcrumbs pagination pager footer foot sidebar aside rail widget widgets share sharing social related recommended recommendations trending disqus discussion respond replies toolbar masthead skip".split()
)
HEADER_WORDS = frozenset("header head topbar".split())
OWN_WORDS = frozenset("article post entry story content text main body".split())
LAYOUT = frozenset("with has no without".split())
#: Containers that begin with this heading hold reader comments.
COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user |all )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)

_ATTRS = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})(>|\Z)?+|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s/>=]+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(tag: str, attrs: str) -> tuple[bool, bool]:
    """(not part of an article, only a header) by what an element's attributes say."""
    if "=" not in attrs and "hidden" not in attrs:
        return False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in NOT_ROLES:
        return True, False
    header = False
    if tag not in ("html", "body", "main"):
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = {w.lower() for w in WORD.findall(token)}
            if words & LAYOUT:
                continue
            if words & NOT_WORDS or any(w.startswith("comment") and not w.startswith("commentar") for w in words):
                return True, False
            header |= bool(words & HEADER_WORDS) and not words & OWN_WORDS
    return False, header


class Page:
    """The block tree of a page, as parallel lists in page order: a parent comes before its children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.header = ["html"], [0], [False], [False]
        self.tags, self.link_tags = [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # (node, text, characters in links)
        self._read(source)

    def _read(self, source: str) -> None:
        stack, opened = [0], {}
        muted: dict[str, int] = {}  # open inline elements without text of the article
        pieces: list[str] = []
        link, links, at, n = 0, 0, 0, len(source)  # link: the depth at which a link opened

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((stack[-1], text, min(links, len(text))))
                pieces.clear()
            links = 0

        def pop(to: int) -> None:
            """Ends all open blocks from place `to` of the stack on, and what stands open in them."""
            nonlocal link
            flush()
            link = 0 if link > to else link
            for node in stack[to:]:
                opened[self.tag[node]] -= 1
            del stack[to:]
            muted.clear()

        while at < n:
            m = TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at and not muted:
                text = html.unescape(source[at:begin])
                pieces.append(text)
                if link:
                    links += len(text.strip())
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if m[4] != ">":  # a quote or the tag never ends
                break
            if name in VOID and name != "hr":
                self.tags[stack[-1]] += not closing
                if name == "br":
                    pieces.append(" ")
            elif name in RAW:
                if not closing:
                    end = _RAW_END[name].search(source, at)
                    at = end.start() if end else n
            elif name not in BLOCKS:
                if closing:
                    if name == "a":
                        link = 0
                    if name in muted:
                        muted[name] -= 1
                        if not muted[name]:
                            del muted[name]
                else:
                    self.tags[stack[-1]] += 1
                    if name == "a":
                        link = len(stack)
                        self.link_tags[stack[-1]] += 1
                    if name in NOT_INLINE or _marked(name, m[3])[0]:
                        if name != "input" and not m[3].rstrip().endswith("/"):
                            muted[name] = muted.get(name, 0) + 1
            elif closing:
                if name in ("html", "body"):
                    flush()  # what follows still belongs to the body
                elif opened.get(name):
                    to = len(stack) - 1
                    while self.tag[stack[to]] != name:
                        to -= 1
                    pop(to)
            elif name == "html":
                flush()
            else:
                if opened.get("p"):
                    to = len(stack) - 1
                    if self.tag[stack[to]] == "p":
                        pop(to)
                if name in ENDS and any(opened.get(t) for t in ENDS[name][0]):
                    own, stops = ENDS[name]
                    for to in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[to]] in own:
                            pop(to)
                            break
                        if self.tag[stack[to]] in stops:
                            break
                flush()
                self.tags[stack[-1]] += 1
                if name == "hr" or name == "body" and opened.get("body"):
                    continue
                out, header = _marked(name, m[3])
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.out.append(out or name in NOT_BLOCKS)
                self.header.append(header or name == "header")
                self.tags.append(0)
                self.link_tags.append(0)
                stack.append(len(self.tag) - 1)
                opened[name] = opened.get(name, 0) + 1
        flush()

    def cut(self) -> None:
        """out: for each node, whether it or a node around it isn't part of an article."""
        n = len(self.tag)
        holds, inside = [t in ("article", "main") for t in self.tag], [False] * n
        first: dict[int, str] = {}
        for node, text, _ in self.blocks:
            if len(text) < 40 and COMMENTS.fullmatch(text) and not self.tag[node] == "p":
                first[node] = text
        for k in range(n - 1, 0, -1):
            holds[self.parent[k]] |= holds[k]
        # a section, not an article, whose first child is a heading of comments holds them
        eldest: dict[int, int] = {}
        for k in range(1, n):
            eldest.setdefault(self.parent[k], k)
        for k in range(1, n):
            up = self.parent[k]
            inside[k] = inside[up] or self.tag[k] in ("article", "main")
            own = self.out[k] or self.header[k] and not inside[k] or self.tag[k] == "form" and not holds[k]
            own = own or self.tag[k] in ("section", "div", "ol", "ul") and eldest.get(k) in first
            self.out[k] = self.out[up] or own

    def measure(self) -> None:
        """chars, link_chars, tags and link_tags become sums over subtrees; density and sums follow."""
        n = len(self.tag)
        self.chars, self.link_chars = [0] * n, [0] * n
        self.children: list[list[int]] = [[] for _ in range(n)]
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for node, text, linked in self.blocks:
            if not self.out[node]:
                self.chars[node] += len(text)
                self.link_chars[node] += linked
                runs[node].append((len(text), linked))
        for k in range(1, n):
            if not self.out[k]:
                self.children[self.parent[k]].append(k)
        for k in range(n - 1, 0, -1):
            if not self.out[k]:
                up = self.parent[k]
                self.chars[up] += self.chars[k]
                self.link_chars[up] += self.link_chars[k]
                self.tags[up] += self.tags[k]
                self.link_tags[up] += self.link_tags[k]
        self.body = next((k for k in range(n) if self.tag[k] == "body" and not self.out[k]), 0)
        share = self.link_chars[self.body] / max(self.chars[self.body], 1)
        self.density = [density(self.chars[k], self.link_chars[k], self.tags[k], self.link_tags[k], share) for k in range(n)]
        # text beside child blocks counts as a child of its own
        self.sum = [sum(self.density[c] for c in self.children[k]) + (sum(density(c, lc, 0, 0, share) for c, lc in runs[k]) if self.children[k] else 0.0) for k in range(n)]

    def chosen(self) -> list[bool]:
        """For each node, whether its text belongs to the article."""
        n, up = len(self.tag), self.parent
        own = [not self.out[k] for k in range(n)]
        below = [False] * n
        for k in range(self.body, n):
            below[k] = k == self.body or below[up[k]]
        heart = max((k for k in range(n) if own[k] and below[k]), key=lambda k: (self.sum[k], -k), default=self.body)
        path = [heart]
        while path[-1] != self.body and path[-1]:
            path.append(up[path[-1]])
        least = min(self.density[k] for k in path)
        named = next((k for k in reversed(path) if self.tag[k] == "article"), None) or next((k for k in path if self.tag[k] == "main"), None)
        if named is None:  # or one within the heart that holds half of its text
            named = next((k for k in range(heart, n) if own[k] and self.tag[k] in ("article", "main") and 2 * self.chars[k] >= self.chars[heart] and self._under(k, heart)), None)
        if named is not None:
            picked = {named}
        else:
            top = heart
            while top != self.body and up[top] != self.body and not any(self._menu(c) for c in self.children[up[top]] if c != top):
                top = up[top]
            best = list(range(n))  # the node of the largest sum in each subtree
            for k in range(n - 1, 0, -1):
                if own[k] and self.sum[best[k]] > self.sum[best[up[k]]]:
                    best[up[k]] = best[k]
            picked, reach = {top}, [False] * n
            for k in range(self.body, n):
                reach[k] = own[k] and below[k] and (k == self.body or reach[up[k]]) and self.density[k] >= least
                if reach[k] and k != self.body and self.sum[best[k]] > 0:
                    picked.add(best[k])
                elif reach[k] and not self.children[k] and k not in path and not self._menu(k):
                    picked.add(k)
        take = [False] * n
        for k in range(n):
            take[k] = own[k] and (k in picked or k > 0 and take[up[k]]) and not (k not in picked and self._menu(k))
        return take

    def _under(self, k: int, top: int) -> bool:
        while k > top:
            k = self.parent[k]
        return k == top

    def _menu(self, k: int) -> bool:
        return self.tag[k] in ("ul", "ol", "div", "section", "table", "td", "p") and self.link_tags[k] >= 3 and self.link_chars[k] >= 0.9 * self.chars[k]

    def text(self) -> str:
        self.cut()
        self.measure()
        take = self.chosen()
        return "\n".join(text for node, text, _ in self.blocks if take[node])


def density(chars: int, link_chars: int, tags: int, link_tags: int, body_share: float) -> float:
    """Composite text density: characters per tag, times a logarithm of how few of the characters and tags are links, whose base grows with the share that are."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    within = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(within, 1.0)) / math.log(max(base, 1.0 + 1e-9))


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars of every row; a task holds some 2 MB of pages at a time, or one longer page."""
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", text string, n_chars long"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in b.column("__html").to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*keep, "text", "n_chars"])

    return map_batches(rows, run, schema, "__html")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages whose article is one element of paragraphs and headings, as in the given tables; SQL can't express the method for others.
OP12_SQL = r"""
with a as (select page_id, url, regexp_replace(regexp_replace(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' '), '</?(p|h[1-6])>', chr(1), 'g'), '<[^>]*>', '', 'g') s from pages),
b as (select page_id, url, list_transform(string_split(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) l from a),
t as (select page_id, url, coalesce(array_to_string(list_filter(l, lambda x: x <> ''), chr(10)), '') "text" from b)
select page_id, url, "text", length("text") n_chars from t
"""
