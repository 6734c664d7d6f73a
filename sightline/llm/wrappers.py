"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page is a stream of block tags and texts. Its wrapper has one node for each path of open blocks; the streams of a host are
aligned with the wrapper so far one after another, see Wrapper.align(). What one side lacks becomes optional, what comes
more than once inside its parent a repeated group, siblings that come in different orders a repeated group of optional
members; equal strings of one path stay template text, and where strings differ there is a slot. So a wrapper is a regular
expression without unions, see Wrapper.pattern().

The article is found in the wrapper: from the page's root down, or from the article or main element that holds the slots,
to the node that holds most of the slots' text outside links and has prose of its own, see Wrapper.root(). A page is then
read with its host's wrapper: what lies below that node is the article, less the strings that the wrapper has as template
text (SUPPORT pages and SUPPORT_SHARE of those with the path at least), less lists of links beside the prose. A string that
the page's title holds is no template text, nor is any where that would take more than MOST_TEMPLATE of a page's article: then
the host's pages are copies of each other. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments that say so by element, role, class or id take no part. An element told by class or id alone is kept if it holds an
article or main, or half of the page's text outside links, unless the name is one of readers' comments; a main resumes inside
any element left out, an article in those but comments, aside and footer; the header of an article or main is part of it.

Streams are merged by host inside tasks before a shuffle, and then in rounds of bounded shares, so a host may hold any
number of pages. Strings and paths that are in fewer than RARE of a host's pages seen so far (paths also: in one of several) are
forgotten once there are many, which bounds a wrapper; a string's count falls short by that share at most. Everything is linear in a page, without recursion.

Defined cases: null html gives an empty text, a null or odd url the host ''; a page without the article's node of its host is
read by a wrapper of its own; equal pages of a host get equal texts; ties go to the node that comes first; rows may repeat;
an empty table gives an empty result; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.llm import ragged
from sightline.operators.grouped import map_groups
from sightline.runtime import discard, materialize, unused

#: Wrappers that one task merges at once, wrappers of different hosts that a task holds before it gives them away, and the
#: share of all pages beyond which a host's result is broadcast rather than joined by a shuffle.
SHARE, HELD, HOT = 64, 512, 1e-3
#: Bytes of results that are broadcast whole.
SMALL_BYTES = 8 << 20
#: Pages, and share of the pages with its path, that a string needs to be template text, and the most of an article it may be.
SUPPORT, SUPPORT_SHARE, MOST_TEMPLATE = 4, 0.8, 0.9
#: Strings of a path beyond which, and paths of a host beyond which, those in fewer than RARE of the pages are forgotten.
MANY, MANY_PATHS, RARE = 256, 4096, 0.02
#: Share of the page's slots that a node has to hold to be descended to, of prose passed by that ends the descent, and of a
#: list's text that is in links.
DESCEND, OWN_PROSE, LINKED = 0.5, 0.01, 0.6

# Element, role and name words of the parts around an article.
RAW = frozenset("script style noscript template iframe svg math object textarea title".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu head script style noscript template iframe svg math object textarea title label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "comment comments commentlist discussion disqus reply replies respond widget toolbar pagination pager login signup search skip".split()
)
STEMS = ("cookie", "advert", "adsby", "sponsor", "newsletter", "sidebar", "breadcrumb", "subscri", "comment", "navbar", "menubar")
#: Words before a name that make it say what a part has or lacks rather than what it is.
STATES = frozenset("no has have with without is not show hide enable disable page layout single type".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_CLOSES = {n: frozenset(c.split()) for n, c in {"p": "p", "li": "li p", "dd": "dd dt p", "dt": "dd dt p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option"}.items()}
_OPENS_BLOCK = BLOCKS - frozenset(["html", "body", "head"])
_SCOPE = frozenset("article main section div table ul ol dl blockquote body html td th aside nav form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW_END = {n: re.compile(rf"</{n}\s*>|\Z", re.I) for n in RAW}
_WORDS = re.compile(r"[^a-z0-9]+")

#: Why an element is outside any article: its name, role or style; a class or id; one that tells comments.
ELEMENT, NAMED, REMARKS = 1, 2, 3


@lru_cache(maxsize=4096)
def mark(name: str, attributes: str) -> tuple[str, int]:
    """(name with its class and id words, why it is outside any article, or 0)."""
    if name in ASIDE:
        return name, ELEMENT
    if not attributes or attributes.isspace():
        return name, 0
    words, outside, named = [], False, 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            for one in value.split():
                parts = [w for w in _WORDS.split(one) if w]
                words += [w for w in parts if not w.isdigit()]
                if parts and parts[0] in STATES:
                    continue
                for w in parts:
                    if w in NAMES or (w.startswith(STEMS) and w != "commentary"):
                        named = max(named, REMARKS if w.startswith(("comment", "disqus", "discussion", "repl", "respond")) else NAMED)
        elif key == "role":
            outside |= value in ROLES
            words.append(f"={value}")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            outside = True
    if name in ("html", "body", "article", "main"):
        outside, named = False, 0
    return (f"{name}.{'.'.join(sorted(set(words)))}" if words else name), ELEMENT if outside else named


def digest(above: int, key: str) -> int:
    """A 63-bit hash of a path from that of the path above it, or of a string at a path."""
    return int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8, key=above.to_bytes(8, "little")).digest(), "little") >> 1


path_digest = lru_cache(maxsize=65536)(digest)


class Opened:
    """The stack of open elements, with how many there are of each name."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        return name

    def has(self, name: str) -> bool:
        return self.count.get(name, 0) > 0

    def at(self, name: str) -> int | None:
        """The place of the innermost open element of a name."""
        return next(i for i in range(len(self.names) - 1, -1, -1) if self.names[i] == name) if self.has(name) else None

    def implied(self, name: str) -> int:
        """How many stay open at a start tag: a block ends an open p, an item its like, body the head."""
        ends = _CLOSES.get(name, frozenset("p") if name in _OPENS_BLOCK else frozenset(["head"]) if name == "body" else ())
        stay = len(self.names)
        if any(self.has(e) for e in ends):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in ends:
                    stay = i
                elif self.names[i] in _SCOPE:
                    break
        return stay


def raw_end(found: re.Match, s: str) -> int:
    """Where an element of raw text ends; svg and math may end themselves."""
    name = found[2].lower()
    if name in ("svg", "math") and found[3].endswith("/"):
        return found.end()
    return _RAW_END[name].search(s, found.end()).end()


def extents(s: str) -> tuple[dict[int, tuple[int, int, bool]], int]:
    """(place of each start tag -> (end of its element, text outside links in it, whether it holds an article or main), all such text)."""
    out: dict[int, tuple[int, int, bool]] = {}
    opened, places = Opened(), []
    at = plain = marked = 0

    def pop(depth: int, end: int) -> None:
        while len(places) > depth:
            opened.pop()
            place, before, seen = places.pop()
            out[place] = end, plain - before, marked > seen

    found = _TOKEN.search(s)
    while found:
        if not opened.has("a"):
            plain += len(s[at : found.start()].strip())
        at = found.end()
        name = found[2].lower() if found[2] else None
        if name and found[1]:
            depth = opened.at(name)
            if depth is not None:
                pop(depth, at)
        elif name in RAW:
            at = raw_end(found, s)
            out[found.start()] = at, 0, False
        elif name and name not in VOID:
            pop(opened.implied(name), found.start())
            marked += name in ("article", "main")
            opened.push(name)
            places.append((found.start(), plain, marked))
        found = _TOKEN.search(s, at)
    if not opened.has("a"):
        plain += len(s[at:].strip())
    pop(0, len(s))
    return out, plain


#: Bits of a node: it comes more than once in its parent; its children come in different orders.
REPEATED, LOOSE = 1, 2
TEXT = "#"
#: Kinds of children beyond which a page's block counts as a repeated group whatever their order.
KINDS = 64


class Wrapper:
    """A union-free regular expression: node 0 is the whole page, each other node a path of open blocks, or a text (TEXT) in one.

    Of every node are known its occurrences (occ), the occurrences of its parent that hold it (held), the pages that hold it
    (seen), its bits, its characters and those in links, and the strings of a text: hash -> [pages, characters]. A node is
    optional if held is less than its parent's occurrences. A child's number is larger than its parent's.
    """

    def __init__(self) -> None:
        self.pages = 0
        self.key, self.above, self.path = [""], [-1], [0]
        self.counts: list[list[int]] = [[0, 0, 0, 0, 0]]  # occ, held, seen, chars, links
        self.bits = [0]
        self.strings: list[dict[int, list[int]]] = [{}]
        self.below: list[list[int]] = [[]]
        self.at: dict[tuple[int, str], int] = {}

    def add(self, node: int, key: str) -> int:
        """A new node below another; its place among the siblings is the caller's to say."""
        self.at[node, key] = new = len(self.key)
        self.key.append(key)
        self.above.append(node)
        self.path.append(path_digest(self.path[node], key))
        self.counts.append([0, 0, 0, 0, 0])
        self.bits.append(0)
        self.strings.append({})
        self.below.append([])
        return new

    def align(self, other: Wrapper) -> Wrapper:
        """This wrapper for the pages of both.

        Siblings meet by their keys, which are distinct. Those in the same order on both sides stay a sequence; where some cross,
        their parent's children become a repeated group. What only one side has goes behind the sibling that it follows there,
        and is optional by its counts. Equal strings of a text stay strings; the others are what its slot has held.
        """
        self.pages += other.pages
        to = [0] * len(other.key)
        for i, key in enumerate(other.key):
            if i:
                found = self.at.get((to[other.above[i]], key))
                to[i] = self.add(to[other.above[i]], key) if found is None else found
            j = to[i]
            mine = self.counts[j]
            for k, n in enumerate(other.counts[i]):
                mine[k] += n
            self.bits[j] |= other.bits[i]
            if other.strings[i]:
                known = self.strings[j]
                for h, (pages, chars) in other.strings[i].items():
                    if (had := known.get(h)) is None:
                        known[h] = [pages, chars]
                    else:
                        had[0] += pages
                if len(known) > MANY:
                    least = RARE * self.counts[j][2]
                    self.strings[j] = {h: s for h, s in known.items() if s[0] >= least}
        for i, theirs in enumerate(other.below):
            if theirs:
                self._order(to[i], [to[c] for c in theirs])
        return self._without_rare_paths() if len(self.key) > MANY_PATHS else self

    def _order(self, node: int, theirs: list[int]) -> None:
        mine = self.below[node]
        if mine == theirs:
            return
        place = {c: k for k, c in enumerate(mine)}
        behind: dict[int | None, list[int]] = {}
        last, reach = None, -1
        for c in theirs:
            at = place.get(c)
            if at is None:
                behind.setdefault(last, []).append(c)
                continue
            if at < reach:
                self.bits[node] |= LOOSE
            last, reach = c, max(reach, at)
        if behind:
            self.below[node] = [*behind.get(None, ()), *(x for c in mine for x in (c, *behind.get(c, ())))]

    def _without_rare_paths(self) -> Wrapper:
        """The wrapper less paths that few pages have, or one of several only, whose text counts as their parent's."""
        least = max(RARE * self.pages, 2 if self.pages > 1 else 1)
        out, to = Wrapper(), [0] * len(self.key)
        out.pages = self.pages
        for i, key in enumerate(self.key):
            up = to[self.above[i]] if i else 0
            if i and (up < 0 or self.counts[i][2] < least):
                to[i] = -1 - (up if up >= 0 else -1 - up)  # the nearest node above that stays
                for k in (3, 4):
                    out.counts[-1 - to[i]][k] += self.counts[i][k]
                continue
            to[i] = out.add(up, key) if i else 0
            for k, n in enumerate(self.counts[i]):
                out.counts[to[i]][k] += n
            out.bits[to[i]] = self.bits[i]
            out.strings[to[i]] = self.strings[i]
        for i, children in enumerate(self.below):
            if to[i] >= 0:
                out.below[to[i]] = [to[c] for c in children if to[c] >= 0]
        return out

    def template(self) -> list[set[int]]:
        """The strings of each text that are part of the template."""
        if self.pages < SUPPORT:
            return [set() for _ in self.key]
        out = [{h for h, (n, _) in s.items() if n >= SUPPORT and n >= SUPPORT_SHARE * c[2]} for s, c in zip(self.strings, self.counts, strict=True)]
        fixed = sum(self.strings[j][h][0] * self.strings[j][h][1] for j, hs in enumerate(out) for h in hs)
        return [set() for _ in out] if fixed > MOST_TEMPLATE * sum(c[3] for c in self.counts) else out

    def root(self) -> tuple[int, list[set[int]]]:
        """(the article's node, the template strings of each node)."""
        template = self.template()
        n = len(self.key)
        prose = [0] * n
        for j in range(n - 1, -1, -1):
            _, _, _, chars, links = self.counts[j]
            prose[j] += max(0, chars - links - sum(self.strings[j][h][0] * self.strings[j][h][1] for h in template[j]))
            if j:
                prose[self.above[j]] += prose[j]
        name = [k.partition(".")[0] for k in self.key]
        marked = [j for j in range(n) if is_marked(self.key[j])]
        if marked and max(prose[j] for j in marked) > 0:
            # the innermost marked element that holds half the prose of the marked ones
            most = max(prose[j] for j in marked)
            depth = [0] * n
            for j in range(1, n):
                depth[j] = depth[self.above[j]] + 1
            return max((j for j in marked if 2 * prose[j] >= most), key=lambda j: (depth[j], prose[j], -j)), template
        at = own = 0
        while True:
            own += sum(prose[c] for c in self.below[at] if name[c] in PROSE or name[c] == TEXT)
            if own > OWN_PROSE * prose[0] or any(prose[c] and name[c] in ("h1", "h2") for c in self.below[at]):
                break
            best = max(self.below[at], key=lambda c: (prose[c], -c), default=None)
            if best is None or self.bits[best] & REPEATED or prose[best] <= DESCEND * prose[0]:
                break
            at = best
        return at, template

    def pattern(self) -> str:
        """The expression as text: ? optional, + repeated, * both; a text is = where all pages have one string, else #."""
        out = [""] * len(self.key)
        for j in range(len(self.key) - 1, -1, -1):
            parts = [out[c] for c in self.below[j]]
            inner = f"({''.join(p if p[-1] in '?*' else p[:-1] + '*' if p[-1] == '+' else f'({p})?' for p in parts)})+" if self.bits[j] & LOOSE else "".join(parts)
            if not j:
                return inner
            if self.key[j] == TEXT:
                pages = [n for n, _ in self.strings[j].values()]
                body = "=" if len(pages) == 1 and pages[0] == self.counts[j][2] > 1 else TEXT
            else:
                body = f"<{self.key[j]}>{inner}</>"
            optional, repeated = self.counts[j][1] < self.counts[self.above[j]][0], self.bits[j] & REPEATED
            sign = "*" if optional and repeated else "+" if repeated else "?" if optional else ""
            out[j] = f"({body}){sign}" if sign else body
        return ""

    def dumps(self) -> str:
        return json.dumps([self.pages, self.key, self.above, self.counts, self.bits, self.below, [[[h, *v] for h, v in s.items()] for s in self.strings]], separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Wrapper:
        out = Wrapper()
        out.pages, keys, above, counts, bits, below, strings = json.loads(text)
        for key, up in zip(keys[1:], above[1:], strict=True):
            out.add(up, key)
        out.counts, out.bits, out.below = counts, bits, below
        out.strings = [{h: [n, c] for h, n, c in s} for s in strings]
        return out


def is_marked(key: str) -> bool:
    """Whether an element says that it is an article or the main part."""
    return key.partition(".")[0] in ("article", "main") or key.endswith((".=main", ".=article"))


class Page:
    """A page's wrapper of its own, its title, its texts in order (node, text, open block) and its blocks.

    A block has its node, the block around it, and the characters and those in links of the texts in it.
    """

    def __init__(self, source: str) -> None:
        self.wrapper = Wrapper()
        self.wrapper.pages = 1
        self.wrapper.counts[0][:3] = [1, 1, 1]
        self.texts: list[tuple[int, str, int]] = []
        self.blocks: list[list[int]] = [[0, -1, 0, 0]]
        self.title = ""
        self._opened = Opened()
        # of each open block: its node, its last child, all its children so far and its number
        self._instances: list[tuple[int, list, set[int], int]] = [(0, [None], set(), 0)]
        self._parts: list[str] = []
        self._links = 0
        self._read(source)
        for count in self.wrapper.counts:
            count[2] = 1
        for _, above, chars, links in reversed(self.blocks[1:]):
            self.blocks[above][2] += chars
            self.blocks[above][3] += links

    def _node(self, key: str) -> int:
        """One more occurrence of a child of the innermost open block."""
        w = self.wrapper
        above, last, children, _ = self._instances[-1]
        node = w.at.get((above, key))
        if node is None:
            node = w.add(above, key)
            # behind the sibling that it follows here
            order = w.below[above]
            if len(order) < KINDS:
                order.insert(0 if last[0] is None else order.index(last[0]) + 1, node)
            else:
                order.append(node)
        w.counts[node][0] += 1
        if node not in children:
            children.add(node)
            w.counts[node][1] += 1
            order = w.below[above]
            if len(order) > KINDS or (last[0] is not None and order.index(node) < order.index(last[0])):
                w.bits[above] |= LOOSE
        else:
            w.bits[node] |= REPEATED
            if last[0] != node:
                w.bits[above] |= LOOSE
        last[0] = node
        return node

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                node = self._node(TEXT)
                links = min(self._links, len(text))
                block = self._instances[-1][3]
                self.texts.append((node, text, block))
                self.blocks[block][2] += len(text)
                self.blocks[block][3] += links
                count = self.wrapper.counts[node]
                count[3] += len(text)
                count[4] += links
                self.wrapper.strings[node][digest(self.wrapper.path[node], text)] = [1, len(text)]
            self._parts, self._links = [], 0

    def _pop(self, depth: int) -> None:
        while len(self._opened.names) > depth:
            if self._opened.names[-1] in BLOCKS:
                self._flush()
                self._instances.pop()
            self._opened.pop()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._opened.has("a"):
            self._links += len(text.strip())

    def _read(self, s: str) -> None:
        # skips: (end, whether an article may resume) of the elements that are left out and that resume, innermost last
        at, skips, extent = 0, [], None
        found = _TOKEN.search(s)
        while found:
            skip = self._skipped(skips, at)
            if not skip and found.start() > at:
                self._text(s[at : found.start()])
            at = found.end()
            skip = self._skipped(skips, found.start())
            name = found[2].lower() if found[2] else None
            if name is None:
                pass
            elif found[1]:
                if not skip:
                    self._close(name)
            elif name in RAW:
                at = raw_end(found, s)
                if name == "title" and not self.title:
                    self.title = " ".join(entities.unescape(s[found.end() : at].rpartition("<")[0] or s[found.end() : at]).split())
            else:
                key, outside = mark(name, found[3].rstrip("/"))
                if outside and name == "header" and (self._opened.has("article") or self._opened.has("main")):
                    outside = 0
                if (outside or skip) and name not in VOID and extent is None:
                    extent, plain = extents(s)
                end, held, marked = extent[found.start()] if extent and name not in VOID else (at, 0, False)
                if skip:
                    if name == "main" or (name == "article" and skips[-1][1]):
                        skips.append((end, None))
                        self._start(name, key)
                elif outside == NAMED and (marked or (held > 0 and 2 * held >= plain)):
                    self._start(name, key)
                elif outside:
                    if name in BLOCKS:
                        self._pop(self._opened.implied(name))
                        self._flush()
                    if name not in VOID:
                        skips.append((end, outside != REMARKS and name not in ("aside", "footer")))
                else:
                    self._start(name, key)
            found = _TOKEN.search(s, at)
        if not self._skipped(skips, at) and at < len(s):
            self._text(s[at:])
        self._flush()
        self._pop(0)

    @staticmethod
    def _skipped(skips: list[tuple[int, bool | None]], at: int) -> bool:
        while skips and skips[-1][0] <= at:
            skips.pop()
        return bool(skips) and skips[-1][1] is not None

    def _start(self, name: str, key: str) -> None:
        self._pop(self._opened.implied(name))
        if name in BLOCKS:
            self._flush()
        elif name == "br":
            self._parts.append(" ")
        if name in VOID:
            return
        self._opened.push(name)
        if name in BLOCKS:
            node = self._node(key)
            self.blocks.append([node, self._instances[-1][3], 0, 0])
            self._instances.append((node, [None], set(), len(self.blocks) - 1))

    def _close(self, name: str) -> None:
        place = self._opened.at(name)
        if place is not None:
            self._pop(place)
        elif name in BLOCKS:
            self._flush()


def reading(wrapper: Wrapper) -> tuple[int, list[int]]:
    """What a page is read with: hashes of the article's path and of the template strings."""
    root, template = wrapper.root()
    return wrapper.path[root], sorted({h for hs in template for h in hs})


def text_of(page: Page, found: tuple[int, list[int]] | None) -> str:
    """The page's article by its host's wrapper, or by its own where there is none or it has nothing at that path."""
    w = page.wrapper
    if found is None or not (texts := _below(page, found[0])):
        found = reading(w)
        texts = _below(page, found[0])
    template = set(found[1])
    kept = [t for j, t in texts if not template or t in page.title or digest(w.path[j], t) not in template]
    if sum(map(len, kept)) < (1 - MOST_TEMPLATE) * sum(len(t) for _, t in texts):
        kept = [t for _, t in texts]
    return "\n".join(kept)


def _below(page: Page, path: int) -> list[tuple[int, str]]:
    """The texts (node, text) below the node of a path, less lists of links unless that is a marked element."""
    w = page.wrapper
    at = next((j for j, p in enumerate(w.path) if p == path), None)
    if at is None:
        return []
    marked = is_marked(w.key[at])
    on = [False] * len(page.blocks)
    for i, (node, above, chars, links) in enumerate(page.blocks):
        inside = above >= 0 and on[above]
        linked = inside and not marked and links > LINKED * chars and w.key[node].partition(".")[0] not in PROSE
        on[i] = node == at or (inside and not linked)
    return [(j, t) for j, t, block in page.texts if on[block]]


def host_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


WRAPPERS = "host string, pages long, wrapper string"
READINGS = "host string, pages long, root long, template array<long>"


def infer(pages: DataFrame) -> DataFrame:
    """(host, pages, root, template): how the pages (columns host, html) of each host are read."""

    def batch(rows: list[tuple[str, Wrapper]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([w.pages for _, w in rows], pa.int64()), pa.array([w.dumps() for _, w in rows], pa.string())], ["host", "pages", "wrapper"])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for b in batches:
            for host, source in zip(b["host"], b["html"], strict=True):
                own = Page(source.as_py() or "").wrapper
                host = host.as_py()
                held[host] = held[host].align(own) if host in held else own
                if len(held) > HELD:
                    yield batch(list(held.items()))
                    held = {}
        yield batch(list(held.items()))

    def whole(t: pa.Table, cut) -> Iterator[tuple[str, Wrapper]]:
        hosts, texts = t["host"], t["wrapper"]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            out = Wrapper.loads(texts[int(s)].as_py())
            for k in range(int(s) + 1, int(e)):
                out = out.align(Wrapper.loads(texts[k].as_py()))
            yield hosts[int(s)].as_py(), out

    def merge(t: pa.Table, cut) -> pa.Table:
        return pa.Table.from_batches([batch(list(whole(t, cut)))])

    def settle(t: pa.Table, cut) -> pa.Table:
        rows = [(h, w.pages, *reading(w)) for h, w in whole(t, cut)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "pages", "root", "template"])

    made = materialize(ragged.map_batches(pages.select("host", "html").filter("host <> ''"), streams, WRAPPERS), "streams")
    while (most := made.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > SHARE:
        shares = -(-most // SHARE)
        dealt = made.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(shares)).cast("int"))
        fewer = materialize(map_groups(dealt, ["host", "share"], ["wrapper"], merge, WRAPPERS), "streams")
        discard(made)
        made = fewer
    found = materialize(map_groups(made, ["host"], ["wrapper"], settle, READINGS), "wrappers")
    discard(made)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars appended (columns by these names are replaced)."""
    source = pages.select([c for c in pages.columns if c not in ("text", "n_chars")])
    kept = list(source.columns)
    host, root, template, n = (unused(kept, c) for c in ("host", "root", "template", "pages"))
    hosted = source.withColumn(host, host_of("url"))
    found = infer(hosted.select(F.col(host).alias("host"), "html"))
    size = found.agg(F.coalesce(F.sum("pages"), F.lit(0)), F.coalesce(F.sum(F.length("host") + 8 * F.size("template") + 100), F.lit(0))).first()
    named = found.select(F.col("host").alias(host), F.col("root").alias(root), F.col("template").alias(template), F.col("pages").alias(n))
    if size[1] <= SMALL_BYTES:
        joined = hosted.join(F.broadcast(named.drop(n)), host, "left")
    else:
        # the few hosts with more than their share of pages are broadcast, so that no key of the shuffle is hot
        hot = F.broadcast(named.filter(F.col(n) > HOT * size[0]).drop(n))
        rest = hosted.join(F.broadcast(hot.select(host)), host, "left_anti")
        joined = hosted.join(hot, host).unionByName(rest.join(named.filter(F.col(n) <= HOT * size[0]).drop(n), host, "left"))
    schema = StructType(source.schema.fields + StructType.fromDDL("text string, n_chars long").fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, at, fixed in zip(b["html"], b[root], b[template], strict=True):
                texts.append(text_of(Page(source.as_py() or ""), (at.as_py(), fixed.as_py()) if at.is_valid else None))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return ragged.map_batches(joined, work, schema)
