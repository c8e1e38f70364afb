"""HTML extraction by union-free wrappers.

Each page becomes a stream of block tokens: the tag path of a text block, the
text being a slot.  Runs that repeat inside a page are folded into repeated
groups.  For each host the distinct folded streams are aligned one after
another, the most frequent first: tokens that match stay, tokens that one side
lacks become optional, and what was folded on either side is a repeated group.
The wrapper keeps statistics of each slot over all pages of the host: whether
its text ever differs, about how many texts it takes, how long they are, how
much of them is linked, and whether a repeated group always opens or closes
with the same text.

The wrapper then says for every slot whether it holds the article.  A text that
never differs over the pages of a host is template, one of a few that take turns
is an advert or the like, and groups of short links are menus; what is left is
read from the main region, or, where the host's wrapper has none or hardly any
text there, from the neutral slots.  Names are priors only: elements and class
names mark a slot as main or as chrome (menus, footers, reader comments) before
the wrapper is known; a constant text goes although its name says main, and
long, varying prose stays where names alone would leave a page empty.  At last
each stream is matched against its host's wrapper, which gives its slots' fate.

A host may hold a third of all pages: a stream travels once, its slots as
numbers keyed by its hash and pre-aggregated; streams are aligned in parts of a
bounded number of tokens, and the parts' wrappers are merged in a tree.

Defined cases.  A null or empty html, and one without an article, give an empty
text.  Pages that are equal count as one, so verbatim copies prove no template.
Where texts never differ on a host, nothing is dropped as template.  A null
url, or one without ``://``, has the empty host.  Repeated rows give equal
results.  An empty table gives an empty result.  Extra columns are ignored.  An
attribute whose quote never closes ends at the next ``>``; raw elements that
never close are empty, but for scripts and styles, which run to the end.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkernel
from .urlfilter import host

#: Distinct pages that must agree on a text before it is template: elsewhere, and in a main region.
TEMPLATE_PAGES, MAIN_PAGES = 3, 8
#: The share of a host's pages a template text is on.
TEMPLATE_SHARE = 0.5
#: A few texts take turns: at most one for so many distinct pages, of which there are so many.
TURNS, TURN_PAGES = 8, 20
#: Links of a menu: so many in a group, of so many characters on average at most.
MENU_LINKS, LINK_CHARS = 3, 40
#: Characters a page of varying prose that names alone do not hide.
PROSE = 200
#: Tokens of streams, and wrappers, that one task aligns.
PART_TOKENS, FAN = 20_000, 16

# fixed values: element and class names of web pages
_RAW = "script|style|noscript|template|svg|textarea|iframe|title|math|object|select|option|button|canvas|audio|video"
_TO_THE_END = frozenset(("script", "style"))
_FOREIGN = frozenset(("svg", "math"))
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SKIP = frozenset("nav aside footer form dialog menu head".split())
_MAIN = frozenset("article main".split())
_CHROME = frozenset(
    "ad ads adbox adsense adsbygoogle advert advertisement advertisements adverts advertising sponsor sponsored sponsors promo promos promotion promotions promoted sidebar sidebars aside nav navbar navigation menu menus submenu "
    "comment comments commentlist commentform reply replies respond disqus cookie cookies consent gdpr notification notifications banner banners newsletter newsletters subscribe subscription signup "
    "share sharing sharebar sharethis social popup popups modal modals overlay breadcrumb breadcrumbs pagination pager widget widgets toolbar skiplink footer footers "
    "disclaimer paywall adblock adunit adslot adcontainer adwrapper adspace adframe topnav sidenav subnav mainnav sitenav navmenu navlinks topmenu mainmenu sidemenu sitefooter pagefooter leftsidebar rightsidebar".split()
)
#: Chrome as a class; as the id of a section these are also the names of parts of papers.
_DOUBTFUL = frozenset("discussion discussions reviews feedback responses related recommended recommendations tags alert alerts search login notice notices announcement announcements skip".split())
_SOFT = frozenset("header head masthead top bottom foot copyright legal siteheader".split())
_CONTENT = frozenset("content maincontent article articlebody post postcontent entry entrycontent story storybody articlecontent maintext".split())
#: Words that stand beside a name without changing what it names.
_BESIDE = frozenset(
    "area bar block body bottom box button buttons card cards col column container content form group header heading icon icons image images inner item items label left link links list lists main outer page panel "
    "post posts article articles right row section sections site slot space text thread threads title toggle tools top unit widget wrap wrapper js wp l m c u o x".split()
)
#: Parts of names that describe the layout around something, not the thing.
_LAYOUT = frozenset("has no with without open enabled layout col row page".split())
_ROLES = {"navigation": "C", "banner": "soft", "contentinfo": "C", "complementary": "C", "search": "C", "form": "C", "dialog": "C", "alert": "C", "main": "main", "article": "main"}

# a quote opens a value only where the value starts; nothing is tried twice
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""",
    re.S,
)
_RAW_NAMES = frozenset(_RAW.split("|"))
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW_NAMES}
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _names(value: str, doubtful: bool) -> str:
    """What a class or id says: chrome where a chrome word stands and what follows it only says which part of it, soft, main or nothing."""
    said = ""
    for one in value.split():
        parts = [p.lower() for p in _PARTS.split(one) if p]
        parts = [p for p in (_DIGITS.sub("", q) for q in parts) if p]
        joined = "".join(parts)
        if set(parts) & _LAYOUT:
            continue
        at = next((k for k, p in enumerate(parts) if p in _CHROME or p in _DOUBTFUL and doubtful), None)
        if joined in _CHROME or at is not None and all(p in _CHROME or p in _DOUBTFUL or p in _BESIDE or p in _SOFT for p in parts[at + 1 :]):
            return "chrome"
        if any(p in _SOFT for p in parts) and all(p in _SOFT or p in _BESIDE for p in parts):
            said = said or "soft"
        elif any(p in _CONTENT for p in (*parts, joined)) and all(p in _CONTENT or p in _BESIDE for p in parts):
            said = said or "main"
    return said


class _Tag(NamedTuple):
    label: str
    #: C chrome by element, c chrome by name, H not shown, soft, main or nothing
    role: str
    #: an anchor with a target
    link: bool


def _tag(tag: str, attrs: str) -> _Tag:
    role = "main" if tag in _MAIN else "C" if tag in _SKIP else "soft" if tag == "header" else ""
    if not attrs.strip(" /") or tag in ("html", "body"):
        return _Tag(tag, "" if tag in ("html", "body") else role, False)
    label, link = tag, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if label == tag and value.strip():
                label = f"{tag}.{_DIGITS.sub('#', value.split()[0].lower())}".replace("/", "_").replace("|", "_")
            if role in ("C", "c") or tag in _HEADING and name == "id":
                continue
            said = _names(value, name == "class" or tag != "section")
            if said == "chrome":
                role = "c"
            else:
                role = role or said
        elif name == "role":
            role = _ROLES.get(value.strip().lower(), role)
        elif name == "hidden" and tag != "input" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _Tag(label, "H", False)
        elif name == "href" and tag == "a":
            link = True
    return _Tag(label, role, link)


class Block(NamedTuple):
    token: str
    text: str
    linked: int


def blocks(html: str) -> list[Block]:
    """The text blocks: token (state M main, C or c chrome, or nothing, and the tag path), text and characters in links."""
    out: list[Block] = []
    stack: list[tuple[str, str, str]] = []  # tag, label, state
    text: list[str] = []
    linked, pos = 0, 0
    link_at = -1  # height of the stack where the open link stands

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block((stack[-1][2] if stack else "") + "|" + "/".join(s[1] for s in stack), whole, linked))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1][2] == "H":
            return
        if "&" in raw:
            raw = unescape(raw)
        text.append(raw)
        if link_at >= 0:
            linked += len(raw.strip())

    def shorten(to: int) -> None:
        nonlocal link_at
        del stack[to:]
        if link_at > len(stack):
            link_at = -1

    while m := _TOKEN.search(html, pos):
        if m.start() > pos:
            say(html[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link_at = -1
            known = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if known is not None:
                if tag in _BLOCK or stack[known][2] != (stack[known - 1][2] if known else ""):
                    close()
                shorten(known)
            elif tag in _BLOCK:
                close()
            continue
        if tag in _RAW_NAMES:
            if not (tag in _FOREIGN and m[0].endswith("/>")):
                ends = _CLOSE[tag].search(html, pos)
                if ends:
                    pos = ends.end()
                elif tag in _TO_THE_END:
                    pos = len(html)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        block = tag in _BLOCK
        if tag == "hr":
            close()
            continue
        label, role, link = _tag(tag, m[3] or "")
        if tag == "a":
            link_at = len(stack) if link else -1
        if not block and role not in ("C", "c", "H"):
            continue
        close()
        if block:
            if stack and stack[-1][0] == "p":
                shorten(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                like = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in like:
                        shorten(k)
                        break
        state = stack[-1][2] if stack else ""
        if state == "H" or role == "H":
            state = "H"
        elif state == "C" or role == "C":
            state = "C"
        elif role == "c" or state == "c":
            state = "c"
        elif role == "soft" and state != "M":
            state = "C" if tag == "header" else "c"
        elif role == "main":
            state = "M"
        stack.append((tag, label, state))
    if pos < len(html):
        say(html[pos:])
    close()
    return out


def fold(tokens: list[str], longest: int = 4) -> tuple[list[str], list[int]]:
    """Adjacent repeats of up to ``longest`` tokens become one group, marked +; also the slot of every token."""
    seq = [(t, [k]) for k, t in enumerate(tokens)]
    for size in range(1, longest + 1):
        out: list[tuple[str, list[int]]] = []
        names = [s[0].rstrip("+") for s in seq]
        k = 0
        while k < len(seq):
            end = k + size
            while end + size <= len(seq) and names[end : end + size] == names[k : k + size]:
                end += size
            if end > k + size:
                for i in range(size):
                    t, at = seq[k + i]
                    for j in range(k + size + i, end, size):
                        at.extend(seq[j][1])
                    out.append((t if t.endswith("+") else t + "+", at))
                k = end
            else:
                out.append(seq[k])
                k += 1
        seq = out
    slots = [0] * len(tokens)
    for k, (_, at) in enumerate(seq):
        for t in at:
            slots[t] = k
    return [s[0] for s in seq], slots


def page(html: str | None) -> tuple[str, list[Block], list[int]]:
    """The folded stream of a page, its blocks, and the slot of each."""
    found = blocks(html) if html else []
    seq, slots = fold([b.token for b in found])
    return "\n".join(seq), found, slots


def hash_text(text: str, before: int = 0) -> int:
    """A running 63-bit hash that is equal on every machine."""
    data = text.encode("utf-8", "surrogatepass")
    return (before * 1_000_003 + (zlib.crc32(data) << 31 ^ zlib.adler32(data))) & (2**63 - 1)


def bit(h: int) -> int:
    """One of 64 bits as a signed number: the bits of many hashes, or-ed, tell about how many they are."""
    b = 1 << ((h * 0x9E3779B97F4A7C15 >> 58) & 63)
    return b - 2**64 if b >= 2**63 else b


def about(bits: int) -> float:
    """Distinct hashes by linear counting; exact up to a few, without end when every bit is set."""
    ones = (bits & 2**64 - 1).bit_count()
    return 64 * math.log(64 / (64 - ones)) if ones < 64 else math.inf


# statistics of a slot, in the order they are kept in: pages (bits of their hashes), texts (bits, and the least and greatest hash), the same of the
# first and the last block, rows, blocks, characters, characters in links
_KEEP = ("n", "pages", "texts", "low", "high", "first_low", "first_high", "last_low", "last_high", "blocks", "chars", "linked")
_ROW = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("slot", pa.int32()), ("stream", pa.string())] + [(k, pa.int64()) for k in _KEEP])
_ROW_SQL = "host string, sig bigint, slot int, stream string, " + ", ".join(f"{k} bigint" for k in _KEEP)


def merged(a: list[int], b: list[int]) -> list[int]:
    return [a[0] + b[0], a[1] | b[1], a[2] | b[2], min(a[3], b[3]), max(a[4], b[4]), min(a[5], b[5]), max(a[6], b[6]), min(a[7], b[7]), max(a[8], b[8]), a[9] + b[9], a[10] + b[10], a[11] + b[11]]


def page_stats(found: list[Block], slots: list[int]) -> list[list[int]]:
    """Statistics of each slot of one page."""
    whole = 0
    hashes = [hash_text(b.text) for b in found]
    for h in hashes:
        whole = (whole * 1_000_003 + h) & (2**63 - 1)
    own = bit(whole)
    out: dict[int, list[int]] = {}
    for b, slot, h in zip(found, slots, hashes, strict=True):
        s = out.get(slot)
        if s is None:
            out[slot] = [1, own, 0, h, h, h, h, h, h, 1, len(b.text), b.linked]
        else:
            s[3] = (s[3] * 1_000_003 + h) & (2**63 - 1)
            s[7] = s[8] = h
            s[9] += 1
            s[10] += len(b.text)
            s[11] += b.linked
    for s in out.values():
        s[4], s[2] = s[3], bit(s[3])
    return [out[k] for k in range(len(out))]


@textkernel.releasing
def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: statistics of each slot of each (host, stream); the stream itself goes with its first slot."""
    for batch in batches:
        seen: dict[tuple, tuple[str, list[list[int]]]] = {}
        for where, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            stream, found, slots = page(html.as_py())
            if not found:
                continue
            own, key = page_stats(found, slots), (where, hash_text(stream))
            if key in seen:
                kept = seen[key][1]
                kept[:] = [merged(a, b) for a, b in zip(kept, own, strict=True)]
            else:
                seen[key] = stream, own
        rows = [(*key, k, None if k else stream, *s) for key, (stream, stats) in seen.items() for k, s in enumerate(stats)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_ROW), _ROW, strict=True)], schema=_ROW)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places of two streams, in order: the k-th of a token meets the k-th, as many as keep the order; then once more between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        places: dict[tuple[str, int], int] = {}
        count: dict[str, int] = {}
        for j in range(b0, b1):
            places[b[j], count.setdefault(b[j], 0)] = j
            count[b[j]] += 1
        count.clear()
        tails: list[int] = []  # the least last place of a run of each length, and how to get back
        at: list[int] = []
        back: list[int] = []
        pairs: list[tuple[int, int]] = []
        for i in range(a0, a1):
            j = places.get((a[i], count.setdefault(a[i], 0)))
            count[a[i]] += 1
            if j is None:
                continue
            k = bisect_left(tails, j)
            pairs.append((i, j))
            back.append(at[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                at.append(len(pairs) - 1)
            else:
                tails[k], at[k] = j, len(pairs) - 1
        if not pairs:
            continue
        run, p = [], at[-1]
        while p >= 0:
            run.append(pairs[p])
            p = back[p]
        out += run
        edges = [(a0 - 1, b0 - 1), *run[::-1], (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


Wrapper = tuple[list[str], list[list[int]]]


def combine(wrapper: Wrapper, other: Wrapper) -> Wrapper:
    """Both tokens in order: those that match once, with + where either has it, the others as optional ones."""
    tokens, stats = [], []
    plain, own = [t.rstrip("+") for t in wrapper[0]], [t.rstrip("+") for t in other[0]]
    i = j = 0
    for x, y in [*align(plain, own), (len(plain), len(own))]:
        tokens += wrapper[0][i:x] + other[0][j:y]
        stats += wrapper[1][i:x] + other[1][j:y]
        if x < len(plain):
            tokens.append(max(wrapper[0][x], other[0][y], key=len))
            stats.append(merged(wrapper[1][x], other[1][y]))
        i, j = x + 1, y + 1
    return tokens, stats


def infer(streams: list[Wrapper]) -> Wrapper:
    """The wrapper of streams (or of wrappers), the most frequent first."""
    order = sorted(streams, key=lambda s: (-max((x[0] for x in s[1]), default=0), s[0]))
    wrapper: Wrapper = ([], [])
    for s in order:
        wrapper = combine(wrapper, s)
    return wrapper


def _state(token: str) -> str:
    return token.split("|", 1)[0]


def decide(tokens: list[str], stats: list[list[int]]) -> str:
    """The fate of each slot: 1 article, 2 to 4 article but for the first, the last, or both ends of the group, n neutral, r prose under a chrome name, 0 none.

    n is read only where a stream has no article slot; r only where nothing else is left of one.
    """
    every = 0
    for s in stats:
        every |= s[1]
    all_pages = about(every)
    varies = any(s[3] != s[4] for s in stats)

    def common_text(s: list[int], low: int, high: int, least: int) -> bool:
        pages = about(s[1])
        return varies and low == high and (s[1] & 2**64 - 1).bit_count() >= least and (all_pages == math.inf or pages >= TEMPLATE_SHARE * all_pages)

    fates = []
    size = {"M": 0.0, "": 0.0}
    for token, s in zip(tokens, stats, strict=True):
        state = _state(token)
        least = MAIN_PAGES if state == "M" else TEMPLATE_PAGES
        if state == "C" or common_text(s, s[3], s[4], least):
            fates.append("0")
            continue
        pages, texts = about(s[1]), about(s[2])
        few = pages >= TURN_PAGES and texts * TURNS <= (pages if pages < math.inf else 64 * math.log(64))
        menu = 2 * s[11] > s[10] and s[9] >= MENU_LINKS * s[0] and s[10] <= LINK_CHARS * s[9]
        if state == "c":
            fates.append("r" if not few and not menu and 2 * s[11] <= s[10] and s[10] >= PROSE * s[0] and s[3] != s[4] else "0")
            continue
        if state != "M" and (few or menu):
            fates.append("0")
            continue
        size[state] += s[10]
        if token.endswith("+"):
            first, last = common_text(s, s[5], s[6], least), common_text(s, s[7], s[8], least)
            fates.append("4" if first and last else "3" if last else "2" if first else "1")
        else:
            fates.append("1")
    if 2 * size["M"] >= size[""]:  # a main region with hardly any text is no main region
        fates = ["n" if f in "1234" and _state(t) == "" else f for t, f in zip(tokens, fates, strict=True)]
    return "".join(fates)


def match(stream: list[str], tokens: list[str], fates: str) -> str:
    """The fate of each slot of a stream, 0 to 4, by matching it against its host's wrapper."""
    got = ["0"] * len(stream)
    plain, own = [t.rstrip("+") for t in tokens], [t.rstrip("+") for t in stream]
    found = dict((y, x) for x, y in align(plain, own))
    elsewhere = dict(zip(plain, fates, strict=True))
    for y, t in enumerate(own):
        got[y] = fates[found[y]] if y in found else elsewhere.get(t, "0")
    for wanted in ("1234", "n", "r"):
        if any(g in wanted for g in got):
            return "".join(("1" if g in "nr" else g) if g in wanted else "0" for g in got)
    return "0" * len(stream)


_WRAP_SQL = "host string, part int, tokens string, stats array<bigint>"


def _flat(stats: list[list[int]]) -> list[int]:
    return [v for s in stats for v in s]


def _unflat(values: list[int]) -> list[list[int]]:
    return [values[k : k + len(_KEEP)] for k in range(0, len(values), len(_KEEP))]


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    tokens, stats = infer([(t.split("\n"), _unflat(s)) for t, s in zip(table["tokens"].to_pylist(), table["stats"].to_pylist(), strict=True)])
    return pa.table({
        "host": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "tokens": pa.array(["\n".join(tokens)], pa.string()), "stats": pa.array([_flat(stats)], pa.list_(pa.int64())),
    })


@textkernel.releasing
def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cache: dict[str, tuple[list[str], str]] = {}
        masks = []
        for at, stream, tokens, stats in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if at not in cache:
                names = tokens.split("\n")
                cache[at] = names, decide(names, _unflat(stats.as_py()))
            masks.append(match(stream.split("\n"), *cache[at]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.string())], names=["host", "sig", "mask"])


def streams(pages: DataFrame) -> DataFrame:
    """host, sig, tokens, stats: each distinct stream of a host once."""
    common.ship(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_streams, _ROW_SQL)
    how = {"n": F.sum, "pages": F.bit_or, "texts": F.bit_or, "blocks": F.sum, "chars": F.sum, "linked": F.sum}
    how |= {k: F.min for k in _KEEP if k.endswith("low")} | {k: F.max for k in _KEEP if k.endswith("high")}
    rows = rows.groupBy("host", "sig", "slot").agg(F.max("stream").alias("stream"), *[how[k](k).alias(k) for k in _KEEP])
    slots = F.sort_array(F.collect_list(F.struct("slot", F.array(*_KEEP).alias("s"))))
    return rows.groupBy("host", "sig").agg(F.max("stream").alias("tokens"), F.flatten(F.transform(slots, lambda x: x["s"])).alias("stats"))


def wrappers(found: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """host, tokens, stats: one wrapper a host, merged in a tree where its streams are too many for one task."""
    tokens = F.size("stats") / len(_KEEP)
    parts = found.groupBy("host").agg(F.ceil(F.sum(tokens) / part_tokens).cast("int").alias("_parts")).withColumnRenamed("host", "_host")
    parts = common.materialize(parts, "stream-parts")
    hosts, left = parts.agg(F.count("*"), F.max("_parts")).first()
    left = left or 0
    rows = found.join(common.small(parts, hosts), F.col("host") == F.col("_host")).select("host", F.pmod("sig", F.col("_parts")).cast("int").alias("part"), "tokens", "stats")
    while True:
        rows = rows.groupBy("host", "part").applyInArrow(_merge, _WRAP_SQL)
        if left <= 1:
            return rows.drop("part")
        rows = common.materialize(rows, "wrapper-parts").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        left = -(-left // FAN)


def masks(pages: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """host, sig (a hash of the stream), mask: per slot of each stream of a host, 0 or how it holds the article."""
    found = common.materialize(streams(pages), "streams")
    made = common.materialize(wrappers(found, part_tokens), "wrappers").withColumnRenamed("host", "_host")
    weight = made.agg(F.sum(F.length("tokens") + 8 * F.size("stats"))).first()[0] or 0
    made = F.broadcast(made) if weight <= common.BROADCAST_BYTES else made
    rows = found.join(made, F.col("host") == F.col("_host")).select("host", "sig", found["tokens"].alias("stream"), made["tokens"].alias("tokens"), made["stats"].alias("stats"))
    return rows.mapInArrow(_masks, "host string, sig bigint, mask string")


@textkernel.releasing
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(np.ceil(batch.num_rows / max(1, batch.nbytes // 4_000_000 + 1))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            sigs, lists = [], []
            for html in part.column(3):
                stream, found, slots = page(html.as_py())
                sigs.append(hash_text(stream))
                ends = {s: k for k, s in enumerate(slots)}
                first = _firsts(slots)
                # a block of chrome by element is never asked for
                lists.append([{"s": s, "e": (2 if f else 0) + (1 if ends[s] == k else 0), "t": b.text} for k, (b, s, f) in enumerate(zip(found, slots, first, strict=True)) if not b.token.startswith("C|")])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("t", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sigs, pa.int64()), pa.array(lists, kind)], names=["page_id", "url", "h", "sg", "blocks"])


def _firsts(slots: list[int]) -> list[bool]:
    seen: set[int] = set()
    return [not (s in seen or seen.add(s)) for s in slots]


def extract(pages: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    plan = common.materialize(masks(pages, part_tokens), "masks")
    weight = plan.agg(F.sum(F.length("mask") + F.coalesce(F.length("host"), F.lit(0)) + 40)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host(F.col("url")).alias("h"), "html")
    rows = rows.mapInArrow(_texts, "page_id bigint, url string, h string, sg bigint, blocks array<struct<s:int,e:int,t:string>>")
    rows = rows.join(F.broadcast(plan) if weight <= common.BROADCAST_BYTES else plan, (F.col("h") == F.col("host")) & (F.col("sg") == F.col("sig")), "left")
    fate = lambda b: F.substring("mask", b["s"] + 1, F.lit(1))
    kept = F.filter("blocks", lambda b: (fate(b) != "0") & ~(fate(b).isin("2", "4") & (b["e"] >= 2)) & ~(fate(b).isin("3", "4") & (b["e"] % 2 == 1)))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["t"]), "\n\n"), F.lit(""))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))
