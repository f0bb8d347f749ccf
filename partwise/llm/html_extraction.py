"""HTML extraction with wrappers: union-free regular expressions inferred per host.

1. Each page is a stream of tokens: block tags with their class or id, and texts. Adjacent repeats of a sub-stream become a
   repeated group (...)+.
2. Streams of one host are aligned one by one: where both have the same token it stays, where their texts differ the text
   becomes a slot, and what only one of them has becomes an optional group (...)?. The result, a wrapper, is a stream
   itself, so wrappers of parts of a host (a batch of pages) are aligned the same way, in two rounds with salted hosts: no
   task gathers a host's pages, only one wrapper for each batch that has the host.
3. A host has two wrappers: of its pages without <article> or <main>, and of what is inside these tags on the others. The
   first tells the container of most of its slots' text (main content); both tell the texts that stayed the same in
   LEAST_PAGES unlike pages or more (template text), each for its own pages.
4. Pages are read again, with their host's findings beside them, and the main text is written out: of <main> or <article>,
   else of the host's main container, else of the body; of several articles side by side the one with most text, the others
   being teasers or posts; never of an article within another, which is a reader's. It is always without menus, headers (but
   for an article's own), footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, which are known by
   tag or role, or by a class or id all of whose words are known: one of MARKS, the others of MARKS or PLAIN (so "ad-slot" is
   one, "ad-hoc" is not); headings are not judged by theirs. And it is without template text.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones are
left out, and the rest is joined by "\\n" in page order. <br> is white space.

No page and no part of a wrapper is dropped, however long: streams of over LONG nodes are aligned by a longest common
subsequence, whose time grows by bit-parallel rows and whose memory is bounded. A wrapper grows with the unlike parts its
host's pages have, so a host whose pages have nothing in common makes one as large as they are.

Findings are joined by broadcast where they have at most SMALL rows and ten times as many texts, else by a shuffle in which
Spark may split hot hosts.

Defined cases: null or empty html: empty text, n_chars 0. Null url: host "". Null page_id: kept as it is. Cut-off tags and pages end where the html
ends. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from difflib import SequenceMatcher
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LEAST_PAGES, LONG, SALTS, SMALL, BITS = 3, 1000, 32, 20_000, 1 << 28
# HTML element names by how they are read.
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
LEFT_OUT = frozenset("head nav header footer aside form button select option dialog menu".split()) | RAW
MAIN = frozenset(["article", "main"])
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div nav aside header footer table ul ol dl body html blockquote form".split())
CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
# Words of class and id attributes that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget "
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored notice notices cookie cookies consent "
    "gdpr alert popup modal overlay newsletter subscribe signup login form search share sharing social comment comments "
    "commentlist respond reply replies disqus discussion related recommended skip toolbar copyright legal".split()
)
# Words that say nothing in a class or id beside one of the above.
PLAIN = frozenset(
    "box block list item items wrap wrapper container content inner outer section area bar panel row col slot unit zone top bottom "
    "left right center main site page global primary secondary mobile desktop widget widgets module group nav link links "
    "button buttons text title heading form post posts user users reader readers thread icon icons small large fixed sticky "
    "js is has no d lg md sm xs id class div ul mini mega bottom inline floating header footer message messages".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BLANK = re.compile(r"\s+")


HEADING = re.compile("h[1-6]")


def _marked_as(value: str) -> bool:
    """Whether a class or id is made of known words only, one of MARKS among them."""
    for token in value.split():
        words = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLAIN for w in words):
            return True
    return False


def _left_out(name: str, attributes: str, inside: bool = False) -> bool:
    """inside: of a story, whose own header is part of it."""
    if name in LEFT_OUT and not (inside and name == "header"):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if key in ("class", "id") and name not in MAIN and name not in ("body", "html") and not HEADING.fullmatch(name) and _marked_as(value):
            return True
    return False


def _signature(name: str, attributes: str) -> str:
    """The tag with its class, or id, without digits: what a wrapper compares."""
    for wanted in ("class", "id"):
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() == wanted:
                return f"{name}.{re.sub(r'[^a-z]+', '-', (m[2] or m[3] or m[4] or '').lower())[:40]}"
    return name


def blocks(html: str):
    """Yields (text, (in <main>, number of its article or 0), path of block signatures) for each block outside what is left
    out."""
    outside = (False, 0)
    stack: list[tuple[str, bool, tuple[bool, int], str]] = []  # name, left out, place, signature
    out, main, at, n, articles = False, outside, 0, len(html), 0
    pieces: list[str] = []

    def flush():
        if pieces:
            text = BLANK.sub(" ", unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                return text, main, tuple(s[3] for s in stack if s[3])
        return None

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            if not out:
                pieces.append(html[at:])
            break
        if not out and m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            if not out:
                pieces.append(" ")
            continue
        inline = name in INLINE
        if not inline and (found := flush()):
            yield found
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline and any(s[0] in SCOPES for s in stack[k + 1 :]):
                        break
                    del stack[k:]
                    break
        else:
            if name in VOID:
                continue
            if not inline:
                ended = ENDS.get(name, set()) | ({"p"} if name in CLOSE_P else set())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ended:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES:
                        break
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if not attributes.endswith("/") or name not in ("svg", "math"):
                drop = out or _left_out(name, attributes, main != outside) or name == "article" and main[1] > 0
                if drop and not out and (found := flush()):
                    yield found
                place = main
                if name == "article" and not drop:
                    articles += 1
                    place = (main[0], articles)
                elif name == "main":
                    place = (True, main[1])
                stack.append((name, drop, place, "" if inline else _signature(name, attributes)))
        out = bool(stack) and stack[-1][1]
        main = stack[-1][2] if stack else outside
    if found := flush():
        yield found


def story(found: list) -> list:
    """The blocks of <main>, else of articles; of several articles there the one with most text (the first of equal ones)."""
    inside = [x for x in found if x[1][0]] or [x for x in found if x[1][1]]
    size: dict[int, int] = {}
    for text, (_, article), _ in inside:
        if article:
            size[article] = size.get(article, 0) + len(text)
    best = max(size, key=lambda a: (size[a], -a), default=0)
    return [x for x in inside if x[1][1] in (0, best)]


# ---- wrappers: nodes are [kind, value, length, pages]; kind "t" tag, "#" text (value: hash, or None for a slot), "?" and "+"
# groups; pages (of a text that has a value): the least LEAST_PAGES keys of unlike pages that had it there with that value


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def stream(found) -> list:
    """A page's blocks as tokens: where the path changes, the tags left and entered; then the text."""
    out, last = [], ()
    for text, _, path in found:
        k = 0
        while k < min(len(path), len(last)) and path[k] == last[k]:
            k += 1
        k = min(k, max(len(path) - 1, 0))  # a block of the same kind is entered anew
        out += [["t", f"/{s}", 0] for s in reversed(last[k:])] + [["t", s, 0] for s in path[k:]]
        out.append(["#", _hash(text), len(text), []])
        last = path
    return out + [["t", f"/{s}", 0] for s in reversed(last)]


def _key(node: list):
    return (node[0], tuple(_key(x) for x in node[1])) if node[0] in "?+" else ("#",) if node[0] == "#" else (node[0], node[1])


def _joined(a: list, b: list) -> list:
    if a[0] in "?+":
        return [a[0], [_joined(x, y) for x, y in zip(a[1], b[1], strict=True)], 0]
    if a[0] == "t":
        return a
    same = a[1] is not None and a[1] == b[1]
    return ["#", a[1] if same else None, a[2] + b[2], sorted({*a[3], *b[3]})[:LEAST_PAGES] if same else []]


def marked(nodes: list, page: str) -> list:
    """The nodes of one page, with its key in each text that has a value."""
    return [
        [n[0], marked(n[1], page), 0] if n[0] in "?+" else [*n[:3], [page]] if n[0] == "#" and n[1] is not None else n
        for n in nodes
    ]


def squash(nodes: list, longest: int = 8) -> list:
    """Adjacent repeats of up to longest nodes become repeated groups."""
    for size in range(1, longest + 1):
        out, keys, k = [], [], 0
        source = [(n, _key(n)) for n in nodes]
        while k < len(source):
            unit = [x for _, x in source[k : k + size]]
            here = [n for n, _ in source[k : k + size]]
            if len(out) and out[-1][0] == "+" and [_key(x) for x in out[-1][1]] == unit:
                out[-1] = ["+", [_joined(a, b) for a, b in zip(out[-1][1], here, strict=True)], 0]
                k += size
            elif len(unit) == size and keys[-size:] == unit and unit[0][0] != "+" and not (size == 1 and unit[0][0] == "?"):
                before = out[-size:]
                del out[-size:], keys[-size:]
                out.append(["+", [_joined(a, b) for a, b in zip(before, here, strict=True)], 0])
                keys.append(_key(out[-1]))
                k += size
            else:
                out.append(source[k][0])
                keys.append(source[k][1])
                k += 1
        nodes = out
    return nodes


def _common(a: list, b: list, bits: int = BITS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: bit-parallel rows, halved (Hirschberg) where they take more than bits bits."""
    start, end, m = 0, len(a), len(b)
    while start < min(end, m) and a[start] == b[start]:
        start += 1
    while end > start and m > start and a[end - 1] == b[m - 1]:
        end, m = end - 1, m - 1
    tail = [(end + k, m + k) for k in range(len(a) - end)]
    head = [(k, k) for k in range(start)]
    a, b = a[start:end], b[start:m]
    if not a or not b:
        return head + tail

    def rows(x, y):
        places: dict = {}
        for k, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << k
        full = row = (1 << len(y)) - 1
        for v in x:
            hit = row & places.get(v, 0)
            row = ((row + hit) | (row - hit)) & full
            yield row

    if len(a) > 1 and len(a) * len(b) > bits:
        half = len(a) // 2

        def lengths(x, y):  # of the common subsequence with each beginning of y
            *_, row = rows(x, y)
            return [0, *accumulate(c == "0" for c in reversed(f"{row:0{len(y)}b}"))]

        before, after = lengths(a[:half], b), lengths(a[:half - 1 : -1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda k: before[k] + after[k])
        found = _common(a[:half], b[:cut], bits) + [(half + i, cut + k) for i, k in _common(a[half:], b[cut:], bits)]
    else:
        kept = [(1 << len(b)) - 1, *rows(a, b)]
        found, i, k = [], len(a), len(b)
        while i and k:
            if kept[i] >> k - 1 & 1:
                k -= 1
            elif not kept[i - 1] >> k - 1 & 1:
                i -= 1
            else:
                i, k = i - 1, k - 1
                found.append((i, k))
        found.reverse()
    return head + [(start + i, start + k) for i, k in found] + tail


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    if max(len(a), len(b)) > LONG:
        numbers: dict = {}
        return _common(*([numbers.setdefault(v, len(numbers)) for v in x] for x in (a, b)))
    return [(i + d, k + d) for i, k, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for d in range(n)]


def align(a: list, b: list) -> list:
    """The wrapper of two streams or wrappers."""
    bare = lambda nodes: [x for n in nodes for x in ([(y, True) for y in n[1]] if n[0] == "?" else [(n, False)])]
    x, y = bare(a), bare(b)
    out: list = []

    def put(node, optional):
        if optional and out and out[-1][0] == "?":
            out[-1][1].append(node)
        else:
            out.append(["?", [node], 0] if optional else node)

    i = k = 0
    for p, q in [*_pairs([_key(n) for n, _ in x], [_key(n) for n, _ in y]), (len(x), len(y))]:
        for n, _ in x[i:p] + y[k:q]:
            put(n, True)
        if p < len(x):
            put(_joined(x[p][0], y[q][0]), x[p][1] or y[q][1])
        i, k = p + 1, q + 1
    return squash(out)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def findings(wrapper: list) -> tuple[str, list[str]]:
    """The container with most slot text, and the texts that never changed in LEAST_PAGES unlike pages or more."""
    size: dict[str, int] = {}
    same: list[str] = []

    def walk(nodes, path):
        for n in nodes:
            if n[0] in "?+":
                walk(n[1], path)
            elif n[0] == "#":
                if n[1] is None:
                    for s in path[-3:-1] or path[-1:]:
                        size[s] = size.get(s, 0) + n[2]
                elif len(n[3]) >= LEAST_PAGES:
                    same.append(n[1])
            elif n[1].startswith("/"):
                if n[1][1:] in path:
                    del path[len(path) - 1 - path[::-1].index(n[1][1:]) :]
            else:
                path.append(n[1])

    walk(wrapper, [])
    best = max(size, key=lambda s: (size[s], s), default="")
    return best, list(dict.fromkeys(same))


def _infer(batches):
    """Wrappers for each batch and host: of the pages without a main element, and of the main elements of the others."""
    for b in batches:
        wrappers: dict[tuple[str, bool], tuple[list, set]] = {}
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = list(blocks(html or ""))
            if not found:
                continue
            main = story(found)
            tokens = squash(stream(main or found))
            key, at = _hash(json.dumps(tokens)), (host_of(url), bool(main))
            known, seen = wrappers.get(at, (None, set()))
            if key not in seen:
                seen.add(key)
                tokens = marked(tokens, key)
                wrappers[at] = (tokens if known is None else align(known, tokens), seen)
        yield pa.RecordBatch.from_pylist([{"host": h, "inside": i, "salt": int(min(s), 16) % SALTS, "wrapper": json.dumps(w)} for (h, i), (w, s) in wrappers.items()], schema=pa.schema([("host", pa.string()), ("inside", pa.bool_()), ("salt", pa.int64()), ("wrapper", pa.string())]))


def _met(table: pa.Table) -> list:
    known = None
    for w in sorted(table.column("wrapper").to_pylist()):
        w = json.loads(w)
        known = w if known is None else align(known, w)
    return known


def _merge(table: pa.Table) -> pa.Table:
    return pa.table({"host": table.column("host")[:1], "inside": table.column("inside")[:1], "wrapper": pa.array([json.dumps(_met(table))])})


def _found(table: pa.Table) -> pa.Table:
    best, same = findings(_met(table))
    return pa.table({"host": table.column("host")[:1], "inside": table.column("inside")[:1], "main": pa.array([best]), "template": pa.array([same], pa.list_(pa.string()))})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, main (signature of the main container), template and inside (hashes of unchanging texts of pages without a main
    element, and of main elements)."""
    partial = pages.select("url", "html").mapInArrow(_infer, "host string, inside boolean, salt long, wrapper string")
    salted = partial.groupBy("host", "inside", "salt").applyInArrow(_merge, "host string, inside boolean, wrapper string")
    found = salted.groupBy("host", "inside").applyInArrow(_found, "host string, inside boolean, main string, template array<string>")
    of = lambda c, kind: F.first(F.when(kind, F.col(c)), ignorenulls=True)
    inside = F.col("inside")
    return found.groupBy("host").agg(of("main", ~inside).alias("main"), of("template", ~inside).alias("template"), of("template", inside).alias("inside"))


def main_text(html: str | None, container: str | None = None, template=(), inside=()) -> str:
    found = list(blocks(html or ""))
    main = story(found)
    kept = main or [x for x in found if container and container in x[2]] or found
    drop = set((inside if main else template) or ())
    return "\n".join(t for t, _, _ in kept if not drop or _hash(t) not in drop)


def _extract(batches):
    for b in batches:
        rows = b.to_pydict()
        text = [main_text(*x) for x in zip(rows["html"], rows["main"], rows["template"], rows["inside"], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    slim = pages.select("page_id", "url", "html")
    facts = written(wrappers(slim), "html")
    hosts, texts = facts.agg(F.count("*"), F.sum(F.coalesce(F.size("template"), F.lit(0)) + F.coalesce(F.size("inside"), F.lit(0)))).first()
    if hosts <= SMALL and (texts or 0) <= 10 * SMALL:
        facts = F.broadcast(facts)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "(?s)[/?#].*", ""))
    joined = slim.withColumn("host", host).join(facts, "host", "left").select("page_id", "url", "html", "main", "template", "inside")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
