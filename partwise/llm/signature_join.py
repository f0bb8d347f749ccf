"""Jaccard join on word shingles with signature trees.

Two documents link when 100 * |A and B| >= PERCENT * |A or B| for their sets of distinct SHINGLE-word shingles.

1. Each text is turned into the hashes of its shingles. Documents with equal sets are one vertex from then on (a group of
   copies of any size is folded before it is shuffled).
2. Near copies are tied to verified representatives: vertices that share a min-hash form stars around the least of them, in
   slices of FOLD members that each get the representative's text, and every member is compared with it exactly. What is
   verified goes on as one star; the representatives meet again by the next of the KEYS min-hashes. A star is a set of
   vertices known to be in one component. It saves comparisons and never replaces one: members stay in the search below.
3. A global order of tokens puts common ones last: those found often in some partition are counted everywhere and the
   ORDERED most common ones, a bounded table, are ranked; all others go by hash. Any fixed order is exact; this one keeps
   shared passages out of what is compared.
4. Linked sets share k of their first n - ceil(0.8 n) + k tokens of the order (the prefix filter, k being 1 + MORE percent
   of the smaller set), so only these are dealt out. Of tokens that at most FEW vertices have, the pairs are counted; pairs
   that cannot come to k, even if they shared all common tokens that either has, are no candidates. Vertices that have k or
   more common tokens, and so may link by these alone, are tied by each of them in chains by size. The connected components
   of the ties between different stars (candidate groups) hold every link between different stars.
5. A group is split into parts of FOLD members or more, SPREAD of them, and more once these would come to over BLOCK words:
   stars of FOLD members or more are units of their own, the rest is split by size (if over BLOCK words), then by hash; a star's
   parts are about as large as the rest that they are held against. Each pair of
   blocks whose sizes can link is one task, but for pairs within a star. In it, sets are leaves of signature trees: a node
   has the OR of its leaves' token bitmaps, its size range and its slack (the most tokens of a leaf that bits hide). Two
   trees are traversed together: a pair of nodes is pruned when its sizes cannot link, when common bits + slack, the most
   overlap possible, is too little, or when all of its leaves are in one component already. Leaf pairs left over are compared
   exactly.
6. The links kept are a forest (at most one per vertex and block pair); the components of the stars by them are the result.

So a group of near copies, whatever its size, costs about its own size, in slices. Vertices of a group that no star takes up
cost the pairs of their blocks.

Defined cases: null or empty text and texts of blanks: no shingles, component of its own. Fewer than SHINGLE words: the
whole sequence is the one shingle. Repeated rows each get a row. Where ids are null or repeat, every row is a document of its
own: the component is the least id in it, null where it has none, and rows without words have their own id. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import beside, parallelism, written

SHINGLE, PERCENT = 5, 80
MORE, FEW = 10, 8
ORDERED, LOCAL_LEAST, COMMON, HELD = 1 << 17, 2, 6, 1 << 21
BLOCK = 2_000_000
FOLD, FOLD_WORDS, SPREAD, KEYS = 256, 500_000, 8, ("low1", "low2", "high1")
FAN, BITS_PER_TOKEN, MOST_BITS = 16, 4, 1 << 16
TOP = np.uint64(1 << 63)


def shingle_sets(column, n: int = SHINGLE):
    """Yields for each text the sorted distinct hashes of its shingles."""
    lower, wordy = K.lower_table(), K.blank_separated()
    for i, j, data, offsets in K.chunks(column):
        data = lower[data]
        starts, ends = K.word_spans(data, wordy)
        h = K.word_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        grams = K.gram_hashes(h, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield K.gram_hashes(h[a:b], b - a) ^ K.GOLD
            else:
                yield np.zeros(0, np.uint64)


def _needed(n):
    """How many tokens of their prefixes sets must share, by the smaller set's size."""
    return 1 + n * MORE // 100


def _prefix(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + _needed(n) if n else 0


def common_tokens(documents: DataFrame) -> np.ndarray:
    """The ORDERED most common tokens, by count; counted everywhere where some partition has LOCAL_LEAST of them."""

    def count(batches):
        held, size = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL_LEAST
            return pa.RecordBatch.from_arrays([pa.array(K.signed(tokens[keep])), pa.array(n[keep])], ["token", "n"])

        for b in batches:
            for s in shingle_sets(b.column(0)):
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = documents.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(ORDERED).toPandas()
    return top["token"].to_numpy(dtype=np.int64)[::-1].copy().view(np.uint64)  # the rarest of them first


class Order:
    """The global order of tokens, as one key for each: hashes, then the common ones by rank."""

    def __init__(self, common: np.ndarray):
        self.at = np.argsort(common)
        self.sorted = common[self.at]
        self.screen = np.zeros(1 << 20, dtype=bool)
        self.screen[common & np.uint64((1 << 20) - 1)] = True

    def keys(self, s: np.ndarray) -> np.ndarray:
        key = s >> np.uint64(1)
        maybe = np.flatnonzero(self.screen[s & np.uint64((1 << 20) - 1)])
        if maybe.size:
            k = np.minimum(np.searchsorted(self.sorted, s[maybe]), len(self.sorted) - 1)
            hit = self.sorted[k] == s[maybe]
            key[maybe[hit]] = TOP | self.at[k[hit]].astype(np.uint64)
        return key


def fingerprints(documents: DataFrame) -> DataFrame:
    """vertex, n_shingles, a 128-bit fingerprint of the set, and KEYS: the least and the largest of its tokens' hashes."""
    none = np.zeros(1, np.uint64)

    def each(batches):
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(1)):
                one, two = K.mix(s ^ K.GOLD), K.mix(s ^ K.C1)
                x, y = (one, two) if len(s) else (none, none)
                rows.append((len(s), one.sum(dtype=np.uint64), two.sum(dtype=np.uint64), x.min(), y.min(), x.max()))
            n, *others = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(K.signed(np.array(x, np.uint64))) for x in others)], ["vertex", "n_shingles", "one", "two", *KEYS])

    return documents.select("vertex", "text").mapInArrow(each, "vertex long, n_shingles long, one long, two long, " + ", ".join(f"{k} long" for k in KEYS))


def _prefixes(batches, order: Order, buckets: int):
    """Prefix tokens with their documents and sizes, packed by bucket of the token."""
    for b in batches:
        tokens, size = [], []
        for s in shingle_sets(b.column(1)):
            p, keys = _prefix(len(s)), order.keys(s)
            tokens.append(np.partition(keys, p - 1)[:p] if 0 < p < len(keys) else keys)
            size.append(len(s))
        if not tokens:
            continue
        many = np.array([len(x) for x in tokens])
        tokens, vertex, size = np.concatenate(tokens), np.repeat(b.column(0).to_numpy(zero_copy_only=False), many), np.repeat(np.array(size), many)
        where = (K.mix(tokens.copy()) % np.uint64(buckets)).astype(np.int64)
        at = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[at], np.arange(buckets + 1))
        rows = [(k, at[edges[k] : edges[k + 1]]) for k in range(buckets) if edges[k + 1] > edges[k]]
        cols = [pa.array([k for k, _ in rows], pa.int64())] + [pa.array([x[i].astype(t).tobytes() for _, i in rows], pa.binary()) for x, t in ((tokens, np.uint64), (vertex, np.int64), (size, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "tokens", "vertices", "sizes"])


def _sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, need: np.ndarray):
    """n summed by (x, y), which comes with its need."""
    order = np.lexsort((y, x))
    x, y, n, need = x[order], y[order], n[order], need[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    return x[at], y[at], np.add.reduceat(n, at) if len(at) else n, need[at]


def _packed(rows: list, keys: np.ndarray, n: int, kind: int, columns: list[tuple[np.ndarray, type]]) -> None:
    """Adds a row (key, kind, arrays) for each key below n that has entries."""
    order = np.argsort(keys, kind="stable")
    edge = np.searchsorted(keys[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        at = order[edge[k] : edge[k + 1]]
        rows.append((k, kind, *(c[at].astype(t).tobytes() for c, t in columns)))


def _home(vertices: np.ndarray, homes: int) -> np.ndarray:
    return (K.mix(vertices.astype(np.uint64) ^ K.GOLD) % np.uint64(homes)).astype(np.int64)


PACKED = "home long, kind int, x binary, y binary, n binary, need binary"


def _shared(table: pa.Table, homes: int) -> pa.Table:
    """What sharing a token says. Of tokens that at most FEW vertices have: the pairs of vertices whose sizes can link, how
    many they share and need, at the home of the one (kind 0) and of the other (kind 1). Of tokens that more have: vertex,
    token and size, at the vertex's home (kind 2)."""
    tokens, vertices, sizes = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("tokens", np.uint64), ("vertices", np.int64), ("sizes", np.int32)))
    order = np.lexsort((vertices, sizes, tokens))
    t, v, s = tokens[order], vertices[order], sizes[order].astype(np.int64)
    begin = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
    group = np.repeat(np.diff(begin), np.diff(begin))
    a, b, need = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(FEW, len(t))):
        at = np.flatnonzero((t[d:] == t[:-d]) & (group[d:] <= FEW) & (v[d:] != v[:-d]) & (100 * s[:-d] >= PERCENT * s[d:]))
        a.append(np.minimum(v[at], v[at + d]))
        b.append(np.maximum(v[at], v[at + d]))
        need.append(_needed(s[at]))
    a, b, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
    a, b, n, need = _sums(a, b, np.ones(len(a), np.int64), need)
    many = np.flatnonzero(group > FEW)
    rows: list = []
    for kind, own in enumerate((a, b)):
        _packed(rows, _home(own, homes), homes, kind, [(a, np.int64), (b, np.int64), (n, np.int32), (need, np.int32)])
    _packed(rows, _home(v[many], homes), homes, 2, [(v[many], np.int64), (t[many].view(np.int64), np.int64), (s[many], np.int32), (s[many], np.int32)])
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["home", "kind", "x", "y", "n", "need"])


VOTES = "a long, b long, bucket long, tokens binary, vertices binary, sizes binary"


def _votes(table: pa.Table, buckets: int) -> pa.Table:
    """Each end's vote for a pair: that what they share, with all the common tokens of this end, may be enough. And the
    common tokens of vertices that have enough of them to link by these alone, packed by bucket."""
    kinds, parts = np.array(table.column("kind").to_pylist()), []
    for kind in range(3):
        own = table.filter(pa.array(kinds == kind))
        parts.append([np.frombuffer(b"".join(own.column(c).to_pylist()), t).astype(np.int64) for c, t in (("x", np.int64), ("y", np.int64), ("n", np.int32), ("need", np.int32))])
    v, t, s, _ = parts[2]
    known, at, many = np.unique(v, return_inverse=True, return_counts=True)
    out_a, out_b = [], []
    for kind in (0, 1):
        a, b, n, need = _sums(*parts[kind])
        if len(known):
            own = (a, b)[kind]
            k = np.minimum(np.searchsorted(known, own), len(known) - 1)
            n = n + np.where(known[k] == own, many[k], 0)
        out_a.append(a[n >= need])
        out_b.append(b[n >= need])
    able = many[at] >= _needed((PERCENT * s + 99) // 100) if len(v) else np.zeros(0, dtype=bool)
    rows: list = []
    t = t[able].view(np.uint64)
    where = (K.mix(t.copy()) % np.uint64(buckets)).astype(np.int64)
    _packed(rows, where, buckets, 0, [(t, np.uint64), (v[able], np.int64), (s[able], np.int32)])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    blank = [None] * len(rows)
    own = list(zip(*rows, strict=True)) if rows else [[]] * 5
    votes = [pa.array(a), pa.array(b), *[pa.nulls(len(a), k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]]
    packs = [pa.array(blank, pa.int64()), pa.array(blank, pa.int64()), pa.array(own[0], pa.int64()), *(pa.array(c, pa.binary()) for c in own[2:])]
    names = ["a", "b", "bucket", "tokens", "vertices", "sizes"]
    return pa.concat_tables([pa.table(votes, names=names), pa.table(packs, names=names)])


def _chained(table: pa.Table) -> pa.Table:
    """Ties between neighbours, in order of size, of the vertices that have a common token."""
    tokens, vertices, sizes = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("tokens", np.uint64), ("vertices", np.int64), ("sizes", np.int32)))
    order = np.lexsort((vertices, sizes, tokens))
    t, v, s = tokens[order], vertices[order], sizes[order].astype(np.int64)
    tie = np.flatnonzero((t[1:] == t[:-1]) & (v[1:] != v[:-1]) & (100 * s[:-1] >= PERCENT * s[1:]))
    one = np.ones(len(tie), np.int64)
    a, b, _, _ = _sums(np.minimum(v[tie], v[tie + 1]), np.maximum(v[tie], v[tie + 1]), one, one)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Tree:
    """A signature tree: levels of nodes, from leaves up, FAN to one; each with OR-ed bitmap, sizes and slack."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for k, s in enumerate(sets):
            at = (s % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slack = n - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def _possible(x, i: np.ndarray, y, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of level x and nodes j of level y, all with all, may hold a link."""
    low_x, high_x, low_y, high_y = x[1][i][:, None], x[2][i][:, None], y[1][j][None, :], y[2][j][None, :]
    fit = (100 * high_x >= PERCENT * low_y) & (100 * high_y >= PERCENT * low_x)
    common = np.bitwise_count(x[0][i][:, None, :] & y[0][j][None, :, :]).sum(axis=2, dtype=np.int64)
    most = common + np.minimum(x[3][i][:, None], y[3][j][None, :])
    return fit & ((100 + PERCENT) * most >= PERCENT * (low_x + low_y))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, stars: dict[int, int] | None = None):
    """A spanning forest of the links within left (right: None), or of those between left and right; stars: by vertex what
    is known to be in one component."""
    ids = list(dict.fromkeys(v for v, _ in left + (right or [])))
    number = {v: k for k, v in enumerate(ids)}
    forest, found, centre = Forest(len(ids)), [], {}
    for v, star in (stars or {}).items():
        forest.join(centre.setdefault(star, number[v]), number[v])
    sizes = [len(s) for _, s in left + (right or [])]
    if not sizes:
        return found
    bits = 64
    while bits < min(MOST_BITS, BITS_PER_TOKEN * int(np.median(sizes))):
        bits *= 2
    # Like sets stand together: by least hash, so that nodes' bitmaps stay sparse.
    sides = [sorted(side, key=lambda x: (int(x[1][0]) if len(x[1]) else 0, len(x[1]))) for side in (left, right) if side is not None]
    trees = [Tree([s for _, s in side], bits) for side in sides]
    owners = [[number[v] for v, _ in side] for side in sides]
    x, y, own_x, own_y, set_x, set_y = trees[0], trees[-1], owners[0], owners[-1], sides[0], sides[-1]
    same = right is None

    def settled(level: int, i: int, j: int) -> bool:
        """All leaves below both nodes are in one component."""
        span = FAN**level
        a, b = own_x[i * span : (i + 1) * span], own_y[j * span : (j + 1) * span]
        r = forest.root(a[0])
        return all(forest.root(k) == r for k in a) and all(forest.root(k) == r for k in b)

    top_x, top_y = len(x.levels) - 1, len(y.levels) - 1
    top = max(top_x, top_y)
    for t in (x, y):
        while len(t.levels) - 1 < top:
            t.levels.append(t.levels[-1])
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            if forest.root(own_x[i]) != forest.root(own_y[j]) and linked(set_x[i][1], set_y[j][1]):
                forest.join(own_x[i], own_y[j])
                found.append((ids[own_x[i]], ids[own_y[j]]))
            continue
        if settled(level, i, j):
            continue
        below_x, below_y = x.levels[level - 1], y.levels[level - 1]
        kids_x = np.arange(i * FAN, min((i + 1) * FAN, len(below_x[0])))
        kids_y = np.arange(j * FAN, min((j + 1) * FAN, len(below_y[0])))
        ok = _possible(below_x, kids_x, below_y, kids_y)
        for p, q in zip(*np.nonzero(ok), strict=True):
            a, b = int(kids_x[p]), int(kids_y[q])
            if not same or a <= b:
                stack.append((level - 1, a, b))
    return found


def _compared(table: pa.Table) -> pa.Table:
    """The links of one pair of blocks."""
    vertices, sides = table.column("vertex").to_pylist(), table.column("side").to_pylist()
    sets = list(shingle_sets(table.column("text")))
    left = [(v, s) for v, s, k in zip(vertices, sets, sides, strict=True) if k == 0]
    right = [(v, s) for v, s, k in zip(vertices, sets, sides, strict=True) if k == 1]
    pairs = links(left, right if right else None, dict(zip(vertices, table.column("star").to_pylist(), strict=True)))
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _verified(table: pa.Table) -> pa.Table:
    """The members of a slice of a star that link with its representative."""
    centre, vertices = table.column("rep")[0].as_py(), table.column("vertex").to_pylist()
    sets = dict(zip(vertices, shingle_sets(table.column("text")), strict=True))
    found = [v for v, s in sets.items() if v != centre and linked(s, sets[centre])]
    return pa.table({"vertex": pa.array(found, pa.int64()), "rep": pa.array([centre] * len(found), pa.int64())})


def stars(texts: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex, star for every vertex: the verified representative that it hangs on, itself for most."""
    known = vertices.select("vertex", F.col("vertex").alias("star"))
    left = vertices.select("vertex", "n_shingles", *KEYS)
    for key in KEYS:
        slices = F.ceil(F.greatest(F.count("*") / FOLD, F.sum("n_shingles") / FOLD_WORDS)).cast("long")
        hubs = left.groupBy(key).agg(F.min("vertex").alias("rep"), F.count("*").alias("n"), slices.alias("slices")).where("n > 1")
        members = left.join(beside(written(hubs, "jaccard")), key).select("vertex", "rep", "slices")
        own = F.when(F.col("vertex") == F.col("rep"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vertex"), "slices")))
        dealt = written(members.select("vertex", "rep", F.explode(own).alias("slice")), "jaccard")
        folds = dealt.join(texts, "vertex") if dealt.limit(1_000_001).count() > 1_000_000 else texts.join(F.broadcast(dealt), "vertex")
        folds = written(folds.select("rep", "slice", "vertex", "text").groupBy("rep", "slice").applyInArrow(_verified, "vertex long, rep long"), "jaccard")
        side = beside(folds)
        left = written(left.join(side, "vertex", "left_anti"), "jaccard")
        hang = beside(folds.select(F.col("vertex").alias("star"), "rep"))
        known = written(known.join(hang, "star", "left").select("vertex", F.coalesce("rep", "star").alias("star")), "jaccard")
    return known


def _units(sized: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(the vertices with unit and part, the units). A unit is a star of FOLD members or more in a group of over block words
    or FOLD vertices, or the rest of a group, by size in a group of over block words; a part is what a task reads of it."""
    by_star = written(sized.groupBy("grp", "star").agg(F.count("*").alias("__members"), F.sum("n_shingles").alias("__star_words")), "jaccard")
    rest = F.col("__members") < FOLD
    total = by_star.groupBy("grp").agg(F.sum("__members").alias("__rows"), F.sum("__star_words").alias("__total"), F.sum(F.when(rest, F.col("__star_words")).otherwise(0)).alias("__rest"), F.sum(F.when(rest, F.col("__members")).otherwise(0)).alias("__rest_rows"))
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("string")
    split, pure = F.col("__total") > block, (F.col("__members") >= FOLD) & ((F.col("__rows") > 2 * FOLD) | (F.col("__total") > block))
    unit = F.when(pure, F.concat(F.lit("star "), F.col("star").cast("string"))).when(split, F.concat(F.lit("size "), step)).otherwise(F.lit("all"))
    placed = sized.join(beside(by_star), ["grp", "star"]).join(beside(total), "grp").withColumns({"unit": unit, "__pure": pure})
    # FOLD members at least to a part, then SPREAD parts to a unit, until these come to block words.
    slice_of = lambda words, rows: F.least(F.lit(block), F.greatest(F.max(words * FOLD / F.greatest(rows, F.lit(1))), F.max(words) / SPREAD))
    own, others = slice_of(F.col("__star_words"), F.col("__members")), slice_of(F.col("__rest"), F.col("__rest_rows"))
    words = F.sum("n_shingles")
    units = placed.groupBy("grp", "unit").agg(
        F.min("n_shingles").alias("low"),
        F.max("n_shingles").alias("high"),
        (F.min("star") == F.max("star")).alias("settled"),
        F.greatest(F.ceil(words / F.when(F.first("__pure"), F.greatest(F.least(F.max("__rest"), F.lit(block)), own)).otherwise(F.greatest(others, F.lit(1)))), F.lit(1)).cast("int").alias("parts"),
    )
    units = written(units, "jaccard")
    blocked = placed.join(beside(units.select("grp", "unit", "parts")), ["grp", "unit"]).select("vertex", "star", "grp", "unit", F.pmod(F.xxhash64("vertex"), "parts").cast("int").alias("part"))
    return blocked, units


def _uses(units: DataFrame) -> DataFrame:
    """The pairs of parts whose sizes can link and that are not within one star, a row for each part that a pair uses."""
    one = units.select("grp", F.col("unit").alias("u"), F.col("low").alias("l"), F.col("high").alias("h"), F.col("parts").alias("p"), "settled")
    two = units.select("grp", F.col("unit").alias("v"), "low", "high", F.col("parts").alias("q"))
    fit = (F.col("v") >= F.col("u")) & (100 * F.col("h") >= PERCENT * F.col("low")) & (100 * F.col("high") >= PERCENT * F.col("l")) & ~((F.col("u") == F.col("v")) & F.col("settled"))
    pairs = one.join(two, "grp").where(fit).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    pairs = pairs.withColumn("k", F.explode(F.sequence(F.when(F.col("u") == F.col("v"), F.col("i")).otherwise(0), F.col("q") - 1)))
    first, second = F.struct(F.col("u").alias("unit"), F.col("i").alias("part")), F.struct(F.col("v").alias("unit"), F.col("k").alias("part"))
    pairs = pairs.select("grp", first.alias("first"), second.alias("second"))
    ends = F.when(F.col("first") == F.col("second"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    used = pairs.select("grp", "first", "second", F.explode(ends).alias("side"))
    return used.withColumn("block", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second"))).select("grp", "first", "second", "side", "block.*")


def _between(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of vertices as edges of their stars, without those within one."""
    moved = known.where("vertex != star")
    for end in ("a", "b"):
        side = beside(moved.select(F.col("vertex").alias(end), F.col("star").alias("__star")))
        edges = edges.join(side, end, "left").withColumn(end, F.coalesce("__star", end)).drop("__star")
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(texts: DataFrame, block: int) -> DataFrame:
    """vertex, n_shingles, component (the least vertex) for every row of vertex (unique), text."""
    spark = texts.sparkSession
    prints = written(fingerprints(texts), "jaccard")
    # One vertex for each distinct set: the least. The others are left out before anything is dealt.
    vertices = written(prints.where("n_shingles > 0").groupBy("one", "two").agg(F.min("vertex").alias("vertex"), *(F.first(c).alias(c) for c in ("n_shingles", *KEYS))), "jaccard")
    copies = written(prints.join(vertices.select("one", "two", F.col("vertex").alias("__least")), ["one", "two"]).where("vertex != __least").select("vertex"), "jaccard")
    original = texts.join(beside(copies), "vertex", "left_anti").select("vertex", "text")
    known = stars(original, vertices)
    n_tokens = vertices.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * (100 - PERCENT + MORE) // 100
    buckets, order = int(max(parallelism(spark), n_tokens // 500_000)), Order(common_tokens(original))
    dealt = original.mapInArrow(lambda b: _prefixes(b, order, buckets), "bucket long, tokens binary, vertices binary, sizes binary")

    def shared(t: pa.Table) -> pa.Table:
        return _shared(t, buckets)

    def votes(t: pa.Table) -> pa.Table:
        return _votes(t, buckets)

    packed = dealt.groupBy("bucket").applyInArrow(shared, PACKED)
    voted = written(packed.groupBy("home").applyInArrow(votes, VOTES), "jaccard")
    pairs = voted.where("bucket is null").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b")
    ties = pairs.unionByName(voted.where("bucket is not null").drop("a", "b").groupBy("bucket").applyInArrow(_chained, "a long, b long"))
    groups = components(written(_between(ties, known), "jaccard")).select(F.col("node").alias("star"), F.col("component").alias("grp"))
    sized = written(known.join(beside(groups), "star").join(vertices.select("vertex", "n_shingles"), "vertex"), "jaccard")
    blocked, units = _units(sized, block)
    uses = written(_uses(units), "jaccard")
    needed = written(blocked.join(beside(uses.select("grp", "unit", "part").distinct()), ["grp", "unit", "part"], "left_semi"), "jaccard")
    tasks = original.join(beside(needed), "vertex").join(beside(uses), ["grp", "unit", "part"]).select("grp", "first", "second", "side", "vertex", "star", "text")
    found = written(tasks.groupBy("grp", "first", "second").applyInArrow(_compared, "a long, b long"), "jaccard")
    merged = components(written(_between(found, known), "jaccard")).select(F.col("node").alias("star"), "component")
    # A representative is the least of all that hang on it, so the least star of a component is its least vertex.
    joined = known.join(beside(merged), "star", "left").select("vertex", F.coalesce("component", "star").alias("component"))
    by_set = vertices.select("one", "two", "vertex").join(joined, "vertex").select("one", "two", "component")
    return prints.join(by_set, ["one", "two"], "left").select("vertex", "n_shingles", F.coalesce("component", "vertex").alias("component"))


def _keyed(documents: DataFrame) -> tuple[DataFrame, bool]:
    """(documents with a column vertex that tells rows apart, whether it is doc_id)."""
    ids = documents.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return documents.withColumn("vertex", F.col("doc_id").cast("long")), True
    slim = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(slim.withColumn("vertex", F.monotonically_increasing_id()), "jaccard"), False


def jaccard_components(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    rows, plain = _keyed(documents.select("doc_id", "text"))
    classes = _classes(rows.select("vertex", "text"), block)
    if plain:
        return classes.select(F.col("vertex").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    named = written(classes, "jaccard").join(rows.select("vertex", "doc_id"), "vertex")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id")


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the least id (without an id, last)."""
    rows, plain = _keyed(documents)
    classes = written(_classes(rows.select("vertex", "text"), BLOCK), "jaccard")
    if plain:
        gone = written(classes.where("vertex != component").select(F.col("vertex").alias("__gone")), "jaccard")
        return documents.join(beside(gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    named = classes.join(rows.select("vertex", "doc_id"), "vertex")
    kept = named.groupBy("component").agg(F.min_by("vertex", F.struct(F.col("doc_id").isNull(), "doc_id", "vertex")).alias("vertex"))
    return rows.join(written(kept.select("vertex"), "jaccard"), "vertex", "left_semi").select(*(F.col("row")[c].alias(c) for c in documents.columns))
