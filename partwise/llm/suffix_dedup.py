"""Repeated substrings by a difference-cover suffix sort of bounded depth, distributed.

A byte is removed if a MATCH-byte string that covers it also starts earlier (in a document of smaller id, or earlier in the
same one). Suffixes need be told apart by their first MATCH bytes only, so the difference-cover construction is run to that
depth, with hashes of equal length as names:

1. Sample. Starts whose offset modulo MODULUS is in COVER are sampled. COVER is a difference cover: for any two starts some
   shift below MODULUS moves both onto sampled ones, so two equal MATCH-byte strings have equal BLOCK-byte blocks at
   sampled starts, BLOCK = MATCH - MODULUS + 1. The sampled blocks are named, dealt out by name and sorted; those of a name
   of their own are done with.
2. Recurse on the names. A sampled start left over is named again by its block and all that may stand around it in a
   matching string (MODULUS - 1 bytes on either side), dealt out by (name, second name), so that a block that stands
   everywhere in ever other surroundings is spread too, and sorted by (name, second name, place). All but the first place of
   a second name are repeats, with all strings through their block. How many second names a name has is summed up over the
   buckets, an entry a bucket; where it has one only, nothing is left.
3. Merge the rest. Starts near the sampled ones of names with several second names, not yet known as repeats, are those
   whose strings end where texts part. They are named by their whole MATCH bytes and sorted by (name, place): equal ones
   stand side by side, and all but the first are repeats.

What is dealt out is packed: arrays of names and places for each bucket, not a row for each. Within a slice of the input
equal names are folded before they are dealt, so a string that is everywhere costs an entry a slice. Whole copies are set
aside first: all but the first of a class go, whatever the size of the class.

Names are 64-bit hashes, joined to those of the bucket and of the level above; a false match needs all of them to collide.
Two parts of the method are replaced, as the depth is bounded: names are hashes, not ranks (only equality is asked, so equal
blocks need a common name, not an order), and comparing neighbours means comparing names that sorting has put side by side.

Defined cases: null or empty text: nothing removed. Documents of under MATCH bytes keep all. Repeated rows with the same id
and text are the same document and get equal rows. Rows without an id come before all others, and rows of one id with unlike
texts in the order of their texts' hashes. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import parallelism, written

MATCH, MODULUS = 100, 57
# A perfect difference set modulo 57; each residue is a difference of two of them.
COVER = (1, 6, 7, 9, 19, 38, 42, 49)
BLOCK, AROUND = MATCH - MODULUS + 1, MODULUS - 1
SLICE, BUCKET_ENTRIES, SMALL_BYTES = 6 << 20, 1_500_000, 48 << 20
DEALT = "bucket long, rids binary, counts binary, places binary, names binary, seconds binary, known binary"
ROUTED = "home long, kind int, rids binary, counts binary, places binary"
LEVEL = ROUTED + ", names binary"


# ---- places: (rid, pos) in order of rows, positions ascending in each row


def _pack(rid: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    starts = np.concatenate(([0], np.flatnonzero(rid[1:] != rid[:-1]) + 1)) if len(rid) else np.zeros(0, np.int64)
    step = pos.astype(np.int64)
    step[1:] -= pos[:-1]
    step[starts] = pos[starts]
    counts = np.diff(np.concatenate((starts, [len(rid)])))
    planes = step.astype("<u4").view(np.uint8).reshape(-1, 4).T  # upper bytes are mostly zero and compress well
    return rid[starts].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), planes.tobytes()


def _unpack(rids: bytes, counts: bytes, planes: bytes) -> tuple[np.ndarray, np.ndarray]:
    rid, count = np.frombuffer(rids, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
    step = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else np.zeros(0, np.int64)
    total = np.cumsum(step)
    return np.repeat(rid, count), total - np.repeat(total[starts] - step[starts], count)


def _deal(buckets: int, rid, pos, names, seconds, known, by_pair: bool = False) -> pa.RecordBatch:
    """Entries by bucket of their name (its upper half is dealt), or of name and second name (all of it is)."""
    where = ((K.mix(names * K.STEP ^ seconds) if by_pair else names) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        at = order[edge[k] : edge[k + 1]]
        a, b, c = _pack(rid[at], pos[at])
        dealt = names[at].astype("<u8") if by_pair else (names[at] >> np.uint64(32)).astype("<u4")
        rows.append((k, a, b, c, dealt.tobytes(), seconds[at].astype("<u8").tobytes() if seconds is not None else b"", known[at].astype(np.uint8).tobytes() if known is not None else b""))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], DEALT.replace(" long", "").replace(" binary", "").split(", "))


def _gathered(table: pa.Table, with_seconds: bool, with_known: bool):
    rid, pos, names, seconds, known = [], [], [], [], []
    for a, b, c, n, s, k in zip(*(table.column(x).to_pylist() for x in ("rids", "counts", "places", "names", "seconds", "known")), strict=True):
        r, p = _unpack(a, b, c)
        rid.append(r)
        pos.append(p)
        names.append(np.frombuffer(n, "<u4"))
        seconds.append(np.frombuffer(s, "<u8"))
        known.append(np.frombuffer(k, np.uint8))
    return np.concatenate(rid), np.concatenate(pos), np.concatenate(names), np.concatenate(seconds) if with_seconds else None, np.concatenate(known) if with_known else None


def _slices(batches, extra: int = 0):
    """Yields (rids, lengths, offsets, padded bytes, extra columns) of whole rows of about SLICE bytes; AROUND zero bytes
    stand before the first text and MATCH after each."""
    gap = "\0" * (MATCH + AROUND)
    for b in batches:
        for i, j, data, offsets in K.chunks(b.column(1), SLICE, gap):
            padded = np.concatenate((np.zeros(MATCH, np.uint8), data, np.zeros(8, np.uint8)))
            rid = b.column(0).to_numpy(zero_copy_only=False)[i:j]
            yield rid, np.diff(offsets) - len(gap), offsets[:-1] + MATCH, padded, [b.column(2 + k).slice(i, j - i) for k in range(extra)]


def _named(view: np.ndarray, at: np.ndarray, first: int, end: int) -> np.ndarray:
    """Hashes of the bytes from first to end (relative) around each place at."""
    h = np.full(len(at), (end - first) * 0x9E3779B1, dtype=np.uint64)
    for k in [*range(first, end - 7, 8), *([end - 8] if (end - first) % 8 else [])]:
        h = K.mix(h * K.STEP ^ view[at + k])
    return h


def _view(padded: np.ndarray) -> np.ndarray:
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def _sampled(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of every sampled start with a whole block."""
    top = int(lengths.max(initial=0))
    base = np.arange(0, top + MODULUS, MODULUS)
    pattern = (base[:, None] + np.array(sorted(COVER))[None, :]).reshape(-1)
    count = np.searchsorted(pattern, np.maximum(lengths - BLOCK + 1, 0))
    row = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, pattern[within]


def _unlike_rows(rid: np.ndarray) -> np.ndarray:
    """The first of each id in a slice: repeated rows are one document."""
    keep = np.zeros(len(rid), dtype=bool)
    keep[np.unique(rid, return_index=True)[1]] = True
    return keep


def _folded(keys: tuple, rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys then place; whether each in that order begins a group of equal keys, and the group's size."""
    order = np.lexsort((pos, rid, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        same = np.ones(len(order) - 1, dtype=bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        new[1:] = ~same
    begin = np.flatnonzero(new)
    return order, new, np.diff(np.concatenate((begin, [len(order)])))


# ---- 1: sampled blocks; a known entry is repeated within its slice


def _sample(batches, buckets: int):
    for rid, lengths, offsets, padded, _ in _slices(batches):
        lengths = np.where(_unlike_rows(rid), lengths, 0)
        row, pos = _sampled(lengths)
        if not len(row):
            continue
        names = _named(_view(padded), offsets[row] + pos, 0, BLOCK)
        # Equal names are folded: the first goes on, with a mark; the others are known to be repeats and go as places only.
        order = np.argsort(names, kind="stable")
        new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
        begin = np.flatnonzero(new)
        many = np.diff(np.concatenate((begin, [len(order)]))) > 1
        mark = np.zeros(len(names), dtype=np.uint8)
        mark[order[begin[many]]] = 1
        mark[order[~new]] = 2
        keep = np.flatnonzero(mark < 2)
        yield _deal(buckets, rid[row[keep]], pos[keep], names[keep], None, mark[keep])
        rest = np.flatnonzero(mark == 2)
        if len(rest):
            spread = (rid[row[rest]].astype(np.uint64) >> np.uint64(4)) & np.uint64(0xFFFF)
            yield _deal(buckets, rid[row[rest]], pos[rest], spread, None, mark[rest])


def _routed(homes: int, parts: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.Table:
    """Places of each kind, packed by the home of their row: a row for each home and kind, not for each document."""
    rows = []
    for rid, pos, kind in parts:
        home = ((K.mix(rid.astype(np.uint64) ^ K.GOLD)) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((pos, rid, home))
        edge = np.searchsorted(home[order], np.arange(homes + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[k] : edge[k + 1]]
            rows.append((k, kind, *_pack(rid[at], pos[at])))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["home", "kind", "rids", "counts", "places"])


def _home(table: pa.Table, reach: int | None) -> pa.Table:
    """A row for each document: its places of kind 0 (as runs of the starts up to reach before them, if reach is given),
    and those of kind 1."""
    by_kind = []
    for kind in (0, 1):
        own = table.filter(pa.array([k == kind for k in table.column("kind").to_pylist()], pa.bool_()))
        pairs = [_unpack(*x) for x in zip(*(own.column(c).to_pylist() for c in ("rids", "counts", "places")), strict=True)]
        rid = np.concatenate([r for r, _ in pairs] or [np.zeros(0, np.int64)])
        pos = np.concatenate([p for _, p in pairs] or [np.zeros(0, np.int64)])
        order = np.lexsort((pos, rid))
        rid, values = rid[order], pos[order][:, None]
        if kind == 0 and reach is not None and len(rid):
            first, last = np.maximum(values[:, 0] - reach, 0), values[:, 0]
            begin = np.concatenate(([True], (rid[1:] != rid[:-1]) | (first[1:] > last[:-1] + 1)))
            at = np.flatnonzero(begin)
            rid, values = rid[at], np.stack((first[at], last[np.concatenate((at[1:] - 1, [len(last) - 1]))]), axis=1)
        turn = np.concatenate(([0], np.flatnonzero(rid[1:] != rid[:-1]) + 1, [len(rid)])) if len(rid) else [0]
        by_kind.append({int(rid[a]): values[a:b].astype("<i4").tobytes() for a, b in zip(turn[:-1], turn[1:], strict=True)})
    rids = sorted(by_kind[0].keys() | by_kind[1].keys())
    arrays = [pa.array([d.get(r, b"") for r in rids], pa.binary()) for d in by_kind]
    return pa.table([pa.array(rids, pa.int64()), *arrays], names=["rid", "repeats", "edges"])


def _repeated(table: pa.Table, homes: int) -> pa.Table:
    """The places of names with more than one."""
    rid, pos, names, _, known = _gathered(table, False, True)
    told = known == 2
    r, p, n, k = rid[~told], pos[~told], names[~told], known[~told]
    order, new, _ = _folded((n,), r, p)
    twice = np.zeros(len(order), dtype=bool)
    if len(order):
        # A place met again (a repeated row) is no second place.
        other = (r[order][1:] != r[order][:-1]) | (p[order][1:] != p[order][:-1])
        differs = np.concatenate(([False], other & ~new[1:]))
        group = np.cumsum(new) - 1
        many = np.bincount(group, weights=differs) + np.bincount(group, weights=k[order]) > 0
        twice[order] = many[group]
    return _routed(homes, [(np.concatenate((rid[told], r[twice])), np.concatenate((pos[told], p[twice])), 0)])


# ---- 2: second names; 3: whole strings


def _anchors(column) -> list[np.ndarray]:
    return [np.unique(np.frombuffer(x or b"", "<i4")).astype(np.int64) for x in column.to_pylist()]


def _second(batches, buckets: int):
    for rid, lengths, offsets, padded, (places,) in _slices(batches, 1):
        found = _anchors(places)
        keep = _unlike_rows(rid)
        row = np.repeat(np.arange(len(rid)), [len(x) * k for x, k in zip(found, keep, strict=True)])
        if not len(row):
            continue
        pos = np.concatenate([x for x, k in zip(found, keep, strict=True) if k])
        at, view = offsets[row] + pos, _view(padded)
        names = _named(view, at, 0, BLOCK)
        room = np.minimum(pos, AROUND) * 1000 + np.minimum(lengths[row] - pos, MATCH)
        seconds = K.mix(_named(view, at, -AROUND, MATCH) ^ (room.astype(np.uint64) * K.GOLD))
        order, new, _ = _folded((names, seconds), rid[row], pos)
        known = np.zeros(len(row), dtype=np.uint8)
        known[order[~new]] = 1
        yield _deal_two(buckets, rid[row], pos, names, seconds, known, True)


def _deal_two(buckets, rid, pos, names, seconds, known, by_pair: bool = False):
    keep, rest = np.flatnonzero(known == 0), np.flatnonzero(known)
    first = _deal(buckets, rid[keep], pos[keep], names[keep], seconds[keep], known[keep], by_pair)
    if not len(rest):
        return first
    spread = (rid[rest].astype(np.uint64) >> np.uint64(4)) & np.uint64(0xFFFF)  # only to spread them
    second = _deal(buckets, rid[rest], pos[rest], spread, None, known[rest])
    return pa.Table.from_batches([first, second]).combine_chunks().to_batches()[0]


def _sorted(table: pa.Table, kind: str):
    """Entries sorted by (name, second name, place): rids, places, names, which begin a second name, and which are after its
    first place; and the places known as repeats. kind: the type of names."""
    rid, pos, names, seconds, told_rid, told_pos = [], [], [], [], [], []
    for a, b, c, n, s, k in zip(*(table.column(x).to_pylist() for x in ("rids", "counts", "places", "names", "seconds", "known")), strict=True):
        r, p = _unpack(a, b, c)
        if k and k[0]:
            told_rid.append(r)
            told_pos.append(p)
        else:
            rid.append(r)
            pos.append(p)
            names.append(np.frombuffer(n, kind))
            seconds.append(np.frombuffer(s, "<u8"))
    none = [np.zeros(0, np.int64)]
    r, p = np.concatenate(rid or none), np.concatenate(pos or none)
    n, s = np.concatenate(names or [np.zeros(0, kind)]), np.concatenate(seconds or [np.zeros(0, np.uint64)])
    order, new, sizes = _folded((n, s), r, p)
    r, p, n = r[order], p[order], n[order]
    # A place met again (a repeated row) is not after itself.
    first_r, first_p = (np.repeat(x[new], sizes) for x in (r, p)) if len(order) else (r, p)
    repeat = ~new & ~((r == first_r) & (p == first_p))
    return r, p, n, new, repeat, np.concatenate([*told_rid, r[repeat]]) if told_rid else r[repeat], np.concatenate([*told_pos, p[repeat]]) if told_pos else p[repeat]


def _told(table: pa.Table, homes: int) -> pa.Table:
    """The places known as repeats (kind 0)."""
    *_, rid, pos = _sorted(table, "<u4")
    return _routed(homes, [(rid, pos, 0)])


def _level(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["home", "kind", "rids", "counts", "places", "names"])


def _paired(table: pa.Table, homes: int) -> pa.Table:
    """Of a bucket of (name, second name): the places known as repeats (kind 0, by their home); the first place of each second
    name with the name (kind 2, here); and how many second names a name has here (kind 3, by the name)."""
    r, p, n, new, _, rid, pos = _sorted(table, "<u8")
    bucket = int(table.column("bucket")[0].as_py())
    rows = [(*x, b"") for x in zip(*(_routed(homes, [(rid, pos, 0)]).column(c).to_pylist() for c in ("home", "kind", "rids", "counts", "places")), strict=True)]
    r, p, n = r[new], p[new], n[new]
    if len(n):
        order = np.lexsort((p, r))
        rows.append((bucket, 2, *_pack(r[order], p[order]), n[order].tobytes()))
        own, many = np.unique(n, return_counts=True)
        where = (own % np.uint64(homes)).astype(np.int64)
        for k in np.unique(where).tolist():
            at = where == k
            rows.append((k, 3, np.int64(bucket).tobytes(), np.minimum(many[at], 2).astype(np.uint8).tobytes(), b"", own[at].tobytes()))
    return _level(rows)


def _several(table: pa.Table) -> pa.Table:
    """Of a bucket of names: those with several second names in all, for each bucket that has one (kind 4)."""
    parts = [(np.frombuffer(b, "<i8")[0], np.frombuffer(c, np.uint8), np.frombuffer(n, "<u8")) for b, c, n in zip(*(table.column(x).to_pylist() for x in ("rids", "counts", "names")), strict=True)]
    names, at = np.unique(np.concatenate([n for _, _, n in parts]), return_inverse=True)
    several = np.bincount(at, weights=np.concatenate([c for _, c, _ in parts])) > 1
    rows, start = [], 0
    for bucket, _, n in parts:
        found = n[several[at[start : start + len(n)]]]
        start += len(n)
        if len(found):
            rows.append((int(bucket), 4, b"", b"", b"", found.tobytes()))
    return _level(rows)


def _edges(table: pa.Table, homes: int) -> pa.Table:
    """Of a bucket of (name, second name): the first places of second names in names with several (kind 1, by their home)."""
    first, names = [], [np.zeros(0, np.uint64)]
    for kind, a, b, c, n in zip(*(table.column(x).to_pylist() for x in ("kind", "rids", "counts", "places", "names")), strict=True):
        if kind == 2:
            first.append((*_unpack(a, b, c), np.frombuffer(n, "<u8")))
        else:
            names.append(np.frombuffer(n, "<u8"))
    if not first:
        return _routed(homes, [])
    r, p, n = (np.concatenate(x) for x in zip(*first, strict=True))
    at = np.isin(n, np.concatenate(names))
    return _routed(homes, [(r[at], p[at], 1)])


def _spread(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which starts of a text of n bytes are in a run from first to last."""
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return (np.cumsum(edge)[: max(n - MATCH + 1, 0)]) > 0


def _marked(n: int, runs: bytes | None) -> np.ndarray:
    r = np.frombuffer(runs or b"", "<i4").reshape(-1, 2).astype(np.int64)
    return _spread(n, r[:, 0], r[:, 1])


def _turns(mask: np.ndarray) -> np.ndarray:
    m = np.concatenate(([False], mask, [False]))
    t = np.flatnonzero(m[1:] != m[:-1]).reshape(-1, 2)
    t[:, 1] -= 1
    return t


def _strings(batches, buckets: int):
    """Starts near edges that are not known as repeats, named whole."""
    for rid, lengths, offsets, padded, (known, edges) in _slices(batches, 2):
        repeats, near = known.to_pylist(), _anchors(edges)
        keep = _unlike_rows(rid)
        rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, n in enumerate(lengths.tolist()):
            if keep[k] and len(near[k]):
                at = np.flatnonzero(_spread(n, np.maximum(near[k] - AROUND, 0), near[k]) & ~_marked(n, repeats[k]))
                rows.append(np.full(len(at), k))
                starts.append(at)
        row, pos = np.concatenate(rows), np.concatenate(starts)
        if row.size:
            view = _view(padded)
            names = _named(view, offsets[row] + pos, 0, MATCH)
            seconds = K.mix(names * K.C2 ^ view[offsets[row] + pos + 45])
            order, new, _ = _folded((names, seconds), rid[row], pos)
            told = np.zeros(len(row), dtype=np.uint8)
            told[order[~new]] = 1
            yield _deal_two(buckets, rid[row], pos, names, seconds, told)


# ---- the whole


def _row(text: str | None, repeats: bytes | None, found: bytes | None, copy: bool) -> tuple[int, int, int, str]:
    """repeats, found: runs of starts of repeats, by second names and by whole strings."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if copy and n >= MATCH:
        return n, n, 1, hashlib.sha256(b"").hexdigest()
    if copy or not (repeats or found):
        return n, 0, 0, hashlib.sha256(data).hexdigest()
    starts = _marked(n, repeats) | _marked(n, found)
    edge = np.zeros(n + 1, dtype=np.int32)
    turns = _turns(starts)
    edge[turns[:, 0]] += 1
    np.add.at(edge, turns[:, 1] + MATCH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone]
    return n, int(gone.sum()), len(_turns(gone)), hashlib.sha256(kept.tobytes()).hexdigest()


def _results(batches):
    for b in batches:
        texts, repeats, found, copy = (b.column(k) for k in (1, 2, 3, 4))
        rows = [_row(t.as_py(), r.as_py(), f.as_py(), bool(c.as_py())) for t, r, f, c in zip(texts, repeats, found, copy, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _beside(df: DataFrame, size) -> DataFrame:
    """df as the smaller side of a join: sent to all tasks only if its rows come to at most SMALL_BYTES."""
    total = df.agg(F.coalesce(F.sum(size + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= SMALL_BYTES else df.hint("shuffle_hash")


def _numbered(documents: DataFrame) -> DataFrame:
    """doc_id, text, rid, digest; rid orders the documents. It is doc_id where that tells the texts apart."""
    base = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    texts = written(base.select(F.col("doc_id").cast("long").alias("id"), "digest").distinct(), "suffix")
    if not texts.agg((F.count("*") - F.count_distinct("id"))).first()[0]:
        return base.withColumn("rid", F.col("doc_id").cast("long"))
    # Numbers that rise from partition to partition of sorted rows, and within each.
    ranked = texts.orderBy(F.col("id").asc_nulls_first(), "digest").withColumn("rid", F.monotonically_increasing_id())
    ranked = written(ranked, "suffix").withColumnRenamed("digest", "d")
    return base.join(ranked, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).drop("id", "d")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    spark = documents.sparkSession
    docs = _numbered(documents)
    sized = docs.select("rid", "digest", F.octet_length("text").cast("long").alias("n"))
    classes = written(sized.groupBy("digest", "n").agg(F.min("rid").alias("first"), F.count_distinct("rid").alias("copies")), "suffix")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = len(COVER) / MODULUS
    buckets = int(max(parallelism(spark), total * share // BUCKET_ENTRIES))
    alike = classes.where("copies > 1").select("digest", "n", "first")
    copies = sized.join(_beside(alike, F.lit(48)), ["digest", "n"]).where("rid != first").select("rid").distinct()
    copies = written(copies, "suffix")
    original = docs.select("rid", "text").join(_beside(copies, F.lit(8)), "rid", "left_anti")

    def homed(routed: DataFrame, reach: int | None = None) -> DataFrame:
        """Places taken home to their documents."""

        def by_home(table: pa.Table) -> pa.Table:
            return _home(table, reach)

        return routed.groupBy("home").applyInArrow(by_home, "rid long, repeats binary, edges binary")

    def settled(dealt: DataFrame, sort, schema: str = ROUTED, key: str = "bucket") -> DataFrame:
        """Entries sorted by bucket, and the places found."""

        def by_bucket(table: pa.Table) -> pa.Table:
            return sort(table, buckets)

        return dealt.groupBy(key).applyInArrow(by_bucket, schema)

    sampled = original.mapInArrow(lambda b: _sample(b, buckets), DEALT)
    places = written(homed(settled(sampled, _repeated)).select("rid", F.col("repeats").alias("places")), "suffix")
    texts = original.join(_beside(places.select("rid"), F.lit(8)), "rid", "left_semi").join(places.hint("shuffle_hash"), "rid")
    texts = written(texts, "suffix")
    second = texts.select("rid", "text", "places").mapInArrow(lambda b: _second(b, buckets), DEALT)
    level = written(settled(second, _paired, LEVEL), "suffix")
    several = level.where("kind = 3").groupBy("home").applyInArrow(_several, LEVEL)
    edges = settled(level.where("kind = 2").unionByName(several), _edges, ROUTED, "home")
    marks = written(homed(level.where("kind = 0").drop("names").unionByName(edges), AROUND), "suffix")
    near = marks.where(F.octet_length("edges") > 0)
    third = texts.select("rid", "text").join(_beside(near, F.octet_length("repeats") + F.octet_length("edges")), "rid").mapInArrow(lambda b: _strings(b, buckets), DEALT)
    found = homed(settled(third, _told), 0).select("rid", F.col("repeats").alias("found"))
    facts = marks.where(F.octet_length("repeats") > 0).select("rid", "repeats").join(found.where(F.octet_length("found") > 0), "rid", "full").withColumn("copy", F.lit(False))
    nothing = F.lit(None).cast("binary")
    facts = written(facts.unionByName(copies.select("rid", nothing.alias("repeats"), nothing.alias("found"), F.lit(True).alias("copy"))), "suffix")
    size = F.coalesce(F.octet_length("repeats"), F.lit(0)) + F.coalesce(F.octet_length("found"), F.lit(0))
    kind = documents.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "rid", "text").join(_beside(facts, size), "rid", "left").select("doc_id", "text", "repeats", "found", "copy")
    return joined.mapInArrow(_results, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
