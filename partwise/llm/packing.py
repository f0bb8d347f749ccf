"""Bounded-space online packing of tokenised documents into sequences of LENGTH tokens.

A document is its token ids and then END. It is cut at every LENGTH ids; its full pieces are sequences of their own, and
its rest goes into one of WINDOWS open windows of its partition: the fullest one in which it fits (best fit), else into a
new one, for which the fullest is closed once WINDOWS are open. The pieces of windows still open at a partition's end are
the leftovers: GROUP partitions' leftovers meet (at most GROUP * WINDOWS windows, whatever the input) and are packed anew,
longest first, best fit. Sequences are padded to LENGTH, except where they end at a power of two.

The ids are those of the tokenizers file of the public byte_bpe_50k vocabulary, encode(text, add_special_tokens=False): the
string of a special token in a text is that token. A text without such a string is encoded with tiktoken from the .tiktoken
file of the same vocabulary, which gives the same ids at a multiple of the speed (the tests hold one against the other); a
text with one goes to the tokenizers file itself. Text is tokenised once: the pieces are written to the shared folder, and
closed and left pieces are read from there. There is no shuffle but that of the leftovers.

Defined cases: null or empty text: the one id END. Repeated rows are packed each. An empty table gives no rows. Pieces carry
doc_id as it is, null too. Other columns are ignored. Sequence ids are unique, not gapless; they follow the input's
partitions.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, WINDOWS, GROUP, END = 1024, 64, 32, 0
VOCABULARY = "byte_bpe_50k"
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(vocabulary: str = VOCABULARY):
    """The vocabulary's encoder, built once in a Python worker."""
    import public_tokenizers
    import tiktoken
    from tiktoken import registry

    key = f"partwise:{vocabulary}"
    if key not in registry.ENCODINGS:
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        registry.ENCODINGS[key] = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[key]


def ids_of(vocabulary: str = VOCABULARY):
    """The function from a text to its ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, whole = encoder(vocabulary), Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return plain.encode_ordinary(text)

    return ids


class Windows:
    """At most most open windows of length tokens; place() returns (window, offset), windows being numbered in order."""

    def __init__(self, length: int = LENGTH, most: int = WINDOWS):
        self.length, self.most, self.open, self.used, self.count = length, most, [], {}, 0

    def full(self) -> tuple[int, int]:
        self.count += 1
        return self.count - 1, 0

    def place(self, n: int) -> tuple[int, int]:
        # open is sorted by (room, window): the first with room enough is the fullest that fits.
        k = bisect_left(self.open, (n, -1))
        if k == len(self.open):
            if len(self.open) >= self.most:
                self.used.pop(self.open.pop(0)[1])
            window, used = self.count, 0
            self.count += 1
        else:
            window = self.open.pop(k)[1]
            used = self.used[window]
        if used + n < self.length:
            self.used[window] = used + n
            insort(self.open, (self.length - used - n, window))
        else:
            self.used.pop(window, None)
        return window, used


def _pieces(batches, length: int, most: int, vocabulary: str):
    """Rows of pieces; window: its number in the partition. Pieces of a window closed later are told by open_after."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encode, windows = ids_of(vocabulary), Windows(length, most)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "part", "left"]
    kinds = (pa.int64(),) * 6

    def batch(ids, rows, part_windows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        left = np.isin(np.asarray(cols[4], dtype=np.int64), part_windows)
        return pa.RecordBatch.from_arrays([ids, *arrays, pa.array(np.full(len(rows), part, np.int64)), pa.array(left)], names)

    waiting: list[tuple] = []  # (doc_id, row) of pieces in open windows
    kind = None
    for b in batches:
        kind = b.column(0).type
        done_ids, done = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
            n = len(ids)
            for start in range(0, n, length):
                m = min(length, n - start)
                window, offset = windows.full() if m == length else windows.place(m)
                row = (start, m, zlib.crc32(ids[start : start + m].tobytes()), n, window, offset)
                if m == length:
                    done_ids.append(doc)
                    done.append(row)
                else:
                    waiting.append((doc, row))
        still = []
        for doc, row in waiting:
            if row[4] in windows.used:
                still.append((doc, row))
            else:
                done_ids.append(doc)
                done.append(row)
        waiting = still
        yield batch(pa.array(done_ids, kind), done, [])
    if waiting:
        yield batch(pa.array([d for d, _ in waiting], kind), [r for _, r in waiting], list(windows.used))


def pack(documents: DataFrame, length: int = LENGTH, windows: int = WINDOWS, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from .shared import written

    columns = documents.select("doc_id", "text")
    kind = columns.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, part long, left boolean"
    pieces = written(columns.mapInArrow(lambda b: _pieces(b, length, windows, vocabulary), schema), "packing")
    plain = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # The upper half of the ids is the partition; leftovers' sequences count down from the top of their group's first one.
    closed = pieces.where("not left").select(*plain, (F.shiftleft(F.col("part"), 32) + F.col("window")).alias("sequence_id"), "offset")

    def merge(table: pa.Table) -> pa.Table:
        n = table.column("length").to_numpy()
        order = np.argsort(-n, kind="stable")
        best = Windows(length, len(n) + 1)
        spot = np.zeros((len(n), 2), dtype=np.int64)
        for k in order.tolist():
            spot[k] = best.place(int(n[k]))
        base = (int(table.column("part")[0].as_py()) // group * group << 32) + (1 << 31)
        out = table.select(plain).append_column("sequence_id", pa.array(spot[:, 0] + base))
        return out.append_column("offset", pa.array(spot[:, 1]))

    left = pieces.where("left").groupBy(F.expr(f"part div {int(group)}")).applyInArrow(merge, f"doc_id {kind}, {FIELDS}")
    return closed.unionByName(left)
