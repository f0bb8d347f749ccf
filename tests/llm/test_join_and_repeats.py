import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from partwise.llm import signature_join as J
from partwise.llm import suffix_dedup as D
from partwise.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(pairs):
    sets, up = {i: shingles(t) for i, t in pairs}, {i: i for i, _ in pairs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def near_copies(seed=3, n=160):
    rng = random.Random(seed)
    passage = [f"shared{k}" for k in range(40)]
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        out.append((i, rng.choice([" ", "  ", "\n"]).join(words).title() if rng.random() < 0.2 else " ".join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "z " * 3000)]


@pytest.mark.parametrize("block", [J.BLOCK, 700])  # the small one splits groups into pairs of blocks
def test_components_against_brute_force(docs, block):
    pairs = near_copies()
    got = sorted(tuple(r) for r in J.jaccard_components(docs(pairs, clash=True), block).collect())
    assert got == brute_components(pairs)


def test_join_of_odd_rows(docs):
    text = " ".join(f"w{k}" for k in range(30))
    got = J.jaccard_components(docs([(5, text), (5, text), (9, text), (None, text), (None, "other"), (7, None)])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(5, 5), (5, 5), (9, 5), (None, 5), (None, None), (7, 7)], key=str)
    assert J.jaccard_components(docs([])).count() == 0
    # One id with unlike texts is two documents; rows without an id go too if they are copies.
    unlike = "all other words here for once"
    kept = J.one_of_each_group(docs([(5, text), (5, text), (5, unlike), (9, text), (None, "other"), (None, text), (7, None)], clash=True))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("5", text), ("5", unlike), ("None", "other"), ("7", "")]) and "vertex" in kept.columns


def test_a_hot_group_is_read_in_slices(docs, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    pairs = []
    for i in range(400):  # near copies of one text, a chain away from it, and texts that share a passage
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(60)] = f"x{rng.randint(0, 999)}"
        pairs.append((i, " ".join(w)))
    pairs += [(1000 + i, " ".join(base[:20] + [f"u{i}v{k}" for k in range(rng.randint(1, 60))])) for i in range(60)]
    monkeypatch.setattr(J, "FOLD", 16)
    got = sorted(tuple(r) for r in J.jaccard_components(docs(pairs), 900).collect())
    assert got == brute_components(pairs)


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for k in range(90):
        s = base[k % 6].copy()
        s[: rng.integers(0, 12)] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append((k, np.unique(s)))
    for left, right in ((sets, None), (sets[:40], sets[40:])):
        found = J.links(left, right)
        up = list(range(90))
        root = lambda x: x if up[x] == x else root(up[x])
        for a, b in found:
            assert J.linked(sets[a][1], sets[b][1]) and root(a) != root(b)
            up[root(a)] = root(b)
        pairs = [(a, b) for a, _ in left for b, _ in (right or left) if a != b]
        assert all(root(a) == root(b) for a, b in pairs if J.linked(sets[a][1], sets[b][1]))


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200 + k) for k in range(80)] + [(7, 7), (900, 900), (60, 61)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(51)} | {200 + k: 100 for k in range(80)} | {100: 100, 900: 900, 60: 60, 61: 60}
    assert got == want


# ---- repeated substrings


def brute_repeats(pairs):
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - D.MATCH + 1):
            s = b[k : k + D.MATCH]
            if s in seen:
                gone[k : k + D.MATCH] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def pieced(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    piece = lambda: base[(a := rng.randint(0, 2900)) : a + rng.randint(30, 400)]
    pairs = [(k, "".join(piece() + rng.choice(["", "zz", "yé" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 6)))) for k in range(150)]
    odd = ["q" * 500, "q" * 99, "q" * 100, None, "", pairs[5][1], base, base, "ab" * 300, "\0" * 300, "\0" * 150 + base[:200], base[100:199]]
    return pairs + [(150 + k, t) for k, t in enumerate(odd)]


def test_cover():
    assert {(a - b) % D.MODULUS for a in D.COVER for b in D.COVER} == set(range(D.MODULUS))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(docs, seed):
    pairs = pieced(seed)
    got = sorted(tuple(r) for r in D.remove_repeats(docs(pairs, clash=True, parts=5)).collect())
    assert got == brute_repeats(pairs)


def test_a_block_in_ever_other_surroundings_is_spread(docs):
    rng = random.Random(9)
    line = "this one line of more than forty four bytes stands everywhere in the whole table"
    words = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    pairs = [(k, f"{words(12)} {line} {words(12)}") for k in range(600)]
    got = sorted(tuple(r) for r in D.remove_repeats(docs(pairs)).collect())
    assert got == brute_repeats(pairs)
    # What a slice deals for the second names: no bucket has more than its share of the line's entries.
    import pyarrow as pa

    at = [t.index(line) for _, t in pairs]
    near = [np.array([a + 3, a + 20], np.int32).tobytes() for a in at]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs]), pa.array([t for _, t in pairs]), pa.array(near, pa.binary())], ["rid", "text", "places"])
    sizes = [len(x) // 8 for b in D._second([batch], 20) for x in b.column(4).to_pylist()]
    assert sum(sizes) == 1200 and max(sizes) < 3 * 1200 / 20


def test_long_texts_across_slices(docs, monkeypatch):
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    pairs = [(0, long), (1, long[5000:30_000] + "x"), (2, "q" + long[100:300]), (3, long[::-1])]
    monkeypatch.setattr(D, "SLICE", 30_000)  # workers have their own; here it cuts what is tested directly
    got = sorted(tuple(r) for r in D.remove_repeats(docs(pairs, parts=1)).collect())
    assert got == brute_repeats(pairs)


def test_repeats_of_odd_rows(docs):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef ") for _ in range(400))
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in D.remove_repeats(docs([(5, t), (5, t), (None, t + "x"), (5, t + "yy"), (8, "short")])).collect()}
    # Rows without an id come first; rows that repeat an id and a text are one document.
    assert got == {(None, 401): 0, (5, 400): 400, (5, 402): 400, (8, 5): 0}
    assert D.remove_repeats(docs([])).count() == 0
