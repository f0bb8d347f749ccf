import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from partwise.llm import decontamination as B
from partwise.llm import html_extraction as H
from partwise.llm import packing as P
from partwise.llm import quality_classifier as C
from partwise.llm import sharding as S
from partwise.llm import toxicity as T

# ---- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(pairs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in pairs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def contaminated_case():
    rng = random.Random(6)
    words = lambda n: [rng.choice(["the", "of", "été", "a1", "x", "yes", "no"]) + rng.choice(["", "s", "7"]) for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([3, 8, 12, 13, 14, 30])))) for k in range(12)] + [(50, None), (51, ""), (52, "...")]
    pairs = []
    for i in range(60):
        w = words(rng.randint(0, 200))
        if rng.random() < 0.6:
            source = rng.choice(items[:12])[1].split()
            a = rng.randint(0, max(0, len(source) - 13))
            at = rng.randint(0, len(w))
            w[at:at] = source[a : a + rng.choice([12, 13, 20])]
        pairs.append((i, rng.choice([" ", ", ", "-\n"]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return pairs + [(60, None), (61, ""), (62, "x " * 4000)], items


@pytest.mark.parametrize("limit", [B.SMALL_BYTES, 0])  # with none the benchmark is shuffled
def test_hits_against_brute_force(docs, rows, limit):
    pairs, items = contaminated_case()
    bench = rows("item_id long, text string", items, 2)
    df = docs(pairs, clash=True)
    got = sorted((tuple(r) for r in B.decontaminate(df, bench, limit).collect()), key=str)
    want = brute_hits(pairs, items)
    assert got == want
    kept = B.clean_documents(df, bench, limit)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_no_benchmark_no_documents(docs, rows):
    none = rows("item_id long, text string", [], 1)
    assert [r["n_hit"] for r in B.decontaminate(docs([(1, "a b"), (None, None)]), none).collect()] == [0, 0]
    assert B.decontaminate(docs([]), none).count() == 0


# ---- sharding


def test_shards_are_level_and_gapless(docs):
    rng = random.Random(7)
    pairs = [(k, "copy " * 30 if k % 3 == 0 else "w" * rng.randint(0, 400)) for k in range(3000)] + [(3001, None), (3002, ""), (None, "n"), (5, "copy"), (5, "copy")]
    got = S.shard(docs(pairs, clash=True)).toPandas()
    assert len(got) == len(pairs) and set(got["shard"]) == set(range(40)) and set(got["law"]) == {"bytes"}
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    again = S.shard(docs(pairs)).toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "size", "shard"]].fillna(-1).astype(int).to_numpy().tolist()))
    assert key(got) == key(again)
    assert S.shard(docs([])).count() == 0


def test_overfull_ranges_are_subdivided_and_small_groups_stay_whole(docs):
    rng = random.Random(2)
    pairs = [(k, "hot " * 50) for k in range(2000)] + [(9, "same row " * 40)] * 600  # a group, and one row, of a third each
    pairs += [(3000 + k, f"copy {k // 5}") for k in range(1000)] + [(5000 + k, "w" * rng.randint(0, 300)) for k in range(1000)] + [(9000, "long " * 20_000)]
    got = S.shard(docs(pairs), shards=8).toPandas()
    assert len(got) == len(pairs)
    size = got.groupby("shard")["size"].sum()
    assert set(got["shard"]) == set(range(8)) and size.max() - size.min() <= 2 * got["size"].max() + 2 * S.WHOLE * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = got[got["doc_id"].between(3000, 3999)]
    assert (small.groupby(small["doc_id"] // 5)["shard"].nunique() == 1).all()


# ---- packing


def test_pieces_are_whole_and_sequences_tight(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    odd = [None, "", "  \n\n x", "<|endoftext|> it's", "a<|endoftext|>b", "<|endoftext|>" * 3000, "né ", "ab" * 4000, "日本語 ünï"]
    pairs = list(enumerate(odd)) + [(100 + k, " ".join(rng.choice(["the", "of", "xyzzy", "été", "don't", "123"]) for _ in range(rng.randint(1, 1500)))) for k in range(120)]
    got = P.pack(docs(pairs, clash=True), windows=8).toPandas()
    for i, t in pairs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own, at = got[got["doc_id"] == i].sort_values("start"), 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(np.cumsum(g["length"]) - g["length"]) and g["length"].sum() <= 1024
    assert got["length"].sum() / (got["sequence_id"].nunique() * 1024) > 0.95
    assert P.pack(docs([])).count() == 0
    assert P.pack(docs([(None, "a"), (3, "b"), (3, "b")])).count() == 3


def naive_windows(lengths, length, most):
    """Best fit among at most most windows by looking at all of them."""
    opened, out, count = [], [], 0  # [window, used]
    for n in lengths:
        fits = [w for w in opened if w[1] + n <= length]
        if fits:
            best = max(fits, key=lambda w: (w[1], -w[0]))
        else:
            if len(opened) == most:
                opened.remove(max(opened, key=lambda w: (w[1], -w[0])))
            best = [count, 0]
            opened.append(best)
            count += 1
        out.append((best[0], best[1]))
        best[1] += n
        if best[1] == length:
            opened.remove(best)
    return out


@pytest.mark.parametrize("most", [1, 3, 16])
def test_windows_against_brute_force(most):
    rng = random.Random(most)
    lengths = [rng.randint(1, 64) for _ in range(800)]
    w = P.Windows(64, most)
    assert [w.place(n) for n in lengths] == naive_windows(lengths, 64, most)


def test_leftovers_of_several_groups_meet(docs):
    rng = random.Random(3)
    pairs = [(k, "word " * rng.randint(1, 900)) for k in range(200)]
    got = P.pack(docs(pairs, parts=7), windows=3, group=2).toPandas()  # four groups of up to two partitions
    assert got.groupby("doc_id")["length"].sum().to_dict() == got.groupby("doc_id")["doc_tokens"].first().to_dict() and len(set(got["doc_id"])) == 200
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(np.cumsum(g["length"]) - g["length"]) and g["length"].sum() <= 1024


def test_windows_are_best_fit_and_bounded():
    w = P.Windows(10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)] and not w.open
    w = P.Windows(10, 2)
    assert [w.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)] and set(w.used) == {0, 2}  # the fullest went


# ---- extraction


def test_main_text_of_an_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><header>top</header><div class="sidebar">side</div>
    <article><h1>A&amp;B &eacute;</h1><p>One <b>two</b><br>three<p>fo<i>u</i>r<!-- c --> &lt;x&gt;<div class="ad">buy</div>
    <div class="notice-box">cookies</div><form><input>f</form><ul><li>a<li>b</ul><section id="comments"><p>reader</p></section>
    <aside>more</aside></article><footer>&copy; foot</footer></body></html>"""
    assert H.main_text(page) == "A&B é\nOne two three\nfour <x>\na\nb"
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("<article><p>cut <b>off") == "cut off" and H.main_text("<article><p>a<p") == "a"


def test_class_words_are_judged_whole_and_teasers_left_out():
    page = """<article><h1>T</h1><h2 id="search">Search trees</h2><p class="ad-hoc">An ad-hoc one.</p><section class="legal-analysis">
    The law.</section><header><h2>Part one</h2></header><p>end</p><div class="ad-slot">buy</div><article class="user-post"><p>I think</p></article></article>"""
    assert H.main_text(page) == "T\nSearch trees\nAn ad-hoc one.\nThe law.\nPart one\nend"
    beside = "<body><article><p>teaser</p></article><article><h1>Story</h1><p>The whole long story.</p></article><article class=user-post><p>a post</p></article></body>"
    assert H.main_text(beside) == "Story\nThe whole long story."
    assert H.main_text(f"<main><h1>Head</h1>{beside}</main><article><p>{'outside ' * 9}</p></article>") == "Head\nStory\nThe whole long story."
    assert H.main_text("<main><p>a</p><div id=userComments>c</div><div class='x comments'>d</div><p>b</p></main>") == "a\nb"


def test_long_and_deeply_nested_pages(rows):
    deep = "<div>" * 3000 + "<article><p>core</p></article>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>P{k} &amp;</p>" for k in range(20_000)) + "</article>"
    got = {r["page_id"]: r["text"] for r in H.extract(rows("page_id long, url string, html string", [(1, "http://d.example/", deep), (None, "http://e.example/", long)])).collect()}
    assert got[1] == "core" and got[None] == "\n".join(f"P{k} &" for k in range(20_000))


def test_pages_with_and_without_article(rows):
    page = lambda k: f"<html><body><div class='top-menu'>m</div><div class=content><h2>T{k}</h2><p>Text {k}</p><p>More {k}</p></div><div class=box>Same on all pages</div></body></html>"
    values = [(k, f"http://one.example/{k}", page(k), "x") for k in range(6)]
    values += [(10, "http://two.example/", "<article><p>x  y</p></article>", "x"), (11, None, None, "x"), (12, "u", "", "x"), (10, "http://two.example/", "<article><p>x  y</p></article>", "x")]
    got = H.extract(rows("page_id long, url string, html string, main string", values)).collect()
    text = {r["page_id"]: (r["text"], r["n_chars"]) for r in got}
    assert len(got) == len(values)
    assert all(text[k][0] == f"T{k}\nText {k}\nMore {k}" for k in range(6))
    assert text[10] == ("x y", 3) and text[11] == text[12] == ("", 0)
    assert H.extract(rows("page_id long, url string, html string", [])).count() == 0


def test_alignment_makes_groups_and_slots():
    a, b = (H.squash(H.stream(H.blocks(f"<body><h1>t</h1>{'<p>x</p>' * n}<div>{n}</div>{x}"))) for n, x in ((3, ""), (5, "<ul><li>q</ul>")))
    wrapper = H.align(a, b)
    kinds = [n[0] for n in wrapper]
    assert kinds.count("+") == 1 and kinds.count("?") == 1
    assert H.align(wrapper, a) and [H._key(n) for n in H.align(wrapper, b)] == [H._key(n) for n in wrapper]


def test_text_of_one_page_is_no_template(rows):
    page = lambda k, x="": f"<body><div class=content><h2>T{k}</h2><p>A{k}</p>{x}</div><div class=box>Same</div></body>"
    values = [(k, f"http://one.example/{k}", page(k, "<blockquote>Q3</blockquote>" if k == 3 else "")) for k in range(8)]
    for parts in (1, 3):
        got = {r["page_id"]: r["text"] for r in H.extract(rows("page_id long, url string, html string", values, parts)).collect()}
        assert got[3] == "T3\nA3\nQ3" and got[0] == "T0\nA0"
    # Same page in several batches: still one page.
    nodes = H.marked(H.squash(H.stream(H.blocks(page(1)))), "k1")
    assert H.findings(H.align(H.align(nodes, nodes), nodes))[1] == []


def test_template_text_of_articles_is_left_out(rows):
    page = lambda k: f"<body><p>Plain {k}</p><article><h1>T{k}</h1><p>A{k}</p><div class=box>Same</div></article></body>"
    values = [(k, f"http://one.example/{k}", page(k)) for k in range(6)]
    values += [(10, "http://two.example/", page(10)), (11, "http://two.example/b", page(11)), (12, "http://one.example/c", "<body><p>Same</p></body>")]
    got = {r["page_id"]: r["text"] for r in H.extract(rows("page_id long, url string, html string", values)).collect()}
    assert all(got[k] == f"T{k}\nA{k}" for k in range(6))
    assert got[10] == "T10\nA10\nSame" and got[11] == "T11\nA11\nSame" and got[12] == "Same"


def test_common_subsequence_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
        for bits in (1, 60, 10_000):
            got = H._common(a, b, bits)
            assert len(got) == best[-1][-1] and all(a[i] == b[k] for i, k in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_long_pages_are_aligned_whole():
    name = lambda n: "".join(chr(97 + n // 26**d % 26) for d in range(3))
    pages = [f"<body><h1>T{k}</h1>" + "".join(f"<div class={name(n)}><p>C{n}</p></div>" for n in range(4100)) + f"<div class=last><p>L{k}</p></div></body>" for k in range(3)]
    wrapper = None
    for k, p in enumerate(pages):
        nodes = H.marked(H.squash(H.stream(H.blocks(p))), f"k{k}")
        wrapper = nodes if wrapper is None else H.align(wrapper, nodes)
    container, template = H.findings(wrapper)
    assert container == "body" and template == [H._hash(f"C{n}") for n in range(4100)]


# ---- classifiers


def labelled(n, seed=9):
    rng = random.Random(seed)
    out, labels = [], []
    plain = [f"word{k}" for k in range(200)]
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 300))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + "$$$" for w in words]
        if rng.random() < 0.5:
            words.insert(3, rng.choice(["women", "muslims", "gay"]))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        out.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return out, labels


@pytest.mark.parametrize(("which", "label", "folds", "out", "cut"), [(C.classify_quality, 1, 3, 1, 0.5), (T.classify_toxicity, 2, 4, 2, 0.3)])
def test_held_out_accuracy(docs, rows, which, label, folds, out, cut):
    pairs, labels = labelled(700)
    known = rows("doc_id long, quality int, toxic int", labels + [(None, 1, 1), (10**6, 1, 0), (3, None, None)])
    extra = [(10**7, None), (10**7 + 1, ""), (None, "x"), (5, pairs[5][1]), (10**7 + 2, "y " * 5000)]
    got = which(docs(pairs + extra, clash=True), known).collect()
    assert len(got) == len(pairs) + len(extra)
    truth = {r[0]: r[label] for r in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % folds == out) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93
    assert which(docs([]), known).count() == 0
    none = rows("doc_id long, quality int, toxic int", [])
    assert which(docs([(1, "a")]), none).first()["score"] == 0.5


def test_identity_terms_do_not_move_scores():
    rng = random.Random(1)
    texts = []
    for k in range(300):  # a biased sample: toxic texts mention one group
        toxic = k % 2
        words = [f"w{rng.randint(0, 60)}" for _ in range(20)]
        if toxic and rng.random() < 0.9:
            words.append("idiot")
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        texts.append((" ".join(words), toxic))
    import pyarrow as pa

    model = T.train(texts)
    assert T.swap_gap([t for t, _ in texts], model) < 0.05
    base, mention, insult = T.score(pa.array(["w1 w2 w3", "w1 w2 w3 muslims", "w1 w2 w3 idiot"]), model)
    assert mention - base < 0.1 and insult - base > 0.3


def test_neutral_mentions_are_left_alone_out_of_sample(monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randint(0, 200)}" for _ in range(n))

    def row(toxic):
        group = rng.choice(["women", "muslims", "immigrants", "gay"])
        biased = rng.random() < (0.7 if toxic else 0.15)
        return f"{words(15)}. {f'The {group} {words(4)}.' if biased else ''} {words(5)} {rng.choice(['idiot', 'scum', 'moron']) if toxic else ''}.", int(toxic)

    rows, neutral = [row(k % 3 == 0) for k in range(900)], [f"{words(12)}. The {g} {words(6)}." for g in ("women", "muslims", "immigrants", "gay") for _ in range(50)]
    import pyarrow as pa

    figures = []
    for penalty in (T.PENALTY, 0.0):
        monkeypatch.setattr(T, "PENALTY", penalty)
        model = T.train(rows)
        figures.append((T.swap_gap(neutral, model), (T.score(pa.array(neutral), model) >= T.CUT).mean()))
    assert figures[0][0] < 0.02 and figures[0][0] < figures[1][0] / 2 and figures[0][1] <= min(0.02, figures[1][1])


def test_terms_are_whole_words_swapped_within_their_kind():
    pairs = T.sentence_pairs(["The Gay man ran. A manly gaylord, womenfolk! männer", "plain text"])
    swapped = [p for p in pairs if p[0] == "The Gay man ran"]
    assert len(swapped) == T.SWAPS + 1 and swapped[-1][1].split() == ["The", "ran"]
    for _, t in swapped[:-1]:
        _, a, b, _ = t.split()
        assert a != "gay" and T.KIND[a] == "orientation" and b != "man" and T.KIND[b] == "person"
    assert (" männer", " frauen") in pairs and not any(s == " A manly gaylord, womenfolk" and t.split()[0] not in T.KIND for s, t in pairs)


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    texts, labels = labelled(60)
    sample = T.Sample([(t + ". The women and gay muslims word3.", y) for (_, t), (_, _, y) in zip(texts, labels, strict=True)])
    w, b = np.zeros(T.BUCKETS), 0.3
    at = np.flatnonzero(sample.scale)
    w[at] = rng.normal(0, 0.5, len(at))
    _, g, d = sample.loss(w, b)
    for k in [*rng.choice(at, 12).tolist(), *np.unique(sample.bucket)[:4].tolist()]:
        up, down = w.copy(), w.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((sample.loss(up, b)[0] - sample.loss(down, b)[0]) / 2e-5 - g[k]) < 1e-5
    assert abs((sample.loss(w, b + 1e-5)[0] - sample.loss(w, b - 1e-5)[0]) / 2e-5 - d) < 1e-5
    # The attention model's gradients, and its attention against a slow form.
    bags, first = np.abs(rng.normal(0, 1, (7, C.BAG))), np.array([0, 3, 4, 7])
    m = {"W": rng.normal(0, 0.1, (C.BAG, C.HIDDEN)), "V": rng.normal(0, 0.3, (C.HIDDEN, C.HIDDEN)), "U": rng.normal(0, 0.3, (C.HIDDEN, C.HIDDEN)), "w": rng.normal(0, 1, C.HIDDEN), "z": rng.normal(0, 1, C.HIDDEN), "c": rng.normal(0, 0.1, C.HIDDEN), "b": 0.2}
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def slow(m):
        out = 0.0
        for i in range(3):
            h = [np.tanh(x @ m["W"] + m["c"]) for x in bags[first[i] : first[i + 1]]]
            e = np.array([np.exp((np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) @ m["w"]) for v in h])
            p = 1 / (1 + np.exp(-(sum(a * v for a, v in zip(e / e.sum(), h, strict=True)) @ m["z"] + m["b"])))
            out -= weight[i] * (y[i] * np.log(p) + (1 - y[i]) * np.log(1 - p))
        return out + C.DECAY / 2 * sum((np.asarray(v) ** 2).sum() for v in m.values())

    g = C._gradients(m, bags, first, y, weight)
    for k in ("W", "V", "U", "w", "z", "c"):
        place = tuple(rng.integers(0, n) for n in m[k].shape)
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][place] += 1e-6
        down[k][place] -= 1e-6
        assert abs((slow(up) - slow(down)) / 2e-6 - g[k][place]) < 1e-5


def test_score_of_no_passages_and_very_long_text():
    import pyarrow as pa

    model = C.train([("a b c", 1), ("$$$ $$$ ###", 0)] * 20, epochs=20)
    p = C.score(pa.array([None, "", "a b c " * 100_000]), model)
    assert len(p) == 3 and np.isfinite(p).all()


def test_scores_are_shifted_to_the_labels_rates(docs, rows):
    # One text for both labels: the score can only be the rate of label 1 outside the held-out fold.
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % C.FOLDS != C.HELD_OUT]
    labels = [(i, int(k % 10 > 0), 0) for k, i in enumerate(ids)]
    rate = sum(y for _, y, _ in labels) / len(labels)
    got = C.classify_quality(docs([(i, "a b c") for i in ids]), rows("doc_id long, quality int, toxic int", labels)).collect()
    assert all(abs(r["score"] - rate) < 0.02 and r["predicted"] == 1 for r in got)
