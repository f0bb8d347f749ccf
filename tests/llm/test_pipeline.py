import random

from test_join_and_repeats import brute_components
from test_other_operators import brute_hits
from test_rules_and_secrets import base, spans

import corpus_pipeline as P
from partwise.llm import packing


def corpus():
    rng = random.Random(12)
    words = lambda n, pool=900: [f"w{rng.randint(0, pool)}" for _ in range(n)]
    item = " ".join(f"q{k}" for k in range(20))
    good = [" ".join(words(120)) + "." for _ in range(10)]
    near = [g.replace(g.split()[5], "changed") for g in good[:4]]
    out = good + near + ["too short", None, "", " ".join(words(60)) + " " + item, " ".join(words(900)) + f" token=abcdefgh{7}x", good[0], "a b c " * 60]
    return list(enumerate(out)), [(0, item)]


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    pairs, items = corpus()
    docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in pairs if (b := base(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    one = {i for i, _, c in brute_components(kept) if i == c}
    clean = {r[0] for r in brute_hits([p for p in kept if p[0] in one], items) if not r[5]}
    texts = {}
    for i, t in kept:
        if i in clean:
            for a, _, b in reversed(spans(t)):
                t = t[:a] + "[SECRET]" + t[b:]
            texts[i] = t
    enc = packing.encoder()
    want = {i: len(enc.encode_ordinary(t)) + 1 for i, t in texts.items()}
    got = P.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    docs_in = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs_out = stage(spark, docs_in, str(tmp_path))
        assert docs_out.columns == docs_in.columns
        assert stage(spark, docs_in.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Clashing columns, repeated ids with unlike texts, repeated rows, null ids, and a very long text."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"v{rng.randint(0, 9999)}" for _ in range(n)) + "."
    a, b, long = words(80), words(90), words(60_000)
    pairs = [(5, a), (5, b), (5, a), (None, b), (None, words(70)), (7, None), (8, long), (9, long)]
    docs_in = docs(pairs, clash=True)
    docs_in.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs_in, str(tmp_path))
        assert out.columns == docs_in.columns
        docs_in = out.persist()
    kept = sorted((str(r["doc_id"]), r["text"]) for r in docs_in.collect())
    assert kept == sorted([("5", a), ("5", b), ("None", pairs[4][1]), ("8", long)])
    got = P.packing(spark, docs_in, str(tmp_path)).toPandas()
    assert got["length"].sum() == sum(len(packing.encoder().encode_ordinary(t)) + 1 for _, t in kept)
