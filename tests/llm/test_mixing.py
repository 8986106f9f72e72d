from collections import Counter, defaultdict

import pytest

from riskloom.llm import mixing

from .helpers import ODD, close, docs, words


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: size} -> {source: target}."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in clamped)
        open_ = sum(w[s] for s in names if s not in clamped)
        share = {s: cap * sizes[s] if s in clamped else left * w[s] / open_ for s in names}
        over = {s for s in names if s not in clamped and share[s] > cap * sizes[s]}
        if not over:
            return share
        clamped |= over


def checked(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and close(r.target, want[r.source], 1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    copies = max(Counter((r.source, r.size) for r in rows).values())
    for s in sizes:
        assert want[s] - 1 - copies < taken[s] <= want[s] + 1e-6
    return sizes


def run(d):
    m = mixing.mix(d)
    return m.selectExpr("doc_id", "source", "text", "mix.size as size", "mix.source_size", "mix.target",
                        "mix.size * mix.whole + mix.part as taken").collect()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = run(d)
    assert len(rows) == d.count()
    checked(rows)
    assert all(r.size == len(words(r.text)) for r in rows)
    once = sorted(map(tuple, mixing.op2_mixing(spark, sf).collect()))
    assert once == sorted(map(tuple, mixing.op2_mixing(spark, sf).collect()))
    assert once == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)


def test_caps_are_met_in_turn(spark):
    rows = [(i, "w " * 10, None, "a") for i in range(2)] + [(10 + i, "w " * 5, None, "b") for i in range(40)] + [
        (100 + i, "w " * (i % 7), None, "c") for i in range(300)] + [(900, "w w w", None, None), (901, "w", None, "")]
    sizes = checked(run(docs(spark, rows)))
    assert brute_targets(sizes)["a"] == 60                       # small and heavy: at its cap


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 9)), None, "abc"[i % 3] if i % 5 else None) for i in range(200)]
    d = docs(spark, rows)
    plan, out = run(d), mixing.mixed_documents(d)
    assert out.columns == d.columns
    got, first = defaultdict(int), {r.doc_id: r.text for r in plan}
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert words(first[r.doc_id])[:len(words(r.text))] == words(r.text) and r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in plan if r.taken} == dict(got)


def test_odd_rows(spark):
    rows = run(docs(spark, ODD))
    assert len(rows) == len(ODD)
    checked(rows)
    assert {r.doc_id: (r.size, r.taken) for r in rows}[1] == (0, 0)
    assert mixing.mix(docs(spark, ODD).limit(0)).count() == 0
    assert mixing.mixed_documents(docs(spark, ODD).limit(0)).count() == 0
    nothing = run(docs(spark, [(1, None, None, "a"), (2, "", None, None)]))
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_changes_the_sample_only(spark, seed):
    rows = [(i, "w " * (1 + i % 4), None, "ab"[i % 2]) for i in range(100)]
    d = docs(spark, rows)
    got = mixing.mix(d, seed=seed).selectExpr("sum(mix.size * mix.whole + mix.part) s").first()
    assert got.s == mixing.mix(d).selectExpr("sum(mix.size * mix.whole + mix.part) s").first().s
