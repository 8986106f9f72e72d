import random
from collections import Counter

import numpy as np

from riskloom.llm import decontam

from .helpers import ODD, docs

BENCH = "item_id long, text string, item int, cosine int"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 90))] for _ in "ab")
        assert decontam.lcs(a, b) == plain_lcs(a, b)


def test_query_finds_every_verbatim_item_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    rows = decontam.op5_decontamination(spark, sf).collect()
    texts = {r.doc_id: b" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: b" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if b" " + x + b" " in b" " + t + b" "}
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 0


def _world(seed=3):
    rng = random.Random(seed)
    common = [f"f{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(4000)]
    text = lambda n: [rng.choice(common) if rng.random() < .5 else rng.choice(rare) for _ in range(n)]
    items = [text(rng.randrange(14, 50)) for _ in range(40)]
    clean = [text(rng.randrange(5, 400)) for _ in range(150)]
    return rng, text, items, clean


def test_paraphrases_are_found_and_clean_texts_stay(spark):
    rng, text, items, clean = _world()
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    planted = {}
    for k, item in enumerate(items):
        changed = [w for w in item if rng.random() > .08]        # words left out and others put between
        for at in sorted(rng.sample(range(len(changed)), 3), reverse=True):
            changed.insert(at, "f1")
        held = text(60) + (item if k % 2 else changed) + text(100)
        planted[1000 + k] = k
        rows.append((1000 + k, ". ".join(held).upper() if k % 3 == 0 else " ".join(held)))
    d = docs(spark, rows)
    bench = spark.createDataFrame([(k, " ".join(w), 1, 1) for k, w in enumerate(items)], BENCH)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).collect()}
    assert got <= set(planted.items()) and len(got) >= 0.95 * len(planted)
    assert {x for x in planted.items() if x[1] % 2} <= got
    assert got == {(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench, block_items=15).collect()}
    left = decontam.without_contaminated(d, bench)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_long_items_are_found(spark):
    """Verbatim items of 500 and 2000 words, of rare and of frequent words."""
    rng = random.Random(5)
    frequent = [f"f{i}" for i in range(600)]
    text = lambda n: [rng.choice(frequent) for _ in range(n)]
    items = [[f"q{n}x{i}" for i in range(n)] for n in (500, 2000)] + [text(500), text(2000)]
    rows = [(i, " ".join(text(1500))) for i in range(60)]
    rows += [(1000 + k, " ".join(text(90) + w + text(70))) for k, w in enumerate(items)]
    rows += [(2000 + k, " ".join(w[:len(w) // 2])) for k, w in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(w), 1, 1) for k, w in enumerate(items)], BENCH)
    got = {(r.doc_id, r.item_id): r.covered for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1000 + k, k): 1.0 for k in range(4)}
    left = decontam.without_contaminated(docs(spark, rows), bench).collect()
    assert {r.doc_id for r in left} == {i for i, _ in rows} - {1000, 1001, 1002, 1003}


def test_parts_cover_an_item():
    for n in (5, 64, 65, 96, 97, 500):
        whole, *parts = decontam.parts_of(list(range(n)))
        assert whole == list(range(n)) and all(len(p) == 64 for p in parts) and bool(parts) == (n > 64)
        assert not parts or {x for p in parts for x in p} == set(whole)


def test_basis_spans_the_items(spark):
    _, _, items, clean = _world(8)
    block = decontam.Block([(k, [w.encode() for w in x]) for k, x in enumerate(items)])
    block.weigh({}, 100)
    texts = spark.createDataFrame([(" ".join(w),) for w in clean], "text string").repartition(4)
    counted = decontam.passages(texts, block)
    basis = decontam.latent_basis(counted, block)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    for w in block.items:
        a = np.bincount(block.codes(w), minlength=len(block.weight)) * block.weight
        assert np.linalg.norm(basis.T @ a) > 0.97 * np.linalg.norm(a)


def test_passages_of_all_texts_are_counted(spark):
    rng, text, items, clean = _world(9)
    clean = clean + clean[:40] * 3
    block = decontam.Block([(k, [w.encode() for w in x]) for k, x in enumerate(items)])
    block.weigh({block.vocab[b"f1"]: 190}, 200)                  # a word that is no term unless an item has none rarer
    want = Counter()
    for w in clean:
        codes = block.codes([x.encode() for x in w])
        for p in range(0, len(codes), decontam.LENGTHS[-1]):
            bag = sorted(c for c in codes[p:p + decontam.LENGTHS[-1]] if block.weight[c])
            if bag:
                want[np.array(bag, "<i4").tobytes()] += 1
    texts = spark.createDataFrame([(" ".join(w),) for w in clean], "text string").repartition(5)
    got = {bytes(r.bag): r.n for r in decontam.passages(texts, block).collect()}
    assert got == want and max(got.values()) >= 4
    q = np.random.default_rng(2).normal(size=(len(block.weight), 6))
    plain = np.zeros_like(q)
    for bag, n in want.items():
        a = np.bincount(np.frombuffer(bag, "<i4"), minlength=len(q)) * block.weight
        a /= np.linalg.norm(a)
        plain += n * np.outer(a, a @ q)
    assert np.allclose(decontam._products(decontam.passages(texts, block), block, q), plain, rtol=1e-4, atol=1e-4)


def test_odd_rows(spark):
    d = docs(spark, [*ODD, (30, "lead in " + " ".join(f"q{i}" for i in range(20)) + " tail"), (30, None)])
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item, 1, 1), (1, item, 1, 1), (2, None, 1, 1), (None, item, 1, 1), (3, "", 1, 1),
                                   (4, "too few words", 1, 1), (5, "z z z z z z", 1, 1)], BENCH)
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).collect()]
    assert got == [(30, 1), (30, 1)]
    assert decontam.contaminated(d.limit(0), bench).count() == 0
    assert decontam.contaminated(d, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(d, bench.limit(0)).count() == d.count()
    assert decontam.without_contaminated(d, bench).count() == d.count() - 1
