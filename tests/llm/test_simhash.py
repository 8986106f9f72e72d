import itertools
import random

import xxhash

from riskloom.llm import simhash

from .helpers import ODD, docs, lowered, words


def brute_print(text, k=3):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    """{key: fp} -> {key: smallest key of its component}, by all pairs."""
    keys, up = sorted(fps), {k: k for k in fps}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_fingerprint_matches_definition():
    for text in ["", None, "one", "One two", "a b c", "the cat sat on the mat " * 7, "Ünï cödé   text", "z" * 3000]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute_print(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_groups(fps, 3)


def test_dense_shards_are_divided_without_losing_links(spark):
    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 700:                       # a dense ball, a chain and scattered ones
        x = centre
        for b in rng.sample(range(20), rng.randrange(5)):
            x ^= 1 << b
        fps |= {x, rng.getrandbits(64)}
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    signed = [simhash._signed(x) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    want = brute_groups({x: x & (1 << 64) - 1 for x in signed}, 3)
    for limit in (1024, 16):
        edges = simhash.links(nodes, 3, limit)
        got = {r.node: r.label for r in simhash.connected_components(edges).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_levels_leave_no_pair_apart():
    rng = random.Random(3)
    for radius in (0, 1, 3, 5):
        for masks in simhash._levels(radius):
            assert len(masks) <= simhash.MAX_MASKS
            for _ in range(40):
                d = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(not d & m for m in masks)


def ball(rng, bits, flips, n):
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < n:
        x = centre
        for b in rng.sample(range(bits), rng.randrange(flips + 1)):
            x ^= 1 << b
        fps.add(x)
    return fps


def test_a_ball_of_twenty_thousand_at_the_registered_limit(spark):
    rng = random.Random(9)
    fps = ball(rng, 30, 6, 20_000)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").repartition(8)
    got = {r.node & (1 << 64) - 1: r.label for r in simhash.connected_components(simhash.links(nodes)).collect()}
    # brute force: neighbours by flipping up to three of the thirty bits, from a few members on
    seen, label = set(), {}
    flips = [sum(1 << b for b in c) for k in (1, 2, 3) for c in itertools.combinations(range(30), k)]
    for start in sorted(fps):
        if start in seen:
            continue
        group, todo = {start}, [start]
        rest = fps - seen
        while todo and len(group) < len(rest):
            x = todo.pop()
            new = {x ^ f for f in flips} & rest - group
            group |= new
            todo += new
        seen |= group
        low = min(map(simhash._signed, group))
        label |= {x: low for x in group if len(group) > 1}
    assert got == label


def test_shards_too_large_at_the_last_level_are_searched_in_parts(spark):
    rng = random.Random(2)
    fps = ball(rng, 12, 4, 400) | {rng.getrandbits(64) for _ in range(50)}
    signed = [simhash._signed(x) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {r.node: r.label for r in simhash.connected_components(simhash.links(nodes, 1, 4)).collect()}
    want = brute_groups({x: x & (1 << 64) - 1 for x in signed}, 1)
    assert {x: got.get(x, x) for x in signed} == want


def test_bk_tree_follows_only_edges_in_reach():
    rng = random.Random(1)
    keys = list({rng.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for k in keys:
        tree.add(k)
    for q in range(0, 1024, 37):
        assert sorted(tree.keys[i] for i in tree.within(q, 2)) == sorted(k for k in keys if (k ^ q).bit_count() <= 2)


def test_odd_rows(spark):
    d = docs(spark, ODD)
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(ODD)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == 4 and comp[6] == 6
    assert comp[None] is None
    kept = simhash.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(
        {0 if i is None else i for i in comp} - {2, 3, 5} - {i for i, c in comp.items() if i is not None and c != i})


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    assert simhash.one_of_each(docs(spark, ODD).limit(0)).count() == 0
