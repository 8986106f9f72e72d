import math
from collections import Counter

from riskloom.llm import lm

from .helpers import ODD, close, crc, docs, lowered, words


def brute(rows, min_context, min_gain=lm.MIN_GAIN):
    """{id: row} from the definition, with plain dictionaries (ids are unique)."""
    texts = {i: [w for w in words(lowered(t))] + [None] for i, t in rows}
    train = [i for i in texts if crc(i) % 10 != 0]
    c, pair, triple = Counter(), Counter(), Counter()
    for i in train:
        t = texts[i]
        c.update(t)
        pair.update(zip([None, *t], t))
        triple.update(zip([None, *t], t, t[1:]))
    n, v = sum(c.values()), len(c)
    p0 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def smooth(count, context, shorter, less=0):
        prior = context ** lm.PRIOR
        return (max(count - less, 0) + prior * shorter) / (context - less + prior)

    p1 = lambda a, w: smooth(pair[a, w], c[a], p0(w)) if c[a] >= min_context else p0(w)
    g1, g2 = Counter(), Counter()
    for (a, w), k in pair.items():
        if c[a] >= min_context:
            g1[a] += k * math.log(smooth(k, c[a], p0(w), 1) / p0(w))
    for (a, b, w), k in triple.items():
        if pair[a, b] >= min_context:
            g2[a, b] += k * math.log(smooth(k, pair[a, b], p1(b, w), 1) / p1(b, w))

    def token(t, j):
        w, a = t[j], t[j - 1] if j else None
        if j:
            ab = (t[j - 2] if j > 1 else None, a)
            if pair[ab] >= min_context and g2[ab] >= min_gain:
                return smooth(triple[(*ab, w)], pair[ab], p1(a, w))
        return p1(a, w) if c[a] >= min_context and g1[a] >= min_gain else p0(w)

    return {i: (crc(i) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p0(w)) for w in t),
                sum(math.log10(token(t, j)) for j in range(len(t)))) for i, t in texts.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert close(r.base_score, w[4], 1e-9) and close(r.score, w[5], 1e-9), i


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm.op9_lm_scoring(spark, sf).collect()}
    same(got, brute(rows, lm.MIN_CONTEXT))
    away = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_blocks_and_buckets_do_not_change_scores(spark):
    rows = [(i, " ".join(["the cat sat", "on the Mat", "a dog ran", "the dog sat on it", f"odd{i}"][(i * j) % 5]
                         for j in range(1, 2 + i % 9))) for i in range(120)] + [(500, None), (501, ""), (502, "the cat sat on the dog")]
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, rows), min_context=5, block_chars=300, bucket_rows=40).collect()}
    want = brute(rows, 5)
    same(got, want)
    assert any(r.score > r.base_score for r in got.values())


def test_contexts_seen_a_few_times_are_states(spark):
    """A passage that training holds a few times predicts its next words; a context seen once has no gain."""
    train = [i for i in range(300) if crc(i) % 10]
    ask = next(i for i in range(10000, 10200) if crc(i) % 10 == 0)
    rows = [(i, f"x{i} y{i % 40} " + ("amber falcon crossed" if k < 6 else f"z{i % 30} x{i}")) for k, i in enumerate(train)]
    rows.append((ask, "amber falcon crossed"))
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, rows)).collect()}
    same(got, brute(rows, 2))
    same(got, brute(rows, 1))
    assert got[ask].score > got[ask].base_score + 1


def test_distributions_add_up_to_one(spark):
    """Held-out texts that differ in their last word only: its probabilities, the one unknown word's too, sum to 1."""
    train = [i for i in range(400) if crc(i) % 10]
    rows = [(i, ["a b a c", "a b b", "b a b c", "c a b"][i % 4]) for i in train]
    ask = [i for i in range(10000, 10200) if crc(i) % 10 == 0][:5]
    last = ["", "a", "b", "c", "never"]
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, rows + [(i, f"a b {w}") for i, w in zip(ask, last)]),
                                               min_context=4).collect()}
    want = brute(rows + [(i, f"a b {w}") for i, w in zip(ask, last)], 4)
    same(got, want)
    n, v = got[ask[0]].train_tokens, 4
    p0_unknown = math.log10(0.1 / (n + 0.1 * (v + 1)))
    assert close(got[ask[4]].base_score - got[ask[0]].base_score, p0_unknown, 1e-9)
    first = lm.BlockState.smoothed                                # the formula every depth uses
    import numpy as np
    p0 = np.array([(c + .1) / (10 + .1 * 4) for c in (5, 3, 2, 0)])
    assert close(p0.sum(), 1.0) and close(first(np.array([4., 1, 0, 0]), np.full(4, 5.), p0).sum(), 1.0)


def test_odd_rows(spark):
    got = lm.score_texts(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert lm.score_texts(docs(spark, ODD).limit(0)).count() == 0
    alone = lm.score_texts(docs(spark, [(None, "x y")])).collect()[0]
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (3, 0, 0, 0.0, 0.0)


def test_packed_arrays_come_back():
    import numpy as np
    for kind in (np.uint8, np.uint32, np.uint64, np.float64):
        a = np.arange(1000).astype(kind)
        assert (lm.unpack(lm.pack(a), kind) == a).all()
        assert len(lm.unpack(lm.pack(a[:0]), kind)) == 0


def test_shuffles_of_a_pass_are_deleted_when_it_ends(spark, monkeypatch):
    """Between passes no shuffle file of an earlier one is on disk."""
    import glob
    import time
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [d.toString() for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before, left, written = files(), [], lm.written

    def watched(*a):
        out, until = written(*a), time.time() + 5                # executors delete on their own
        while files() - before and time.time() < until:
            time.sleep(0.1)
        left.append(files() - before)
        return out

    monkeypatch.setattr(lm, "written", watched)
    rows = [(i, f"a b c{i % 7} d{i % 5} a b") for i in range(200)]
    same({r.doc_id: r for r in lm.score_texts(docs(spark, rows), block_chars=300).collect()}, brute(rows, lm.MIN_CONTEXT))
    assert left == [set()] * 5
    assert spark.conf.get(key, "false") == "false"
