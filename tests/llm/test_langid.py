import math
import random

import numpy as np

from riskloom.llm import langid

from .helpers import ODD, close, crc, docs

EN = "the rain in spain stays mainly on the plain and then there were other things that they said with them "
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft er nicht mehr auf der straße "


def slow_kn(texts, text):
    """log2 probabilities of a text's scored characters, written out from the definition."""
    def codes(t):
        out = [langid.EDGE]
        for c in t:
            k = int(langid._classes()[ord(c)])
            if k or out[-1]:
                out.append(k)
        return out

    tri, d = {}, langid.DISCOUNT
    for t in texts:
        cs = [langid.EDGE, *codes(t)]
        for a, b, c in zip(cs, cs[1:], cs[2:]):
            tri[a, b, c] = tri.get((a, b, c), 0) + 1
    left = {}
    for a, b, c in tri:
        left.setdefault((b, c), set()).add(a)
    uni = {}
    for b, c in left:
        uni.setdefault(c, set()).add(b)

    def p1(c):
        total = sum(map(len, uni.values()))
        return max(len(uni.get(c, ())) - d, 0) / total + d * len(uni) / total / 64

    def p2(b, c):
        own = {y: len(s) for (x, y), s in left.items() if x == b}
        return (max(own.get(c, 0) - d, 0) + d * len(own) * p1(c)) / sum(own.values()) if own else p1(c)

    def p3(a, b, c):
        own = {z: n for (x, y, z), n in tri.items() if (x, y) == (a, b)}
        return (max(own.get(c, 0) - d, 0) + d * len(own) * p2(b, c)) / sum(own.values()) if own else p2(b, c)

    cs = [langid.EDGE, *codes(text)]
    return [math.log2(p3(a, b, c)) for a, b, c in zip(cs, cs[1:], cs[2:])]


def test_model_matches_the_written_out_definition():
    texts = ["abba cab", "a bad cab!! 12 dab"]
    counts = np.bincount(langid.trigrams(texts)[0], minlength=langid.SIZE)
    model = langid.LanguageModels(["x"], counts[None])
    for t in ["abba", "cab dab zz qx", "b", "a  b\n\nc", "ca" * 30]:
        bits, n, letters = model.entropies([t])
        want = slow_kn(texts, t)
        assert n[0] == len(want) and letters[0] and close(bits[0, 0], -sum(want) / len(want), 1e-9)


def test_texts_do_not_depend_on_their_neighbours():
    model = langid.LanguageModels(["x"], np.bincount(langid.trigrams([EN])[0], minlength=langid.SIZE)[None])
    alone = [model.entropies([t])[0][0, 0] for t in (EN, DE, "", "1 2")]
    assert np.allclose(model.entropies([EN, DE, "", "1 2"])[0][:, 0], alone)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == lang.keys()
    away = [i for i in lang if crc(i) % 3 == 1]
    assert away == [i for i in lang if got[i].held_out]
    assert sum(got[i].lang_pred == lang[i] for i in away) >= 0.98 * len(away)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, (EN if i % 2 else DE) * 2, "en" if i % 2 else "de") for i in range(40)]
    wrong = [(i, t, "zz" if crc(i) % 3 == 1 else la) for i, t, la in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs(spark, x)).collect())
            for x in (rows, wrong))
    assert a == b and {x[1] for x in a} == {"en", "de"}


def test_noise_is_rejected_and_texts_stay(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample((EN if i % 2 else DE).split(), 12)), "en" if i % 2 else "de") for i in range(200)]
    noise = [(1000 + i, "".join(rng.choice("qxzjkvwyç fbþ") for _ in range(400)), None) for i in range(5)]
    d = docs(spark, rows + noise + [(2000, "... 123", "en"), (2001, None, "en")])
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert [i for i, r in got.items() if i < 1000 and r.rejected] == []
    assert all(got[i].rejected for i in got if i >= 1000)
    kept = langid.keep_identified(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_odd_rows(spark):
    got = {}
    for r in langid.identify(docs(spark, ODD)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(ODD)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (1, 2, 3, 8))
    assert got[4][0].lang_pred == got[5][0].lang_pred == "en"
    assert langid.identify(docs(spark, ODD).limit(0)).count() == 0
    unlabelled = langid.identify(docs(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert [r.lang_pred for r in unlabelled] == ["und", "und"]
