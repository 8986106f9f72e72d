import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from riskloom.llm import spelling

from .helpers import LONG, ODD, docs, lowered

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def apart(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, every=97, min_chars=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in map(lowered, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def brute(words):
    # words one error apart share a word with one code point left out at the same place, or are one
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    out = {}
    for w, n in words.items():
        near = {x for v in (w, *(w[:i] + w[i + 1:] for i in range(len(w)))) for x in holes[v] if apart(w, x)}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [n, len(near), best if best is not None and words[best] >= 2 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row += [words[row[2]] if row[2] else None, root]
    return {w: tuple(r) for w, r in out.items()}


def result(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("letters,trials", [("ab", 25), ("abcé", 25), ("a", 3)])
def test_search_finds_all_words_one_error_apart(letters, trials):
    rng = random.Random(len(letters))
    for _ in range(trials):
        m = rng.randrange(5, 9)
        half = rng.choice((m // 2, m - m // 2))
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice((m, m + 1)))) for _ in range(120)})
        asked = rng.sample(words, (len(words) + 1) // 2) + ["z" * m, letters[0] * (m + 1) + "ÿ"][:1]
        who, at = spelling.one_error_apart(words, asked, m, half)
        got = list(zip(who.tolist(), at.tolist()))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words)
                            if apart(a, b) and a[:half] == b[:half] and not len(a) == len(b) == m + 1}


def test_runs_are_those_of_the_pattern():
    for _, text, *_ in [*ODD, (0, "a×b ÀB-cİd퟿āe_ÿz9Q", None, None)]:
        assert [r.decode("latin-1") for r in spelling.runs(text)] == [lowered(x) for x in RUN.findall(text or "")]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    got = result(spelling.op11_spelling_variants(spark, sf))
    assert len(words) > 500 and got == brute(words)


def test_hot_halves_chains_and_ties(spark):
    rng = random.Random(5)
    # a third of the words share their first half, another third their last one
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(6)): 1 for _ in range(300)}
    words |= {"".join(rng.choice("abc") for _ in range(6)) + "suffix": 1 for _ in range(300)}
    words |= {"".join(rng.choice("ab") for _ in range(n)): 1 for n in (5, 6, 7) for _ in range(100)}
    words = {w: 3 * 2 ** rng.randrange(5) for w in words}
    words |= {"chainaaaaa": 3, "chainaaaab": 6, "chainaaabb": 12, "chainaabbb": 24, "tiesone": 3, "tiestwo": 3, "xiesone": 6, "yiesone": 6}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    want = brute(brute_words(rows, every=0))
    assert want["chainaaaaa"][4] == "chainaabbb" and want["tiesone"][2] == "xiesone"
    for shard_words in (40, 12_000):
        assert result(spelling.spelling_variants(docs(spark, rows), every=0, shard_words=shard_words)) == want


def test_odd_rows(spark):
    rows = [*ODD, (11, LONG.replace("stone", "stoné"), "en", "a"), (None, "lost lost lost lost", None, None)]
    d = docs(spark, rows)
    assert result(spelling.spelling_variants(d)) == brute(brute_words([(r[0], r[1]) for r in rows]))
    assert spelling.spelling_variants(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(d, ratio=1)
