from collections import Counter

import corpus_pipeline as cp
from riskloom.llm import decontam, langid

from .helpers import close, words
from .test_mixing import brute_targets
from .test_simhash import brute_groups, brute_print
from .test_tokenfile import brute as brute_tokens
from .test_tokenfile import library  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert [d.columns for d in seen[:-1]] == [columns] * len(cp.STAGES)
    raw, identified, single, clean, mixed, final = ([r.asDict() for r in d.collect()] for d in seen)

    rejected = {r.doc_id for r in langid.identify(docs).collect() if r.rejected}
    assert {r["doc_id"] for r in identified} == {r["doc_id"] for r in raw} - rejected
    assert all(not any(c.isalpha() for c in r["text"]) for r in raw if r["doc_id"] in rejected)

    groups = brute_groups({r["doc_id"]: brute_print(r["text"]) for r in identified}, 3)
    assert sorted(r["doc_id"] for r in single) == sorted(set(groups.values()))

    bench = [b" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(b" " + x + b" " in b" " + b" ".join(decontam.words(t)) + b" " for x in bench)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in single if not holds(r["text"]))

    sizes, taken, whole = Counter(), Counter(), {r["doc_id"]: r for r in clean}
    for r in clean:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
        assert words(whole[r["doc_id"]]["text"])[:len(words(r["text"]))] == words(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(t - 2 < taken[s] <= t + 1e-6 for s, t in brute_targets(sizes).items())
    assert close(sum(taken.values()), sum(sizes.values()), 0.01)

    want = brute_tokens(sorted((r["doc_id"], r["text"]) for r in mixed), library)
    strip = lambda rows: sorted((a, c, d) for a, _, c, d in rows)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in final]
    assert strip(got) == strip(want)
    end = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):       # files hold one document after another
        assert start == end
        end += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [r[0] for r in want]


def test_run_joins_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
