import hashlib
from collections import Counter

from pyspark.sql import functions as F

from riskloom.llm import lines

from .helpers import ODD, docs, lowered


def brute(rows, least=10):
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    seen = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if not (key(x) and seen[key(x)] >= least)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(d):
    out = lines.drop_lines(d)
    return sorted(map(tuple, out.select("doc_id", F.size("_lines"), F.coalesce(F.size("_dropped"), F.lit(0)),
                                        F.sha2(lines.kept_text(), 256)).collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, lines.op10_line_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_threshold_counts_rows_and_folds_keys(spark):
    rows = [(i, f"  Common LINE\t\nown {i}\n\n\tcommon line") for i in range(10)] + [
        (20 + i, f"nearly common\nx{i}") for i in range(9)] + [(40, "Common line"), (41, None), (42, "")]
    assert digest(docs(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    assert digest(docs(spark, ODD)) == brute(ODD)
    many = ODD * 10
    assert digest(docs(spark, many)) == brute(many)
    assert digest(docs(spark, ODD).limit(0)) == []


def test_runs_are_compacted_and_exact(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    batches = [[(1, 1), (2, 2)], [(1, 1), (3, 3)], [(1, 1), (2, 2)], [(2, 2), (1, 1)], [(4, 4)]]
    for b in batches:
        runs.add(spark.createDataFrame(b, "h1 long, h2 int"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(map(tuple, runs.frequent().collect())) == [(1, 1), (2, 2)]


def test_query_compacts_runs(spark, monkeypatch):
    made = []

    class Seen(lines.LineRuns):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(lines, "LineRuns", Seen)
    lines.op10_line_dedup(spark, "/root/testdata/sf0.001")
    assert [len(x) for x in made[0].levels] == [2, 1]


def test_no_python_on_the_main_path(spark):
    plan = lines.op10_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
