import hashlib
import re

from pyspark.sql import functions as F

from riskloom.llm import pii

from .helpers import ODD, docs

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c@d.e", "a@b.c_d@e.f", "x..y%+@host-.co.uk. z@q", "mail me@x.y.z,you@x.y", "@a.b a@.b a@b a@b.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 1..2.3.4 99999999999999999999.1.1.1", "1.2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "41111111111111111111", "x4111111111111111y",
    "+1 (988) 555-2485", "+1 (988) 555-2485 +44.20.7946.0958", "+12", "+1 2", "++1 555 555 5555 ", "+1 5)", "+1 555 555 555 555 555 555 9",
    "é+49 30 1234567 ü 4111111111111111 ñ a@b.de \U0001F600 10.0.0.1", "7 " * 9000, "9" * 30000, "a" * 40000 + "@", "1." * 20000,
]


def found(d):
    out = pii.find_personal_data(d)
    return {r.doc_id: ([tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in out.collect()}


def test_base_spans_match_the_plain_expressions(spark):
    rows = list(enumerate(TRICKY))
    got = found(docs(spark, rows))
    for i, text in rows:
        assert got[i][0] == brute(text), text[:60]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in PLAIN]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_confident_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call helpdesk number: +1 (300) 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "please call helpdesk number: 0300-555-7777, today"), (51, "we met number 12 of 0300-555-7777")]
    rows += [(100 + i, f"the value is {i}") for i in range(30)] + [(200 + i, f"the value is u{i}@x.org") for i in range(6)]
    rows += [(300, "the value is 77")]
    got = found(docs(spark, rows))
    text = dict(rows)
    assert [(k, text[50][s:e]) for k, s, e in got[50][1]] == [("phone", "0300-555-7777")] and got[50][0] == []
    assert got[51][1] == [] and got[300][1] == [] and all(got[100 + i][1] == [] for i in range(30))
    assert all(got[i][1] == got[i][0] and len(got[i][0]) == 1 for i in range(12))


def test_one_word_labels_find_unseen_identifiers(spark):
    """Labels at the start of a text or line and in label lists, where the word before the label varies."""
    rows = [(i, f"w{'abcdefghijkl'[i]} note\nPhone: +1 (300) 555-{1000 + i}") for i in range(12)]
    rows += [(50, "Phone: 0300-555-7777"), (51, "Email: a@b.c Phone: 0300-555-8888 end"), (52, "some\nPhone: 0300-555-9999"),
             (53, "Room: 0300-555-1111")]
    got, text = found(docs(spark, rows)), dict(rows)
    for i, want in ((50, "0300-555-7777"), (51, "0300-555-8888"), (52, "0300-555-9999")):
        assert [text[i][s:e] for k, s, e in got[i][1] if k == "phone"] == [want]
    assert got[53][1] == []


def test_discovered_spans_cover_spaced_identifiers(spark):
    rows = [(i, f"please call us +1 (300) 555-{1000 + i} today") for i in range(40)]
    want = ["020 7946 0958", "(020) 7946 - 0959", "020 (7946)", "4111 1111 1111 1112", "020-7946 0960", "020 7946"]
    rows += [(50, f"please call us {want[0]}"), (51, f"please call us {want[1]}, or come"), (52, f"(please call us {want[2]})"),
             (53, f"please call us {want[3]}. 7 days"), (54, f"please call us {want[4]} 24x7"), (55, f"please call us {want[5]} 10.0.0.1 now")]
    got, text = found(docs(spark, rows)), dict(rows)
    for i, w in enumerate(want):
        assert [text[50 + i][s:e] for k, s, e in got[50 + i][1] if k == "phone"] == [w]
    assert [k for k, *_ in got[55][0]] == ["ip"]


def test_class_of_the_identifier_before_is_a_word(spark):
    rows = [(i, f"{w} u{w}@x.org tel +1 (300) 555-{1000 + i}") for i, w in enumerate("abcdefghijkl")]
    rows += [(100 + i, f"x{w} tel {i}") for i, w in enumerate("abcdefghijkl")] + [(50, "q v@y.org tel 0300-555-7777")]
    got, text = found(docs(spark, rows)), dict(rows)
    assert [text[50][s:e] for k, s, e in got[50][1] if k == "phone"] == ["0300-555-7777"]
    assert all(got[100 + i][1] == [] for i in range(12))


def test_rounds_go_on_until_no_token_is_added(spark):
    """Each label shares its tokens with the next: six hops from the seeds."""
    names = ["la", "lb", "lc", "ld", "le", "lf", "lg"]
    rows = [(i, f"x la: +1 (300) 555-{1000 + i}") for i in range(30)]
    tokens = lambda h: [f"0{h}00-555-{7000 + i}" for i in range(5)]
    for h, name in enumerate(names):
        rows += [(100 * (h + 1) + i, f"x {name}: {t}") for i, t in enumerate(tokens(h))]
        if h:                                                    # the tokens of the label before, which make it confident
            rows += [(100 * (h + 1) + 50 + i, f"x {name}: {t}") for i, t in enumerate(tokens(h - 1) + tokens(h)[:1])]
            rows += [(100 * (h + 1) + 60 + j, f"x {name}: {t}") for j, t in enumerate(f"+1 (300) 555-{h}{100 + i}" for i in range(20))]
    got = found(docs(spark, rows))
    assert all([k for k, *_ in got[100 * (h + 1) + i][1]] == ["phone"] for h in range(7) for i in range(5))


def test_odd_rows(spark):
    got = found(docs(spark, ODD))
    texts = {r[0]: r[1] for r in ODD}
    assert {i: x[0] for i, x in got.items()} == {i: brute(t) for i, t in texts.items()}
    assert pii.find_personal_data(docs(spark, ODD)).count() == len(ODD)
    assert pii.find_personal_data(docs(spark, ODD).limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = pii.op3_pii(spark, "/root/testdata/sf0.001").select(F.col("spans"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
