"""Account rows from profile and media documents, against the row written out in Python."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from riskloom.sources import records as R

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def stamp(days, form="+0000"):
    return (NOW - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S") + form


CASES = {
    1: ({"username": "b0t_4417", "biography": "Visit HTTP://x", "followers_count": 10, "follows_count": 4, "media_count": 3,
         "is_verified": True, "profile_picture_url": "p"},
        [{"caption": "win  a Prize", "like_count": 4, "timestamp": stamp(3, "Z")}, {"caption": "a prize today", "like_count": None, "timestamp": stamp(40)},
         {"caption": None, "timestamp": ""}]),
    2: ({"username": None, "biography": None, "profile_picture_url": ""}, []),
    3: ({"username": "aabbbc", "followers_count": 5}, [{"caption": "one"}, {"caption": "two", "timestamp": "not a time"}]),
    4: ({"username": "Ünï_x"}, [{"caption": f"word{i} same", "like_count": 1, "timestamp": stamp(i, "+02:00")} for i in range(30)]),
    5: ({"username": "new"}, [{"caption": "x", "timestamp": stamp(0)}]),
}


def want(profile, media):
    media = media[:R.MEDIA_LIMIT]
    u, bio = profile.get("username") or "", profile.get("biography") or ""
    captions = [m.get("caption") or "" for m in media]
    sets = [set(c.lower().split()) for c in captions if c]
    pairs = [len(a & b) / max(len(a | b), 1) for i, a in enumerate(sets) for b in sets[i + 1:]]
    sim = sum(pairs) / len(pairs) if len(captions) > 1 and pairs else 0.0
    spam = sum(any(w in c.lower() for w in R.CAPTION_SPAM_KEYWORDS) for c in captions) / len(captions) if captions else 0.0
    try:
        oldest = min(datetime.fromisoformat(m["timestamp"].replace("Z", "+00:00")) for m in media if m.get("timestamp"))
        age = max(1, (NOW - oldest).days)
    except ValueError:
        age = 365
    fo, fi, po = (profile.get(k) or 0 for k in ("followers_count", "follows_count", "media_count"))
    likes, digits = sum(m.get("like_count") or 0 for m in media), sum(c.isdigit() for c in u)
    return dict(zip(R.RECORD_COLUMNS, [
        u, bio, int(bool(profile.get("profile_picture_url"))), len(bio), int(digits / max(len(u), 1) > 0.4), fo, fi, fo / max(fi, 1),
        age, po, po / max(age, 1), sim, sim * 0.8, 0, spam, spam * 0.5, int("http" in bio.lower() or "bit.ly" in bio.lower()),
        int(bool(profile.get("is_verified"))), len(u), digits, digits / max(len(u), 1), sum(not c.isalnum() for c in u),
        sum(a == b for a, b in zip(u, u[1:])), likes / max(po, 1), 0, likes]))


def records(spark, rows):
    df = spark.createDataFrame(rows, "id long, profile string, media string")
    return R.account_record(df, "profile", "media", F.lit(NOW), ["id"])


def test_rows_written_out(spark):
    got = {r.id: r for r in records(spark, [(i, json.dumps(p), json.dumps(m)) for i, (p, m) in CASES.items()]).collect()}
    for i, (p, m) in CASES.items():
        row = got[i].asDict()
        assert list(row) == ["id", *R.RECORD_COLUMNS]
        for c, x in want(p, m).items():
            assert abs(row[c] - x) < 1e-12 if isinstance(x, float) else row[c] == x, (i, c, row[c], x)


def test_unreadable_documents_read_as_empty(spark):
    got = records(spark, [(1, None, None), (2, "{", "[{"), (3, "{}", "[]")]).drop("id").collect()
    assert [r.asDict() for r in got] == [want({}, [])] * 3
    assert records(spark, []).count() == 0


def test_newest_media_keeps_the_limit(spark):
    rows = [(k, f"c{i}", i, 0, f"t{i}", i) for k, n in ((1, 50), (2, 3)) for i in range(n)]
    items = spark.createDataFrame(rows, "k long, caption string, like_count long, comments_count long, timestamp string, at long").repartition(4)
    got = {r.k: [x["caption"] for x in json.loads(r.media)] for r in R.newest_media(items, "k", [F.col("at").desc()]).collect()}
    assert got == {1: [f"c{i}" for i in range(49, 29, -1)], 2: ["c2", "c1", "c0"]}
