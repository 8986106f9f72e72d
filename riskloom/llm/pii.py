"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans come from four regular expressions (leftmost, non-overlapping per
kind).  They seed the bootstrap: the word before an identifier-like token and
the two words before it are lexical patterns, with a mark for the start of a
text or line and the class of an identifier in place of a word; patterns and
tokens form a bipartite graph over the whole corpus, scored in rounds until
nothing changes.  A pattern's confidence for a kind is the mean score of its
distinct tokens, a token's score the noisy-or of its confident patterns; tokens
that confident patterns introduce and no base expression knows become further
spans of that kind.

Only DataFrame operations.  The expressions below are written so that Java's
matcher neither recurses nor restarts inside a run of one class (possessive
repetitions, a run starts where the last match ended or after another
character); they find the matches of the plain forms in the operator's
contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A group of digits of a spaced identifier: brackets, no part of a word and no IP address.
_GROUP = (r"\(*+(?![0-9]++(?:\.[0-9]++){3}(?![.]?[0-9]))[0-9]++(?:[.()/-]++[0-9]++)*+\)*+"
          r"(?=[.,;:!?\]}>\x22']*+(?![^\x20\x09-\x0D]))")
#: Groups joined by single spaces and hyphens, or else one word with a digit or an @.
_TOKEN = (r"(?<![^\x20\x09-\x0D])(?:[\[{<(\x22']*+\+?+" + _GROUP + r"(?:\x20(?:-\x20)?+" + _GROUP + r")*+"
          r"|[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]*+")
#: The last two words of a stretch, found in the reversed stretch.
_CONTEXT = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)([\x20\x09-\x0D]*+)([^\x20\x09-\x0D]*+)"
#: Start of a text or line, in patterns; no word is white space, none before a token has a digit or an @.
_START = "\n"
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
_BIN = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def text_key(text: Column) -> list[Column]:
    """Two hashes that name a text: equal texts have equal spans."""
    return [F.xxhash64(text).alias("u1"), F.hash(F.reverse(text)).alias("u2")]


def _pieces(text: Column, kind: str, pattern: str, may: Column) -> Column:
    """struct(kind, pieces): each match with the length of the stretch before it, a token also with its last words, reversed."""
    def piece(gap: Column, match: Column) -> Column:
        words = F.regexp_extract(F.reverse(gap), _CONTEXT, 0) if kind == "token" else F.lit("")
        return F.struct(F.length(gap).alias("gap"), words.alias("before"), match.alias("match"))

    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece)
    return F.struct(F.lit(kind).alias("kind"), F.when(may, pieces).alias("pieces"))


def _patterns(order: Window) -> Column:
    """The patterns of a token: the word before it, the two words before it and,
    at a line's first word, the mark with that word.  The mark stands for the
    word before a text's first, the class of an identifier for the identifier."""
    def word(i: int) -> Column:
        return F.lower(F.reverse(F.regexp_extract("before", _CONTEXT, i)))

    def named(match: Column) -> Column:
        return (F.when(match.isNull(), _START).when(F.contains(match, F.lit("@")), "@")
                .when(match.rlike(r"^[^0-9]*+[0-9]++(?:\.[0-9]++){3}(?![.]?[0-9])"), "0.0.0.0").otherwise("0"))

    last, older = word(1), word(3)
    prev, prev_last = F.lag("match").over(order), F.lag(last).over(order)
    two = F.concat_ws(" ", F.when(older != "", older).otherwise(named(prev)), last)
    line = F.when(F.regexp_extract("before", _CONTEXT, 2).rlike("[\n\r]"), F.concat_ws(" ", F.lit(_START), last))
    after = F.concat_ws(" ", F.when(prev_last != "", prev_last).otherwise(named(F.lag("match", 2).over(order))), named(prev))
    return (F.when(last != "", F.array_distinct(F.array_compact(F.array(last, two, line))))
            .when(prev.isNotNull(), F.array(after)).otherwise(F.array().cast("array<string>")))


def matches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(u1, u2, kind, start, end, match, patterns) of every distinct text's
    matches, those of kind token being identifier-like words (with a digit or
    an @) and runs of groups of digits.  Positions are running sums over a
    text's pieces."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    may = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+"))}
    kinds = [_pieces(t, k, PATTERNS[k], may[k]) for k in KINDS] + [_pieces(t, "token", _TOKEN, digit | may["email"])]
    rows = (docs.select(docs[text_col].alias("t")).select(*text_key(t), F.inline(F.array(*kinds)))
            .select("u1", "u2", "kind", F.posexplode("pieces").alias("pos", "p")).filter("p.match is not null")
            .select("u1", "u2", "kind", "pos", "p.gap", "p.before", "p.match").distinct())
    order = Window.partitionBy("u1", "u2", "kind").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto).cast("int"))
              .withColumn("patterns", F.when(F.col("kind") == "token", _patterns(order))))
    valid = F.lit(True)
    for k in KINDS:
        valid = F.when(F.col("kind") == k, _valid(k, F.col("match"))).otherwise(valid)
    return placed.filter(valid).select("u1", "u2", "kind", (F.col("end") - F.length("match")).alias("start"), "end",
                                       "match", "patterns")


def _bins(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.expr(f"sequence(int(start / {_BIN}), int((end - 1) / {_BIN}))")))


def _count(col: str, char: str) -> Column:
    return F.length(col) - F.length(F.replace(F.col(col), F.lit(char), F.lit("")))


def bootstrap(found: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """found: matches().  Returns (u1, u2, kind, start, end) of the identifiers
    that confident patterns add.  No score falls from one round to the next, so
    the rounds end."""
    key = ["u1", "u2"]
    base = found.filter("kind <> 'token'").select(*key, "start", "end", "kind", F.col("match").alias("entity"))
    tokens = (found.filter("kind = 'token'")
              .withColumn("lead", F.length("match") - F.length(F.ltrim("match", F.lit("([{<\"'"))))
              .withColumn("token", F.btrim("match", F.lit("([{<\"'.,;:!?)]}>")))
              .withColumn("size", F.length("token"))
              # brackets that pair with one inside belong to the identifier
              .withColumn("open", _count("token", "(") - _count("token", ")"))
              .withColumn("less", F.when((F.col("open") < 0) & (F.substr("match", F.col("lead"), F.lit(1)) == "("), 1).otherwise(0))
              .withColumn("more", F.when((F.col("open") > 0) & (F.substr("match", F.col("lead") + F.col("size") + 1, F.lit(1)) == ")"), 1)
                          .otherwise(0))
              .withColumn("lead", F.col("lead") - F.col("less"))
              .withColumn("token", F.substr("match", F.col("lead") + 1, F.col("size") + F.col("less") + F.col("more")))
              .filter((F.col("token") != "") & (F.size("patterns") > 0))
              .select(*key, (F.col("start") + F.col("lead")).alias("start"),
                      (F.col("start") + F.col("lead") + F.length("token")).alias("end"), "token", "patterns"))
    tokens = cut_lineage(tokens)
    over = (_bins(tokens).select(*key, "bin", "start", "end")
            .join(_bins(base).select(*key, "bin", F.col("start").alias("s"), F.col("end").alias("e"), "kind", "entity"),
                  [*key, "bin"])
            .filter("s < end and start < e").groupBy(*key, "start", "end")
            .agg(F.min(F.struct("s", "kind", "entity")).alias("seed")))
    # a token that a base span starts in stands for that whole entity; one inside a span is no instance
    marked = cut_lineage(tokens.join(over, [*key, "start", "end"], "left").filter("seed is null or seed.s >= start")
                         .withColumn("known", F.col("seed.kind"))
                         .withColumn("token", F.coalesce("seed.entity", "token")).drop("seed"))
    marked = marked.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = cut_lineage(marked.groupBy("pattern", "token").agg(F.min("known").alias("known")))
    seeds = edges.filter("known is not null").select("token", F.col("known").alias("kind")).distinct()
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    scores = seeds.withColumn("score", F.lit(1.0))
    before, now = None, (-1, 0.0)
    while before is None or now[0] != before[0] or now[1] - before[1] > 1e-9 * now[1]:
        confident = cut_lineage(
            edges.select("pattern", "token").join(scores, "token").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support")).join(total, "pattern")
            .withColumn("confidence", F.col("sum") / F.col("all"))
            .filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
            .select("pattern", "kind", "confidence"))
        found_now = (edges.filter("known is null").join(confident, "pattern").groupBy("token", "kind")
                     .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("score")))
        scores = cut_lineage(seeds.withColumn("score", F.lit(1.0))
                             .unionByName(found_now.filter(F.col("score") >= min_confidence)))
        state = scores.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()
        before, now = now, (state["n"], state["s"])
    best = (scores.join(seeds.select("token").distinct(), "token", "left_anti")
            .groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")))
    return (marked.filter("known is null").join(confident.select("pattern", "kind"), "pattern")
            .join(best, ["token", "kind"]).select(*key, "kind", "start", "end").distinct())


def find_personal_data(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows without the text, plus base (array of kind, start, end in the
    order of KINDS, then start) and spans (base and discovered ones, likewise).

    Defined results: a null text is empty and has no spans; equal texts have
    equal spans; an empty table gives an empty result; other columns stay (those named
    base or spans are replaced).  Positions are code points, the end exclusive.
    """
    cols = [c for c in docs.columns if c not in (text_col, "base", "spans")]
    rank = F.when(F.col("kind") == KINDS[0], 0)
    for i, k in enumerate(KINDS[1:], 1):
        rank = rank.when(F.col("kind") == k, i)
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    found = cut_lineage(matches(docs, text_col))
    known = found.filter("kind <> 'token'").select("u1", "u2", span.alias("s"), F.lit(True).alias("base"))
    more = bootstrap(found, **options).select("u1", "u2", span.alias("s"), F.lit(False).alias("base"))
    by_text = known.unionByName(more).groupBy("u1", "u2").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("base"),
        F.array_sort(F.collect_list("s")).alias("spans"))
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)], *text_key(docs[text_col]))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")

    def plain(spans: str) -> Column:
        return F.transform(F.coalesce(F.col(spans), none), lambda s: F.struct(s["kind"], s["start"], s["end"]))

    return src.join(by_text, ["u1", "u2"], "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], plain("base").alias("base"), plain("spans").alias("spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_personal_data(docs)
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *count, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
                      _digest(F.col("spans")).alias("spans"))
