"""Spelling variants by search schemes over FM-indexes of the vocabulary.

Words one inserted, deleted or replaced code point apart agree on their first
or on their last half: with m the length of the shorter one, on its first m // 2
code points or on its last m - m // 2.  So the vocabulary is dealt into shards
by (m, side, that half), a word into those of its own length and of the length
below it, and a word meets all its neighbours.  A shard is indexed as the
delimited text of its words.  Its suffix-rank intervals are extended to the
right from a delimiter in the shards of first halves (an FM-index of the words
written backwards) and to the left in those of last halves (an FM-index of the
words as they are): one half exactly, then across the other with one error, and
to a delimiter.  Every search begins at a delimiter, so it never changes its
direction and needs one interval of the two.  Delimiters are in the order of
the words after them, so the last interval is the number of the word found.

Shards hold about SHARD_WORDS words.  A half that more words share than that is
dealt into blocks, and every block of its words as queries meets every block of
them as index, so no task holds more than two blocks.  Neighbours are counted
and compared in the task; one row per word and shard leaves it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read_table, written

MIN_CHARS = 5
MIN_COUNT = 3
TYPO_EVERY = 97
SHARD_WORDS = 12_000
_FLUSH = 400_000
#: One byte for each code point up to U+00FF: letters small, anything else a space.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, as Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def typo(name: str, run: bytes, every: int = TYPO_EVERY) -> bytes:
    """The run, without one code point where the hash of name and run says so."""
    h = zlib.crc32(f"{name}:{run.decode('latin-1')}".encode())
    if not every or h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = TYPO_EVERY) -> DataFrame:
    """docs (id, text) -> (word, n) of the words that are long and frequent enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                prefix = zlib.crc32(f"{name}:".encode()) if name is not None else zlib.crc32(b":")
                for w, n in Counter(runs(text)).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix)
                    if every and not h % every:
                        w = w[:h % len(w)] + w[h % len(w) + 1:]
                    if len(w) >= min_chars:
                        counts[w] += n
                if len(counts) > _FLUSH:
                    yield flush()
        yield flush()

    return (docs.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


class ReverseIndex:
    """FM-index of "$w$w...$" with each word written backwards: prepending a
    symbol to a pattern extends the words it stands for by one to the right."""

    def __init__(self, words: list[str], alphabet: str) -> None:
        self.order = sorted(range(len(words)), key=lambda i: words[i][::-1])
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        text = np.fromiter((x for i in self.order for x in (0, *(code[c] for c in reversed(words[i])))), np.int64,
                           sum(map(len, words)) + len(words))
        text = np.append(text, 0)
        n, self.sigma = len(text), len(alphabet) + 2             # the delimiter first, one symbol that no word has last
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.append(np.arange(1, len(ends)), 0)       # the last delimiter begins the smallest suffix
        reach = 1
        while True:                                              # delimiters differ, so a word's length bounds the rounds
            key = rank * (n + len(ends) + self.sigma) + np.append(rank[reach:], np.zeros(min(reach, n), np.int64))[:n]
            suffixes = np.argsort(key, kind="stable")
            steps = np.append(False, np.diff(key[suffixes]) != 0)
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(steps)
            if rank[suffixes[-1]] == n - 1:
                break
            reach *= 2
        last = text[suffixes - 1]
        self.seen = np.zeros((n + 1, self.sigma), np.int32)      # symbols of each kind before a row, plus those of smaller kinds
        self.seen[np.arange(1, n + 1), last] = 1
        np.cumsum(self.seen, axis=0, out=self.seen)
        self.seen += np.append(0, np.cumsum(np.bincount(text, minlength=self.sigma)))[:-1].astype(np.int32)
        self.words = len(words)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.seen[low, symbol], self.seen[high, symbol]


def one_error_apart(index_words: list[str], queries: list[str], m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, index number) of all words of length m or m + 1 that agree
    on their first `half` symbols, differ by one error after them and are not
    both of length m + 1."""
    none = np.zeros(0, np.int64)
    if not index_words or not queries:
        return none, none
    alphabet = "".join(sorted(set().union(*index_words)))
    index = ReverseIndex(index_words, alphabet)
    code = {c: i + 1 for i, c in enumerate(alphabet)}
    q = np.zeros((len(queries), m + 3), np.int64)
    for i, w in enumerate(queries):
        q[i, :len(w)] = [code.get(c, index.sigma - 1) for c in w]
    length = np.fromiter(map(len, queries), np.int64, len(queries))
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), index.words + 1)
    for i in range(half):
        low, high = index.extend(low, high, q[:, i])
    open_, found = [], []                                        # states after the error, all to go on at symbol i

    def keep(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = hi > lo
        return who[ok], lo[ok], hi[ok]

    for i in range(half, m + 2):
        later = []
        alive = np.flatnonzero((high > low) & (length >= i))
        short = alive[length[alive] == m]
        if len(short):
            lo, hi = index.seen[low[short], 1:-1], index.seen[high[short], 1:-1]
            at, symbol = np.nonzero(hi > lo)
            other = symbol + 1 != q[short[at], i]
            at, symbol = at[other], symbol[other]
            state = short[at], lo[at, symbol], hi[at, symbol]
            open_.append(state)                                  # inserted before symbol i
            inside = length[state[0]] > i
            later.append(tuple(x[inside] for x in state))        # in place of symbol i
        long = alive[(length[alive] == m + 1)]
        long = long[(length[long] > i) & (q[long, i] != q[long, i + 1])]
        later.append((long, low[long], high[long]))              # symbol i left out
        who, lo, hi = (np.concatenate(x) for x in zip(*open_)) if open_ else (none, none, none)
        lo, hi = index.extend(lo, hi, q[who, i])
        who, lo, hi = keep(who, lo, hi)
        ends = length[who] == i
        found.append((who[ends], lo[ends] - 1))
        open_ = [(who[~ends], lo[~ends], hi[~ends]), *later]
        low, high = index.extend(low, high, q[:, i])
    who, at = (np.concatenate(x) for x in zip(*found))
    return who, np.array(index.order, np.int64)[at]


_NEAR = "word string, n_near long, form string, form_n long"


def _shard_rows(m: int, side: int, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """One row per query with neighbours: their number and the most frequent, smallest one."""
    left = m // 2
    turn = (lambda w: w) if side == 0 else (lambda w: w[::-1])
    words, asked = index["word"].tolist(), queries["word"].tolist()
    who, at = one_error_apart([*map(turn, words)], [*map(turn, asked)], m, left if side == 0 else m - left)
    got = pd.DataFrame({"word": [asked[i] for i in who], "form": [words[i] for i in at], "form_n": index["n"].to_numpy()[at]})
    if side and len(got):                                        # those that agree on the first half too are found there
        got = got[[a[:left] != b[:left] for a, b in zip(got["word"], got["form"])]]
    got = got.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    got["n_near"] = got.groupby("word")["form"].transform("size")
    return got.drop_duplicates("word")[["word", "n_near", "form", "form_n"]].astype({"word": object, "form": object})


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """words (word, n), distinct -> (word, n_near, form, form_n): how many words are
    one error apart, and which of them is the most frequent (ties: smallest).
    Words without neighbours do not appear."""
    size = F.length("word")
    own = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= min_chars)
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")),
                    F.struct(F.lit(1).alias("side"), F.expr("right(word, m - cast(floor(m / 2) as int))").alias("half")))
    placed = own.withColumn("s", F.explode(sides)).select("m", "s.side", "s.half", "word", "n")
    groups = placed.groupBy("m", "side", "half").agg(F.count(F.lit(1)).alias("rows"))
    # one row per length and side; halves that too many words share are dealt into blocks of their own
    slots = cut_lineage(groups.filter(F.col("rows") <= shard_words // 2).groupBy("m", "side")
                        .agg(F.ceil(F.sum("rows") / shard_words).cast("int").alias("slots")))
    hot = cut_lineage(groups.filter(F.col("rows") > shard_words // 2).select(
        "m", "side", "half", F.ceil(F.col("rows") / shard_words).cast("int").alias("blocks")))
    at = (placed.join(hot, ["m", "side", "half"], "left").join(slots, ["m", "side"], "left")
          .withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int"))
          .withColumn("shard", F.when(F.col("blocks").isNull(), F.concat(F.lit("s"), F.pmod(F.xxhash64("half"), "slots")))
                      .otherwise(F.concat(F.lit("h"), "half"))))
    common = ["m", "side", "shard", "word", "n"]
    # a cell is (block as index, block as queries); a shard of usual size has the one cell (0, 0) and each word once
    usual = at.filter("blocks is null").select(*common, F.lit(0).alias("i"), F.lit(0).alias("j"),
                                               F.lit(True).alias("indexed"), F.lit(True).alias("asked"))
    large = at.filter("blocks is not null").withColumn("every", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (usual.unionByName(large.select(*common, F.col("own").alias("i"), F.col("every").alias("j"),
                                            F.lit(True).alias("indexed"), F.lit(False).alias("asked")))
             .unionByName(large.select(*common, F.col("every").alias("i"), F.col("own").alias("j"),
                                       F.lit(False).alias("indexed"), F.lit(True).alias("asked"))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _shard_rows(int(key[0]), int(key[1]), rows[rows["indexed"]], rows[rows["asked"]])

    near = dealt.groupBy("m", "side", "shard", "i", "j").applyInPandas(run, _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form or null) -> (word, root).  Roots go down from the words
    without a form, one step a round; a word is the form of at most the words
    one error apart, so no join key is hot."""
    forms = cut_lineage(forms.select("word", "form"))
    level = cut_lineage(forms.filter("form is null").select("word", F.col("word").alias("root")))
    rest = forms.filter("form is not null")
    out = level
    while not level.isEmpty():
        up = level.select(F.col("word").alias("form"), "root")
        level = cut_lineage(rest.join(up, "form").select("word", "root"))
        out = out.unionByName(level)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, every: int = TYPO_EVERY, shard_words: int = SHARD_WORDS,
                      ratio: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A word's form is its most frequent neighbour (ties: the smallest in
    code-point order) if that is at least `ratio` times as frequent; counts rise
    along forms, so roots exist.
    Defined results: a null or empty text has no words; a null id hashes as the
    empty string; repeated rows count each; an empty table gives an empty result;
    other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could go round in circles")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    words = written(vocabulary(src, min_chars, min_count, every), "words")
    near = neighbours(words, shard_words, min_chars)
    good = F.col("form_n") >= ratio * F.col("n")
    got = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"),
        F.when(good, F.col("form_n")).alias("form_n")))
    return got.join(roots(got), "word").select("word", "n", "n_near", "form", "form_n", "root")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
