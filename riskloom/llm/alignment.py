"""Alignment of two tokenizers over the bytes of the same texts.

Both tokenizers work through a text with a space before it, so their tokens
cover the same bytes.  For a batch of documents the starts of all tokens of
either side go through pandas.merge_asof, keyed by document: each token start
finds the other side's token that covers it.  The union of both directions is
every pair of tokens whose byte ranges overlap; a start that both sides have
begins a group (the place where tokens of both sides end together).

Batches are written as blocks: the tokens as a dictionary of the text's pieces
(cut before spaces, where neither tokenizer has a token across) and, for each
token, how far its covering token moved on.  Ids, links and groups of a document are
read back from its block.  Counts of id pairs are added up over all blocks;
blocks look them up in a broadcast table of at most `max_pairs` pairs.  If the
corpus has more, the table is dealt into parts by hash, each small enough, and
the parts' sums are added.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table, written
from .langid import _pieces
from .lm import pack, unpack

BATCH_CHARS = 1 << 20
MEMO = 400_000
MAX_PAIRS = 1 << 22
_CUT = re.compile(r"(?<=\S)(?= )")
_JOINED = re.compile(r"\s ")
_MARK = "▁"
#: What follows an id in the written form of groups: next of its side, other side, next group, nothing.
_AFTER = (",", "|", ";", "")


def byte_of_char() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes for bytes: printable
    Latin-1 for itself, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def pieces(text: str) -> list[str]:
    """`text` with a space before it, cut before each space that follows no white space."""
    if not text.startswith(" ") and not _JOINED.search(text):
        return [" " + p for p in text.split(" ")]
    return _CUT.split(" " + text)


class TokenizerPair:
    """Both tokenizers, with memory for pieces."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"           # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True                      # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_of_char()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            token = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(token[3:5], 16)]) if self.b.is_byte(i) else token.replace(_MARK, " ").encode())
        if any(_MARK in t.lstrip(_MARK) for t in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError("pieces that go on over a space cannot be cut before spaces")
        self.len_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.len_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.space = self.b.piece_to_id(_MARK)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        #: For each lot of pieces learned together: ids of either side and how many a piece has; whether both sides keep its bytes.
        self.lots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def learn(self, some: list[str]) -> None:
        for at in range(0, len(some), 20_000):
            new = some[at:at + 20_000]
            got_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            # the library puts a space before
            got_b = [b if len(p) > 1 else [self.space] for p, b in zip(new, self.b.encode([p[1:] for p in new], num_threads=1))]
            size = np.fromiter((len(p.encode()) for p in new), np.int64, len(new))
            raw, same, lot = "".join(new).encode(), np.ones(len(new), bool), []
            for got, table, lens in ((got_a, self.bytes_a, self.len_a), (got_b, self.bytes_b, self.len_b)):
                n = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter(itertools.chain.from_iterable(got), np.int64, int(n.sum()))
                total = np.concatenate(([0], np.cumsum(lens[flat])))[np.concatenate(([0], np.cumsum(n)))]
                if (np.diff(total) != size).any() or b"".join(map(table.__getitem__, flat.tolist())) != raw:
                    same &= [b"".join(map(table.__getitem__, ids)) == p.encode() for p, ids in zip(new, got)]
                lot += [n, flat.astype(np.uint32)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.lots.append((*lot, same))

    def tables(self) -> list[np.ndarray]:
        """n_a, flat_a, n_b, flat_b, same of all known pieces, by their numbers."""
        if len(self.lots) > 1:
            self.lots = [tuple(np.concatenate(x) for x in zip(*self.lots))]
        empty = np.zeros(0, np.int64)
        return list(self.lots[0]) if self.lots else [empty, empty, empty, empty, empty.astype(bool)]

    def tokens_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, one after another, and how many a text has (none for one without tokens)."""
        if len(self.known) > MEMO:
            self.clear()
        cut = [pieces(t) if t else [] for t in texts]
        self.learn([p for p in set().union(*cut) if p not in self.known])
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        same = self.tables()[4]
        if len(numbers) and not same.all():
            owner = np.repeat(np.arange(len(cut)), per_text)
            bad = [i for i in np.unique(owner[~same[numbers]]).tolist() if not self._bytes_hold(texts[i], numbers[owner == i])]
            numbers = numbers[~np.isin(owner, bad)]
            per_text[bad] = 0
        return numbers, per_text

    def rows(self, kinds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side the offsets and the ids of some pieces."""
        n_a, flat_a, n_b, flat_b, _ = self.tables()
        out = []
        for n, flat in ((n_a, flat_a), (n_b, flat_b)):
            ids, some = _spread(np.concatenate(([0], np.cumsum(n))), flat, kinds)
            out.append((np.concatenate(([0], np.cumsum(some))), ids))
        return out

    def _bytes_hold(self, text: str, numbers: np.ndarray) -> bool:
        raw = (" " + text).encode()
        return all(b"".join(map(table.__getitem__, ids.tolist())) == raw
                   for (_, ids), table in zip(self.rows(numbers), (self.bytes_a, self.bytes_b)))


@functools.cache
def _pair(path_a: str, path_b: str) -> TokenizerPair:
    return TokenizerPair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def covers(start_a: np.ndarray, doc_a: np.ndarray, start_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either side the number of the other side's token that covers its start."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a), dtype=np.int32)})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b), dtype=np.int32)})
    return (pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy(np.int64),
            pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy(np.int64))


def _spread(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows of a flat table, one after another, and their numbers."""
    n = offsets[rows + 1] - offsets[rows]
    at = np.arange(int(n.sum())) + np.repeat(offsets[rows] - (np.cumsum(n) - n), n)
    return flat[at], n


class Aligned:
    """Tokens of a block's documents and the tokens that cover their starts."""

    def __init__(self, numbers: np.ndarray, per_doc: np.ndarray, off_a: np.ndarray, flat_a: np.ndarray,
                 off_b: np.ndarray, flat_b: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
        self.a, n = _spread(off_a, flat_a, numbers)
        self.doc_a = np.repeat(doc, n)
        self.b, n = _spread(off_b, flat_b, numbers)
        self.doc_b = np.repeat(doc, n)
        self.docs = len(per_doc)
        self.n_a, self.n_b = (np.bincount(d, minlength=self.docs) for d in (self.doc_a, self.doc_b))

    def join(self, one: TokenizerPair) -> Aligned:
        ends = [np.cumsum(one.len_a[self.a]), np.cumsum(one.len_b[self.b])]
        self.cover_a, self.cover_b = covers(ends[0] - one.len_a[self.a], self.doc_a, ends[1] - one.len_b[self.b], self.doc_b)
        return self

    def first_in_group(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether both sides start where the token starts."""
        return (self.cover_b[self.cover_a] == np.arange(len(self.a)), self.cover_a[self.cover_b] == np.arange(len(self.b)))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of A and B and the document of every overlapping pair."""
        more = np.flatnonzero(~self.first_in_group()[1])
        return (np.concatenate((np.arange(len(self.a)), self.cover_b[more])), np.concatenate((self.cover_a, more)),
                np.concatenate((self.doc_a, self.doc_b[more])))

    def pair_codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.b[b].astype(np.uint64) << np.uint64(32)) | self.a[a].astype(np.uint64)

    def group_texts(self, table: pa.Array) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document; empty without tokens."""
        if not len(self.a):
            return [b""] * self.docs
        new_a, new_b = self.first_in_group()
        at_a, at_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
        n_a, n_b = np.bincount(at_a), np.bincount(at_b)
        codes = np.empty(len(self.a) + len(self.b), np.int32)
        last_a, last_b = np.append(new_a[1:], True), np.append(new_b[1:], True)
        ends = np.append(self.doc_b[1:] != self.doc_b[:-1], True)
        codes[np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[at_a]] = self.a.astype(np.int32) * 4 + last_a
        codes[np.arange(len(self.b)) + np.cumsum(n_a)[at_b]] = self.b.astype(np.int32) * 4 + np.where(ends, 3, last_b * 2)
        cells = table.take(pa.array(codes))
        _, offsets, data = cells.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(cells) + 1)
        cut = offsets[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        view = memoryview(data)
        return [bytes(view[s:e]) for s, e in zip(cut.tolist(), cut[1:].tolist())]


@functools.cache
def _cells(size: int) -> pa.Array:
    return pa.array([f"{i}{after}" for i in range(size) for after in _AFTER], pa.large_string())


_BLOCK = "block long, n_pieces binary, numbers binary, n_a binary, a binary, n_b binary, b binary, step_a binary, step_b binary, codes binary, counts binary"


def aligned_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
                   batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs (id, text) -> one row per batch of whole documents, written and read again.
    A document whose joined tokens of a side differ from its bytes has no tokens."""
    if path_a is None or path_b is None:
        path_a, path_b = (given or usual for given, usual in zip((path_a, path_b), default_paths()))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, one = TaskContext.get().partitionId(), 0, _pair(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in _pieces([t or "" for t in texts], batch_chars):
                numbers, per_doc = one.tokens_of(texts[s])
                kinds, at = np.unique(numbers, return_inverse=True)
                (off_a, flat_a), (off_b, flat_b) = one.rows(kinds)
                got = Aligned(at, per_doc, off_a, flat_a, off_b, flat_b).join(one)
                a, b, _ = got.links()
                codes, counts = np.unique(got.pair_codes(a, b), return_counts=True)
                columns = [pack(per_doc.astype(np.uint32)), pack(at.astype(np.uint32)),
                           pack(np.diff(off_a).astype(np.uint32)), pack(flat_a.astype(np.uint32)),
                           pack(np.diff(off_b).astype(np.uint32)), pack(flat_b.astype(np.uint32)),
                           pack(np.diff(got.cover_a, prepend=0).astype(np.uint32)),
                           pack(np.diff(got.cover_b, prepend=0).astype(np.uint32)),
                           pack(np.diff(codes, prepend=np.uint64(0))), pack(counts.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + seq], pa.int64()), *[pa.array([c], pa.binary()) for c in columns],
                     pa.ListArray.from_arrays(pa.array([0, len(per_doc)], pa.int32()),
                                              batch.column(0).slice(s.start, len(per_doc)))],
                    [*(f.split()[0] for f in _BLOCK.split(", ")), "ids"])
                seq += 1

    return written(docs.select("id", "text").mapInArrow(run, f"{_BLOCK}, ids array<{kind}>"), "aligned")


def _read(row: dict) -> Aligned:
    n_a, n_b = (unpack(row[c], np.uint32).astype(np.int64) for c in ("n_a", "n_b"))
    got = Aligned(unpack(row["numbers"], np.uint32).astype(np.int64), unpack(row["n_pieces"], np.uint32),
                  np.concatenate(([0], np.cumsum(n_a))), unpack(row["a"], np.uint32),
                  np.concatenate(([0], np.cumsum(n_b))), unpack(row["b"], np.uint32))
    got.cover_a, got.cover_b = (np.cumsum(unpack(row[c], np.uint32).astype(np.int64)) for c in ("step_a", "step_b"))
    return got


_READ = ["ids", "block", "n_pieces", "numbers", "n_a", "a", "n_b", "b", "step_a", "step_b"]


def _list(values: np.ndarray, per_doc: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_doc)))), pa.array(values.astype(np.int32)))


def alignments(blocks: DataFrame) -> DataFrame:
    """One row per document: id, a and b (token ids), new_a and new_b (whether
    a token begins a group), link_a and link_b (token places of each overlapping
    pair, from 0)."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]           # one block at a time
                got = _read(row)
                a, b, doc = got.links()
                order = np.lexsort((b, a, doc))
                a, b, doc = a[order], b[order], doc[order]
                first_a, first_b = np.cumsum(got.n_a) - got.n_a, np.cumsum(got.n_b) - got.n_b
                n = np.bincount(doc, minlength=got.docs)
                new = [_list(x, m).cast(pa.large_list(pa.bool_())) for x, m in zip(got.first_in_group(), (got.n_a, got.n_b))]
                lists = [_list(got.a, got.n_a), _list(got.b, got.n_b), *new, _list(a - first_a[doc], n), _list(b - first_b[doc], n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, *[x.cast(pa.list_(x.type.value_type)) for x in lists]],
                    ["id", "a", "b", "new_a", "new_b", "link_a", "link_b"])

    return blocks.select(*_READ).mapInArrow(
        run, f"id {kind}, a array<int>, b array<int>, new_a array<boolean>, new_b array<boolean>, "
             "link_a array<int>, link_b array<int>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair of ids in all blocks, and whether no
    other pair of the same b has more."""
    def add(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        kinds, at = np.unique(np.concatenate(codes), return_inverse=True)
        return kinds, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def rows() -> pa.RecordBatch:
            k, n = add(codes, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array((k >> np.uint64(32)).astype(np.int32)),
                 pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for c, n in zip(batch.column(0), batch.column(1)):
                codes.append(np.cumsum(unpack(c.as_py(), np.uint64), dtype=np.uint64))
                counts.append(unpack(n.as_py(), np.uint32).astype(np.int64))
                if sum(map(len, codes)) > MAX_PAIRS:
                    got = add(codes, counts)
                    codes[:], counts[:] = [got[0]], [got[1]]
                    if len(got[0]) > MAX_PAIRS // 2:
                        yield rows()
                        codes[:], counts[:] = [got[0][:0]], [got[1][:0]]
        yield rows()

    pairs = (blocks.select("codes", "counts").mapInArrow(run, "a int, b int, n long")
             .groupBy("b", "a").agg(F.sum("n").alias("n")))
    # at most one row per id of A under a b
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _summaries(blocks: DataFrame, pairs: DataFrame, cells: int) -> DataFrame:
    """Digest columns of every document, its links looked up in `pairs` alone."""
    got = pairs.select("a", "b", "n", "best").toArrow()
    code = (got["b"].to_numpy().astype(np.uint64) << np.uint64(32)) | got["a"].to_numpy().astype(np.uint64)
    order = np.argsort(code)
    shared = blocks.sparkSession.sparkContext.broadcast(
        (code[order], got["n"].to_numpy()[order], got["best"].to_numpy(zero_copy_only=False)[order]))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]           # one block at a time
                got = _read(row)
                a, b, doc = got.links()
                here = got.pair_codes(a, b)
                at = np.minimum(np.searchsorted(known, here), max(0, len(known) - 1))
                there = known[at] == here if len(known) else np.zeros(len(here), bool)
                # sums of integers: exact in float64 up to 2^53, so counts are added in two halves
                count = np.where(there, n[at], 0) if len(known) else np.zeros(len(here), np.int64)
                low, high = (np.bincount(doc, x, got.docs).astype(np.int64) for x in (count & 0xFFFFFF, count >> 24))
                ok = np.bincount(doc, there & best[at] if len(known) else there, got.docs).astype(np.int64)
                texts = got.group_texts(_cells(cells))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(np.full(got.docs, row["block"])), pa.array(np.arange(got.docs)),
                     pa.array(got.n_a.astype(np.int64)), pa.array(got.n_b.astype(np.int64)),
                     pa.array(np.bincount(got.doc_a, got.first_in_group()[0], got.docs).astype(np.int64)),
                     pa.array(np.bincount(doc, minlength=got.docs)), pa.array(ok), pa.array(low + (high << 24)),
                     pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())],
                    ["id", "block", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return blocks.select(*_READ).mapInArrow(
        run, f"id {kind}, block long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
             "count_sum long, groups_sha256 string")


def alignment_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                      path_b: str | None = None, max_pairs: int = MAX_PAIRS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Defined results: a null or empty text, or one whose bytes a tokenizer does
    not keep, has no tokens: zeros and an empty groups_sha256; pairs of equal
    count under a B id are all its best; repeated rows are counted and returned
    each; an empty table gives an empty result; other columns are not read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    blocks = aligned_blocks(src, path_a, path_b, batch_chars)
    pairs = cut_lineage(pair_counts(blocks))
    top = pairs.agg(F.greatest(F.max("a"), F.max("b"))).first()[0]
    parts = -(-pairs.count() // max_pairs)
    if parts <= 1:
        got = _summaries(blocks, pairs, (top or 0) + 1)
    else:
        part = F.pmod(F.xxhash64("a", "b"), F.lit(2 * parts))    # parts of about half the bound, so that none is above it
        some = [_summaries(blocks, pairs.filter(part == i), top + 1) for i in range(2 * parts)]
        got = functools.reduce(DataFrame.unionByName, some).groupBy("block", "row").agg(
            F.first("id").alias("id"), *[F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")],
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return got.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_summary(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
