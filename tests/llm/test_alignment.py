import hashlib
from collections import Counter

import pytest

from riskloom.llm import alignment

from .helpers import ODD, docs

HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b c", "\t a", "<|endoftext|> x <s></s> <unk>",
        "é ü  ñ \U0001F600 q", "a▁b", "▁ ▁", "x▁ y", "a\x1c b\x85 c   d　 e", "naive naıve café",
        "1 22  333 +1 (988) 555", "tail \n", "日本語 русский", "   lead", "word" * 500]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def tokens(text, libraries):
    """(ids, byte ends) of both sides, or None for a text without tokens: whole texts through the libraries."""
    a, b = libraries
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    back = {c: x for c, x in alignment.byte_of_char().items()}
    out = []
    for ids, parts in ((a.encode(" " + text, add_special_tokens=False).ids, None), (b.encode(text), 1)):
        if parts is None:
            parts = [bytes(back[c] for c in a.id_to_token(i)) for i in ids]
        else:
            parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                     for i in ids]
        if b"".join(parts) != raw:
            return None
        ends = [sum(map(len, parts[:k + 1])) for k in range(len(parts))] if len(parts) < 300 else None
        if ends is None:
            ends, at = [], 0
            for p in parts:
                at += len(p)
                ends.append(at)
        out.append((ids, ends))
    return out


def brute(rows, libraries):
    docs_, totals = [], Counter()
    for i, text in rows:
        got = tokens(text, libraries)
        links, groups = [], []
        if got:
            (a, ea), (b, eb) = got
            starts_a, starts_b, j = [0, *ea[:-1]], [0, *eb[:-1]], 0
            for k in range(len(a)):
                while eb[j] <= starts_a[k]:
                    j += 1
                x = j
                while x < len(b) and starts_b[x] < ea[k]:
                    links.append((a[k], b[x]))
                    x += 1
            cuts = sorted(set(ea) & set(eb))
            place = lambda ends: [sum(c < e for c in cuts) if len(cuts) < 50 else __import__("bisect").bisect_left(cuts, e) for e in ends]
            ga, gb = place(ea), place(eb)
            members = [([], []) for _ in cuts]
            for side, (ids, at) in enumerate(((a, ga), (b, gb))):
                for x, g in zip(ids, at):
                    members[g][side].append(str(x))
            groups = ["|".join(",".join(m) for m in g) for g in members]
        totals.update(links)
        docs_.append((i, len(got[0][0]) if got else 0, len(got[1][0]) if got else 0, links, groups))
    best = Counter()
    for (_, y), n in totals.items():
        best[y] = max(best[y], n)
    return sorted(((i, n_a, n_b, len(groups), len(links), sum(totals[x] == best[x[1]] for x in links), sum(totals[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, links, groups in docs_), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pieces_have_the_ids_of_the_whole(libraries):
    one = alignment.TokenizerPair(*alignment.default_paths())
    for text in [*HARD, *(t for _, t, *_ in ODD if t)]:
        if not text:
            continue
        assert "".join(alignment.pieces(text)) == " " + text
        numbers, per_text = one.tokens_of([text])
        assert per_text.sum() == len(numbers)
        want = tokens(text, libraries)
        got = [ids.tolist() for _, ids in one.rows(numbers)]
        assert tuple(got) == (
            (want[0][0], want[1][0]) if want else ([], [])), text[:40]


def test_query_against_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(alignment.op12_tokenizer_alignment(spark, sf)) == brute(rows, libraries)


def test_odd_rows_small_batches_and_parted_tables(spark, libraries):
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, t) for i, t in enumerate(HARD)]
    want, d = brute(rows, libraries), docs(spark, rows)
    assert result(alignment.alignment_summary(d)) == want
    assert result(alignment.alignment_summary(d, batch_chars=50)) == want
    assert result(alignment.alignment_summary(d, max_pairs=100)) == want
    assert alignment.alignment_summary(d.limit(0)).count() == 0
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in alignment.alignment_summary(docs(spark, [(1, None), (2, "")])).collect())


def test_alignments_of_documents(spark, libraries):
    src = docs(spark, [(i, t) for i, t in enumerate(HARD)]).select(docs(spark, []).columns[0], "text").withColumnRenamed("doc_id", "id")
    for r in alignment.alignments(alignment.aligned_blocks(src)).collect():
        want = tokens(HARD[r.id], libraries)
        (a, ea), (b, eb) = want if want else (([], []), ([], []))
        assert (r.a, r.b) == (a, b)
        ends = set(ea) & set(eb)
        assert r.new_a == [k == 0 or ea[k - 1] in ends for k in range(len(a))] and r.new_b == [k == 0 or eb[k - 1] in ends for k in range(len(b))]
        spans = lambda e: list(zip([0, *e[:-1]], e))
        sa, sb = spans(ea), spans(eb)
        overlap = {(x, y) for x in range(len(a)) for y in range(len(b)) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]} if len(a) < 60 else None
        got = list(zip(r.link_a, r.link_b))
        assert got == sorted(got) and len(got) == len(set(got)) and (overlap is None or set(got) == overlap)
