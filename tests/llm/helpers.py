"""Fixtures shared by the tests of the training-data operators."""

import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, key string, label int, t string"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def docs(spark, rows, parts=3):
    """rows of (doc_id, text[, lang, source]); further columns clash with names that operators like to use."""
    full = [(*r, *(None, None)[len(r) - 2:]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 7, 7, "k", 7, "t")
                                  for i, t, la, s in full], DOCS).repartition(parts)


LONG = " ".join(f"word{i % 997} stone{i % 13}" for i in range(30000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, LONG, "en", "a"), (5, LONG, "en", "b"),
       (6, "Ein Über-Test ß\n\nzwei", "de", None), (6, "Ein Über-Test ß\n\nzwei", "de", None), (None, "lost id text", "en", "b"),
       (7, "x", None, "a"), (8, "1 2 3 " * 4000, "en", "a"), (9, "a" * 50000, None, "b"), (10, "\U0001F600 smile   line", "fr", "c")]


def close(a, b, rel=1e-9):
    return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
