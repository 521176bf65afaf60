"""Small inputs and plain rewordings of the operators' contracts."""

import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = " ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "va", "ze") for b in ("ban", "cor", "dim", "fel", "gop", "hun", "jat", "kel"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, texts, ids=None, sources=None, slices=3):
    """A documents table of the texts, spread over tasks, in a fixed order."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["s0"] * len(texts))[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.repartitionByRange(slices, "doc_id").checkpoint() if rows else frame


#: nulls, blanks, controls, accents, one word, a very long text
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "É é ÀB Ab ab", "a b c", "x" * 70_000, "two words\n\ntwo words\nTWO words", "<|endoftext|> \x1c x", "日本 語 🙂 🙂🙂"]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2
