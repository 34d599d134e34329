"""Text that was decoded with the wrong encoding: found and restored with a table of garbled forms.

Every distinct word of the corpus that holds a non-ASCII character is written under each encoding and read under each other
one, once or twice over. Document words are joined by hash with that table; a match says what the word was and how it was
damaged. Matches are verified before they count, because two clean words can be each other's garbled form:

* forms of UTF-8 bytes count as they are: nobody writes them by hand;
* forms with U+FFFD beside a letter or digit count as they are too: decoding leaves it behind, prose about it doesn't put it there;
* other forms need an original that is in at least RATIO times as many distinct texts, so copies of a damaged text don't
  outvote its original, or in as many texts and RATIO times as many documents, and count as proof only from three letters
  on (or if they hold U+FFFD).

Words are runs of letters with the non-ASCII characters in and beside them. Non-ASCII marks without letters are taken with
what stands around them up to white space, digits folded, so that `(U+FFFD)` in prose about it isn't `12 U+FFFD 34`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

#: Distinct words whose garbled forms one task makes.
WORDS_A_TASK = 20_000
RATIO = 3
# Encodings by their names in Python's codec registry.
WRITTEN = ["utf-8", "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman", "shift_jis", "euc_jp"]
READ = ["cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman", "shift_jis", "euc_jp", "utf-8"]
TWICE = ["cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp850"]
LOST = "�"

_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_CHUNK = re.compile(r"[!-~]*[^\x00-\x7f]+[!-~\x80-\U0010ffff]*")
_DIGITS = re.compile(r"[0-9]+")


def _lettered(s: str) -> bool:
    return any(c.isalpha() for c in s)


def tokens(text: str | None) -> dict[str, tuple[int, int]]:
    """Each distinct word of the text that holds a non-ASCII character, with the place of its first occurrence."""
    out: dict[str, tuple[int, int]] = {}
    if not text or text.isascii():
        return out
    for m in _WORD.finditer(text):
        w = m.group()
        if _lettered(w) and not (len(w) == 1 and w == LOST):
            out.setdefault(w, m.span())
    for m in _CHUNK.finditer(text):
        if not _lettered(re.sub("[A-Za-z]", "", m.group())):
            for p in _WORD.finditer(m.group()):
                if not _lettered(p.group()):
                    out.setdefault(_DIGITS.sub("0", re.sub("[A-Za-z_]+", "a", m.group())), m.span())
                    break
    return out


def _write(w: str, enc: str) -> bytes | None:
    try:
        return w.encode(enc)
    except UnicodeEncodeError:
        return None


def _read(b: bytes, enc: str) -> str | None:
    """As a lenient reader does: bytes without a character stay as control characters, broken UTF-8 becomes U+FFFD."""
    if enc == "utf-8":
        return b.decode("utf-8", "replace")
    try:
        return b.decode(enc)
    except UnicodeDecodeError:
        if enc in ("shift_jis", "euc_jp"):
            return None
        one = [bytes([x]).decode(enc, "replace") for x in b]
        return "".join(chr(x) if c == LOST else c for x, c in zip(b, one))


def garbled(word: str) -> dict[str, str]:
    """Garbled form: chain, for all chains. A form that splits into several words is given by its parts of four characters or more."""
    out: dict[str, str] = {}
    for e in WRITTEN:
        b = _write(word, e)
        if b is None:
            continue
        for r in READ:
            if r == e:
                continue
            g = _read(b, r)
            if g is None or g == word or g.isascii():
                continue
            out.setdefault(g, f"{e}>{r}")
            if e == "utf-8" and r in TWICE:
                again = _write(g, "utf-8")
                for r2 in TWICE:
                    out.setdefault(_read(again, r2), f"utf-8>{r}>utf-8>{r2}")
    for g in [g for g in out if _lettered(g) and not _WORD.fullmatch(g)]:
        chain = out.pop(g)
        for part in _WORD.findall(g):
            if len(part) >= 4:
                out.setdefault(part, chain)
    return out


def _doc_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [(d, h, list(t)) for d, h, t in ((d, h, tokens(x)) for d, h, x in zip(b["doc_id"], b["text_hash"], b["text"])) if t]
        yield pd.DataFrame(got, columns=["doc_id", "text_hash", "words"])


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(g, w, chain, n, k) for w, n, k in zip(b["word"], b["docs"], b["texts"]) if LOST not in w for g, chain in garbled(w).items()]
        yield pd.DataFrame(rows, columns=["form", "original", "chain", "original_docs", "original_texts"])


def damage(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, form, original, chain, proof: each garbled word of each document, with what it was and how it came to be.

    Null and ASCII texts have none. The table of forms is made from all distinct words of all documents, nothing sampled.
    """
    tmp = Scratch(spark)
    held = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x00-\\x7F]")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    held = tmp.write(held.mapInPandas(_doc_tokens, "doc_id bigint, text_hash bigint, words array<string>"))
    texts = held.groupBy("text_hash").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("docs"))
    vocabulary = tmp.write(texts.select("docs", F.explode("words").alias("word")).groupBy("word").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("texts")))
    spread = vocabulary.repartition(max(8, math.ceil(vocabulary.count() / WORDS_A_TASK)))  # few bytes, but dozens of forms each
    forms = spread.mapInPandas(_forms, "form string, original string, chain string, original_docs bigint, original_texts bigint")
    met = forms.join(vocabulary.select(F.col("word").alias("form"), F.col("docs").alias("form_docs"), F.col("texts").alias("form_texts")), "form")
    utf = F.col("chain").startswith("utf-8>")
    sure = utf & ~F.col("form").contains(LOST) | F.col("form").rlike(r"[\p{L}\p{N}]\x{FFFD}|\x{FFFD}[\p{L}\p{N}]")
    more = (F.col("original_texts") >= F.col("form_texts")) & (F.col("original_docs") >= RATIO * F.col("form_docs"))
    met = met.where(sure | (F.col("original_texts") >= RATIO * F.col("form_texts")) | more)
    letters = F.length(F.regexp_replace("form", r"[^\p{L}\p{S}\p{M}]", ""))
    proof = utf | F.col("form").contains(LOST) | (letters >= 3)
    best = met.groupBy("form").agg(F.max_by(F.struct("original", "chain", proof.alias("proof")), F.struct("original_docs", "original")).alias("b"))
    best = tmp.write(best.select("form", "b.*"))
    return held.select("doc_id", F.explode("words").alias("form")).join(best, "form").select("doc_id", "form", "original", "chain", "proof")


def damaged_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id of each document with a proven garbled word."""
    return damage(spark, documents).where("proof").select("doc_id").distinct()


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text, forms, originals in zip(b["doc_id"], b["text"], b["forms"], b["originals"]):
            table = dict(zip(forms, originals))
            done = 0

            def word(m: re.Match) -> str:
                nonlocal done
                if (new := table.get(m.group())) is None:
                    return m.group()
                done += 1
                return new

            def chunk(m: re.Match) -> str:
                nonlocal done
                s = m.group()
                new = table.get(_DIGITS.sub("0", re.sub("[A-Za-z_]+", "a", s)))
                marks = _WORD.findall(s)
                if new is None or len(marks) != 1 or len(fresh := _WORD.findall(new)) != 1:
                    return s
                done += 1
                return s.replace(marks[0], fresh[0])

            out.append((doc, _CHUNK.sub(chunk, _WORD.sub(word, text)), done))
        yield pd.DataFrame(out, columns=["doc_id", "text", "replaced"])


def restored(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, text, replaced, chains: each damaged document with its garbled words put right where their originals are known."""
    found = Scratch(spark).write(damage(spark, documents))
    proven = found.where("proof").select("doc_id").distinct()
    per = found.join(proven, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.collect_list("form").alias("forms"), F.collect_list("original").alias("originals"), F.array_sort(F.collect_set("chain")).alias("chains")
    )  # one document's distinct words, so bounded by its text
    texts = documents.where("text is not null").select("doc_id", "text").join(per, "doc_id")
    fixed = texts.select("doc_id", "text", "forms", "originals").mapInPandas(_restore, "doc_id bigint, text string, replaced int")
    return fixed.join(per.select("doc_id", "chains"), "doc_id")


