import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamquarry.llm import encoding as E
from seamquarry.llm import frequency as Q
from seamquarry.llm import splitting as P
from seamquarry.llm.languages import with_language

PIECE = st.sampled_from(["# h\n", "## sub\n", "para one. And two!\n", "\n", "- item\n", "  - deeper\n", "```\n", "x" * 37, " ", "\r\n", "    code();\n", "}\n", "e\u0301", "長い文。", "\r"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, max_size=60).map("".join), st.integers(1, 120), st.integers(0, 90), st.booleans())
def test_pieces_tile_the_text(text, limit, overlap, md):
    if overlap >= limit:
        with pytest.raises(ValueError):
            P.cut(text, limit, overlap, md)
        return
    cuts = P.cut(text, limit, overlap, md)
    assert cuts[0][1] == 0 and cuts[-1][2] == len(text) and (len(cuts) > 1) == (len(text) > limit)
    for (s, b, e), (s2, b2, e2) in zip(cuts, cuts[1:]):
        assert b2 == e and s2 == max(0, b2 - overlap) and s2 >= s and e2 > e
    assert all(e - s <= limit for s, _, e in cuts)


def test_cuts_fall_on_structure():
    text = "".join(f"# part {i}\n\n" + "word " * 30 + "\n\n" for i in range(6))
    assert all(text[b:].startswith("# part") for _, b, _ in P.cut(text, 400, 0, True))
    code = "".join(f"int f{i}(void)\n{{\n" + "    a();\n" * 10 + "}\n\n" for i in range(8))
    assert all(code[b:].startswith("int f") for _, b, _ in P.cut(code, 300, 20, False))
    with pytest.raises(ValueError):
        P.cut("abc", 0, 0, True)


def test_short_sections_keep_out_of_oversized_ones():
    long = "".join(f"para {i} " + "word " * 12 + "\n\n" for i in range(12))
    text = "# short one\n\nfew words\n\n# long\n\n" + long + "# short two\n\nfew words\n\n# short three\n\nend\n"
    bodies = [text[b:e] for _, b, e in P.cut(text, 300, 0, True)]
    assert bodies[0] == text[: text.index("# long")] and bodies[1].startswith("# long\n\npara 0")
    assert bodies[-1] == text[text.index("# short two") :] and all(x.startswith(("#", "para")) for x in bodies) and "".join(bodies) == text


def test_split_items(spark):
    rows = [("k", 1, "ab " * 50, 40, 5, False, "x"), ("k", 1, "ab " * 50, 40, 5, False, "y"), ("k", 2, None, 40, 5, False, "x"), ("k", 3, "", 40, 5, False, "x"), ("k", 4, "é" * 40, 40, 5, False, "x"), ("k", 5, "é" * 41, 40, None, True, "x"), ("k", 6, "a" * 99, None, 5, True, "x"), ("k", None, "a" * 99, 9, 5, True, "x")]
    df = spark.createDataFrame(rows, "item_kind string, item_id bigint, text string, max_chars int, overlap_chars int, markdown boolean, whole string")
    got = P.split_items(df).orderBy("item_id", "piece_no").collect()
    assert {r.item_id for r in got} == {1, 5} and all(len(r.text) == r.n_chars <= 40 for r in got)
    assert "".join(r.text[r.body_start - r.start :] for r in got if r.item_id == 1) == "ab " * 50
    long = spark.createDataFrame([("k", 7, "w. " * 700_000, 9000, 600, True)], "item_kind string, item_id bigint, text string, max_chars int, overlap_chars int, markdown boolean")
    assert P.piece_spans(long).count() == math.ceil((2_100_000 - 9000) / 8400) + 1 or P.piece_spans(long).count() < 260
    assert P.split_items(df.limit(0)).count() == 0


def test_language_by_ending(spark):
    langs = spark.createDataFrame([("c", [".c", ".h"], 1, 2), ("b", [".h", None], 3, 4), ("n", None, 5, 6)], "language string, extensions array<string>, max_chars int, overlap_chars int")
    df = spark.createDataFrame([("a/b.C", "z"), ("x.y\\k.h", "z"), ("dir.c/noext", "z"), (None, "z")], "p string, e string")
    assert [(r.p, r.language) for r in with_language(df, "p", langs).orderBy("p").collect()] == [(None, None), ("a/b.C", "c"), ("dir.c/noext", None), ("x.y\\k.h", "b")]


def test_terms(spark):
    rows = [(i, "CWE-1, cwe-1 ;x", "HIGH") for i in range(5)] + [(5, None, ""), (6, " / | ", None), (7, "Straße", "low"), (7, "Straße", "low"), (8, "x\u00a0", "low"), (None, "x", "low")] + [(i, "", "none") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "finding_id bigint, cwe string, severity string").withColumnRenamed("finding_id", "id")
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in Q.term_counts(spark, df, "id", ["cwe", "severity"]).collect()}
    assert got == {("cwe", "CWE-1"): (10, 5, None), ("cwe", "X"): (7, 7, "common"), ("cwe", "STRASSE"): (1, 1, "rare"), ("severity", "HIGH"): (5, 5, None), ("severity", "LOW"): (3, 3, None), ("severity", "NONE"): (50, 50, "common")}
    assert Q.term_counts(spark, df.limit(0), "id", ["cwe"]).count() == 0


CLEAN = ["für größere Blöcke müssen Schlüssel geprüft", "вызов функции пишет за границу буфера", "aucune régression n’a été observée côté client", "může přepsat cizí paměť, délka není", "関数の長さが制限されていない。", "puts U+FFFD (\ufffd) in place of bytes", "range 12–34 entries", "plain text"]
DAMAGED = {
    100: CLEAN[0].encode().decode("cp1252", "replace"), 101: CLEAN[0].encode("cp1252").decode("utf-8", "replace"), 102: CLEAN[1].encode("cp1251").decode("koi8-r"), 103: CLEAN[2].encode("cp1252").decode("cp437"),
    104: CLEAN[3].encode("cp1250").decode("latin-1"), 105: CLEAN[4].encode().decode("latin-1"), 106: "ok ok " + CLEAN[2].encode().decode("latin-1").encode().decode("latin-1"), 107: "range 56\ufffd78 entries",
}


def test_damaged_documents(spark):
    rows = [(i, t, "x") for k, t in enumerate(CLEAN) for i in range(k * 10, k * 10 + 8)] + [(i, t, "x") for i, t in DAMAGED.items()] + [(200, None, "x"), (201, "", "x"), (None, DAMAGED[100], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    assert {r.doc_id for r in E.damaged_documents(spark, df).collect()} == set(DAMAGED)
    back = {r.doc_id: r.text for r in E.restored(spark, df).collect()}
    assert set(back) == set(DAMAGED)
    for i, k in ((101, 0), (102, 1), (103, 2), (104, 3), (105, 4)):
        assert back[i] == CLEAN[k]
    assert back[106] == "ok ok " + CLEAN[2] and back[107] == "range 56–78 entries"
    assert E.damaged_documents(spark, df.limit(0)).count() == 0


def test_copies_of_a_damaged_document(spark):
    # half of all rows are copies of one damaged text; its words stand clean in three other texts
    bad = CLEAN[1].encode("cp1251").decode("koi8-r")
    rows = [(i, f"{CLEAN[1]} {i}") for i in range(3)] + [(i, "plain text") for i in range(10, 40)] + [(i, bad) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in E.damaged_documents(spark, df).collect()} == set(range(100, 140))
    back = E.restored(spark, df).collect()
    assert len(back) == 40 and {r.text for r in back} == {CLEAN[1]}


def test_lost_characters_need_no_ratio(spark):
    # each original stands clean in one document only; a bare U+FFFD in prose stays clean beside a dash in the same place
    rows = [(1, CLEAN[0]), (2, "range 12–34 entries"), (3, "a dash (–) here"), (10, CLEAN[0].encode("cp1252").decode("utf-8", "replace")), (11, "range 56\ufffd78 entries"), (12, "puts U+FFFD (\ufffd) in place of bytes")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in E.restored(spark, df).collect()} == {10: CLEAN[0], 11: "range 56–78 entries"}
    assert {r.doc_id for r in E.damaged_documents(spark, df).collect()} == {10, 11}


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1252", "cp437"), ("cp1251", "koi8-r"), ("cp1250", "latin-1"), ("cp1251", "cp1252")]


def test_rate_of_texts_restored(spark, data):
    """Clean texts of the corpus, each garbled as a whole by a known chain: how many come back exactly."""
    docs = spark.read.parquet(f"{os.path.dirname(data)}/sf0.01/documents.parquet").select("doc_id", "text")
    bad = {r.doc_id for r in E.damaged_documents(spark, docs).collect()}
    clean = [(r.doc_id, r.text) for r in docs.where(r"text rlike '[^\\x00-\\x7F]'").collect() if r.doc_id not in bad]
    made = {}
    for i, (doc, text) in enumerate(sorted(clean)):
        e, r = CHAINS[i % len(CHAINS)]
        try:
            garbled = text.encode(e).decode(r)
        except UnicodeError:
            continue
        if garbled != text:
            made[10**6 + doc] = (garbled, text)
    both = docs.unionByName(spark.createDataFrame([(k, g) for k, (g, _) in made.items()], "doc_id bigint, text string"))
    back = {r.doc_id: r.text for r in E.restored(spark, both).collect()}
    found = sum(k in back for k in made) / len(made)
    exact = sum(back.get(k) == t for k, (_, t) in made.items()) / len(made)
    print(f"garbled {len(made)}, found {found:.3f}, restored exactly {exact:.3f}")
    assert len(made) > 50 and found > 0.9 and exact > 0.5
