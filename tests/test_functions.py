"""Text functions, Python functions and their odd cases."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions import udfs as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


def plain_words(text):
    found = re.finditer(r"\d+(?:[.,]\d+)*%?|\w+|[^\w\s]", text)
    return [(m[0].casefold(), m.start(), m.end()) for m in found if any(c.isalnum() for c in m[0])]


@pytest.mark.parametrize("text", ["", "3rd of 30% 1.5,2 a_b", "Straße — Ünï 😀 x", "a\nb  c!", "½ ² x", "no.", "_ __", "1,", "ﬁnance ΟΔΥΣΣΕΥΣ ſo ẞ µ İ"])
def test_word_offsets(spark, text):
    got = [(r.word, r.start, r.end) for r in one(spark, T.word_offsets(F.col("t")), t=text)]
    assert got == plain_words(text)
    assert [(r.word, r.start, r.end) for r in one(spark, U.word_offsets("t"), t=text)] == got
    assert one(spark, T.words(F.col("t")), t=text) == [w for w, _, _ in got]


def test_fold_is_unicode_case_folding(spark):
    points = [chr(p) for p in (*range(0x20, 0xD800), *range(0xE000, 0x20000)) if chr(p).casefold() != chr(p)]
    rows = spark.createDataFrame([(c, f"a{c}B") for c in points], "c string, t string").select("c", "t", T.fold(F.col("t")).alias("f"), F.lower("c").alias("low")).collect()
    # Java and Python may know different versions of Unicode: characters that Java has no lower case for are left out.
    wrong = [r.c for r in rows if r.f != r.t.casefold() and r.low == r.c.lower()]
    assert len(rows) > 1300 and wrong == []


def test_windows_of_short_texts(spark):
    w = T.windows(F.col("w"))
    assert one(spark, w, w=["a"] * 7) == [] and one(spark, w, w=[]) == []
    assert [(x.at, x.gram) for x in one(spark, w, w=list("abcdefghi"))] == [(0, "a b c d e f g h"), (1, "b c d e f g h i")]


def test_identifiers(spark):
    c = F.col("t")
    assert one(spark, T.id_part(c), t=" a/b c.d ") == "a-b-c.d" and one(spark, T.id_part(c), t="///") is None
    assert one(spark, T.procedure_slug(c), t="2021/0106(COD)") == "2021-0106-COD"
    assert one(spark, T.usable_register_id(c), t=" 123456-78 ") == "123456-78" and one(spark, T.usable_register_id(c), t="12-3") is None
    assert one(spark, T.com_references(c), t="COM(2020)825 and COM(2020) 0842, COM(2020)825") == ["COM(2020)825", "COM(2020)842"]
    assert one(spark, T.com_references(c), t=None) == []
    assert one(spark, T.input_hash(F.lit("a"), F.lit("b"))) != one(spark, T.input_hash(F.lit("ab"), F.lit("")))


@pytest.mark.parametrize(
    ("typed", "kind", "value"),
    [("2021/106 cod", "procedure", "2021/0106(COD)"), ("CELEX:32024r1689", "celex", "32024R1689"), ("com 2021/206 final", "com", "COM(2021)206"), ("  the  act ", "title", "the act")],
)
def test_query_kind(spark, typed, kind, value):
    assert tuple(one(spark, T.query_kind(F.col("t")), t=typed)) == (kind, value)


def test_blank_query_is_nothing(spark):
    assert one(spark, T.query_kind(F.col("t")), t="  ") is None


@pytest.mark.parametrize(("run", "cites"), [("regulation eu 2016 679 of the", True), ("the directive ec on", True), ("we want rules like oj l 119", True), ("a rule of the european parliament and of the council of 2016", True), ("we ask that the regulation says", False)])
def test_citations(spark, run, cites):
    assert one(spark, T.is_citation(F.split("t", " ")), t=run) is cites


def test_names(spark):
    assert one(spark, T.name_key(F.col("t")), t="The L'Oreal Group, e.V. of Europe") == "loreal group"
    assert one(spark, T.title_words(F.col("t")), t="On the Act") == ["on", "the", "act"]
    assert U.caseless_name("The A.I.-Act") == "ai act" == U.caseless_name("AI  act the")
    assert U.caseless_name("Règlement sur l'IA") == "reglement sur lia"


@given(st.integers(0, 50), st.integers(0, 50))
@settings(max_examples=25, deadline=None)
def test_wilson(spark, a, b):
    real, total = min(a, b), max(a, b)
    r = spark.range(1).select(T.wilson(F.lit(real), F.lit(total)).alias("w")).first()["w"]
    share = real / total if total else 0.5
    assert 0 <= r.low <= share + 1e-12 and share - 1e-12 <= r.high <= 1
    assert (r.low == 0) == (real == 0) and (r.high == 1) == (real == total)


def test_changes():
    assert U.token_changes("The cat sat.", "the dog sat.") == [{"operation": "delete", "start": 4, "end": 7, "text": "cat"}, {"operation": "insert", "start": 4, "end": 7, "text": "dog"}]
    kinds = [(c["kind"], c["old"], c["new"]) for c in U.quoted_changes("replace 'shall' with 'may', delete “x y” and add 'z'; the provider's duty")]
    assert kinds == [("replace", "shall", "may"), ("delete", "x y", ""), ("insert", "", "z")]
    assert U.quoted_changes("  ") == [] and U.quoted_changes(" prose ")[0]["old"] is None


def test_sentences_and_passages():
    text = "See Art. 5 of it. Dr. No said e.g. this. 1. First point\n\nPage 3\n\n- item one\n- item two in 2021. Next"
    parts = [text[s:e] for s, e, _ in U.sentences(text)]
    assert parts[0] == "See Art. 5 of it." and "Page 3" not in parts and all(p == p.strip() for p in parts)
    long = "word " * 500
    assert [n for _, _, n in U.sentences(long)] == [120, 120, 120, 120, 20]
    spans = U.passages("One aa. Two bb. Three cc. Four dd. Five ee.")
    assert len(spans) == 2 and spans[0][1] > spans[1][0]
    packed = U.packed_passages("a b c. " * 100)
    assert all(s < e for s, e in packed) and all(x[1] <= y[0] for x, y in zip(packed, packed[1:], strict=False))
    assert U.sentences("") == [] and U.passages("12 34") == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("See fig. 2 for it. Next one.", ["See fig. 2 for it.", "Next one."]),
        ("The U.S. is e.g. here. J. Doe agrees! Really? yes.", ["The U.S. is e.g. here.", "J. Doe agrees!", "Really?", "yes."]),
        ("He said \"stop.\" Then left… and came back. (Done.) Fine", ["He said \"stop.\"", "Then left… and came back.", "(Done.)", "Fine"]),
        ("1. One\n2. Two\n(a) Three\n• Four\nstill four", ["1. One", "2. Two", "(a) Three", "• Four\nstill four"]),
        ("Head\n\nSeite 4 von 9\n\n12\n\nTail in 2021. It ended.", ["Head", "Tail in 2021.", "It ended."]),
        ("ends with version 5. And more", ["ends with version 5.", "And more"]),
        ("no end", ["no end"]), (" \n ", []), ("...", []),
    ],
)
def test_where_sentences_end(text, expected):
    assert [text[s:e] for s, e, _ in U.sentences(text)] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Change “a” to “b” and strike 'c d'.", [("replace", "a", "b"), ("delete", "c d", "")]),
        ("replace 'a' and 'b'; ADD \"x\"", [("insert", "", "x")]),
        ("add 'don't' here", [("statement", None, "add 'don't' here")]),
        ("insert ' padded' or 'q'", [("statement", None, "insert ' padded' or 'q'")]),
        ("readd 'x'", [("statement", None, "readd 'x'")]),
        ("delete\n'x'\treplace 'y'  by  'z'", [("delete", "x", ""), ("replace", "y", "z")]),
    ],
)
def test_instructions(text, expected):
    found = U.quoted_changes(text)
    assert [(c["kind"], c["old"], c["new"]) for c in found] == expected
    assert all(0 <= c["start"] < c["end"] <= len(text) for c in found)


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<p>a <b>b</b>c<img src=x>d</p>tail", [("a bcd", []), ("tail", [])]),
        ("<div class='x'><p class='y'>one</div>two", [("one", ["x", "y"]), ("two", [])]),
        ("<p><span class='num'>1</span>text</p>", [("1 text", [])]),
        ("<p>call <a class='footnoteRef'>(1)</a>, rest</p>", [("call, rest", [])]),
        ("</div><p>x<br/><br>y</p><style>p{}</style>", [("x\ny", [])]),
        ("<p>&amp; &eacute;</p><!-- no --><p>  </p>", [("& é", [])]),
        ("<table><tr><td>a<td>b</table>c", [("a", []), ("b", []), ("c", [])]),
    ],
)
def test_paragraphs_of_markup(markup, expected):
    assert [(r["text"], r["classes"]) for r in U.html_paragraphs(markup)] == expected


@pytest.mark.parametrize(("old", "new"), [("a b c d", "a x c"), ("", "new words"), ("gone", ""), ("same", "SAME"), ("1,5 % of it", "1.5% of them, it")])
def test_changes_rebuild_the_new_text(old, new):
    """What is not deleted of the old tokens and what is not inserted of the new ones are the same tokens."""
    changes = U.token_changes(old, new)
    left = lambda text, op: [m[0].casefold() for m in U._TOKEN.finditer(text) if not any(c["operation"] == op and c["start"] <= m.start() < c["end"] for c in changes)]
    assert left(old, "delete") == left(new, "insert")
    assert all(c["text"] == (old if c["operation"] == "delete" else new)[c["start"] : c["end"]] for c in changes)


def test_html():
    rows = U.html_paragraphs("<html><head><title>t</title></head><body><p class='a b'>x<br>y <a id='ntc1'>(5)</a>z</p><div id='art_1'><p>q<script>no</script></div>tail</body>")
    assert [r["text"] for r in rows] == ["x\nyz", "q", "tail"]
    assert rows[0]["classes"] == ["a", "b"] and rows[1]["ids"] == ["art_1"]
    assert U.html_paragraphs("</p><p>unclosed <b>bold") != [] and U.html_paragraphs("") == []


def test_ligatures():
    assert U.repaired("ﬁnal eﬀort") == ("final effort", 0, 0)
    assert U.repaired("signi\x00cant") == ("significant", 1, 0)
    assert U.repaired("zuffix zu\x00x") == ("zuffix zuffix", 1, 0)
    assert U.repaired("x\x00y \x00 a\x00b\x00c\x00d\x00e") == ("x y   a b c d e", 0, 6)
    assert U.repaired("o\x00cial") == ("official", 1, 0)


def test_direction(spark):
    word = lambda o, w: F.struct(F.lit(o).alias("operation"), F.lit(w).alias("word"))
    assert one(spark, T.direction(F.array(word("insert", "Shall,"), word("delete", "may")))) == "stricter"
    assert one(spark, T.direction(F.array(word("insert", "may"), word("insert", "must")))) == "unknown"


def test_word_rows_come_in_small_batches(spark, monkeypatch):
    texts = ["Straße 1,5% x", None, "", "é " * 50, "- a -"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "t"])
    monkeypatch.setattr(U, "WORD_ROWS", 8)
    parts = list(U._word_batches(iter([batch, batch]), ["id", "word", "start", "end"]))
    assert max(p.num_rows for p in parts) <= 8
    expected = [(i, w, s, e) for i, t in enumerate(texts) for w, s, e in U._places(t or "")]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == expected * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert sorted(map(tuple, U.word_rows(df, "id", "t").collect())) == sorted(expected)
