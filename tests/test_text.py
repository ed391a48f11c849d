from __future__ import annotations

import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.functions import ids, scan, text


def one(spark, column, *values):
    names = "abcd"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(("a", "b"), [("می‌رود", "می رود"), ("كتاب", "کتاب"), ("I don't know", "I do not know"), ("  Well, WELL!", "well well")])
def test_normal_forms_agree(spark, a, b):
    assert one(spark, text.normalize, a) == one(spark, text.normalize, b)


def test_blank_normalizes_to_nothing(spark):
    assert one(spark, text.normalize, "  ") == "" and one(spark, text.normalize, "") == ""
    assert one(spark, text.normalize, None) is None


@pytest.mark.parametrize(("a", "b", "low", "high"), [("same words", "Same, words!", 1.0, 1.0), ("", "x", 0.0, 0.0), ("he will go home", "he will not go home", 0.0, 0.3499), ("red fox", "the red fox ran", 0.69, 0.71)])
def test_similarity(spark, a, b, low, high):
    assert low <= one(spark, text.similarity, a, b) <= high


@pytest.mark.parametrize(("raw", "want"), [("می‌روم", "می‌روم"), ("‌می", "می"), ("می‌ روم", "می روم"), ("می‌‌روم", "می‌روم"), ("كـتاب ٣", "کتاب ۳"), ("12", "12")])
def test_polish(spark, raw, want):
    assert one(spark, text.polish_persian, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("سلام!", True), ("۱۲۳؟", False), ("English only", False)])
def test_script(spark, raw, want):
    assert one(spark, text.contains_persian_letters, raw) is want


@pytest.mark.parametrize(("raw", "want"), [("Chapter 1", True), ("فصل اول", True), ("chapters", False), ("part " + "x" * 130, False), ("", False)])
def test_headings(spark, raw, want):
    assert one(spark, text.is_chapter_heading, raw) is want


def test_paragraphs_join_lines(spark):
    assert one(spark, text.split_paragraphs, "a \r\n b\r\n\r\n\r\n c") == ["a b", "c"]


def test_phrase_tokens_keep_compounds(spark):
    assert one(spark, text.phrase_tokens, "I don't — well-known (fact).") == ["i", "do not", "well known", "fact"]


@pytest.mark.parametrize(("raw", "want"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, raw, want):
    assert one(spark, ids.fnv1a64, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("[para-3]", "para-3"), ("paragraph-12", "para-12"), ("para-0", None), ("x", None)])
def test_ordinals(spark, raw, want):
    assert one(spark, ids.ordinal, raw) == want


def test_typography_kinds(spark):
    found = one(spark, scan.typography, "كتاب ٣  می روم ـ .")
    assert [f["kind"] for f in found] == ["arabic_letter_variant", "arabic_digit_variant", "multiple_spaces", "prefix_spacing", "kashida", "space_before_punctuation"]
    assert one(spark, scan.typography, "") == []


def test_names(spark):
    # a full stop ends a run, that of an abbreviation too
    assert one(spark, scan.name_candidates, "Lady Darcy, met Elizabeth Bennet. The End Of All Things. Mr. Hill") == ["Darcy", "Elizabeth Bennet", "The End Of", "All Things", "Mr", "Hill"]
    assert one(spark, scan.name_candidates, None) == []


def test_quotes(spark):
    spans = lambda t: [(q["start"], q["end"], q["style"], q["quote"]) for q in one(spark, scan.quotes, t)]
    assert spans('He said "no" and “yes”.') == [(9, 11, "straight_double", "no"), (18, 21, "curly_double", "yes")]
    assert spans("— Come in.\nHe came.") == [(2, 10, "leading_dash", "Come in.")]
    # a dash line counts beside quotes of other lines, not beside one of its own
    assert spans('— Stay here.\nHe said "no".') == [(2, 12, "leading_dash", "Stay here."), (22, 24, "straight_double", "no")]
    assert spans('— Stay "here".\n \u2003— \n—x') == [(8, 12, "straight_double", "here"), (21, 22, "leading_dash", "x")]
    assert spans("‘It’s late’ “a “b” c” «d» \"e\" \"") == [(1, 3, "curly_single", "It"), (13, 17, "curly_double", "a “b"), (23, 24, "guillemets", "d"), (27, 28, "straight_double", "e")]
    assert spans('""“”') == [(1, 1, "straight_double", ""), (3, 3, "curly_double", "")] and spans("") == spans("”x“") == [] and one(spark, scan.quotes, None) == []


@pytest.mark.parametrize("body", ["", "short", "One two. Three four!\n\nFive six seven eight nine ten.", "x" * 200, "a b " * 90])
def test_passages_lose_nothing(spark, body):
    parts = one(spark, lambda c: scan.passages(c, 48), body)
    assert "".join(parts) == body and all(len(p) <= 48 for p in parts)


def test_passages_end_behind_breaks_and_sentences(spark):
    split = lambda t, n: one(spark, lambda c: scan.passages(c, n), t)
    assert split("Aaaa bbbb cccc.\r\n\r\nDddd eeee", 22) == ["Aaaa bbbb cccc.\r\n\r\n", "Dddd eeee"]
    assert split("One two three four five.Six", 24) == ["One two three four five.", "Six"]  # a whole window that ends a sentence
    assert split("Aaaa bbbb cccc (dd.) eeee ffff", 25) == ["Aaaa bbbb cccc (dd.) ", "eeee ffff"]
    assert split("Aa. bbbb cccc dddd eeee ffff", 20) == ["Aa. bbbb cccc dddd ", "eeee ffff"]  # too early a sentence doesn't count


def test_labels_and_secrets(spark):
    assert one(spark, ids.sanitize_label, "a.b:c/d é_-" + "x" * 80) == ("abcd_-" + "x" * 80)[:64]
    assert [one(spark, ids.looks_secret, v) for v in ("SK-1", "my API_KEY", "tokens", "task", "", None)] == [True, True, True, False, False, False]
    assert [one(spark, ids.is_sensitive_field, v) for v in ("source_TEXT", "contents", "model", None)] == [True, True, False, False]


def test_upper_case_keeps_the_number_of_letters(spark):
    from folium.functions.text import upper_letters

    words = ["erßie", "Straße", "ŉa", "ᾳx", "plain", "", None, "éa"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(upper_letters(F.col("w"))).collect()]
    assert got == ["ERẞIE", "STRAẞE", "ŉA", "ᾼX", "PLAIN", "", None, "ÉA"]


def test_a_name_in_capitals_stands_in_a_text_with_sharp_s(spark):
    from folium.functions.text import upper_letters
    from folium.operators import analysis

    units = spark.createDataFrame([("u", "Der erßie kam.")], "unit_id string, text_content string")
    names = spark.createDataFrame([(0, "erßie")], "position bigint, value string").withColumn("value", upper_letters(F.col("value")))
    assert analysis.present(units, names, 3, "n").first()["n"] == ["ERẞIE"]


def test_pairs_of_names_with_sharp_s_are_approved(spark, tmp_path):
    """Two names of neighbouring rank, one with a letter whose upper case is two letters."""
    from folium.plans import recall

    line = "Straßer saw Mina here. "
    spark.createDataFrame([(1, (line + "\n") * 70, "s")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a b")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = recall.relationship_seeds(spark, str(tmp_path)).collect()
    assert [(r["a"], r["b"], r["n"], r["approved"]) for r in got] == [("Mina", "Straßer", 70, True)]


def test_scanners_hold_few_results_as_python_values():
    """Of 60 texts that come at once, no more results than those of a slice are Python values together."""

    class Found(str):
        pass

    alive, most = weakref.WeakSet(), 0

    def scan_one(text):
        nonlocal most
        found = [Found(f"{text[:4]}{i}") for i in range(3)]
        for x in found:
            alive.add(x)
        most = max(most, len(alive))
        return found

    texts = [f"{i:04d}" + "x" * (scan.SLICE_CHARS // 10) for i in range(60)]
    out = scan._lists(pa.array([*texts]), scan_one, pa.string())
    assert out.to_pylist() == [[f"{i:04d}{k}" for k in range(3)] for i in range(60)] and most <= 3 * 11
    assert scan._lists(pa.array([], pa.string()), scan_one, pa.string()).to_pylist() == []
