from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from gradeframe.functions import text

CASES = [
    "",
    "   ",
    "Hello <b>World</b> <not closed",
    "line <one\ntwo> three",
    "@user_1 and @名前 met at 5pm, '99 was 1 999 ways",
    "see https://example.org/x?y=1 or http://a.b",
    "too\t\tmany    spaces\r\n\x1c\x85here",
    "dots..... and ,,,, commas.. .,",
    "Ünïcödé ÅÉ ſtraße ٣٤ digits ² ½",
    "emoji 😀😀 <😀> end",
]


def _apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [row[0] for row in df.select("i", expression(F.col("t")).alias("out")).orderBy("i").select("out").collect()]


def test_clean_matches_plain(spark):
    assert _apply(spark, text.clean, CASES) == [plain.clean(c) for c in CASES]


def test_clean_keeps_url_tail(spark):
    assert _apply(spark, text.clean, ["go https://a.b/c"]) == ["go ://a.b/c"]


def test_strip_html_and_punct(spark):
    assert _apply(spark, text.strip_html, ["<p>a</p>\n<\nb>"]) == ["a\n<\nb>"]
    assert _apply(spark, text.strip_punct, CASES) == [plain.bare(c) for c in CASES]
    assert _apply(spark, text.strip_punct, [r"""a!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~z“”"""]) == ["az“”"]


def test_splits_keep_empty_pieces(spark):
    assert _apply(spark, lambda c: text.split_on(c, "."), ["a..b.", ""]) == [["a", "", "b", ""], [""]]
    assert _apply(spark, lambda c: text.split_on(c, "\n\n"), ["a\n\n\nb\n\n"]) == [["a", "\nb", ""]]
    assert _apply(spark, lambda c: text.piece_count(c, " "), ["", " ", "a b  c"]) == [1, 2, 4]


ALPHABET = st.one_of(
    st.sampled_from("aZ<>@'.,_ \n\t\r\x0b\x1c\x85\xa0\u2003\u3000 0123456789http:/"),
    st.characters(min_codepoint=0x20, max_codepoint=0x24F, exclude_categories=["Cn", "Cc"]),
    st.characters(min_codepoint=0x4E00, max_codepoint=0x4FFF),
    st.sampled_from("😀𝔘٣²½Ⅷ"),
)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=20, max_size=40))
def test_clean_on_random_text(spark, texts):
    assert _apply(spark, text.clean, texts) == [plain.clean(t) for t in texts]
