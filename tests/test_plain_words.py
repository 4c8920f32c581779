"""Plain texts are folded whole: the words are those of the way word by word; lines of a text are made once."""

from pyspark.sql import functions as F

from chartspark.functions import text as X
from chartspark.functions.language_rules import SECTION_TAG, WORD_PATTERN

TEXTS = [
    "Straße ÉTÉ don't [Verse 1] Ǆ-ǅ ª½ x_y", "İstanbul µ ſo Σίσυφος ΟΔΟΣ, end", " \x1c a  \t b ", "aͅb ʼn ŉ ǰ", "'tis rock'n'roll -- well-known", "ẞ ﬁ Ⅳ ①", "", " \n\r\x1f", None,
]


def test_words_of_plain_texts_are_those_word_by_word(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "i int, t string, l string")
    raw = F.regexp_extract_all(F.regexp_replace(X.normalize_text("t"), SECTION_TAG, " "), F.lit(f"({WORD_PATTERN})"), F.lit(1))
    for r in df.select("t", X.tokenize("t", "l").alias("a"), X.clean_tokens(raw).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_strip_takes_the_same_blanks_as_the_expression(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(chr(c) + "x" + chr(c),) for c in range(0x3100)], "t string")
    old = F.regexp_replace("t", f"^{X._BLANK}+|{X._BLANK}+$", "")
    assert df.where(~X.strip("t").eqNullSafe(old)).count() == 0
    assert df.where((old != "") != F.col("t").rlike(X._VISIBLE)).count() == 0


def test_lines_are_not_made_again_in_a_filter(spark):
    df = spark.createDataFrame([(1, "a b c\n" * 3)], "k int, t string")
    plan = X.with_chorus_repetition(df, "t", "n")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "translate(" in line]
