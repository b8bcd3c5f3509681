import pytest
from pyspark.sql import functions as F

from trustloom.functions import text as X


def one(spark, fn, value):
    df = spark.createDataFrame([(value,)], "t STRING")
    return df.select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, text, want", [
    (X.strip_html, "<div>Solid <i>little</i> lamp<br/>, bright</div>", "Solid little lamp, bright"),
    (X.strip_urls, "manual at http://lamps.test/a?b=1 (pdf)", "manual at  (pdf)"),
    (X.strip_urls, "see www.lamps.test or ask", "see  or ask"),
    (X.strip_emails, "write to a.b-c@lamps.test, thanks", "write to , thanks"),
    (X.strip_phones, "ring 555-010-9876 after six", "ring  after six"),
    (X.strip_phones, "fax (555) 010-9876", "fax "),
    (X.strip_phones, "desk 555 010 9876", "desk "),
    (X.repeated_chars, "zzzz", 3), (X.repeated_chars, "lamp", 0), (X.repeated_chars, "", 0), (X.repeated_chars, "bulb off", 1),
    (X.repeated_chars, None, 0),
    (X.repeated_words, "dim dim dim bulb", 1), (X.repeated_words, "a b A c b", 2), (X.repeated_words, "", 0),
    (X.word_count, "", 0), (X.word_count, "  one two three ", 3), (X.avg_word_length, "lamp bulb", 4.0),
    (X.avg_word_length, "", 0.0), (X.sentence_count, "One. Two!! Three", 3), (X.clean, None, ""),
    (X.clean, "The BEST <b>product</b> 123, see http://x.y!", "best product see"),
])
def test_exact(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_ratios_count_unicode_letters_as_words(spark):
    assert one(spark, lambda c: X.share_of(c, X.PUNCTUATION), "Étion déjà 12, ok!") == pytest.approx(2 / 19)


def test_terms_fold_accents_and_need_whole_words(spark):
    assert one(spark, X.terms, "Éclair straße abc1 x the Zebra") == ["eclair", "zebra"]
