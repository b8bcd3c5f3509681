"""Text cleaning and text measures.

Character classes are written out in Unicode terms, because ``\\w``, ``\\d`` and ``\\s`` are ASCII-only in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Character classes and removal patterns.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE_RUN = rf"[{SPACE}]+"
WORD_RUN = rf"[^{SPACE}]+"
WORD_CHARS = r"\p{L}\p{N}_"
PUNCTUATION = rf"[^{WORD_CHARS}{SPACE}]"
DIGIT = r"\p{Nd}"
UPPER = r"[A-Z]"
ANY_UPPER = r"\p{Lu}"
SPECIAL = r"[!@#$%^&*()_+]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
SENTENCE_END = r"[.!?]+"
HTML_TAG = r"<[^>]+>"
URL = r"https?://[!$-_a-z]+"
WWW = r"www\.[!$-_a-z]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\(\d{3}\)\s*\d{3}[-.]?\d{4}\b",
    r"\b\d{3}\s\d{3}\s\d{4}\b",
)
VOWEL_GROUP = r"[aeiouy]+"

# Common English function words, as left by removing punctuation.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn
    doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)

# Sentiment words and the topics a specific review mentions.
POSITIVE_WORDS = ("great", "excellent", "amazing", "love", "perfect", "best")
NEGATIVE_WORDS = ("terrible", "awful", "hate", "worst", "bad", "horrible")
TOPIC_WORDS = ("location", "price", "staff", "service", "quality", "time", "date")

MIN_WORD, MAX_WORD = 2, 15


def _accent_rule() -> tuple[str, str]:
    """Letters that decompose to one base letter plus marks, and those base letters."""
    plain = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            plain[chr(cp)] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, UNACCENTED = _accent_rule()


def _remove(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def strip_html(col: Column) -> Column:
    return _remove(col, HTML_TAG)


def strip_urls(col: Column) -> Column:
    return _remove(_remove(col, URL), WWW)


def strip_emails(col: Column) -> Column:
    return _remove(col, EMAIL)


def strip_phones(col: Column) -> Column:
    for pattern in PHONES:
        col = _remove(col, pattern)
    return col


def normalise(col: Column, remove_numbers: bool = True, remove_punctuation: bool = True) -> Column:
    """Lower-case, drop digits, turn punctuation into spaces, collapse white space.

    Punctuation and white space together are all that is not a word character, so one replacement covers both.
    """
    col = F.lower(col)
    if remove_numbers:
        col = _remove(col, f"{DIGIT}+")
    gap = rf"[^{WORD_CHARS}]+" if remove_punctuation else SPACE_RUN
    return F.trim(F.regexp_replace(col, gap, " "))


def words(col: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(col, SPACE_RUN), lambda w: w != "")


def keep_tokens(tokens: Column, stop_words=STOP_WORDS, shortest: int = MIN_WORD, longest: int = MAX_WORD) -> Column:
    keep = lambda w: F.length(w).between(shortest, longest) & ~w.isin(*stop_words)
    return F.filter(tokens, keep)


def scrub(col: Column) -> Column:
    """Remove markup and contact data, in that order."""
    return strip_phones(strip_emails(strip_urls(strip_html(col))))


def clean(col: Column, stop_words=STOP_WORDS) -> Column:
    """Full cleaning: scrub, normalise, keep meaningful tokens, join by one space; null gives ''."""
    spaced = normalise(scrub(F.coalesce(col, F.lit(""))))  # one space between tokens
    return F.array_join(keep_tokens(F.split(spaced, " "), stop_words), " ")


def text_length(col: Column) -> Column:
    return F.length(F.coalesce(col, F.lit("")))


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD_RUN))


def sentence_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(SENTENCE_END)) + 1


def avg_word_length(col: Column) -> Column:
    col = F.coalesce(col, F.lit(""))
    return F.coalesce(F.try_divide(F.length(_remove(col, SPACE_RUN)).cast("double"), word_count(col)), F.lit(0.0))


def share_of(col: Column, pattern: str) -> Column:
    """Matches of a one-character pattern over length plus one."""
    col = F.coalesce(col, F.lit(""))
    return F.regexp_count(col, F.lit(pattern)) / (F.length(col) + 1)


def literal_count(col: Column, mark: str) -> Column:
    col = F.coalesce(col, F.lit(""))
    return F.length(col) - F.length(F.replace(col, F.lit(mark), F.lit("")))


def repeated_chars(col: Column) -> Column:
    """Characters equal to the one before them."""
    col = F.coalesce(col, F.lit(""))
    return F.length(col) - F.length(F.regexp_replace(col, r"(?s)(.)\1+", "$1"))


def repeated_words(col: Column) -> Column:
    """Distinct lower-cased words that occur more than once: one pass over the sorted words."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("hits"))

    def step(acc, w):
        same = acc["word"] == w
        return F.struct(
            w.alias("word"),
            F.when(same, acc["run"] + 1).otherwise(1).alias("run"),
            (acc["hits"] + F.when(same & (acc["run"] == 1), 1).otherwise(0)).alias("hits"),
        )

    return F.aggregate(F.sort_array(words(F.lower(F.coalesce(col, F.lit(""))))), start, step, lambda acc: acc["hits"])


def upper_share(col: Column) -> Column:
    """Capital letters over length (no plus one); 0 for empty text."""
    col = F.coalesce(col, F.lit(""))
    return F.when(F.length(col) > 0, F.regexp_count(col, F.lit(UPPER)) / F.length(col)).otherwise(F.lit(0.0))


def all_caps_words(col: Column) -> Column:
    shout = lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    return F.size(F.filter(words(F.coalesce(col, F.lit(""))), shout))


def plain_share(col: Column, pattern: str) -> Column:
    col = F.coalesce(col, F.lit(""))
    return F.when(F.length(col) > 0, F.regexp_count(col, F.lit(pattern)) / F.length(col)).otherwise(F.lit(0.0))


def syllables(col: Column) -> Column:
    """Vowel groups, the usual cheap estimate."""
    return F.regexp_count(F.lower(col), F.lit(VOWEL_GROUP))


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)


def reading_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59


def fold_accents(col: Column) -> Column:
    return _remove(F.translate(col, ACCENTED, UNACCENTED), r"\p{Mn}+")


def terms(col: Column, stop_words=STOP_WORDS) -> Column:
    """Vector terms: lower-case words of two or more plain letters after folding accents, stop words out."""
    runs = F.regexp_extract_all(fold_accents(F.lower(F.coalesce(col, F.lit("")))), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin(*stop_words))


def mentions(col: Column, vocabulary) -> Column:
    """How many vocabulary entries occur in the lower-cased text as substrings."""
    low = F.lower(F.coalesce(col, F.lit("")))
    total = F.lit(0)
    for word in vocabulary:
        total = total + F.contains(low, F.lit(word)).cast("int")
    return total
