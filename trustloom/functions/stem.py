"""English word stems by Porter's suffix rules, as SQL expressions over an array of lower-case tokens.

A step looks at a word ``w`` and at its letters' kinds ``cv`` (``V``: a, e, i, o, u, or y after a consonant; ``C``: anything
else). The measure of a stem, how often vowels are followed by consonants, shows in ``cv``: it is above 0 if ``VC`` occurs
and above 1 if it occurs twice. A stem's kinds are a prefix of the word's. The texts of the steps are plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Porter's suffixes and their replacements, with the usual later additions, in the order they are tried.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
             "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
          "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
          "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize")

ABOVE_0, ABOVE_1 = "{} LIKE '%VC%'", "{} LIKE '%VC%VC%'"
EXACTLY_1 = "({0} LIKE '%VC%' AND NOT {0} LIKE '%VC%VC%')"


def _cut(name: str, n: int) -> str:
    return f"left({name}, length({name}) - {n})"


def _when(suffix: str, then: str) -> str:
    return f"WHEN {{w}} LIKE '%{suffix}' THEN {then}"


def _if(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {{w}} END"


def _swap(suffix: str, other: str, condition: str) -> str:
    """If the word ends so, the first such rule decides: replaced if what is left fits the condition, else unchanged."""
    n = len(suffix)
    return _when(suffix, _if(condition.format(_cut("{cv}", n)), f"{_cut('{w}', n)} || '{other}'"))


def _short(w: str, cv: str) -> str:
    """Consonant, vowel, consonant other than w, x, y at the end; or a word of a vowel and a consonant."""
    return f"(({cv} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {cv} = 'VC')"


def _mended(n: int) -> str:
    """The word without ``n`` letters (-ed, -ing), with its last letters put right."""
    w, cv = _cut("{w}", n), _cut("{cv}", n)
    return (f"CASE WHEN {w} LIKE '%at' OR {w} LIKE '%bl' OR {w} LIKE '%iz' THEN {w} || 'e' "
            f"WHEN length({w}) > 1 AND {cv} LIKE '%C' AND right({w}, 1) = left(right({w}, 2), 1) "
            f"THEN CASE WHEN right({w}, 1) IN ('l', 's', 'z') THEN {w} ELSE {_cut('{w}', n + 1)} END "
            f"WHEN {EXACTLY_1.format(cv)} AND {_short(w, cv)} THEN {w} || 'e' ELSE {w} END")


def _case(*rules: str) -> str:
    return f"CASE {' '.join(rules)} ELSE {{w}} END"


def _fourth(suffix: str) -> str:
    n = len(suffix)
    more = f" AND right({_cut('{w}', n)}, 1) IN ('s', 't')" if suffix == "ion" else ""
    return _when(suffix, _if(ABOVE_1.format(_cut("{cv}", n)) + more, _cut("{w}", n)))


STEPS = (
    _case("WHEN {w} LIKE '%ies' AND length({w}) = 4 THEN left({w}, 3)",
          *[_when(s, f"{_cut('{w}', len(s))} || '{o}'") for s, o in PLURALS.items()]),
    _case(f"WHEN {{w}} LIKE '%ied' THEN CASE WHEN length({{w}}) = 4 THEN left({{w}}, 3) ELSE {_cut('{w}', 2)} END",
          _swap("eed", "ee", ABOVE_0), *[f"WHEN {{w}} LIKE '%{s}' AND {_cut('{cv}', len(s))} LIKE '%V%' THEN {_mended(len(s))}"
                                         for s in ("ed", "ing")]),
    _case(f"WHEN {{w}} LIKE '%y' AND length({{w}}) > 2 AND {_cut('{cv}', 1)} LIKE '%C' THEN {_cut('{w}', 1)} || 'i'"),
    # -alli becomes -al and is looked at again
    _case(f"WHEN {{w}} LIKE '%alli' AND {ABOVE_0.format(_cut('{cv}', 4))} THEN {_cut('{w}', 2)}"),
    _case(*[_swap(s, o, ABOVE_0) for s, o in SECOND.items()], _when("logi", _if(ABOVE_0.format(_cut("{cv}", 3)), _cut("{w}", 1)))),
    _case(*[_swap(s, o, ABOVE_0) for s, o in THIRD.items()]),
    _case(*map(_fourth, FOURTH)),
    _case(f"WHEN {{w}} LIKE '%e' AND ({ABOVE_1.format(_cut('{cv}', 1))} OR ({EXACTLY_1.format(_cut('{cv}', 1))} AND NOT "
          f"{_short(_cut('{w}', 1), _cut('{cv}', 1))})) THEN {_cut('{w}', 1)}"),
    _case(f"WHEN {{w}} LIKE '%ll' AND {ABOVE_1.format(_cut('{cv}', 1))} THEN {_cut('{w}', 1)}"),
)


def _kinds(w: str) -> str:
    """``cv`` of a word. Every y takes its kind from the letter before it, so runs of y are settled in pairs from the left."""
    plain = f"regexp_replace(translate({w}, 'aeiou', 'VVVVV'), '[^Vy]', 'C')"
    out = f"regexp_replace({plain}, '^y', 'C')"
    for before, pair, one in (("C", "VC", "V"), ("V", "CV", "C")):
        out = rf"regexp_replace({out}, r'(?:(?<={before})|\G(?<!^))yy', '{pair}')"
        out = f"regexp_replace({out}, '(?<={before})y', '{one}')"
    return f"CASE WHEN {w} LIKE '%y%' THEN {out} ELSE {plain} END"


def with_stems(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add the stems of an array of lower-case tokens. Words of one or two letters stay; null tokens stay null."""
    df = df.withColumn(out, F.col(tokens))
    for step in STEPS:
        bound = f"transform(`{out}`, w -> struct(w AS w, {_kinds('w')} AS cv))"
        df = df.withColumn(out, F.expr(f"transform({bound}, x -> {step.format(w='x.w', cv='x.cv')})"))
    known = " ".join(f"WHEN t = '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    return df.withColumn(out, F.expr(f"zip_with(`{tokens}`, `{out}`, (t, s) -> CASE WHEN length(t) <= 2 THEN t {known} ELSE s END)"))
