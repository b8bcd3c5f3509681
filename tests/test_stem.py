"""Stems against a plain Python version, written from the rules letter by letter."""

import re

from pyspark.sql import functions as F

from trustloom.functions import stem as S


def consonant(w, i):
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))


def kinds(w):
    out = []
    for i, ch in enumerate(w):  # without recursion, for long runs of y
        out.append("V" if ch in "aeiou" or ch == "y" and i and out[-1] == "C" else "C")
    return "".join(out)


def measure(w):
    return len(re.findall("V+C+", kinds(w)))


def short(w):
    k = kinds(w)
    return k.endswith("CVC") and w[-1] not in "wxy" or k == "VC"


def replaced(w, rules, fits):
    for suffix, other in rules.items():
        if w.endswith(suffix):
            rest = w[:len(w) - len(suffix)]
            return rest + other if fits(rest) else w
    return w


def stem(w):
    if len(w) <= 2:
        return w
    if w in S.IRREGULAR:
        return S.IRREGULAR[w]
    w = w[:3] if w.endswith("ies") and len(w) == 4 else replaced(w, S.PLURALS, lambda r: True)
    if w.endswith("ied"):
        w = w[:3] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            rest = w[:-len(suffix)]
            if w.endswith(suffix) and "V" in kinds(rest):
                if rest.endswith(("at", "bl", "iz")):
                    rest += "e"
                elif len(rest) > 1 and rest[-1] == rest[-2] and kinds(rest)[-1] == "C":
                    rest = rest if rest[-1] in "lsz" else rest[:-1]
                elif measure(rest) == 1 and short(rest):
                    rest += "e"
                w = rest
                break
    if w.endswith("y") and len(w) > 2 and kinds(w)[-2] == "C":
        w = w[:-1] + "i"
    if w.endswith("alli") and measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi") and not w.endswith(tuple(S.SECOND)):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        w = replaced(w, S.SECOND, lambda r: measure(r) > 0)
    w = replaced(w, S.THIRD, lambda r: measure(r) > 0)
    for suffix in S.FOURTH:
        if w.endswith(suffix):
            rest = w[:-len(suffix)]
            w = rest if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


# Words whose stems Porter's paper and the usual tables give
KNOWN = """caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor
sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file
happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic
differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal
decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic
formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow
inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac
adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog
effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll dying:die cried:cri died:die
enjoy:enjoy say:say by:by geology:geolog""".split()


def stems(spark, words):
    df = spark.createDataFrame([(list(words),)], "tokens array<string>")
    return S.with_stems(df, "tokens", "stems").first().stems


def test_known_stems(spark):
    words = dict(k.split(":") for k in KNOWN)
    assert {w: stem(w) for w in words} == words
    assert dict(zip(words, stems(spark, words))) == words


def test_all_words_of_the_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = [r.w for r in docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct().collect()]
    words += ["y", "yy", "yyy", "syyyyzed", "ayyyying", "toyyy", "ss", "ies", "zzzed", "éing", "9ing", "ionion", "eeed", "ation", "s"]
    assert len(words) > 500
    assert stems(spark, words) == [stem(w) for w in words]
    assert stems(spark, []) == [] and stems(spark, [None, "cats"]) == [None, "cat"]


def test_kinds(spark):
    words = ["syzygy", "yyyyyy", "ayyyyy", "tyyyy", "toy", "b", "aeiou", "yay"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.expr(S._kinds("w")).alias("cv")).collect()
    assert {r.w: r.cv for r in rows} == {w: kinds(w) for w in words}
    assert all("".join("C" if consonant(w, i) else "V" for i in range(len(w))) == kinds(w) for w in words)
