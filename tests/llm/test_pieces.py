import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from trustloom.llm import pieces, tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, id int, ids string, n_tokens string, body int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocab():
    return pieces.read_vocabulary(PATH)


def samples():
    rng = random.Random(7)
    out = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "\n\n a\n", "a\n b \n  c", "\t x\r\n", "x" * 5000, "</s>a<s><unk>",
           "\0 a", "日本 😀𐍈 ع", "a▁b ▁▁ c", " nbsp  ", "aaaaaaaaaaaaaaaaab" * 40, "1234567890 " * 30, "é́̂"]
    alphabet = "aabcdeéeinorst   \n\t.,'!#%日😀▁AB01"
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(rng.choices(["the", "in", "g", " ", "  ", "er", "at", "ion", "\n", "s"], k=40)) for _ in range(300)]
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return out + docs


def test_counts_and_ids_as_library(library, vocab):
    texts = samples()
    machine = tokens.Counter(vocab)
    auto = pieces.automaton(vocab)

    def ids(u):
        return auto.encode(u)

    def join(parts):
        return [i for p in parts for i in p]

    bare = pieces.Units(auto, ids, join, "")
    spaced, nl = pieces.Units(auto, ids, join, pieces.MARK, bare.parts), [vocab.bytes_at[10]]
    for t in texts:
        want = library.encode(t or "")
        got = [i for u in pieces.unit_results(pieces.spaced_text(t), bare, spaced, nl) for i in u]
        assert got == want, repr(t)[:200]
        assert machine.count(t) == len(want), repr(t)[:200]
        assert pieces.decode(vocab, want) == library.decode(want)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunk_maps_compose(library, vocab, chunk):
    machine = tokens.Counter(vocab)
    for t in [x for x in samples() if x and len(x) < 400][:300]:
        assert machine.count(t, chunk) == len(library.encode(t)), repr(t)


def test_fit_as_merges(vocab):
    auto, rng = pieces.automaton(vocab), random.Random(8)
    often = [i for i in vocab.plain if i < 2500]
    marks = [i for i in vocab.plain if not vocab.pieces[i].strip("▁")]
    for k in range(6000):
        pool = (often, vocab.plain, [*marks, *often[:40]])[k % 3]
        i, j = rng.choice(pool), rng.choice(pool)
        a, b = vocab.pieces[i], vocab.pieces[j]
        assert auto.fit(i, j) == (auto.merged(a + b) == [a, b]), (a, b)


def test_viterbi_unigram_brute():
    words = ["a", "b", "c", "▁", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bca"]
    rng = random.Random(1)
    scores = [-rng.uniform(1, 9) for _ in words]
    v = pieces.vocabulary(words, scores, range(len(words)), [-1] * 256, "unigram")
    a = pieces.Automaton(v)
    score = dict(zip(words, scores))

    def best(t):
        top = [0.0] + [float("-inf")] * len(t)
        for i in range(1, len(t) + 1):
            top[i] = max((top[j] + score[t[j:i]] for j in range(i) if t[j:i] in score), default=float("-inf"))
        return top[-1]

    for _ in range(200):
        t = "".join(rng.choices("abc▁", k=rng.randint(1, 12)))
        got = a.encode(t)
        assert "".join(words[i] for i in got) == t
        assert abs(sum(scores[i] for i in got) - best(t)) < 1e-9


def test_tables(spark, library, vocab):
    rows = [(i, t, 1, "x", "y", 2) for i, t in enumerate(samples()[:60])] + [(None, "null id", 1, "x", "y", 2), (3, "a", 1, "x", "y", 2)]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, vocab, limit=30).collect()}
    n = [len(library.encode(r[1] or "")) for r in rows]
    assert got == {(r[0], len((r[1] or "").encode()), k, k > 30) for r, k in zip(rows, n)}
    enc = pieces.encode_table(df, vocab)
    back = pieces.decode_table(enc, vocab).collect()
    assert len(back) == len(rows)
    assert {r.id: r.decoded for r in back if r.id not in (3, None)} == {
        r[0]: (r[1] or "").replace("▁", " ") for r in rows if r[0] not in (3, None)}
    for r in pieces.encode_digest(df, vocab).collect():
        if r.doc_id not in (3, None):
            t = rows[r.doc_id][1] or ""
            ids = library.encode(t)
            assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert r.round_trip == ("▁" not in t)
    none = df.where("false")
    assert tokens.token_counts(none, vocab).count() == pieces.encode_digest(none, vocab).count() == 0


def test_memo_keeps_what_is_frequent(monkeypatch):
    """Rare keys push each other out; a key that comes again and again is computed once."""
    monkeypatch.setattr(pieces, "MEMO", 20)
    asked = []

    class Whole:
        def cut(self, unit):
            return [unit]

    units = pieces.Units(Whole(), lambda part: asked.append(part) or len(part), sum, "")
    for i in range(200):
        assert units["often"] == 5 and units[f"rare{i}"] == len(f"rare{i}")
    assert asked.count("often") == 1 and len(asked) == 201 and len(units) + len(units.old) <= 20


@pytest.mark.parametrize("head", [1, 2, 4])
def test_beginnings_are_walked_once(library, vocab, monkeypatch, head):
    """Texts that begin alike share the ways through their beginning, and get the library's ids."""
    monkeypatch.setattr(pieces, "HEAD", head)
    monkeypatch.setattr(pieces, "MEMO", 60)
    auto, walked = pieces.Automaton(vocab), []
    walk = auto._walk
    auto._walk = lambda text, start, *rest: walked.append(text[start:]) or walk(text, start, *rest)
    for word in ["thening", "thenings", "theninger", "thening"]:
        assert auto.encode(pieces.MARK + word) == library.encode(word), word
    assert walked.count(f"{pieces.MARK}thening"[:head]) == 1 and len(walked) == 5
    for word in [t for t in samples() if t and t.isalpha()][:60]:
        assert auto.encode(pieces.MARK + word) == library.encode(word), word
        assert len(auto.heads) <= 10
