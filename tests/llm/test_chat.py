import random

import pytest

from trustloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, conv string, turns int, a string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS)


def show(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    out = [n, "".join(show(*t[1:]) for t in a[:n])]
    for side in (a[n:], b[n:]):
        out.append("".join(show(*t[1:]) for t in side))
    for side in (a[n:], b[n:]):
        mask = []
        for _, role, text in side:
            head, body = len(f"<|im_start|>{role or ''}\n"), len(f"{text or ''}<|im_end|>\n")
            mask.append((head, body) if role == "assistant" else (head + body, 0))
        out.append(mask)
    return out


def key(t):
    return tuple((x is not None, x) for x in t)


def test_brute(spark):
    rng = random.Random(5)
    convs = {}
    for i in range(60):
        turns = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "", None, "é😀", "x" * 5000]))
                 for k in range(rng.randint(1, 7))]
        if i % 2 and rng.random() < 0.8:
            turns = convs[i - 1][:rng.randint(0, 5)] + turns
            turns = [(k, r, t) for k, (_, r, t) in enumerate(turns)]
        convs[i] = turns
    convs[7].append(convs[7][-1])
    convs[9].append((None, "user", "no number"))
    rows = [(i, *t) for i, turns in convs.items() for t in turns] + [(None, 0, "user", "lost"), (70, 0, "user", "alone"), (73, 0, "user", "odd")]
    rng.shuffle(rows)
    turns = frame(spark, rows)
    got = {(r.chosen_id, r.rejected_id): r for r in chat.preferences(turns, chat.neighbour_pairs(turns)).collect()}
    assert set(got) == {(i, i + 1) for i in range(0, 60, 2)} | {(70, None), (None, 73)}
    for i in range(0, 60, 2):
        r = got[i, i + 1]
        a, b = (sorted(convs[k], key=key) for k in (i, i + 1))
        want = brute(a, b)
        assert [r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask]] == want
        assert sum(m.skip + m.learn for m in r.chosen_mask) == len(r.chosen)
    one = got[70, None]
    assert (one.prompt, one.chosen, one.rejected, one.rejected_mask) == ("", show("user", "alone"), None, None)


@pytest.mark.parametrize("same", [True, False])
def test_copies_and_hot_chosen(spark, same):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good")]
    rows += [(i, k, r, t) for i in range(1, 200) for k, r, t in ((0, "user", "q"), (1, "assistant", "good" if same else f"bad{i}"))]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 200)], "chosen_id long, rejected_id long")
    got = chat.preferences(frame(spark, rows), pairs).collect()
    assert len(got) == 199 and {r.n_prompt_turns for r in got} == {2 if same else 1}
    assert {r.chosen for r in got} == {"" if same else show("assistant", "good")}


def test_empty(spark):
    none = frame(spark, [])
    assert chat.preferences(none, chat.neighbour_pairs(none)).count() == 0
