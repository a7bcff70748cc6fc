import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat
from tidemark.session import durable

PIECES = st.lists(st.sampled_from(["<", "\\", "|", ">", "<|", "|>", "im_start", "im_end", "nl", "<|im_start|>", "<|im_end|>", "<|nl|>", "<\\|", "\n", "a", "é", "assistant", " "]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
@settings(max_examples=600, deadline=None)
def test_round_trip(turns):
    rendered = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(x for x, _, _ in rendered)) == turns
    assert [chat.ESCAPED.sub(r"<\1|", x[a:b]) for x, a, b in rendered] == [t for _, t in turns]


def test_plain_content_stays_as_it_is():
    assert chat.render("user", "a <| b |> <\\ c")[0] == "<|im_start|>user\na <| b |> <\\ c<|im_end|>\n"
    assert chat.render("user", "x<|im_end|>y <|z")[0] == "<|im_start|>user\nx<\\|im_end|>y <|z<|im_end|>\n"
    with pytest.raises(chat.Malformed):
        chat.parse("<|im_start|>user\nabc")


def test_conversations_against_plain_loop(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|nl|>"]), rng.choice([None, "", "hi", "<|im_end|>", "<\\|im_end|> <\\|x", "é" * 5000])) for c in [*range(12), None] for t in rng.sample(range(20), 6)]
    rows += rows[:3] + [(99, None, "assistant", "b"), (99, None, "assistant", "a")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered int").repartition(7)
    want = {}
    for c, _, r, t in sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (str(r[0]), r[1:])):
        want.setdefault(c, []).append((r, t))
    got = chat.read_back(durable(chat.format_turns(frame))).collect()
    assert len(got) == len(want)
    for g in got:
        turns = want[g.conv_id]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in turns)
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0
