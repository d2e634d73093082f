import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pocketlens.llm import chat

PARTS = ["<|im_start|>", "<|im_end|>", "<|", "<\\|", "<\\\\|", "\\", "\n", "<", "|>", "\\n", "\\l", "assistant", "é", " ", "a"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    segments = [chat.write_turn(role, text) for role, text in turns]
    whole = "".join(s for s, _, _ in segments)
    assert [t[:2] for t in chat.parse(whole)] == turns
    for (segment, start, end), (_, text) in zip(segments, turns):
        assert chat.unescape_text(segment[start:end]) == text


def test_plain_text_is_not_escaped():
    assert chat.write_turn("user", "1 < 2 <| 3 \\ 4")[0] == "<|im_start|>user\n1 < 2 <| 3 \\ 4<|im_end|>\n"


def test_outside_the_grammar():
    for text in ("x", "<|im_start|>user", "<|im_start|>u\nx", "<|im_start|>u\nx<|im_end|>", "<|im_start|>u\n<|im_start|>x<|im_end|>\n"):
        assert chat.parse(text) is None
    assert chat.parse("") == []


def test_digests(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo"), (1, 2, "assistant", None), (2, 5, "assistant", "<\\|"),
        (3, 0, None, "no role"), (3, None, "assistant", "first"), (None, 0, "assistant", "null conversation"), (4, 0, "user", ""),
        (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (6, 0, "assistant", "é" * 50_000),
    ]
    rows += [(7, i, "assistant", f"t{i}") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    turns = turns.selectExpr("*", "1 AS segment", "2 AS n_turns")
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    conversations = {}
    for conv_id, turn, role, text in rows:
        conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == conversations.keys()
    for conv_id, own in conversations.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        everything = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        chars = sum(len(chat.write_turn(r, t)[0]) for _, _, r, t in own)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (everything, loss)]
        assert got[conv_id] == (len(own), sha[0], len(loss), sha[1], chars)


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversation_digests(chat.format_turns(turns)).count() == 0
