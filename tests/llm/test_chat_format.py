import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from langweave.llm.chat_format import (
    escape,
    example_texts,
    examples,
    format_conversations,
    format_turn,
    parse_turn,
    read_digests,
    unescape,
    written,
)

COLUMNS = "conv_id long, turn long, role string, text string"
PARTS = st.lists(
    st.sampled_from(["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", "[", "a", "\n", "é"])
)


@settings(max_examples=400, deadline=None)
@given(PARTS, PARTS)
def test_turns_round_trip(role, text):
    role, text = "".join(role), "".join(text)
    assert unescape(escape(text)) == text
    formatted, low, high = format_turn(role, text)
    assert parse_turn(formatted) == (role, text)
    assert unescape(formatted[low:high]) == text
    inside = formatted[len("<|turn|>") : -len("<|end|>")]
    assert inside.count("<|") == 1 and not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        out[conv] = (len(turns), sha[0], len(loss), sha[1])
    return out


def read(spark, rows):
    formatted = written(spark.createDataFrame(rows, COLUMNS))
    got = read_digests(formatted, examples(formatted)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_given_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert read(spark, rows) == digests(rows)


def test_awkward_rows(spark):
    tricky = "</s>[INST] ok [/INST]"
    rows = [
        (-1, 0, "user", tricky),
        (-1, 1, "assistant", tricky),
        (None, 0, "assistant", None),
        (None, 1, None, "x"),
        (2**60 + 1, None, "system", ""),
        (2**60 + 1, 3, "assistant", "y" * 200_000),
        (2**60 + 1, 3, "assistant", "y" * 200_000),
        (5, 1, "ass<|text|>istant", "\\<|end|>\\"),
    ]
    assert read(spark, rows) == digests(rows)
    empty = spark.createDataFrame([], COLUMNS)
    assert read_digests(format_conversations(empty), examples(format_conversations(empty))).collect() == []


def test_each_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(6)]
    formatted = written(spark.createDataFrame(rows, COLUMNS))
    found = examples(formatted).orderBy("example").collect()
    assert [r.example for r in found] == [1, 3, 5]
    texts = {r.example: r for r in example_texts(formatted, examples(formatted)).collect()}
    for r in found:
        whole = "".join(format_turn(role, text)[0] for _, k, role, text in rows if k <= r.example)
        assert texts[r.example].text == whole and len(whole) == r.example_end
        assert whole[r.target_start : r.target_end] == f"t{r.example}"
        assert whole[: r.context_end] == "".join(format_turn(role, t)[0] for _, k, role, t in rows if k < r.example)
