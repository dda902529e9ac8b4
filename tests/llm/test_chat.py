from siltstone.llm import chat

ROWS = [
    (1, 0, "system", "be kind", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "hello", 1), (1, 3, None, None, 1), (1, 3, None, None, 1),
    (2, 0, "system", "alone", 1), (None, 0, "amy", "first", 1), (None, None, "ben", "second", 1),
]


def test_every_participant_is_once_the_assistant(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, perspective int")
    got = chat.rotate_perspectives(frame).collect()
    one = [r for r in got if r.conv_id == 1]
    assert {r.perspective for r in one} == {"user", "assistant", "unknown"} and len(one) == 15
    assert not [r for r in got if r.conv_id == 2]
    assert {(r.perspective, r.turn, r.mask) for r in got if r.conv_id is None} == {("amy", 0, 1), ("amy", None, 0), ("ben", 0, 0), ("ben", None, 1)}
    for r in got:
        assert (r.role == "assistant") == (r.mask == 1)
        if r.mask:
            assert r.rendered[r.mask_start : r.mask_end].endswith(chat.END)
    assert [r.rendered for r in one if r.perspective == "assistant" and r.turn == 1] == ["<|im_start|>user name=user\nhi<|im_end|>\n"]


def test_empty_table(spark):
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
