from hearthframe.llm import chat


def test_maximal_conversations(spark):
    rows = [
        (1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0),
        (2, 0, "user", "a", 0), (2, 1, "assistant", "b", 0), (2, 2, "user", "c", 0),
        (3, 0, "user", "a", 0), (3, 1, "assistant", "b", 0), (3, 2, "user", "c", 0),
        (4, 0, "user", "a", 0), (4, 1, "assistant", "x", 0),
        (5, None, None, None, 0), (None, 0, "user", "lost", 0), (6, 0, "user", "", 0), (6, 0, "user", "", 0),
        (7, 0, "usera", "", 0), (8, 0, "user", "b" * 200_000, 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.chats(df).collect()}
    assert set(got) == {2, 4, 5, None, 6, 7, 8}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[2] == (3, turn("user", "a") + turn("assistant", "b") + turn("user", "c"))
    assert got[5] == (1, turn("", "")) and got[6] == (2, turn("user", "") * 2)
    assert chat.chats(df.limit(0)).count() == 0


def test_against_prefix_scan(spark):
    talks = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    keep = set()
    for c, t in talks.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t or o == t and d < c for d, o in talks.items() if d != c)
        if not longer:
            keep.add(c)
    assert {r.conv_id for r in chat.op10(spark, "/root/testdata/sf0.01").collect()} == keep
