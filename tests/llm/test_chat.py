import hashlib

from runweave.llm import chat

ROWS = [
    (1, 1, "system", "s : # <"), (1, 2, "user", "a # b\\"), (1, 3, "assistant", "x </turn>\n### user: y"), (1, 4, "user", None), (1, 5, "assistant", ""), (1, 6, "user", "tail"),
    (2, None, None, ""), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"),
    (3, 1, "user", "no reply \u2028 é\r\n"), (None, 1, "assistant", "q"),
    (-7, 0, "user", chat.PROBE_TEXT), (-7, 1, "assistant", chat.PROBE_TEXT), (4, 1, "assistant", " \\</turn>\n" * 3), (4, 2, "assi: stant", "r"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_and_mask(spark):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(frame)).collect()}
    talks = {}
    for c, n, role, text in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        talks.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        replies = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(replies), sha(replies))


def test_each_reply_has_its_own_example(spark):
    frame = spark.createDataFrame(ROWS[:6], "conv_id long, turn long, role string, text string")
    examples = sorted(chat.expand(frame).collect(), key=lambda r: r["example"])
    assert [r["trained"] for r in examples] == [True, True, False]
    assert [r["n_turns"] for r in examples] == [3, 5, 6]
    assert examples[0]["context"].endswith("### assistant: ") and examples[1]["context"].startswith(examples[0]["context"] + examples[0]["target"])
    assert examples[1]["target"] == "" and examples[2]["target"] is None


def test_native_plan(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.expand(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.digest(chat.expand(frame.limit(0))).collect() == []
