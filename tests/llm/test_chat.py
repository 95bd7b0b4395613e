from collections import defaultdict

from threadloom.llm import chat

TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye é"), (1, 3, "cy", ""), (2, 0, "system", "alone"), (3, None, None, "who?"), (3, 1, " ", "me"), (None, 5, "ann", "no id"), (4, 1, "ann", "x"), (4, 1, "ann", "x")]


def test_every_participant_is_the_assistant_once(spark):
    d = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, piece string")
    rows = chat.rotate(d).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id, r.participant].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown"), (None, "ann"), (4, "ann")}
    for (conv, who), rs in by.items():
        assert len(rs) == sum(t[0] == conv for t in TURNS)
        whole = "".join(r.piece for r in sorted(rs, key=lambda r: r.start))
        for r in rs:
            assert whole[r.start : r.stop] + "\n<|end|>\n" == r.piece[r.piece.index("|>\n") + 3 :]
            assert r.train == (r.speaker == who) == (r.role == "assistant") and (r.name == r.speaker) == (r.role == "user")
    assert [r.piece for r in sorted(by[1, "bob"], key=lambda r: r.start)][:3] == ["<|system|>\nBe kind.\n<|end|>\n", "<|user name=ann|>\nHi\n<|end|>\n", "<|assistant|>\n\n<|end|>\n"]
    whole = {(r.conv_id, r.participant): r for r in chat.render(chat.rotate(d)).collect()}
    assert [whole[1, "ann"].rendered[s.start : s.stop] for s in whole[1, "ann"].spans] == ["Hi", "Bye é"]
    assert chat.rotate(d.limit(0)).count() == 0
