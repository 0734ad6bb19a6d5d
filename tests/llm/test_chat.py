import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from paywire.llm import chat


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="\\[]<>/INSTs:\nuser ok\U0001f600", max_size=40), st.text(alphabet="a]\\[<\n", max_size=6))
def test_escape_is_exact(body, role):
    assert chat.unescape(chat.escape(body)) == body
    one, at = chat.turn_text(role, chat.escape(body))
    two = chat.turn_text("x", chat.escape("]\\" + body))[0]
    turns = chat.read_back(one + two)
    assert [(r, chat.unescape(b)) for r, b, _, _ in turns] == [(role, body), ("x", "]\\" + body)]
    assert turns[0][2] == at


def test_conversations(spark):
    marks = "</s>[INST] ok [/INST]</s>\n\\"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", marks), (1, 1, "assistant", "b"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (-7, 0, "user", "a\U0001f600"), (1, 3, "assistant", "z" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = table.select("conv_id", "turn", "role", chat.text_parts(table.text).alias("content"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(messages)).collect()}
    assert len(got) == 4
    for k in (1, 2, None, -7):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == k))
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(messages.limit(0))).count() == 0


def test_parts(spark):
    p = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    content = [p("text", "see [image:0]"), p("image", ref="a.png", width=513, height=512), p("audio", ref="b.wav", seconds=2.1), p("text", "!"), None, p("document", ref="c.pdf", pages=3), p("vi deo]", ref="d")]
    rows = [(1, 0, "user", content), (1, 1, "assistant", [p("image", ref="e", width=1, height=1)]), (2, 0, "user", None)]
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_conversations(messages).collect()}
    body = r"see \[image:0][image:0][audio:1]![document:2][video:3]"
    assert got[1]["formatted"].startswith(f"[INST:user]\n{body}[/INST]</s>\n")
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, "image", "a.png", 425), (1, "audio", "b.wav", 27), (2, "document", "c.pdf", 1800), (3, "video", "d", 0), (4, "image", "e", 255)]
    assert got[1]["attached_tokens"] == 425 + 27 + 1800 + 255
    span = got[1]["loss"][0]
    assert got[1]["formatted"][span["start"] : span["end"]] == "[image:4]"
    assert chat.unescape(chat.read_back(got[1]["formatted"])[0][1].replace("[audio:1]", "")).startswith("see [image:0]") and got[2]["attachments"] == []


def test_ids_of_other_types_and_other_columns(spark):
    rows = [("b", 1, "user", "x", 9), ("b", 2, "assistant", "y", 9), ("a", 1, "assistant", "z", 9)]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, formatted int")
    made = chat.format_conversations(table.withColumn("content", chat.text_parts(table.text)))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(made).collect()}
    assert got == {"b": (2, 1), "a": (1, 1)}
    assert chat.digests(chat.format_conversations(table.limit(0).withColumn("content", chat.text_parts(table.text)))).count() == 0
