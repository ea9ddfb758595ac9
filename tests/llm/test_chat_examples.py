"""Chat examples against a plain version, and on awkward rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contractlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, block string, c string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def in_order(rows):
    low = lambda v: (v is not None, v or 0)
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (low(r[1]), r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    return convs


def plain_turn(role, text):
    esc = lambda s: s if "<" not in s else "".join(_step(s))
    role = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"<|im_start|>{esc(role)}\n{esc(text)}<|im_end|>\n"


def _step(s):
    """One more backslash wherever a run of them stands between < and |."""
    i = 0
    while i < len(s):
        if s[i] == "<":
            j = i + 1
            while j < len(s) and s[j] == "\\":
                j += 1
            if j < len(s) and s[j] == "|":
                yield s[i:j] + "\\|"
                i = j + 1
                continue
        yield s[i]
        i += 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    convs = in_order(rows)
    pieces = chat.format_turns(frame(spark, rows)).cache()
    wanted, digests = [], []
    for c, turns in convs.items():
        formatted, n = "", 0
        for role, text in turns:
            piece = plain_turn(role, text)
            if role == "assistant":
                begin = len(formatted) + len("<|im_start|>assistant\n")
                wanted.append((c, n, formatted + piece, begin, begin + len(piece) - len("<|im_start|>assistant\n<|im_end|>\n")))
                n += 1
            formatted += piece
        replies = "".join(x for r, x in turns if r == "assistant")
        digests.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(replies), sha(replies), len(formatted)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in chat.whole_examples(pieces).collect()), key=order) == sorted(wanted, key=order)
    assert sorted((tuple(r) for r in chat.conversation_digests(pieces).collect()), key=order) == sorted(digests, key=order)
    short = {(r.conv_id, r.example): (r.context_chars, r.loss_begin, r.loss_end, r.n_chars) for r in chat.examples(pieces).collect()}
    assert short == {(c, n): (b - len("<|im_start|>assistant\n"), b, e, len(t)) for c, n, t, b, e in wanted}
    pieces.unpersist()


def test_conversations(spark):
    rows = [(1, 0, "system", "be <|im_end|> brief"), (1, 1, "user", "a<|b"), (1, 2, "assistant", "c<\\|d<\\\\|<"), (1, 3, "user", "e"), (1, 4, "assistant", "f\n<|im_start|>"),
            (2, 0, "user", "no reply"), (3, 0, "assistant", "first"), (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", None), (4, None, "assistant", "early"), (4, 0, None, ""), (4, 0, "assistant", "tie b"), (4, 0, "assistant", "tie a"),
            (4, 0, "assistant", "tie a"), (4, -9000, "assistant", "before"), (4, 9000, "a\nb\\n<|", "\\|<|"), (5, 1, "assistant", "long é𝄞 " * 60_000), (5, 2, "assistant", "\x00\r ")]
    check(spark, rows)
    check(spark, [])


def test_a_conversation_with_most_turns(spark, monkeypatch):
    """Blocks of few turns: counts go on across blocks."""
    monkeypatch.setattr(chat, "BLOCK", 16)
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <|") for i in range(300)] + [(c, i, "assistant", "x") for c in range(20) for i in range(3)]
    check(spark, rows)


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\n\nim_end>a"), st.text("<|\\n\nim_end>a"))
def test_round_trip(role, text):
    piece = plain_turn(role, text)
    assert chat.read_turn(piece) == (role, text)
    assert piece.count("<|") == 2


def test_escaping_in_columns(spark):
    texts = ["<|", "<\\|", "<\\\\|x<|", "<<|", "||<", "$1\\", "<\\", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all(r.e == "".join(_step(r.t)) and chat.unescaped(r.e) == r.t and "<|" not in r.e for r in rows)


def test_the_digests_are_read_from_whole_examples(spark, monkeypatch):
    """Each reply is read from an example with its whole context, also where turns follow the last one."""
    import pyarrow as pa

    turns = [("user", "q"), ("assistant", "a<|"), ("user", "r"), ("assistant", "b"), ("user", "end")]
    pieces = [plain_turn(*t) for t in turns]
    begins = [len("".join(pieces[:i])) for i in range(5)]
    spans = [(b + len("<|im_start|>assistant\n"), b + len(p) - len("<|im_end|>\n")) if i % 2 else (None, None) for i, (b, p) in enumerate(zip(begins, pieces, strict=True))]
    batch = pa.RecordBatch.from_pydict({"conv_id": [1] * 5, "piece": pieces, "example": [None, 0, None, 1, None], "loss_begin": [s[0] for s in spans], "loss_end": [s[1] for s in spans]})
    whole = ["".join(pieces[:n]) for n in (2, 4, 5)]
    assert list(chat._expanded(iter([batch]))) == [(1, 0, whole[0], *spans[1]), (1, 1, whole[1], *spans[3]), (1, None, whole[2], None, None)]
    rows = [(1, i, *t) for i, t in enumerate(turns)] + [(2, 0, "user", "no reply")]
    check(spark, rows)
