import hashlib

from pyspark.sql import functions as F

from sparkwell.llm import chat

TEXTS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>x", "a\\<\\|im_sep|> <\\\\s> [\\INST] <<SYS>> [[INST] <", "", None, "ünï\n\n", "<\\/s>"]


def rows():
    out = [(i, t, r, x, "clash") for i, x in enumerate(TEXTS) for t, r in ((2, "assistant"), (0, "user"), (1, "user"), (3, "assistant"), (4, "<s>tool"))]
    return [*out, (90, None, None, "n", ""), (90, 1, "assistant", "n", ""), (90, 1, "assistant", "n", ""), (None, 1, "user", "x", None)]


def test_round_trip(spark):
    data = rows()
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted).collect()}
    raw = {r.conv_id: r for r in formatted.collect()}
    for conv in {r[0] for r in data}:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in data if c == conv))
        assert read[conv] == [(r, x) for _, r, x in mine]
        told = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        learned = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(mine), len(learned))
        at, masked = 0, ""
        for m in raw[conv].mask:
            at += m.skip
            masked += raw[conv].formatted[at : at + m.length] if m.learned else ""
            at += m.length
        assert at + len(chat.END) == len(raw[conv].formatted) == got[conv].formatted_chars
        assert len(masked) >= len(learned)
    # Adjacent turns of one role share a message.
    assert raw[0].formatted.count(chat.START) == 3
    assert "</s>" not in raw[0].formatted and "[INST]" not in raw[0].formatted


def test_long_conversations(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 20) for i in range(4000)] + [(2, 0, "assistant", "long " * 200_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    learned = "".join(x for c, _, r, x in turns if c == 1 and r == "assistant")
    assert got[1].n_turns == 4000 and got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[2].loss_chars == 1_000_000


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_loss_is_what_the_mask_covers(spark):
    turns = spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_conversations(turns)
    none = formatted.withColumn("mask", F.transform("mask", lambda m: m.withField("learned", F.lit(False))))
    assert {(r.loss_chars, r.loss_sha256) for r in chat.digests(none).collect()} == {(0, hashlib.sha256(b"").hexdigest())}
    every = formatted.withColumn("mask", F.transform("mask", lambda m: m.withField("learned", F.lit(True))))
    texts = {r.conv_id: "".join(t.text for t in r.turns) for r in chat.read_back(formatted).collect()}
    assert {r.conv_id: r.loss_sha256 for r in chat.digests(every).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()}
