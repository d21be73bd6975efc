"""Chat formatting: round trips, parts, positions over partitions, digests."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semweave.llm import chat_format as C

ROWS = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "<|end|>\n", "\\<|turn|>user\n", "a\\n<|", "<|image 1|>", "\\\\<|\\", "<", "|>", "ä\u2028😀\n\n", "<|<|end|>"]


@given(st.lists(st.sampled_from(["\\", "<", "|", ">", "n", "\n", "<|", "|>", "<|end|>", "<|turn|>", "image 1", "x", "😀"])),
       st.lists(st.sampled_from(["\\", "<|", "\n", "user", "n", "<|end|>\n"])))
@settings(max_examples=300, deadline=None)
def test_messages_round_trip(text, role):
    text, role = "".join(text), "".join(role)
    formatted, _, attached, _ = C.format_message(role, [{"type": "text", "text": text}])
    assert C.read_message(formatted) == (role, text) and not attached
    assert formatted.count("<|turn|>") - formatted.count("\\<|turn|>") == 1


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <|image 1|>"}, {"type": "image", "ref": "s3://b/1.png", "width": 57, "height": 28},
             {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 3},
             {"type": None, "text": "end"}, {"type": "video", "ref": "v.mp4"}, None, {}]
    formatted, loss, attached, tokens = C.format_message("assistant", parts)
    assert formatted == ("<|turn|>assistant\nsee \\<|image 1|><|image 1|><|audio 2|><|document 3|>end<|file 4|><|end|>\n")
    assert [(a["number"], a["kind"], a["ref"], a["n_tokens"]) for a in attached] == [
        (1, "image", "s3://b/1.png", 3), (2, "audio", "a.wav", 25), (3, "document", "d.pdf", 1536), (4, "file", "v.mp4", 1)]
    assert tokens == 3 + 25 + 1536 + 1
    for a in attached:
        assert formatted[a["start"]:].startswith(f"<|{a['kind']} {a['number']}|>")
    assert [C.unescape(formatted[s:e]) for s, e in loss] == ["see <|image 1|>", "end"]
    assert C.format_message("user", parts)[1] == []


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0,
                                                              (r[2] or "").encode(), (r[3] or "").encode())):
        role, text = role or "", text or ""
        t = out.setdefault(conv, [0, "", "", 0])
        t[0] += 1
        t[1] += f"{role}\n{text}\n"
        t[2] += text if role == "assistant" else ""
        t[3] += len("<|turn|>" + C.escape_role(role) + "\n" + C.escape(text) + "<|end|>\n")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(a), sha(a), k) for c, (n, t, a, k) in out.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(7, k, rnd.choice(["user", "assistant"]), f"{rnd.choice(ODD)} {k}") for k in range(400)]  # a third of all rows
    out += [(c, k, r, rnd.choice(ODD)) for c in range(20, 140) for k, r in enumerate(["system", "user", "assistant"])]
    out += [(None, 0, "user", "no id"), (None, None, None, None), (300, 1, "assistant", "tie b"), (300, 1, "assistant", "tie a"),
            (300, None, "user", "first"), (301, 0, "user", "same"), (301, 0, "user", "same"), (302, 0, "assistant", "w " * 200_000)]
    return out


def digests(df):
    return {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"])
            for r in df.collect()}


def test_digests_equal_brute_force(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    clash = df.select("*", *[F.lit("clash").alias(c) for c in ("conv", "lot", "at", "over", "formatted", "parts", "loss")])
    formatted = C.format_conversations(clash)
    assert formatted.where("over").select("conv").distinct().count() >= 1  # the long conversation is split
    want = brute(rows)
    assert digests(C.read_back(formatted, in_place=True)) == want
    formatted.write.parquet(str(tmp_path / "f"))  # stored output, read in any order
    assert digests(C.read_back(spark.read.parquet(str(tmp_path / "f")).repartition(3, F.rand(1)))) == want


def test_positions_run_through_the_whole_conversation(spark, rows):
    out = C.format_conversations(spark.createDataFrame(rows, ROWS)).where("conv = 7").orderBy("at").collect()
    assert [r["at"] for r in out] == list(range(400))
    start = 0
    for r in out:
        assert r["start"] == start and r["turn"] == r["at"]
        start += r["n_chars"]


def test_attachments_are_counted_across_messages(spark):
    part = "struct<type:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>"
    rows = [(1, k, "user", None, [("text", f"t{k}", None, None, None, None, None), ("image", None, f"r{k}", 56, 28, None, None)])
            for k in range(30)] + [(1, 30, "assistant", "plain", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content array<{part}>")
    out = C.format_conversations(df, parts_col="content").orderBy("at").collect()
    assert [r["first_file"] for r in out] == [*range(30), 30] and [r["first_token"] for r in out] == [2 * k for k in range(31)]
    assert out[30]["formatted"] == "<|turn|>assistant\nplain<|end|>\n" and out[30]["loss"][0].asDict() == {"start": 18, "end": 23}
    assert out[4]["attachments"][0]["ref"] == "r4"


def test_text_tokens(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, 0, "user", "how many tokens <|end|>")], ROWS)
    n = C.format_conversations(df, model_file=path).first()["n_tokens"]
    assert n == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("how many tokens <|end|>"))


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert C.format_conversations(df).count() == 0 and C.read_back(C.format_conversations(df)).count() == 0
    assert [r["conv_id"] for r in C.chat_digests(df).collect()] == [-7]
