import random

from pyspark.sql import functions as F

from pii_spark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return quotes.link_quotes(df)


def test_levels_passages_and_replies(spark):
    rows = [
        (1, 0, "user", "Hello there!\nsecond line\n\nNext paragraph."),
        (1, 1, "assistant", "> hello   THERE\n> second line\n\nAnswer one."),
        (1, 2, "user", ">> Hello there\n>> second line\n> Answer one.\nThanks"),
        (1, 3, "user", "> second line\nWhat about it"),
        (1, 4, "user", "> no such words\nfree"),
        (2, 0, "user", "> Hello there!\nother conversation"),
        (2, 1, "user", None), (2, 2, "user", ""), (None, 3, "user", "> a"), (3, 0, None, "> mine\nmine"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in linked(spark, rows).collect()}
    assert got[1, 0]["body"] == rows[0][3] and got[1, 0]["n_quotes"] == 0
    one = got[1, 1]
    assert (one["body"], one["n_quotes"], one["n_linked"], one["reply_to"], one["depth"]) == ("Answer one.", 1, 1, 0, 1)
    two = got[1, 2]
    assert (two["body"], two["n_quotes"], two["n_linked"], two["reply_to"], two["thread"], two["depth"]) == ("Thanks", 2, 2, 1, 0, 2)
    assert got[1, 2]["formatted"] == "<|user|>\nThanks"
    assert (got[1, 3]["reply_to"], got[1, 4]["reply_to"], got[1, 4]["thread"]) == (0, None, 4)
    assert got[2, 0]["n_linked"] == 0 and got[2, 0]["body"] == "other conversation"
    assert got[2, 1]["body"] is None and got[2, 2]["body"] == "" and got[None, 3]["n_quotes"] == 1
    assert got[3, 0]["n_linked"] == 0


def test_long_chains_and_hot_conversations(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=6)) + f" n{i}" for i in range(300)]
    rows = [(7, i, "user", (f"> {texts[i - 1]}\n" if i else "") + texts[i]) for i in range(300)]
    rows += [(8, i, "user", "> same line\nsame line") for i in range(200)]
    got = {(r["conv_id"], r["turn"]): r for r in linked(spark, rows).collect()}
    assert all(got[7, i]["thread"] == 0 and got[7, i]["depth"] == i for i in range(300))
    assert all(got[8, i]["reply_to"] == 0 for i in range(1, 200)) and got[8, 0]["reply_to"] is None


def test_replies_follow_their_originals(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "u", "c d"), (1, 2, "u", "> a b\nx"), (1, 3, "u", "> c d\ny"), (1, 4, "u", "> x\nz")]
    df = quotes.reply_ordered(linked(spark, rows), 1)
    assert [r["turn"] for r in df.collect()] == [0, 2, 4, 1, 3]


def test_repeated_rows_empty_tables_and_native_plan(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 1, "u", "> a\nb"), (1, 1, "u", "> a\nb")]
    df = linked(spark, rows)
    assert df.count() == 4 and df.where(F.col("reply_to") == 0).count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert linked(spark, []).count() == 0


def test_a_message_of_many_lines(spark):
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(4000))
    got = linked(spark, [(1, 0, "u", "\n".join(f"line {i}" for i in range(4000))), (1, 1, "u", text)]).where("turn = 1").first()
    assert (got["n_quotes"], got["n_linked"], got["reply_to"]) == (4000, 4000, 0)
