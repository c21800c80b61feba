import hashlib
import random

from pyspark.sql import functions as F

from driftline.llm import chat


def log(spark, rows):
    return spark.createDataFrame(rows, "conv long, slot long, seq long, kind string, role string, text string")


def read(df):
    out = df.select("conv", "formatted", "loss", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("masked"))
    return {r.conv: ([(t.role, t.text) for t in r.turns], r.masked, r.formatted) for r in out.collect()}


def test_round_trip_of_hostile_texts(spark):
    rnd = random.Random(1)
    bits = ["\\", "<", ">", "l", "g", "\\l", "</turn>\n", "<turn role=assistant>", "### Assistant:", "é", "\U0001f600", "\n", "", " "]
    rows, want = [], {}
    for conv in range(40):
        for slot in range(rnd.randrange(1, 9)):
            role, text = rnd.choice(["user", "assistant", "system", "a>b<\\"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
            rows.append((conv, slot, slot, "message", role, text))
            want.setdefault(conv, []).append((role, text))
    rnd.shuffle(rows)
    got = read(chat.rendered(log(spark, rows)))
    for conv, turns in want.items():
        assert got[conv][0] == turns
        assert got[conv][1] == "".join(t for r, t in turns if r == "assistant")


def test_events(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "delta", None, "!"),
        (1, 2, 4, "message", "user", "no"), (1, 3, 5, "message", "assistant", "gone"),
        (1, 1, 6, "regenerate", None, "Good "), (1, 1, 7, "delta", None, "day"),
        (1, 2, 8, "message", "user", "thanks"), (1, 0, 9, "edit", None, "hello"),
        (2, 0, 0, "message", "user", "x"), (2, 0, 1, "delete", None, None), (2, 1, 2, "message", "user", "y"), (2, 1, 2, "message", "user", "y"),
        (None, None, None, "message", None, None), (3, 0, 0, "delta", "user", "lone"),
    ]
    got = read(chat.rendered(log(spark, rows)))
    # Turn 2 began before turn 1 was generated again, so what it held is dropped with it.
    assert got[1][0][:2] == [("user", "hello"), ("assistant", "Good day")] and ("assistant", "gone") not in got[1][0]
    assert got[1][1] == "Good day"
    assert got[2][0] == [("user", "y"), ("user", "y")]
    assert got[None][0] == [("", "")] and got[3][0] == [("user", "lone")]
    assert chat.rendered(log(spark, rows).where("false")).count() == 0


def test_many_chunks(spark):
    rows = [(1, i, i, "message", "assistant" if i % 2 else "user", f"t{i}") for i in range(1000)]
    turns, masked, _ = read(chat.rendered(log(spark, rows), regenerates=False))[1]
    assert [t for _, t in turns] == [f"t{i}" for i in range(1000)]
    assert hashlib.sha256(masked.encode()).hexdigest() == hashlib.sha256("".join(f"t{i}" for i in range(1, 1000, 2)).encode()).hexdigest()
