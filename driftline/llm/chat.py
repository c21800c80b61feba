"""Conversations from event logs, folded and rendered with DataFrame functions only.

A log has events (conversation, sequence, kind, role, text): `message` starts a message, `delta` adds to the last one,
`edit` replaces its text, `regenerate` replaces it and drops what the conversation said after it, `delete` takes it
away. Events are folded by slot (the message's place, such as a turn) and slots are put together in chunks before they
are put together as a conversation, so that no step gathers more than a chunk of slots or a conversation's chunks.

The rendered form of a turn is `<turn role=ROLE>TEXT</turn>` and a newline. In roles and texts a backslash is written
`\\\\`, `<` is written `\\l` and `>` is written `\\g`, so no text can hold a mark, and reading back is exact. The loss mask
is a list of spans (begin, end, in code points of the rendered string) over the texts of the assistant.

Defined cases: null text and null role are empty; rows of equal sequence are put in order by role and text, and equal
rows are turns of their own; a null sequence comes first; rows of a null conversation form one conversation; an empty
log gives no rows; texts of any length are taken whole; other columns of the log are not read; a delta, edit or delete without a message before it in its slot starts (or leaves) nothing but its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, SHUT = "<turn role=", ">", "</turn>\n"
#: Slots in a chunk.
CHUNK = 256


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(x: Column) -> Column:
    """Between pairs of backslashes every backslash begins an escape."""
    piece = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), piece), "\\")


def folded(log: DataFrame) -> DataFrame:
    """(conv, slot, seq, messages): the final messages (role, text) of every slot. log: conv, slot, seq, kind, role, text."""
    none = F.expr("CAST(array() AS array<struct<role:string,text:string>>)")
    last = lambda acc: F.element_at(acc, -1)
    before = lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)

    def step(acc: Column, e: Column) -> Column:
        fresh = F.struct(e["role"].alias("role"), e["text"].alias("text"))
        some = F.size(acc) > 0
        grown = lambda text: F.concat(before(acc), F.array(F.struct(last(acc)["role"].alias("role"), text.alias("text"))))
        return (
            F.when(e["kind"] == "delete", F.when(some, before(acc)).otherwise(acc))
            .when((e["kind"] == "delta") & some, grown(F.concat(last(acc)["text"], e["text"])))
            .when((e["kind"].isin("edit", "regenerate")) & some, grown(e["text"]))
            .otherwise(F.concat(acc, F.array(fresh)))
        )

    each = log.select("conv", "slot", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("message")).alias("kind")).alias("e"))
    by = each.groupBy("conv", "slot").agg(F.array_sort(F.collect_list("e")).alias("events"), F.max(F.when(F.col("e.kind") == "regenerate", F.col("e.seq"))).alias("again"), F.min("e.seq").alias("seq"))
    return by.select("conv", "slot", "seq", "again", F.aggregate("events", none, step).alias("messages"))


def rendered(log: DataFrame, regenerates: bool = True) -> DataFrame:
    """(conv, formatted, loss): the rendered conversation and its loss mask, an array of (begin, end).

    regenerates: whether the log may hold that event; without it slots need no look at each other.
    """
    slots = folded(log)
    chunk = F.floor(F.coalesce(F.col("slot").cast("double"), F.lit(-1.0)) / CHUNK)
    if regenerates:
        # A slot is dropped if an earlier one was generated again after it began: the latest such event so far, first over chunks of slots, then inside each.
        so_far = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rangeBetween(Window.unboundedPreceding, -1)
        placed = slots.where("slot IS NOT NULL").withColumn("chunk", chunk)
        tops = placed.groupBy("conv", "chunk").agg(F.max("again").alias("top")).withColumn("before", F.max("top").over(so_far("conv", "chunk"))).select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "before")
        near = placed.withColumn("inside", F.max("again").over(so_far("conv", "chunk", "slot"))).join(tops, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
        left = near.where(F.coalesce(F.greatest("inside", "before") <= F.col("seq"), F.lit(True))).select(*slots.columns)
        slots = left.unionByName(slots.where("slot IS NULL"))
    turn = lambda m: F.struct(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(CLOSE)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss"))
    laid = slots.select("conv", "slot", chunk.alias("chunk"), F.transform("messages", turn).alias("turns"))
    chunks = laid.groupBy("conv", "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "turns"))), lambda x: x["turns"])).alias("turns"))
    whole = chunks.groupBy("conv").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "turns"))), lambda x: x["turns"])).alias("turns"))
    start = F.expr("named_struct('at', 0L, 'spans', CAST(array() AS array<struct<begin:bigint,end:bigint>>))")

    def walk(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        spans = F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(SHUT)).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(SHUT))), "")
    return whole.select("conv", text.alias("formatted"), F.aggregate("turns", start, walk)["spans"].alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a rendered string."""
    pieces = F.filter(F.split(formatted, SHUT, -1), lambda p: p != "")
    at = lambda p: F.instr(p, CLOSE)
    read = lambda p: F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, at(p) + 1, F.length(p))).alias("text"))
    return F.transform(pieces, read)


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, put together."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
