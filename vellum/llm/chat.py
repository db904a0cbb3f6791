"""Chat formatting in budgeted windows.

Each turn is rendered between marks, with control strings inside its text escaped. Prefix sums
of turn tokens deal the turns of a conversation to windows, cut between turns. A window begins
with the conversation's system turn, repeats a limited history of the turns before it, and then
has its own turns. Only the texts of its own assistant turns are under the loss mask, so each is
learnt from once.

What the budget leaves beside the system turn and the history is the room for own turns. A turn
of more than half the room has a window of its own; the others are dealt by where they begin, to
stretches of half the room, so that the turns of one stretch never take more than the room. A
window is beyond the budget only if its own single turn doesn't fit beside the system turn; then
it repeats no history.

Prefix sums are made in two steps, within blocks of turn numbers and over blocks, so that a long
conversation isn't one task; what is gathered into one row is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import bpe
from vellum.llm.common import map_arrow, map_columns, materialise, resident
from vellum.llm.token_store import LibraryEncoder

BUDGET = 512
HISTORY = 128
BLOCK = 64
LEARNT = "assistant"
SYSTEM = "system"
START, MIDDLE, END = "### ", ": ", " </turn>\n"
#: Control strings and what stands for them; the backslash itself comes first when escaping and last when reading back.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: str) -> str:
    for plain, coded in reversed(ESCAPES):
        text = text.replace(coded, plain)
    return text


def estimate_tokens(turns: DataFrame) -> DataFrame:
    """Add ``tokens``: four characters of ``shown`` a token, and one more for each turn."""
    return turns.withColumn("tokens", (F.ceil(F.length("shown") / 4) + 1).cast("long"))


def count_tokens(path: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``tokens``: the number of ids of ``shown`` by the tokenizers library with a byte-level vocabulary.
    Marks are cut from texts by the vocabulary's pattern, so the turns' numbers add up to that of the window."""

    def add(turns: DataFrame) -> DataFrame:
        def make():
            tokenizer = resident(("library", path), lambda: LibraryEncoder(path)).tokenizer
            return lambda batch: [[len(x.ids) for _, t in bpe.slices(batch, "shown") for x in tokenizer.encode_batch_fast(t.to_pylist(), add_special_tokens=False)]]

        return map_columns(turns, [T.StructField("tokens", T.LongType())], make)

    return add


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[DataFrame], DataFrame] = estimate_tokens) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns that an earlier window has too), loss_spans (code points, end exclusive), n_tokens.

    Turns are ordered by turn (nulls first), then role and text. Null roles and texts are empty; a null
    conv_id is a conversation of its own. The system turn is the conversation's first turn, if it has that
    role. A window's number is that of its first own turn, from 1. Extra columns are left out; an empty table
    gives an empty one.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    inner = escape(F.col("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(head, inner, F.lit(END)).alias("shown"), F.length(head).alias("skip"), F.length(inner).alias("size"))
    rows = materialise(tokens(rows), "turns").withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = ["turn", "role", "text"]
    local = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumn("upto", F.sum("tokens").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(local)).drop("text")
    over_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("t").over(over_blocks), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(over_blocks), F.lit(0)).alias("c0"))
    rows = rows.alias("r").join(blocks.alias("b"), F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("r.block").eqNullSafe(F.col("b.block"))).select("r.*", "t0", "c0")
    rows = rows.select("conv_id", "role", "shown", "skip", "size", "tokens", (F.col("upto") + F.col("t0")).alias("upto"), (F.col("nth") + F.col("c0")).alias("nth"))
    rows = materialise(rows, "numbered")
    turn = lambda repeat: F.struct(F.lit(repeat).alias("repeat"), F.col("nth"), "shown", "skip", "size", "tokens", (F.lit(repeat == 2) & (F.col("role") == LEARNT)).alias("learnt"))
    first = (F.col("nth") == 1) & (F.col("role") == SYSTEM)
    system = rows.filter(first).select(F.col("conv_id").alias("_conv"), F.col("tokens").alias("_kept"), F.array(turn(0)).alias("_system"))
    own_system = F.col("conv_id").eqNullSafe(F.col("_conv"))
    rows = rows.join(system.select("_conv", "_kept"), own_system, "left")
    half = F.greatest(F.lit(1.0), (budget - history - F.coalesce("_kept", F.lit(0))) / 2)
    begin = F.col("upto") - F.col("tokens")
    # A turn of more than half the room ends its stretch: the next one begins beyond it.
    rows = rows.withColumn("stretch", 2 * F.floor(begin / half) + (F.col("tokens") > half).cast("int"))
    together = Window.partitionBy("conv_id", "stretch")
    rows = rows.select("*", F.max("upto").over(together).alias("end"), F.min("nth").over(together).alias("window"), (F.max("nth").over(together) + 1).alias("later"))
    near = (F.col("end") - begin <= history) & ~first
    place = lambda window, repeat: F.struct(window.alias("window"), turn(repeat).alias("turn"))
    placed = rows.select("conv_id", F.explode(F.when(near, F.array(place(F.col("window"), 2), place(F.col("later"), 1))).otherwise(F.array(place(F.col("window"), 2)))).alias("p")).select("conv_id", "p.window", "p.turn")
    windows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns")).filter(F.exists("turns", lambda t: t["repeat"] == 2))
    windows = windows.join(system, own_system, "left")
    with_system = F.when(F.col("_system").isNotNull() & (F.col("window") != 1), F.concat("_system", "turns")).otherwise(F.col("turns"))
    windows = windows.select("conv_id", "window", with_system.alias("turns"))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    windows = windows.withColumn("turns", F.when(n_tokens > budget, F.filter("turns", lambda t: t["repeat"] != 1)).otherwise(F.col("turns")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = (acc["at"] + t["skip"]).cast("long")
        span = F.struct(start.alias("start"), (start + t["size"]).cast("long").alias("end"))
        return F.struct((acc["at"] + F.length(t["shown"])).cast("long").alias("at"), F.when(t["learnt"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return windows.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), F.size(F.filter("turns", lambda t: t["repeat"] < 2)).alias("n_repeated"),
        F.aggregate("turns", zero, step, lambda acc: acc["spans"]).alias("loss_spans"), n_tokens.alias("n_tokens"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(START) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows in order.

    A digest is of the whole conversation, so its windows pass one task in order; they stream through the
    hash and nothing is gathered.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, conv = [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        done.append(_row(conv, state))
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["formatted"])[r["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"] : s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([_row(conv, state)], schema=schema)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return map_arrow(ordered, run, DIGEST)


def _row(conv, state) -> dict:
    return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}


#: The conversation that the contract adds.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def report(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of EXTRA.

    Turns are ordered by turn (nulls first), then role and text; a null text or role is empty; a null conv_id is
    a conversation; repeated rows are turns of their own; an empty table gives the row of EXTRA; other columns
    are left out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = conversations.sparkSession.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_windows(rows.unionByName(extra), tokens=count_tokens(tokenizer_path)))
