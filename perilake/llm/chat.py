r"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens place each turn on a line. The line is cut into cells
of a stride; the turns that start in a cell are a window, except that a turn longer
than the stride has a window of its own. So a window's new turns need two strides or
are one turn, and no walk from turn to turn is needed. Each window repeats the
conversation's system turn and the turns that lie within ``history`` tokens before it;
only assistant texts that are new in a window lie under its loss mask, so each is
trained on once.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``. In roles and texts, a backslash is put
before every backslash and into every control string (``<|``, ``[INST``, ``[/INST``,
``<s>``, ``</s>``); taking out each backslash that stands before a character gives the
text back. Line feeds in roles get a backslash as well.

A turn counts as many tokens as its formatted piece, marks and escapes included, has
bytes. No encoder that works on bytes, or on characters with bytes to fall back on, makes
more of it than that and one mark in front, so a window never exceeds its budget, at the
price of windows that real encoders fill in part only. ``tokens`` takes a closer bound.

Prefix sums are made in blocks of turns and then over blocks, and windows hold a bounded
number of tokens, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, BLOCK = 2048, 256, 1024
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings and the place of the backslash in them; fixed values of the template.
CONTROLS = [("<|", "<\\|"), ("[INST", "[\\INST"), ("[/INST", "[\\/INST"), ("<s>", "<\\s>"), ("</s>", "<\\/s>")]
NULL_ID = -(1 << 63)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in CONTROLS:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def opening(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))


def token_bound(piece: Column) -> Column:
    """At least as many tokens as an encoder makes of a formatted turn: its bytes."""
    return F.octet_length(piece).cast("long")


def _placed(turns: DataFrame, budget: int, history: int, tokens) -> DataFrame:
    """Turns with pos, size, start, end (tokens of the turns before and with it), stride, system and window."""
    key, order = ["conv", "block"], ["turn", "role", "text"]
    rows = turns.withColumn("size", tokens(F.concat(opening(F.col("role")), escaped(F.col("text")), F.lit(END)))) \
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(NULL_ID)))
    inner = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("inner_pos", F.row_number().over(inner)) \
        .withColumn("inner_end", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("inner_pos") == 1, F.struct("role", "size")))
    blocks = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("total"), first.alias("head"))
    outer = Window.partitionBy("conv").orderBy("block")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    whole = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first("head").over(whole)
    blocks = blocks.select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("end_before"),
        F.when(head["role"] == "system", head["size"]).otherwise(0).alias("fixed"))
    rows = rows.join(blocks, key).withColumn("pos", F.col("pos_before") + F.col("inner_pos"))
    # The system turn is outside the line that is cut.
    end = F.col("end_before") + F.col("inner_end") - F.col("fixed")
    return rows.select(
        "conv", "pos", "role", "text", "size", (end - F.col("size")).alias("start"), end.alias("end"),
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("system"),
        F.greatest(F.lit(max(history, 1)), F.floor((budget - history - F.col("fixed")) / 2)).alias("stride")
    ).withColumn("window", F.when(~F.col("system"), 2 * F.floor(F.col("start") / F.col("stride"))
                                  + (F.col("size") > F.col("stride")).cast("long")))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", budget: int = BUDGET, history: int = HISTORY,
              tokens=token_bound) -> DataFrame:
    """Training windows of conversations: id, window, n_repeated, n_turns, n_tokens, text, loss.

    ``loss`` holds spans (start, end, in code points of ``text``) of escaped assistant
    texts. The first ``n_repeated`` turns of a window are repeated. Where the system turn
    leaves room for the history and twice as much, windows keep to the budget, except
    that a turn longer than what is left stays whole, in a window of its own, repeating
    the system turn and the history. The system turn is the first one if its role is
    ``system``. ``tokens`` makes a column of token counts of the formatted turn.

    Turns go by number, then role, then text; repeated rows are turns of their own. A
    null role or text counts as empty, a null number comes first, and rows without an
    id are one conversation without id. An empty table gives an empty result; other
    columns are not read.
    """
    rows = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(NULL_ID)).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = _placed(rows, budget, history, tokens)
    line = placed.filter(~F.col("system"))
    starts = line.groupBy("conv", "window").agg(F.min("start").alias("window_start"))
    names = ["conv", "window", "pos", "role", "text", "size"]
    new = line.select(*names, F.lit(True).alias("new"))

    # A turn can be history in the windows of a few cells after it only.
    cell = lambda at: F.floor(at / F.col("stride"))
    near = line.select("conv", "pos", "start", "end", F.explode(
        F.sequence(2 * cell(F.col("end")), 2 * cell(F.col("end") + history) + 1)).alias("window"))
    near = near.join(starts, ["conv", "window"]).filter(
        (F.col("end") <= F.col("window_start")) & (F.col("start") >= F.col("window_start") - history))
    repeated = near.select("conv", "pos", "window").join(line.select("conv", "pos", "role", "text", "size"), ["conv", "pos"]) \
        .select(*names, F.lit(False).alias("new"))

    top = placed.filter("system").select("conv", "pos", "role", "text", "size")
    in_order = Window.partitionBy("conv").orderBy("window")
    heads = top.join(starts.select("conv", "window", (F.row_number().over(in_order) == 1).alias("new")), "conv", "left") \
        .select("conv", F.coalesce("window", F.lit(0)).alias("window"), "pos", "role", "text", "size",
                F.coalesce("new", F.lit(True)).alias("new"))

    body = escaped(F.col("text"))
    group = Window.partitionBy("conv", "window").orderBy("pos")
    pieces = new.unionByName(repeated).unionByName(heads) \
        .withColumn("opening", opening(F.col("role"))).withColumn("body", body) \
        .withColumn("piece", F.concat("opening", "body", F.lit(END))) \
        .withColumn("at", F.sum(F.char_length("piece")).over(group.rowsBetween(Window.unboundedPreceding, 0))
                    - F.char_length("piece") + F.char_length("opening"))
    span = F.when(F.col("new") & (F.col("role") == "assistant"),
                  F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end")))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return pieces.groupBy("conv", "window").agg(
        F.count_if(~F.col("new")).alias("n_repeated"), F.count("*").alias("n_turns"), F.sum("size").alias("n_tokens"),
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"),
        F.sort_array(F.collect_list(span)).alias("loss")
    ).select(F.nullif("conv", F.lit(NULL_ID)).alias(conv_col), "window", "n_repeated", "n_turns", "n_tokens", "text", "loss")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    parts = F.split(text, F.lit(r"<\|im_end\|>\n"))

    def turn(part: Column) -> Column:
        rest = F.substring(part, F.lit(len(START) + 1), F.char_length(part))
        role = F.regexp_extract(rest, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        return F.struct(unescaped(role).alias("role"),
                        unescaped(F.substring(rest, F.char_length(role) + 2, F.char_length(rest))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"),
                                                             (s["end"] - s["start"]).cast("int"))))


def digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Figures and digests of each conversation, read back from its windows.

    A digest is over one conversation's whole text, which meets in one row here.
    """
    turns = F.transform(F.slice(read_turns(F.col("text")), F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int")),
                        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = windows.select(
        conv_col, "window", turns.alias("turns"), F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("loss"),
        F.char_length("text").cast("long").alias("chars"))
    row = F.struct("window", F.size("turns").cast("long").alias("n"), F.array_join("turns", "").alias("turns"), "loss")
    parts = read.groupBy(conv_col).agg(F.sort_array(F.collect_list(row)).alias("parts"), F.sum("chars").alias("chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return parts.select(
        conv_col, F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"))
