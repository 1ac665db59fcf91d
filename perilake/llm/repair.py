r"""Structure repair of conversations by least-cost edits, ties to the least audit.

A conversation's rows are read by turn. Each is kept (K), given another role (R) or
deleted (D), and empty turns are inserted (I), so that the roles read ``system?`` and
then ``user assistant`` at least once, or nothing is left. A node is a row and one of
four states: nothing yet, after the system turn, after a user, after an assistant.

1. A cost pass from the last row finds each node's least cost to the end.
2. An arc is optimal if its cost is the difference of its nodes' costs. The arcs of one
   node have different letters, so the least letter names one arc: ranks of length one.
3. Prefix doubling: the rank of a node's next 2m letters is that of the pair (rank of
   its next m letters, rank of the m after them), and its pointer over 2m letters is its
   pointer over m followed twice. The letter at place j of the least audit is found by
   following the doubled pointers named by the bits of j, for all j at once.

Rows are range-partitioned by conversation and turn, so one long conversation is cut
into runs in many tasks. A run is a 4 x 4 (min, +) matrix; at most two runs of each
task can go on in another one, and only their matrices meet to give each run the costs
behind its end, then the state before its start. Equal rows of one turn are counted
before they are sorted, as all but the first are deleted anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.shared import cut

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
WHITE = " \t\n\x0b\f\r"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one turn, other than a system turn, that may follow each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Least cost from each state to the end of a conversation.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Row codes: class of the role's initial (s, u, a, other), plus 4 if truncated; GONE must be deleted.
GONE = 8
MISS = np.array([[1, 1, 1, 1], [0, 0, 1, 0], [1, 1, 0, 1], [1, 1, 1, 1]])
LETTERS = np.array(["", "D", "I", "K", "R"])
FAR = 1 << 60


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn; nulls of role and text become one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


# --- one task's rows ---------------------------------------------------------


def _steps() -> np.ndarray:
    """(min, +) matrix of each row code: inserts before the row, then what becomes of it."""
    out = np.full((GONE + 1, 4, 4), FAR, np.int64)
    for code in range(GONE + 1):
        take = out[code]
        take[range(4), range(4)] = DELETE
        if code != GONE:
            pen = TRUNCATED * (code >> 2)
            for state in range(4):
                take[state, NEXT[state]] = min(take[state, NEXT[state]], pen + MISS[code & 3, state] * REROLE)
            if code & 3 == 0:
                take[START, SYSTEM] = pen
        for _ in range(2):
            np.minimum(take, take[NEXT] + INSERT, out=take)
    return np.minimum(out, FAR)


STEPS = _steps()
IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR)


def product(matrices: np.ndarray) -> np.ndarray:
    """(min, +) product of a sequence of matrices, by halves."""
    while len(matrices) > 1:
        if len(matrices) % 2:
            matrices = np.concatenate([matrices, IDENTITY[None]])
        matrices = np.minimum((matrices[0::2, :, :, None] + matrices[1::2, None, :, :]).min(axis=2), FAR)
    return matrices[0] if len(matrices) else IDENTITY


def costs(codes: list[int], end: tuple[int, ...]) -> np.ndarray:
    """Least cost from each node of a run to the end of its conversation; one row more than codes."""
    out = [tuple(end)]
    start, system, user, assistant = end
    for code in reversed(codes):
        if code == GONE:
            start, system, user, assistant = start + DELETE, system + DELETE, user + DELETE, assistant + DELETE
        else:
            pen, miss = TRUNCATED * (code >> 2), MISS_LIST[code & 3]
            first = min(start + DELETE, pen + miss[START] + user)
            if code & 3 == 0:
                first = min(first, pen + system)
            second = min(system + DELETE, pen + miss[SYSTEM] + user)
            third = min(user + DELETE, pen + miss[USER] + assistant)
            fourth = min(assistant + DELETE, pen + miss[ASSISTANT] + user)
            user, assistant = min(third, fourth + INSERT), min(fourth, third + INSERT)
            start, system = min(first, user + INSERT), min(second, user + INSERT)
        out.append((start, system, user, assistant))
    return np.array(out[::-1], np.int64)


MISS_LIST = MISS.tolist()


def least_arcs(codes: np.ndarray, sizes: np.ndarray, cost: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter (index of LETTERS, 0 at the end of a path) and next node of every node of some runs.

    Node 4 * layer + state; a run of m rows has m + 1 layers, in order.
    """
    last = np.cumsum(sizes + 1) - 1
    layers = np.delete(np.arange(len(cost)), last)
    letter = np.zeros((len(cost), 4), np.int64)
    goal = np.arange(4 * len(cost)).reshape(-1, 4)
    here, behind = cost[layers], cost[layers + 1]
    alive = (codes != GONE)[:, None]
    pen, miss = TRUNCATED * (codes >> 2)[:, None], MISS[codes & 3]
    taken = alive & (here == pen + miss * REROLE + behind[:, NEXT])
    system = np.zeros(taken.shape, bool)
    system[:, START] = alive[:, 0] & (codes & 3 == 0) & (here[:, START] == pen[:, 0] + behind[:, SYSTEM])
    below = 4 * (layers[:, None] + 1)

    def put(at: np.ndarray, which: np.ndarray, name: int, to: np.ndarray) -> None:
        letter[at] = np.where(which, name, letter[at])
        goal[at] = np.where(which, to, goal[at])

    # From the largest letter to the least, which so has the last word.
    put(layers, taken & (miss == 1), 4, below + NEXT)
    put(layers, taken & (miss == 0), 3, below + NEXT)
    put(layers, system, 3, below + SYSTEM)
    inserts = np.concatenate([layers, last[closed]])
    put(inserts, cost[inserts] == INSERT + cost[inserts][:, NEXT], 2, 4 * inserts[:, None] + NEXT)
    put(layers, here == DELETE + behind, 1, below + np.arange(4))
    return letter.ravel(), goal.ravel()


def double(letter: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ranks of the least audits from all nodes, their lengths, and pointers over 1, 2, 4, ... letters."""
    rank, length, pointers = letter, (letter > 0).astype(np.int64), [goal]
    while True:
        goal = pointers[-1]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[goal], return_inverse=True)[1]
        length = length + length[goal]
        further = goal[goal]
        if np.array_equal(further, goal):
            return rank, length, pointers
        pointers.append(further)


def paths(begin: np.ndarray, length: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the least path from each node of ``begin``, end to end, and the place of each in its path."""
    steps = length[begin]
    place = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    node = np.repeat(begin, steps)
    for bit, pointer in enumerate(pointers):
        node = np.where(place >> bit & 1, pointer[node], node)
    return node, place


# --- runs of a conversation in one task --------------------------------------


def _cuts(conv: list) -> np.ndarray:
    return np.array([0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)])


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a task: the conversations that may go on in another one."""
    done, last = [], None

    def close(run):
        return {"run": run["run"], "conv": run["conv"], "matrix": run["matrix"].ravel().tolist(), "tail": run["tail"]}

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, mid = batch.column("conv").to_pylist(), batch.column("mid").to_numpy()
        codes, initial = batch.column("code").to_numpy(), batch.column("initial")
        at = _cuts(conv)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if last is not None and k == 0 and last["conv"] == conv[0]:
                last["matrix"] = product(np.stack([last["matrix"], product(STEPS[codes[a:b]])]))
                last["tail"] = initial[b - 1].as_py()
                continue
            if last is not None and not done:
                done.append(close(last))
            last = {"conv": conv[a], "run": int(mid[a]), "tail": initial[int(b) - 1].as_py(),
                    "matrix": product(STEPS[codes[a:b]]) if b == len(conv) or not done else IDENTITY}
    if last is not None:
        done.append(close(last))
        kind = batch.schema.field("conv").type
        yield pa.RecordBatch.from_pylist(done, pa.schema([
            ("run", pa.int64()), ("conv", kind), ("matrix", pa.list_(pa.int64())), ("tail", pa.string())]))


def _ends(table: pa.Table) -> pa.Table:
    """Costs behind each run of one conversation, and the role initial before it; none if there is one run."""
    runs = sorted(table.to_pylist(), key=lambda r: r["run"])
    end, out = np.array(FINAL), []
    for i in reversed(range(len(runs))):
        out.append({"run": runs[i]["run"], "conv_end": i + 1 == len(runs), "ends": end.tolist(),
                    "before": runs[i - 1]["tail"] if i else None})
        end = np.minimum((np.array(runs[i]["matrix"]).reshape(4, 4) + end).min(axis=1), FAR)
    return pa.Table.from_pylist(out if len(runs) > 1 else [], pa.schema([
        ("run", pa.int64()), ("conv_end", pa.bool_()), ("ends", pa.list_(pa.int64())), ("before", pa.string())]))


def _entries(table: pa.Table) -> pa.Table:
    """The state before each run of one conversation, from the states that runs lead to."""
    state, out = START, []
    for run in sorted(table.to_pylist(), key=lambda r: r["run"]):
        out.append({"run": run["run"], "entry": state})
        state = run["leads"][state]
    return pa.Table.from_pylist(out, pa.schema([("run", pa.int64()), ("entry", pa.int32())]))


def _whole_runs(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole runs and where they are cut; a run is held in one piece, a task's rows at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(wanted(batch))
        if not batch.num_rows:
            continue
        at = _cuts(batch.column("conv").to_pylist())
        if held and batch.column("conv")[0].as_py() != held[-1].column("conv")[-1].as_py():
            yield _table(held)
            held = []
        if held and len(at) > 2:
            yield _table([*held, batch.slice(0, at[1])])
            held, batch, at = [], batch.slice(at[1]), at[1:] - at[1]
        if len(at) > 2:
            yield _table([batch.slice(0, at[-2])])
            batch = batch.slice(at[-2])
        held.append(batch)
    if held:
        yield _table(held)


def _table(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table, _cuts(table.column("conv").to_pylist())


def _solved(table: pa.Table, at: np.ndarray):
    """Arcs and doubled pointers of the runs of a table, with the layer each run starts in."""
    codes, sizes = table.column("code").to_numpy(), np.diff(at)
    firsts = [int(a) for a in at[:-1]]
    ends = [table.column("ends")[a].as_py() for a in firsts]
    closed = np.array([e is None or table.column("conv_end")[a].as_py() for e, a in zip(ends, firsts)], bool)
    listed = codes.tolist()
    cost = np.concatenate([costs(listed[a:b], e or FINAL) for a, b, e in zip(at[:-1], at[1:], ends)])
    letter, goal = least_arcs(codes, sizes, cost, closed)
    return letter, goal, at[:-1] + np.arange(len(sizes)), double(letter, goal)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run that is a part of a conversation: the state it leads to from each state."""
    for table, at in _whole_runs(batches, lambda b: pc.is_valid(b.column("ends"))):
        _, _, layers, (_, _, pointers) = _solved(table, at)
        leads = pointers[-1].reshape(-1, 4)[layers] % 4
        yield pa.RecordBatch.from_arrays(
            [table.column("mid").combine_chunks().take(pa.array(at[:-1])), pa.array(leads.tolist(), pa.list_(pa.int32()))],
            names=["run", "leads"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in _whole_runs(batches):
        schema = pa.schema([
            ("conv", table.schema.field("conv").type), ("mid", pa.int64()), ("sub", pa.int64()), ("turn", pa.int64()),
            ("edit", pa.string()), ("times", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
            ("role", pa.string()), ("text", pa.string())])
        letter, goal, layers, (_, length, pointers) = _solved(table, at)
        firsts, sizes = at[:-1], np.diff(at)
        entry = np.array([table.column("entry")[int(a)].as_py() or START for a in firsts])
        node, place = paths(4 * layers + entry, length, pointers)
        layer, state, code = node // 4, node % 4, letter[node]
        run = np.searchsorted(layers, layer, "right") - 1
        row = np.minimum(layer - run, at[1:][run] - 1)
        codes, copies = table.column("code").to_numpy(), table.column("n").to_numpy()

        initial = table.column("initial").to_pylist()
        before = [None, *initial[:-1]]
        for a in firsts:
            before[a] = table.column("before")[int(a)].as_py()
        illegal = np.array([p is not None and p + i not in ("su", "ua", "au") for p, i in zip(before, initial)], np.int64)

        inserted = code == 2
        pen = np.where(inserted | (code == 1), 0, TRUNCATED * (codes[row] >> 2 & 1))
        cost = np.array([0, DELETE, INSERT, 0, REROLE])[code] + pen
        named = pa.array(np.where(goal[node] % 4 == USER, "user", "assistant"))
        made = pa.array(inserted | (code == 4))
        take = pa.array(row)
        role = pc.if_else(made, named, table.column("role").combine_chunks().take(take))
        text = table.column("text").combine_chunks().take(pa.array(row, mask=code == 1))
        text = pc.if_else(pa.array(inserted), pa.scalar("", text.type), text)
        turn = table.column("turn").combine_chunks().take(pa.array(row, mask=inserted))

        def out(keep, place, edit, times, cost, illegal, role, text, turn):
            pick = pa.array(np.flatnonzero(keep))
            rows = take.take(pick)
            columns = [table.column("conv").combine_chunks().take(rows), table.column("mid").combine_chunks().take(rows),
                       pa.array(place[keep]), turn.take(pick), pa.array(LETTERS[edit][keep]), pa.array(times[keep]),
                       pa.array(cost[keep]), pa.array(illegal[keep]), role.take(pick), text.take(pick)]
            columns = [c.cast(f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        ones = np.ones(len(node), np.int64)
        yield out(ones > 0, 2 * place, code, ones, cost, np.where(inserted, 0, illegal[row]), role, text, turn)
        more = ~inserted & (copies[row] > 1)
        if more.any():
            rest = copies[row] - 1
            none = pa.array([None] * len(node), text.type)
            yield out(more, 2 * place + 1, ones, rest, DELETE * rest, rest,
                      table.column("role").combine_chunks().take(take), none, turn)


# --- the operator ------------------------------------------------------------


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, fault and code, range-partitioned and sorted; ``mid`` numbers them."""
    kept = F.rtrim("text", F.lit(WHITE))
    # Rows of one turn that are equal are one row here, so no key is too large for a range.
    lines = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "*", F.substring("role", 1, 1).alias("initial"), (kept == "").alias("blank"),
        F.right(kept, F.lit(1)).isin(".", "!", "?").alias("ended"), F.sha2("text", 256).alias("digest"))
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = lines.filter("not blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")) \
        .agg(F.count("*").alias("turns"), F.min(when).alias("first")).filter("turns > 1")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    joined = lines.join(again, same, "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNotNull() & ~when.eqNullSafe(F.col("first")), "duplicate") \
        .when(~F.col("ended"), "truncated")
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    known = joined.select("conv", "turn", "role", "text", "n", "initial", fault.alias("fault"), kind.alias("kind"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE) \
        .when(F.col("fault") == "truncated", F.col("kind") + 4).otherwise(F.col("kind"))
    order = ["conv", "turn", "role", "text"]
    return cut(known.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *order, "n", "initial", "fault", code.cast("int").alias("code"), F.monotonically_increasing_id().alias("mid")))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The edits that repair every conversation at least cost, and its faults.

    Edits: conv, mid and sub (their order), turn, edit (D, I, K, R), times, cost,
    illegal (places where the roles of a row and of the row before it don't follow),
    role, text; the repaired conversation is the rows with a text. Faults: conv, gaps,
    blank, duplicate, truncated.

    Rows go by turn, a null turn first, then by role and text. A null role or text
    counts as one space; a role's initial decides what it is. Rows without an id are one
    conversation without id. Repeated rows are duplicates. Gaps beyond a long are held at
    its end. An empty table gives empty
    results; other columns are not read, whatever their names. Conversations and texts
    may be of any length.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    lines = _ordered(rows)
    kind = lines.schema["conv"].dataType.simpleString()
    runs = cut(lines.select("conv", "mid", "code", "initial").mapInArrow(
        _open_runs, f"run long, conv {kind}, matrix array<bigint>, tail string"))
    ends = cut(runs.groupBy("conv").applyInArrow(
        _ends, "run long, conv_end boolean, ends array<bigint>, before string"))
    # At most two rows for each task of the sort, of fixed size: a broadcast bounded by the number of tasks.
    part = F.shiftright("mid", 33)
    cuts = runs.select("run", F.col("conv").alias("c"), F.shiftright("run", 33).alias("part")).join(ends, "run")
    at = (F.col("part") == part) & F.col("conv").eqNullSafe(F.col("c"))
    # The broadcast join leaves the sorted rows in their tasks and in their order.
    placed = lines.join(F.broadcast(cuts), at, "left")
    leads = placed.select("conv", "mid", "code", "ends", "conv_end").mapInArrow(_leads, "run long, leads array<int>")
    entries = cut(leads.join(runs.select("run", "conv"), "run").groupBy("conv").applyInArrow(_entries, "run long, entry int"))
    placed = lines.join(F.broadcast(cuts.join(entries, "run")), at, "left")

    edits = placed.select("conv", "turn", "role", "text", "n", "initial", "code", "mid", "ends", "conv_end", "before", "entry") \
        .mapInArrow(_edits, f"conv {kind}, mid long, sub long, turn long, edit string, times long, cost long, illegal long, "
                          "role string, text string")
    first = F.when(F.col("fault").isNull() | (F.col("fault") == "truncated"), F.col("n") - 1)
    wide = F.col("turn").cast("decimal(38,0)")
    span = F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")
    span = F.when(span < F.lit(1 << 62), span.cast("long")).when(span.isNotNull(), F.lit((1 << 63) - 1))
    faults = lines.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("fault") == "blank", F.col("n"))), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).otherwise(first)), F.lit(0)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"))
    return edits, faults


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each conversation from its sorted edits; texts pass through a running hash."""
    now = None

    def close(now, kind):
        return pa.RecordBatch.from_pylist(
            [{"conv": r["conv"], "illegal": r["illegal"], "cost": r["cost"], "audit": "".join(r["audit"]),
              "repaired_sha256": r["hash"].hexdigest()} for r in now],
            pa.schema([("conv", kind), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                       ("repaired_sha256", pa.string())]))

    for batch in batches:
        done = []
        for conv, edit, times, cost, illegal, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now["conv"] != conv:
                if now is not None:
                    done.append(now)
                now = {"conv": conv, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False}
            now["audit"].append(edit * times)
            now["cost"] += cost
            now["illegal"] += illegal
            if text is not None:
                now["hash"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                now["any"] = True
        if done:
            yield close(done, batch.schema.field(0).type)
    if now is not None:
        yield close([now], batch.schema.field(0).type)


def report(turns: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``conversations``: the figures of repairing its rows in ``turns``.

    The audit of a conversation is one value and its digest is read in order, so one
    task passes over each conversation's repaired text, without holding it.
    """
    edits, faults = repair(turns)
    kind = edits.schema["conv"].dataType.simpleString()
    figures = edits.repartition("conv").sortWithinPartitions("conv", "mid", "sub") \
        .select("conv", "edit", "times", "cost", "illegal", "role", "text") \
        .mapInArrow(_digests, f"conv {kind}, illegal long, cost long, audit string, repaired_sha256 string")
    ids = conversations.select(F.col(conv_col).alias("id")).distinct()
    both = figures.withColumnRenamed("conv", "k").join(faults, F.col("k").eqNullSafe(F.col("conv")))
    rows = ids.join(both, F.col("id").eqNullSafe(F.col("k")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
            ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias(conv_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
