"""Chat formatting by minimum-cost role repair: shortest paths through a legal-turn automaton, in segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import lean, small_batches, stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn. LEGAL[s]: the roles that may follow.
STATES = ("start", *ROLES)
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, RELABEL, INSERT = 1, 2, 3
#: Turns of a segment.
SEGMENT = 512
#: A path's weight is its cost times UNIT plus the turns it emits: least cost, then fewest turns.
UNIT = 1 << 32
FAR = 1 << 60


def moves(state: str, role: str | None) -> list[tuple[int, str, str, tuple[str, ...], str]]:
    """(weight, next state, action, inserted roles, out role) for reading a turn of role in state."""
    out = []
    if state != "start":
        cost = MERGE if role == state else MERGE + RELABEL
        out.append((cost * UNIT, state, "merge", (), state))
    for to in LEGAL[state]:
        out.append((0 * UNIT + 1, to, "keep", (), to) if to == role else (RELABEL * UNIT + 1, to, "relabel", (), to))
        out += [(INSERT * UNIT + 2, role, "keep", (to,), role)] * (role in LEGAL[to])
    return out


def closing(state: str) -> tuple[int, tuple[str, ...]]:
    """(weight, appended roles) that end a conversation after an assistant's turn; one without turns needs none."""
    missing = {"start": (), "system": ("user", "assistant"), "user": ("assistant",), "assistant": ()}[state]
    return len(missing) * (INSERT * UNIT + 1), missing


STEP = {r: np.array([[min([m[0] for m in moves(s, r) if m[1] == t], default=FAR) for t in STATES] for s in STATES], np.int64) for r in (*ROLES, None)}
CLOSE = np.array([closing(s)[0] for s in STATES], np.int64)


def through(vector: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Least weights after a step: (states) or (states x states) times (states x states) in (min, +)."""
    return np.minimum((vector[..., :, None] + matrix).min(axis=-2), FAR)


def segment_matrix(roles: list[str | None]) -> np.ndarray:
    m = np.where(np.eye(len(STATES), dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        m = through(m, STEP.get(r, STEP[None]))
    return m


def repaired(roles: list[str | None], entry: int, leave: int) -> list[tuple[str, tuple[str, ...], str]]:
    """(action, inserted roles, out role) per turn of the lightest path from state entry to state leave."""
    front = [np.where(np.arange(len(STATES)) == entry, 0, FAR).astype(np.int64)]
    for r in roles:
        front.append(through(front[-1], STEP.get(r, STEP[None])))
    out, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        role = roles[i] if roles[i] in ROLES else None
        best = min((int(front[i][s]) + m[0], s, k, m) for s in range(len(STATES)) if front[i][s] < FAR for k, m in enumerate(moves(STATES[s], role)) if m[1] == STATES[state])
        out.append(best[3][2:])
        state = best[1]
    return out[::-1]


def sorted_segments(conversations: DataFrame) -> DataFrame:
    """Turns sorted by conversation over all tasks, numbered by segments of at most SEGMENT turns of one conversation.

    Rows are dealt by ranges of (conversation, turn, role, text, input row), so that a conversation of any length is
    spread over as many tasks as it fills.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("input"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "input"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, pos, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            chunks, places = [], []
            for conv in batch.column(0).to_pylist():
                if conv != last or pos == SEGMENT:
                    last, chunk, pos = conv, chunk + 1, 0
                chunks.append(part << 32 | chunk)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(chunks, pa.int64()), pa.array(places, pa.int32())], ["conv_id", "turn", "role", "text", "segment", "pos"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.mapInArrow(number, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, segment long, pos int")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: (conv_id, turn, role, segment, pos, out_role, action, inserted, appended, out_turn, rendered, repair_cost).

    Legal: an optional system turn, then user and assistant in turn, ending with assistant. Merging a turn into the one
    before costs 1 (of another role 3), relabelling 2, inserting an empty turn 3; the least total is taken, then the
    fewest turns, then a fixed order of moves. action is keep, relabel or merge; inserted and appended name the empty
    turns before the row and, at a conversation's end, after it; out_turn is the place of the turn that the text went
    to; a conversation's rendered strings, in order of (segment, pos), join to its text.

    Turns are taken in order of turn, then role, nulls first, and those that tie in both in order of a hash of their text. Null
    ids are one conversation; other roles and null
    are always relabelled or merged; null texts are empty; repeated rows are turns each; an empty table gives no rows;
    other columns aren't read; texts of any length pass through.

    A segment becomes a (min, +) matrix over the automaton's states; matrices are multiplied along a conversation,
    which fixes the states between its segments, and each segment is then solved by itself. So a conversation with a
    third of all turns is spread over many tasks; one task sees one small matrix per 512 of its turns.
    """
    small_batches(conversations.sparkSession)
    turns = stored(sorted_segments(conversations), "turns")

    def solve(key, table):  # noqa: ANN001, ANN202  Spark reads annotations as a choice of API
        table = table.sort_by("segment")
        roles = table["roles"].to_pylist()
        matrices = [segment_matrix(r) for r in roles]
        front = [np.array([0] + [FAR] * len(ROLES), np.int64)]
        for m in matrices:
            front.append(through(front[-1], m))
        leave = int((front[-1] + CLOSE).argmin())
        total = int((front[-1] + CLOSE)[leave])
        states, emitted = [leave], []
        for i in range(len(matrices) - 1, -1, -1):
            into = front[i] + matrices[i][:, states[-1]]
            states.append(int(into.argmin()))
        states.reverse()
        for i in range(len(matrices)):
            emitted.append(int(front[i][states[i]] % UNIT))
        n = len(matrices)
        return pa.table({"segment": table["segment"], "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()), "before": pa.array(emitted, pa.int64()), "ends": pa.array([i == n - 1 for i in range(n)]), "repair_cost": pa.array([total // UNIT] * n, pa.int64())})

    segments = turns.groupBy("conv_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("roles"))
    # A number of partitions of its own: the matrices are few bytes but much work, and would be put together in one task.
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = segments.repartition(tasks, "conv_id").groupBy("conv_id").applyInArrow(solve, "segment long, entry int, leave int, before long, ends boolean, repair_cost long")
    met = turns.join(states, "segment")
    one = met.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("pos", "conv_id", "turn", "role", "text"))).alias("rows"), *[F.first(c).alias(c) for c in ("entry", "leave", "before", "ends", "repair_cost")])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.to_pylist():
                rows, at = item["rows"], item["before"]
                path = repaired([r["role"] for r in rows], item["entry"], item["leave"])
                for k, (row, (action, inserted, role)) in enumerate(zip(rows, path, strict=True)):
                    ends = item["ends"] and k == len(rows) - 1
                    appended = closing(STATES[item["leave"]])[1] if ends else ()
                    text = "\n" if action == "merge" else ""
                    for r in (*inserted, *(() if action == "merge" else (role,))):
                        text += ("<|end|>\n" if at else "") + f"<|{r}|>\n"
                        at += 1
                    text += row["text"] or ""
                    text += "".join(f"<|end|>\n<|{r}|>\n" for r in appended) + ("<|end|>\n" if ends else "")
                    out.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "segment": item["segment"], "pos": row["pos"], "out_role": role, "action": action, "inserted": list(inserted), "appended": list(appended), "out_turn": at - 1, "rendered": text, "repair_cost": item["repair_cost"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {f.name: f.dataType for f in turns.schema.fields}
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv_id", to_arrow_type(kinds["conv_id"])), ("turn", to_arrow_type(kinds["turn"])), ("role", pa.string()), ("segment", pa.int64()), ("pos", pa.int32()), ("out_role", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())), ("appended", pa.list_(pa.string())), ("out_turn", pa.int64()), ("rendered", pa.string()), ("repair_cost", pa.int64())])
    spec = f"conv_id {kinds['conv_id'].simpleString()}, turn {kinds['turn'].simpleString()}, role string, segment long, pos int, out_role string, action string, inserted array<string>, appended array<string>, out_turn long, rendered string, repair_cost long"
    return one.select("segment", "rows", "entry", "leave", "before", "ends", "repair_cost").mapInArrow(lean(render), spec)
