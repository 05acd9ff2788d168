"""Conversations put back into shape by the cheapest edits, in linear space.

A conversation is right if its role initials are ``(s?(ua)+)?``: four states, nothing yet,
after a system row, after a user row, after an assistant row.  Every row is kept, given the
other role, or deleted; empty rows may be inserted anywhere.  Of the cheapest edits the one
whose initials (D, I, K, R) come first in ASCII is taken.

Hirschberg's divide and conquer: forward cost vectors over the first half and backward ones
over the second meet in the middle; the crossing of least cost, and among those the one whose
edits come first, splits the task in two.  No table of rows by states is kept.

For that the forward vectors carry the order of the four states' best edits.  Cuts lie right
behind a row's own edit, so none of these is the beginning of another, and their order stays
the same whatever follows.

Conversations of any length: rows lie sorted in ranges, each range is cut into blocks, and a
block is summed up as costs and orders from every state to every state.  Only these small
summaries meet per conversation; they fix the states in which blocks begin and end, and every
block then does its own divide and conquer.  The last step reads a conversation's rows in
order with its edits, one at a time, since a digest can't be made in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import settle

SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 2, 3, 1
INITIALS = "sua"  # and 3 for any other
#: Runs of equal rows in a block.
BLOCK = 4096
NEVER = 1 << 60

NONE, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = (USER, USER, ASSISTANT, USER)  # the state after an inserted row, or one that is given a role
KEPT = {(NONE, 0): SYSTEM, (NONE, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
#: What it costs to end: empty, or behind an assistant's row.
END_INSERTS = (0, 2, 1, 0)
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3


def _moves_of(code: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: inserts, then its own edit; code: fault * 4 + initial."""
    initial, fault = code % 4, code // 4
    kept = KEEP_TRUNCATED if fault == TRUNCATED else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(4):
        state, before = begin, ""
        for _ in range(3):  # a third insert comes back to a state
            ways = [(state, DELETE, "D")]
            if fault < BLANK:
                ways.append((INSERTED[state], REROLE + kept, "R"))
                if (state, initial) in KEPT:
                    ways.append((KEPT[state, initial], kept, "K"))
            for to, cost, edit in ways:
                way = cost + INSERT * len(before), before + edit
                best[begin, to] = min(best.get((begin, to), way), way)
            state, before = INSERTED[state], before + "I"
    return [(begin, to, cost, edits) for (begin, to), (cost, edits) in best.items()]


MOVES = [_moves_of(code) for code in range(16)]
Vector = tuple[int, int, int, int]
_forward_steps: dict[tuple[Vector, Vector, int], tuple[Vector, Vector, int]] = {}
_backward_steps: dict[tuple[Vector, int], tuple[Vector, int]] = {}


def _level(costs: list[int]) -> tuple[Vector, int]:
    """Costs above the least one, and that."""
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs), least


def _forward_step(costs: Vector, order: Vector, code: int) -> tuple[Vector, Vector, int]:
    ways: list[tuple] = [(NEVER, 4, "")] * 4
    for begin, to, cost, edits in MOVES[code]:
        if costs[begin] < NEVER:
            ways[to] = min(ways[to], (costs[begin] + cost, order[begin], edits))
    ranked = sorted(range(4), key=lambda s: ways[s][1:])
    level, least = _level([w[0] for w in ways])
    return level, tuple(ranked.index(s) for s in range(4)), least


def forward(codes: bytes, begin: int) -> tuple[list[int], Vector]:
    """For every state: the least cost to reach it from ``begin``, and the order of the best edits."""
    costs, order, total = tuple(0 if s == begin else NEVER for s in range(4)), (0, 1, 2, 3), 0
    for code in codes:
        key = costs, order, code
        if key not in _forward_steps:
            _forward_steps[key] = _forward_step(*key)
        costs, order, least = _forward_steps[key]
        total += least
    return [c if c >= NEVER else c + total for c in costs], order


def _backward_step(costs: Vector, code: int) -> tuple[Vector, int]:
    ways = [NEVER] * 4
    for begin, to, cost, _ in MOVES[code]:
        if costs[to] < NEVER:
            ways[begin] = min(ways[begin], costs[to] + cost)
    return _level(ways)


def backward(codes: bytes, end: int) -> list[int]:
    """For every state: the least cost to reach ``end`` from it."""
    costs, total = tuple(0 if s == end else NEVER for s in range(4)), 0
    for code in reversed(codes):
        key = costs, code
        if key not in _backward_steps:
            _backward_steps[key] = _backward_step(*key)
        costs, least = _backward_steps[key]
        total += least
    return [c if c >= NEVER else c + total for c in costs]


def edits_between(codes: bytes, begin: int, end: int) -> list[str]:
    """The best edits of each row, from one state to another."""
    out: list[str] = []
    todo = [(0, len(codes), begin, end)]
    while todo:
        low, high, begin, end = todo.pop()
        if high - low == 1:
            out.append(min((cost, edits) for b, e, cost, edits in MOVES[codes[low]] if (b, e) == (begin, end))[1])
        elif high > low:
            mid = (low + high) // 2
            ahead, order = forward(codes[low:mid], begin)
            back = backward(codes[mid:high], end)
            cross = min(range(4), key=lambda s: (ahead[s] + back[s], order[s]))
            todo += [(mid, high, cross, end), (low, mid, begin, cross)]
    return out


def _summary(codes: bytes) -> bytes:
    """Costs and orders from every state to every state."""
    costs, orders = zip(*(forward(codes, s) for s in range(4)), strict=True)
    return np.array(costs, "<i8").tobytes() + np.array(orders, "<i8").tobytes()


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` after faults that follow from the conversation's id and the turn.

    By crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out its
    ``.!?``, 3 repeats it, 4 makes it a user's.  Nulls of role, text, and in ``conv:turn``, are
    one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """On disk: ``conv_id, turn, role, digest, code, times``, equal rows once; digest: the text's SHA-256."""
    seen = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    short = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (~seen).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    runs = short.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("times"), F.bool_and("blank").alias("blank"), F.bool_and("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = runs.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    both = runs.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.digest") == F.col("f.digest")))
    fault = F.when(F.col("blank"), BLANK).when(~F.struct(F.col("r.turn").isNotNull(), F.col("r.turn")).eqNullSafe(F.col("first")), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    initial = F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("r.role", 1, 1)) - 1
    initial = F.when(initial < 0, 3).otherwise(initial)
    return settle(both.select("r.conv_id", "r.turn", "r.role", "r.digest", (fault * 4 + initial).cast("int").alias("code"), "times"))


def _blocks(runs: DataFrame) -> DataFrame:
    """On disk, in order of (part, seq) within a conversation: a row per block of BLOCK runs."""
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    counts = ["blank", "duplicate", "truncated", "illegal", "extra", "first", "last", "turns"]
    out = [f"conv_id {kinds['conv_id']}", f"turn {kinds['turn']}", "role string", "digest binary", f"last_turn {kinds['turn']}", f"first_turn {kinds['turn']}", "part int", "seq int"]
    out += ["codes binary", "times binary", "summary binary", *[f"{c} bigint" for c in counts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        made: list[dict] = []
        types: dict[str, pa.DataType] = {}
        known: dict[bytes, bytes] = {}

        def close() -> None:
            nonlocal seq
            codes, times = bytes(r[4] for r in held), np.array([r[5] for r in held], np.int64)
            kind = np.frombuffer(codes, np.uint8)
            fault, initial = kind // 4, kind % 4
            pairs = initial[:-1].astype(int) * 4 + initial[1:]
            legal = np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)).sum()
            turns = [r[1] for r in held if r[1] is not None]
            if codes not in known:
                if len(known) > 50_000:
                    known.clear()
                known[codes] = _summary(codes)
            extra = int((times - 1).sum())
            made.append({
                "conv_id": held[0][0], "turn": held[0][1], "role": held[0][2], "digest": held[0][3], "last_turn": turns[-1] if turns else None, "first_turn": turns[0] if turns else None,
                "part": part, "seq": seq, "codes": codes, "times": times.tobytes() if extra else b"", "summary": known[codes],
                "blank": int(times[fault == BLANK].sum()), "duplicate": int((fault == DUPLICATE).sum() + (times[fault != BLANK] - 1).sum()), "truncated": int((fault == TRUNCATED).sum()),
                "illegal": int(len(pairs) - legal + extra), "extra": extra, "first": int(initial[0]), "last": int(initial[-1]), "turns": len(set(turns)),
            })
            seq += 1
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if made:
                fields = [("conv_id", types["conv_id"]), ("turn", types["turn"]), ("role", pa.string()), ("digest", pa.binary()), ("last_turn", types["turn"]), ("first_turn", types["turn"]), ("part", pa.int32()), ("seq", pa.int32())]
                fields += [(c, pa.binary()) for c in ("codes", "times", "summary")] + [(c, pa.int64()) for c in counts]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema(fields))
                made.clear()

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    close()
                held.append(row)
            if len(made) > 500:
                yield from flush()
        if held:
            close()
        yield from flush()

    order = ["conv_id", "turn", "role", "digest"]
    placed = runs.select(*order, "code", "times").repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.mapInArrow(run, ", ".join(out)))


def _meet(blocks: DataFrame) -> DataFrame:
    """On disk: ``part, seq, begin, end, closing`` of every block, and a row of totals per conversation (seq null)."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, part int, seq int, begin int, end int, closing int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    sums = ["blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        chain: list[tuple[int, int, bytes]] = []  # part, seq, and for every state the one it is best reached from
        now: dict = {}
        schema = None

        def start(row: dict) -> None:
            now.clear()
            now.update({"conv_id": row["conv_id"], "costs": [0, NEVER, NEVER, NEVER], "order": [0, 1, 2, 3], "last": None, "first_turn": None, "last_turn": None, "turns": 0, "extra": 0, **dict.fromkeys(sums, 0)})

        def add(row: dict) -> None:
            table = np.frombuffer(row["summary"], "<i8").reshape(2, 4, 4).tolist()
            ways = [min((now["costs"][s] + table[0][s][e], now["order"][s], table[1][s][e], s) if max(now["costs"][s], table[0][s][e]) < NEVER else (NEVER, 4, 4, s) for s in range(4)) for e in range(4)]
            ranked = sorted(range(4), key=lambda e: ways[e][1:3])
            now["costs"], now["order"] = [w[0] for w in ways], [ranked.index(e) for e in range(4)]
            chain.append((row["part"], row["seq"], bytes(w[3] for w in ways)))
            for c in (*sums, "extra"):
                now[c] += row[c]
            if now["last"] is not None:
                now["illegal"] += (now["last"], row["first"]) not in ((0, 1), (1, 2), (2, 1))
            now["last"] = row["last"]
            if row["turns"]:
                now["turns"] += row["turns"] - (now["last_turn"] == row["first_turn"])
                now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = row["last_turn"]

        def finish() -> None:
            total = [c + INSERT * END_INSERTS[s] for s, c in enumerate(now["costs"])]
            end = min(range(4), key=lambda s: (total[s], now["order"][s]))
            cost, closing = total[end] + DELETE * now["extra"], END_INSERTS[end]
            gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0
            made.append({"conv_id": now["conv_id"], "gaps": gaps, "cost": cost, **{c: now[c] for c in sums}})
            for part, seq, reached in reversed(chain):
                made.append({"part": part, "seq": seq, "begin": reached[end], "end": end, "closing": closing})
                end, closing = reached[end], 0
            chain.clear()

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int32()) for c in ("part", "seq", "begin", "end", "closing")], *[(c, pa.int64()) for c in ("gaps", *sums, "cost")]])
            for row in batch.to_pylist():
                if not now or row["conv_id"] != now["conv_id"]:
                    if now:
                        finish()
                    start(row)
                add(row)
                if len(made) > 5000:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made.clear()
        if now:
            finish()
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    small = blocks.drop("codes", "times", "turn", "role", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return settle(small.mapInArrow(run, out))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edits as one string."""
    known: dict[tuple, list[str]] = {}
    for batch in batches:
        made = []
        for codes, times, begin, end, closing in zip(*(batch[c].to_pylist() for c in ("codes", "times", "begin", "end", "closing")), strict=True):
            key = codes, begin, end
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                known[key] = edits_between(*key)
            edits = known[key]
            if times:
                edits = [e + "D" * (n - 1) for e, n in zip(edits, np.frombuffer(times, np.int64).tolist(), strict=True)]
            made.append("".join(edits) + "I" * closing)
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv_id", "turn", "role", "digest")], pa.array(made, pa.string())], names=["conv_id", "turn", "role", "digest", "edits"])


def _script(turns: DataFrame, rows: DataFrame, conv: str) -> DataFrame:
    """Per conversation and in order: its totals (kind 0), then blocks of edits (1) before their rows (2)."""
    blocks = _blocks(faults(rows))
    met = _meet(blocks)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    chosen = blocks.select("conv_id", "turn", "role", "digest", "codes", "times", "part", "seq").join(met.where("seq is not null").select("part", "seq", "begin", "end", "closing"), ["part", "seq"])
    edits = chosen.mapInArrow(_edits, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, digest binary, edits string").withColumn("kind", F.lit(1))
    texts = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "kind": F.lit(2)})
    totals = met.where("seq is null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost").withColumn("kind", F.lit(0))
    # every conversation, also those without a row left
    known = turns.select(F.col(conv).alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    every = totals.unionByName(known, True).unionByName(edits, True).unionByName(texts, True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "role", "digest", "kind")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of the rows of ``_script``: (conv_id, totals or None, edit, role, text), one for each row or inserted row.

    edit: "" begins a conversation; a deleted row has a null role and text.
    """
    now: tuple | None = None
    state, edits, at = NONE, "", 0
    names = {USER: "user", ASSISTANT: "assistant"}

    def inserted() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state, at = INSERTED[state], at + 1
            yield now[0], None, "I", names[state], ""

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now[0]:
                if now is not None:
                    yield from inserted()
                now, state, edits, at = (row["conv_id"],), NONE, "", 0
                yield row["conv_id"], None, "", None, None
            if row["kind"] == 0:
                if row["cost"] is not None:
                    yield now[0], row, "", None, None
            elif row["kind"] == 1:
                yield from inserted()
                edits, at = row["edits"], 0
            else:
                yield from inserted()
                edit, at = edits[at], at + 1
                if edit == "D":
                    yield now[0], None, "D", None, None
                    continue
                if edit == "R":
                    state = INSERTED[state]
                else:
                    state = KEPT[state, INITIALS.index(row["role"][0])]
                yield now[0], None, edit, names[state] if edit == "R" else row["role"], row["text"]
    if now is not None:
        yield from inserted()


def repair_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, edit, role, text``: every conversation's edits in order.

    edit: Keep, Rerole, Delete or Insert; without the deleted rows (null role and text) the
    rows are the repaired conversation.  Rows come by turn, nulls first, ties by role, then by
    the text's SHA-256.  Null roles and texts are one space, so their rows are blank or have no
    known role; rows with a null ``conv`` are one conversation; equal rows beyond the first are
    duplicates; a conversation of which nothing stays has only deleted rows; an empty table
    gives none; other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    script = _script(turns, rows, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, place, schema = [], 0, 0, None

        def peek() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), *[(c, pa.string()) for c in ("edit", "role", "text")]])
                yield batch

        for key, _, edit, role, text in _walk(peek()):
            if not edit:
                place = 0
                continue
            made.append({"conv_id": key, "place": place, "edit": edit, "role": role, "text": text})
            place, size = place + 1, size + 50 + len(text or "")
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return script.mapInArrow(run, f"conv_id {turns.schema[conv].dataType.simpleString()}, place bigint, edit string, role string, text string")


def repair_digests(turns: DataFrame, rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The query's columns: each of the conversations of ``turns``, as ``rows`` (``damage``) left it.

    Faults: blank, duplicate (role and text came earlier), truncated, the first of them counts.
    gaps: turns missing between the first and last.  illegal: neighbours whose initials are not
    su, ua or au.  A conversation without rows has zeros and an empty audit.
    """
    script = _script(turns, rows, conv)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        schema, totals, audit, digest, written = None, {}, [], hashlib.sha256(), False

        def peek() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())])
                yield batch

        def close() -> None:
            made.append({"conv_id": now[0], **{c: totals.get(c, 0) for c in longs}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

        now: tuple | None = None
        for key, row, edit, role, text in _walk(peek()):
            if row is not None:
                totals = row
            elif not edit:
                if now is not None:
                    close()
                now, totals, audit, digest, written = (key,), {}, [], hashlib.sha256(), False
                if len(made) > 5000:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made.clear()
            else:
                audit.append(edit)
                if role is not None:
                    digest.update((("\n" if written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    written = True
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return script.mapInArrow(run, f"conv_id {turns.schema[conv].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in longs)}, audit string, repaired_sha256 string")


def oracle_sql() -> str:
    """DuckDB has no crc32: a table of the 256 steps, and a fold over the key's bytes."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return _SQL.replace("CRC_TABLE", str(table))


#: The edits by dynamic programming over whole rows: the least (cost, audit) of each state, a row at a time.
_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) FOR x IN string_split(key, '')]),
                                lambda crc, x: xor(crc >> 8, list_extract(CRC_TABLE, xor(crc & 255, x) + 1))), 4294967295) % 20 AS kind FROM c),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER () AS id FROM damaged),
numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS times,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
         CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE '-' END AS i, lag(role[1:1]) OVER w AS before
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), id)),
r AS (SELECT conv_id, turn, role, text, n, i, CASE WHEN seen = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN seen[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             n > 1 AND before || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
inserts AS (SELECT * FROM (VALUES (0,0,'',''), (0,2,'I','u'), (0,3,'II','ua'), (1,1,'',''), (1,2,'I','u'), (1,3,'II','ua'), (2,2,'',''), (2,3,'I','a'), (3,3,'',''), (3,2,'I','u')) v(b, s, ins, roles)),
path AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT p.conv_id, p.n + 1, m.e,
         min({'cost': p.best.cost + 3 * length(m.ins) + m.cost + CASE WHEN m.op <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
              'audit': p.best.audit || m.ins || m.op,
              'said': p.best.said || [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(m.roles, '') IF x <> '']
                      || CASE m.op WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [CASE m.e WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] ELSE [] END})
  FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
  JOIN (SELECT b, ins, roles, 'D' AS op, s AS e, 4 AS cost, '' AS i FROM inserts
        UNION ALL SELECT b, ins, roles, 'R', CASE s WHEN 2 THEN 3 ELSE 2 END, 3, '' FROM inserts
        UNION ALL SELECT b, ins, roles, 'K', kept.e, 0, kept.i FROM inserts
        JOIN (VALUES (0,'s',1), (0,'u',2), (1,'u',2), (3,'u',2), (2,'a',3)) kept(s, i, e) USING (s)) m
    ON m.b = p.s AND (m.op = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.op <> 'K' OR m.i = r.i)
  GROUP BY ALL),
ends AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 3 * length(f.ins), 'audit': p.best.audit || f.ins, 'said': p.best.said || f.said}) AS best
  FROM path p JOIN (SELECT conv_id, max(n) AS n FROM r GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.n
  JOIN (VALUES (0, '', []::VARCHAR[]), (3, '', []), (2, 'I', ['assistant:']), (1, 'II', ['user:', 'assistant:'])) f(s, ins, said) USING (s)
  GROUP BY p.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM c) a
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
