"""Repair of the turn structure of conversations.

A conversation is well formed if the initials of its roles spell
``(s?(ua)+)?``. Its rows, by turn, may be kept (0), given the role user or
assistant (3) or deleted (4); empty turns of either role may be inserted
anywhere (3). Blank and duplicate rows must be deleted, truncated rows that
stay cost 3 more. The cheapest edits are a shortest path in the lattice of
(rows done, state of the pattern): a forward heap from its start and a reverse
heap from its ends meet, all crossings of the least cost are finished, and the
audit (initials of the edits) that is least as text is read off along the edges
that lie on a least path. In a state, each initial stands for one edit, so the
walk takes the least initial at each node and needs no stored strings.

Rows of one conversation are ordered by turn (nulls first), then role, then the
md5 of the text: equal turns keep a defined order. Two passes over sorted
streams, each shuffled by conversation:

1. narrow rows (initial, fault, md5; no texts) give figures and the audit; one
   byte a turn is held, and the lattice about 40 bytes a turn while it is solved;
2. audits and rows together give the repaired turns, one row at a time.

A conversation's rows go to one task as a stream that spills, never as a group
in memory: its audit and digest are one value of one row each, and a digest
cannot be computed in parts.

Cases: nulls in any column count as one space (a null conversation id is a
conversation); a role's initial is its first character, an empty role counts as a
space; empty and white-space texts are blank; repeated rows are duplicates of the
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import frozen

_SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# One byte a row: fault and role initial together.
_CODES = {(f, r): i for i, (f, r) in enumerate((f, r) for f in ("", "truncated", "gone") for r in "sua ")}
_NAMES = {i: k for k, i in _CODES.items()}

# States of the pattern: nothing yet, after s, after u, after a. Fixed by the pattern.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_DUE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the role that an edit may give
_ROLE = {"u": "user", "a": "assistant"}


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """Edits that use up a row of this code, by state: (initial, next state, cost)."""
    fault, role = _NAMES[code]
    out = []
    for state in range(4):
        found = [("D", state, DELETE)]
        if fault != "gone":
            more = TRUNCATED if fault else 0
            if (state, role) in _NEXT:
                found.append(("K", _NEXT[state, role], KEEP + more))
            found.append(("R", _NEXT[state, _DUE[state]], REROLE + more))
        out.append(found)
    return out


_FORWARD = [_steps(c) for c in range(len(_CODES))]
_BACKWARD = [[[(s, c) for s in range(4) for _, t, c in steps[s] if t == to] for to in range(4)] for steps in _FORWARD]
_INSERTED = [_NEXT[s, _DUE[s]] for s in range(4)]
_BEFORE_INSERT = [[s for s in range(4) if _INSERTED[s] == to] for to in range(4)]
_FAR = (1 << 30) - 1


def cheapest(codes: bytes) -> tuple[int, str]:
    """(least cost, least audit of that cost) for the rows' codes."""
    n = len(codes)
    ahead, behind = array("i", [_FAR]) * (4 * n + 4), array("i", [_FAR]) * (4 * n + 4)
    settled = bytearray(4 * n + 4)  # 1: forward, 2: reverse
    ahead[START] = 0
    fore, back = [(0, START)], []
    for end in _ENDS:
        behind[4 * n + end] = 0
        heapq.heappush(back, (0, -(4 * n + end)))

    # Nodes are 4 * row + state. Of equal costs the heaps give the node of the
    # fewest (reverse: most) rows first, so edges of cost 0 are finished in order.
    def reach(heap: list, cost: array, other: array, node: int, new: int, sign: int) -> None:
        nonlocal best
        if new < cost[node]:
            cost[node] = new
            heapq.heappush(heap, (new, sign * node))
            best = min(best, new + other[node])

    best = min(ahead[4 * n + e] + behind[4 * n + e] for e in _ENDS)
    while fore and back and fore[0][0] + back[0][0] <= best:
        if len(fore) <= len(back):
            cost, node = heapq.heappop(fore)
            if settled[node] & 1 or cost > ahead[node]:
                continue
            settled[node] |= 1
            row, state = divmod(node, 4)
            reach(fore, ahead, behind, node - state + _INSERTED[state], cost + INSERT, 1)
            if row < n:
                for _, to, price in _FORWARD[codes[row]][state]:
                    reach(fore, ahead, behind, node - state + 4 + to, cost + price, 1)
        else:
            cost, node = heapq.heappop(back)
            node = -node
            if settled[node] & 2 or cost > behind[node]:
                continue
            settled[node] |= 2
            row, state = divmod(node, 4)
            for come in _BEFORE_INSERT[state]:
                reach(back, behind, ahead, node - state + come, cost + INSERT, -1)
            if row:
                for come, price in _BACKWARD[codes[row - 1]][state]:
                    reach(back, behind, ahead, node - state - 4 + come, cost + price, -1)
    _finish(codes, ahead, behind, best)
    return best, _walk(codes, behind, best)


def _finish(codes: bytes, ahead: array, behind: array, best: int) -> None:
    """Carry the reverse costs from all crossings of the least cost back over the
    forward part: a node there is on a least path if an edge of its price leads
    to a node that is."""
    crossing = np.frombuffer(ahead, np.int32) + np.frombuffer(behind, np.int32)
    heap = [-int(i) for i in np.flatnonzero(crossing == best)]
    heapq.heapify(heap)
    while heap:
        node = -heapq.heappop(heap)
        row, state = divmod(node, 4)
        edges = [(node - state + s, INSERT) for s in _BEFORE_INSERT[state]]
        if row:
            edges += [(node - state - 4 + s, price) for s, price in _BACKWARD[codes[row - 1]][state]]
        for come, price in edges:
            left = best - ahead[come]
            if behind[node] + price == left < behind[come]:
                behind[come] = left
                heapq.heappush(heap, -come)


def _walk(codes: bytes, behind: array, best: int) -> str:
    """The least initials along edges that keep to a least path."""
    node, left, audit, last = START, best, [], 4 * len(codes)
    while node < last or left:
        row, state = divmod(node, 4)
        edges = [("I", node - state + _INSERTED[state], INSERT)]
        if node < last:
            edges += [(x, node - state + 4 + to, price) for x, to, price in _FORWARD[codes[row]][state]]
        x, node, price = min(e for e in edges if behind[e[1]] + e[2] == left)
        audit.append(x)
        left -= price
    return "".join(audit)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, from the rows in their order."""
    state = START
    for x in audit:
        if x == "I":
            due = _DUE[state]
            state = _NEXT[state, due]
            yield x, _ROLE[due], ""
            continue
        role, text = next(rows)
        if x == "D":
            continue
        if x == "R":
            due = _DUE[state]
            state = _NEXT[state, due]
            role = _ROLE[due]
        else:
            state = _NEXT[state, role[:1]]
        yield x, role, text


FIGURES = ("turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _filled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def prepared(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns under names of our own, nulls filled; ids and turns keep their nulls."""
    role = _filled(F.col(role_col))
    return conversations.select(
        F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.when(role == "", " ").otherwise(role).alias("r"), _filled(F.col(text_col)).alias("x")
    )


def _in_order() -> list[Column]:
    return [F.col("t").asc_nulls_first(), F.col("r"), F.col("m")]


def audits(rows: DataFrame) -> DataFrame:
    """c, the figures and the audit of each conversation of ``prepared`` rows."""
    text = F.rtrim(F.col("x"), F.lit(_SPACE))
    narrow = rows.select(
        "c",
        "t",
        "r",
        F.md5(F.col("x").cast("binary")).alias("m"),
        (text == "").alias("blank"),
        (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    again = F.row_number().over(Window.partitionBy("c", "r", "m").orderBy(*_in_order())) > 1
    fault = F.when(F.col("blank"), 2).when(F.col("again"), 3).when(F.col("cut"), 1).otherwise(0)
    ordered = (
        narrow.repartition("c")
        .withColumn("again", again)
        .sortWithinPartitions(F.col("c").asc_nulls_first(), *_in_order(), "again")
        .select("c", "t", F.left("r", F.lit(1)).alias("i"), fault.alias("f"))
    )

    def solved(turns: Iterator[tuple]) -> tuple:
        codes, faults, illegal, before = bytearray(), [0, 0, 0, 0], 0, None
        least = most = None
        distinct = 0
        for t, i, f in turns:
            faults[f] += 1
            codes.append(_CODES["gone" if f > 1 else "truncated" if f else "", i if i in "sua" else " "])
            illegal += before is not None and before + i not in ("su", "ua", "au")
            before = i
            if t is not None:  # turns ascend
                distinct += t != most
                least, most = t if least is None else least, t
        cost, audit = cheapest(bytes(codes))
        return len(codes), 0 if least is None else most - least + 1 - distinct, faults[2], faults[3], faults[1], illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["c", *FIGURES, "audit"])
        for c, turns in _conversations(batches, ("t", "i", "f"), out):
            yield from out.add((c, *solved(turns)))
        yield from out.rest()

    return ordered.mapInArrow(run, f"c {_kind(rows)}, {', '.join(f'{x} long' for x in FIGURES)}, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """c, position (from 0), edit, role, text of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["c", "position", "edit", "role", "text"])
        for c, turns in _conversations(batches, ("r", "x"), out):
            audit = next(turns)[1]
            for position, (edit, role, text) in enumerate(edited(audit, turns)):
                yield from out.add((c, position, edit, role, text), len(text))
        yield from out.rest()

    return _audits_then_rows(rows, found).mapInArrow(run, f"c {_kind(rows)}, position long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The figures and audits, with the sha256 of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["c", *FIGURES, "audit", "repaired_sha256"])
        for c, turns in _conversations(batches, ("r", "x", *FIGURES), out):
            _, audit, *figures = next(turns)
            digest = hashlib.sha256()
            for position, (_, role, text) in enumerate(edited(audit, (t[:2] for t in turns))):
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield from out.add((c, *figures, audit, digest.hexdigest()))
        yield from out.rest()

    schema = f"c {_kind(rows)}, {', '.join(f'{x} long' for x in FIGURES)}, audit string, repaired_sha256 string"
    return _audits_then_rows(rows, found).mapInArrow(run, schema)


def _audits_then_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and figures as one row before its rows in order."""
    heads = found.select("c", F.lit(0).alias("o"), F.lit(None).cast("long").alias("t"), F.lit("").alias("r"), F.col("audit").alias("x"), *FIGURES)
    both = heads.unionByName(rows.withColumn("o", F.lit(1)), allowMissingColumns=True).withColumn("m", F.md5(F.col("x").cast("binary")))
    return both.repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), "o", *_in_order()).drop("o", "t", "m")


def _kind(rows: DataFrame) -> str:
    return rows.schema["c"].dataType.simpleString()


class _Rows:
    """Result rows on their way into record batches of bounded size."""

    def __init__(self, names: list[str], rows: int = 4096, size: int = 1 << 22):
        self.names, self.most, self.size = names, rows, size
        self.kind, self.held, self.bytes = None, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.bytes += size
        if len(self.held) >= self.most or self.bytes >= self.size:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            text = ("audit", "repaired_sha256", "edit", "role", "text")
            kinds = [self.kind if x == "c" else pa.string() if x in text else pa.int64() for x in self.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.held), kinds)], self.names)
            self.held, self.bytes = [], 0


def _conversations(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], out: _Rows) -> Iterator[tuple]:
    """(id, iterator of its rows) of a stream sorted by id."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            out.kind = batch.schema.field("c").type
            yield from zip(batch["c"].to_pylist(), *(batch[x].to_pylist() for x in names))

    for c, some in itertools.groupby(rows(), key=lambda row: row[0]):
        yield c, (row[1:] for row in some)


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(figures and audit by conversation, repaired turns)."""
    rows = prepared(conversations, conv_col, turn_col, role_col, text_col)
    found = frozen(audits(rows), "audits")
    names = found.withColumnRenamed("c", conv_col)
    return names, repaired(rows, found).withColumnRenamed("c", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the contract, by crc32 of ``conv_id:turn``."""
    kind = F.crc32(F.concat_ws(":", _filled(F.col("conv_id")), _filled(F.col("turn"))).cast("binary")) % 20
    text, role = _filled(F.col("text")), _filled(F.col("role"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def structure(conversations: DataFrame) -> DataFrame:
    """Figures, audit and digest of every conversation of the table after damage."""
    rows = prepared(damaged(conversations))
    found = digests(rows, audits(rows))
    ids = conversations.select("conv_id").distinct()
    figures = [F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left").select(
        "conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
