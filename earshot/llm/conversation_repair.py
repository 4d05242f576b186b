"""Repair of damaged conversations: the cheapest edits that make the roles alternate, by a search from both ends.

The places of a conversation and the states of its role grammar span a lattice; a step keeps, gives a new role to,
deletes or inserts a row. Dijkstra's search runs from the start and from the end at once until their heaps show that
no further path can be as cheap as the best one, so that every crossing of equal cost is known; of the cheapest
paths the one with the ASCII-least audit is taken. A conversation's rows reach their task in order, first as codes of
a few bytes, then as texts, so that a task holds the codes of one conversation and the texts of one batch.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a conversation that one search spans; longer ones are searched segment by segment.
SEGMENT = 4096
#: Lattices of equal conversations are searched once for each of so many patterns that a task remembers.
REMEMBERED = 4096
#: What an edit costs, and what a truncated row adds where it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Codes of rows: the role's initial (0 none of these) and the flags of faults.
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE, CUT = 4, 8
ROLES = {2: "user", 3: "assistant"}

# States of the grammar (s?(ua)+)?: nothing yet, after a system row, after a user's, after an assistant's.
_ANSWER = (2, 2, 3, 2)  # where the next row of user or assistant leads
_ENDS = (0, None, None, 0)
_FAR = 1 << 60


def _kept(initial: int, state: int) -> int | None:
    if initial == 1:
        return 1 if state == 0 else None
    return initial if initial and _ANSWER[state] == initial else None


def _row_steps(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state (letter, cost, next state) of a row's edits, in the order of letters."""
    out = []
    for state in range(4):
        steps = [("D", DELETE, state)]
        if not code & GONE:
            more = TRUNCATED if code & CUT else 0
            to = _kept(code & 3, state)
            if to is not None:
                steps.append(("K", more, to))
            steps.append(("R", REROLE + more, _ANSWER[state]))
        out.append(steps)
    return out


def _turned(steps: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int]]]:
    """For each state (cost, earlier state) of the steps that lead to it."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(4)]
    for state, found in enumerate(steps):
        for _, cost, to in found:
            out[to].append((cost, state))
    return out


_STEPS = [_row_steps(c) for c in range(16)]
_BACK = [_turned(s) for s in _STEPS]
_INSERTED_FROM = _turned([[("I", INSERT, to)] for to in _ANSWER])


class _Side:
    """One of the two searches: costs so far, what is settled, and the heap."""

    def __init__(self, size: int, seeds: list[tuple[int, int]]):
        self.cost, self.done, self.heap, self.order = [_FAR] * size, bytearray(size), [], []
        for cost, node in seeds:
            self.reach(node, cost)

    def reach(self, node: int, cost: int) -> None:
        if cost < self.cost[node]:
            self.cost[node] = cost
            heappush(self.heap, (cost, node))

    def top(self) -> int:
        return self.heap[0][0] if self.heap else _FAR

    def settle(self) -> int | None:
        """The nearest node that is not settled yet, now settled; None for a stale entry."""
        _, node = heappop(self.heap)
        if self.done[node]:
            return None
        self.done[node] = 1
        self.order.append(node)
        return node


@lru_cache(REMEMBERED)
def cheapest(codes: bytes, entry: int = 0, exits: tuple = _ENDS, last: bool = True) -> tuple[int, str, int] | None:
    """(cost, audit, state at the end) of the cheapest edits from ``entry`` on, ASCII-least among equals; None if no end can be reached.

    ``exits`` has for each state what it costs to go on from there (None: no way). Rows may be inserted after the last
    row only if it is the ``last`` of the conversation; otherwise they belong to what follows.
    """
    n = len(codes)

    def ahead(node: int):
        place, state = node >> 2, node & 3
        if place == n:
            return (("I", INSERT, node - state + _ANSWER[state]),) if last else ()
        found = [(letter, cost, node - state + 4 + to) for letter, cost, to in _STEPS[codes[place]][state]]
        found.insert(1, ("I", INSERT, node - state + _ANSWER[state]))
        return found

    def behind(node: int):
        place, state = node >> 2, node & 3
        found = [(cost, node - state - 4 + frm) for cost, frm in _BACK[codes[place - 1]][state]] if place else []
        if place < n or last:
            found += [(cost, node - state + frm) for cost, frm in _INSERTED_FROM[state]]
        return found

    front = _Side(4 * n + 4, [(0, entry)])
    back = _Side(4 * n + 4, [(cost, 4 * n + state) for state, cost in enumerate(exits) if cost is not None])
    best = _FAR
    # Beyond ``best``, not at it: paths of equal cost must all be found.
    while front.heap and back.heap and front.top() + back.top() <= best:
        if len(front.heap) <= len(back.heap):
            node = front.settle()
            if node is not None:
                at = front.cost[node]
                best = min(best, at + back.cost[node])
                for _, cost, to in ahead(node):
                    front.reach(to, at + cost)
                    best = min(best, at + cost + back.cost[to])
        else:
            node = back.settle()
            if node is not None:
                at = back.cost[node]
                best = min(best, at + front.cost[node])
                for cost, frm in behind(node):
                    back.reach(frm, at + cost)
                    best = min(best, at + cost + front.cost[frm])
    if best >= _FAR:
        return None
    # Every node of a cheapest path lies strictly within one of the two searches.
    reach_f, reach_b = front.top(), back.top()
    known = lambda node: back.cost[node] < reach_b
    finish = [_FAR if cost is None else cost for cost in exits]
    ends = lambda node, onward: node >> 2 == n and finish[node & 3] == onward
    # Nodes of the search from the start that lead to a crossing of least cost.
    leads = bytearray(4 * n + 4)
    heap = []
    for node in front.order:
        at = front.cost[node]
        if at < reach_f and not known(node) and (ends(node, best - at) or any(known(to) and at + cost + back.cost[to] == best for _, cost, to in ahead(node))):
            leads[node] = 1
            heap.append(node)
    while heap:
        node = heap.pop()
        for cost, frm in behind(node):
            if not leads[frm] and front.cost[frm] < reach_f and front.cost[frm] + cost == front.cost[node]:
                leads[frm] = 1
                heap.append(frm)
    node, audit = entry, []
    while True:
        if ends(node, back.cost[node] if known(node) else best - front.cost[node]):
            break
        if known(node):
            letter, _, to = next(s for s in ahead(node) if s[1] + back.cost[s[2]] == back.cost[node])
        else:
            at = front.cost[node]
            letter, _, to = next(
                s for s in ahead(node) if (at + s[1] + back.cost[s[2]] == best if known(s[2]) else leads[s[2]] and front.cost[s[2]] == at + s[1])
            )
        audit.append(letter)
        node = to
    return best, "".join(audit), node & 3


def repaired_audit(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of any length, in the memory of a segment besides a byte for each row and edit."""
    if len(codes) <= segment:
        cost, audit, _ = cheapest(codes)
        return cost, audit
    parts = [codes[k : k + segment] for k in range(0, len(codes), segment)]
    # From the end on: what it costs to go on from each state before each segment.
    onward = [_ENDS]
    for k in range(len(parts) - 1, 0, -1):
        found = [cheapest(parts[k], state, onward[-1], k == len(parts) - 1) for state in range(4)]
        onward.append(tuple(f[0] if f else None for f in found))
    state, audits, cost = 0, [], None
    for k, part in enumerate(parts):
        total, audit, state = cheapest(part, state, onward[len(parts) - 1 - k], k == len(parts) - 1)
        cost = total if cost is None else cost
        audits.append(audit)
    return cost, "".join(audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the drawn damage; nulls of role and text are one space, and so are null ids and turns in the draw.

    A dropped row stays as a row without role and text, so that its conversation is known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    changed = drawn.select("conv_id", "turn", "draw", role.alias("role"), text.alias("text"))
    gone = changed.filter("draw = 0").select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("dropped")).distinct()
    times = F.when(F.col("draw") == 3, 2).otherwise(1)
    left = changed.filter("draw <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return left.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.lit(False).alias("dropped")).unionByName(gone)


def _code(role: Column, text: Column) -> Column:
    """What a row's fault and initial are, but for duplicates, which take the other rows."""
    initial = F.substring(role, 1, 1)
    found = F.lit(0)
    for letter, number in INITIALS.items():
        found = F.when(initial == letter, number).otherwise(found)
    # All white space of the faults is ASCII, so a row's end needs no look at the whole text.
    end = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)
    return F.when(end == "", found + GONE).when(~end.isin(".", "!", "?"), found + CUT).otherwise(found).cast("int")


SCHEMA = "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, n_rows bigint"


class _Conversation:
    """One conversation while its rows pass by: codes first, texts then."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.prints, self.turns, self.hash, self.places = conv_id, bytearray(), [], [], None, 0

    def mark(self, codes: np.ndarray, prints: list[bytes], turns: np.ndarray) -> None:
        self.codes += codes.tobytes()
        self.prints.append(b"".join(prints))
        self.turns.append(turns)

    def solve(self) -> None:
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        blank = codes & GONE > 0
        # The first row of each role and text: rows of the same print keep their order in the sort.
        prints = np.frombuffer(b"".join(self.prints), "S16")
        again = np.ones(len(codes), bool)
        again[np.unique(prints, return_index=True)[1]] = False
        again &= ~blank
        codes[again] = codes[again] & 3 | GONE
        self.faults = int(blank.sum()), int(again.sum()), int((codes & CUT > 0).sum())
        at = codes & 3
        legal = (at[:-1] == 1) & (at[1:] == 2) | (at[:-1] == 2) & (at[1:] == 3) | (at[:-1] == 3) & (at[1:] == 2)
        self.illegal = int((~legal).sum())
        turns = np.concatenate(self.turns) if self.turns else np.empty(0, np.int64)
        self.gaps = int(turns[-1]) - int(turns[0]) + 1 - (1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else 0
        self.cost, self.audit = repaired_audit(codes.tobytes())
        self.at = codes
        self.prints = self.turns = None
        self.hash, self.state, self.step, self.empty = hashlib.sha256(), 0, 0, True

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserted(self) -> None:
        while self.step < len(self.audit) and self.audit[self.step] == "I":
            self.state = _ANSWER[self.state]
            self._write(ROLES[self.state], "")
            self.step += 1

    def say(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.step]
        self.step += 1
        if letter == "K":
            self.state = _kept(int(self.at[self.places]) & 3, self.state)
            self._write(role, text)
        elif letter == "R":
            self.state = _ANSWER[self.state]
            self._write(ROLES[self.state], text)
        self.places += 1

    def row(self) -> tuple:
        if self.hash is None:
            self.solve()
        self._inserted()
        return (self.conv_id, self.gaps, *self.faults, self.illegal, self.cost, self.audit, self.hash.hexdigest(), self.places)


def repaired(rows: DataFrame) -> DataFrame:
    """For each conv_id of ``rows`` (conv_id, turn, role, text, dropped) its faults and its repair, (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows).

    Rows go by turn, nulls first, and within a turn by the MD5 of role and text, so equal rows stand together and a
    repeated row is a duplicate. A null conv_id is a conversation of its own. A conversation without rows has zeros, an
    empty audit and the hash of nothing. Texts of any length pass in order through one hash; an empty table gives none.
    What a task keeps of a conversation is 30 bytes a row, not its texts; the hash of a conversation can only be
    taken in order, by one task.
    """
    kind = rows.schema["conv_id"].dataType
    print_ = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    placed = rows.withColumn("print", F.when(F.col("dropped"), None).otherwise(print_))
    coded = placed.select("conv_id", F.lit(0).alias("phase"), "turn", "print", F.when(F.col("dropped"), -1).otherwise(_code(F.col("role"), F.col("text"))).alias("code"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    said = placed.filter("NOT dropped").select("conv_id", F.lit(1).alias("phase"), "turn", "print", F.lit(None).cast("int").alias("code"), "role", "text")
    dealt = coded.unionByName(said).repartition("conv_id").sortWithinPartitions("conv_id", "phase", F.col("turn").asc_nulls_first(), "print")

    def work(batches):
        now, found = None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), names)], schema=names)

        names = _arrow_schema(kind)
        for batch in batches:
            ids, phases = batch.column(0), batch.column(1).to_numpy()
            values = ids.fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), object)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((values[1:] != values[:-1]) | (missing[1:] != missing[:-1]) | (phases[1:] != phases[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if a == b:
                    continue
                conv_id = ids[a].as_py()
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        found.append(now.row())
                    if len(found) >= 1000:
                        yield made()
                        found.clear()
                    now = _Conversation(conv_id)
                part = batch.slice(a, b - a)
                if phases[a] == 0:
                    codes = part.column(4).to_numpy()
                    real = codes >= 0
                    turns = part.column(2).filter(pa.array(real)).drop_null().to_numpy()
                    now.mark(codes[real].astype(np.uint8), [p for p in part.column(3).to_pylist() if p is not None], turns)
                else:
                    if now.hash is None:
                        now.solve()
                    for role, text in zip(part.column(5), part.column(6)):
                        now.say(role.as_py(), text.as_py())
        if now is not None:
            found.append(now.row())
        if found:
            yield made()

    return dealt.mapInArrow(work, SCHEMA.format(kind=kind.simpleString()))


def _arrow_schema(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_rows", pa.int64())])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text, any others, which are not looked at) as they are, repaired: see ``repaired``.

    Nulls of role and text are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return repaired(conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), F.lit(False).alias("dropped")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, damaged by a draw on (conv_id, turn) and repaired."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """The twin in DuckDB: the best (cost, audit) of each state row by row, as text of which the first nine digits are the cost."""
    step = lambda s, cost, letter: f"lpad(CAST(CAST(left({s}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || '{letter}'"
    insert = lambda s: step(s, INSERT, "I")
    when = lambda c, v: f"CASE WHEN {c} THEN {v} END"
    drop = lambda s: step(s, DELETE, "D")
    keep = lambda s, letter: when(f"NOT gone AND initial = '{letter}'", step(s, "cut", "K"))
    rerole = lambda s: when("NOT gone", step(s, f"({REROLE} + cut)", "R"))
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([ascii(x) FOR x IN string_split(k, '')], lambda crc, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 20 AS draw FROM c),
g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM c)),
d AS (SELECT g, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END))
      FROM h JOIN g ON h.conv_id IS NOT DISTINCT FROM g.conv_id WHERE draw <> 0),
o AS (SELECT g, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM d),
b AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short, lag(initial) OVER (PARTITION BY g ORDER BY i) AS before FROM o),
f AS (SELECT *, blank OR again AS gone, CASE WHEN short AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS cut FROM b),
n AS (SELECT g, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
r(g, i, s0, s1, s2, s3) AS (
  SELECT g, 0::BIGINT, '000000000', CAST(NULL AS VARCHAR), {insert("'000000000'")}, {insert("(" + insert("'000000000'") + ")")} FROM n
  UNION ALL
  SELECT g, i, x0, x1, y2, least(x3, {insert("y2")}) FROM (SELECT *, least(x2, {insert("x0")}, {insert("x1")}, {insert("x3")}) AS y2 FROM (
    SELECT r.g, f.i, {drop("s0")} AS x0, least({drop("s1")}, {keep("s0", "s")}) AS x1,
      least({drop("s2")}, {keep("s0", "u")}, {keep("s1", "u")}, {keep("s3", "u")}, {rerole("s0")}, {rerole("s1")}, {rerole("s3")}) AS x2,
      least({drop("s3")}, {keep("s2", "a")}, {rerole("s2")}) AS x3
    FROM r JOIN f ON f.g = r.g AND f.i = r.i + 1))),
a AS (SELECT r.g, substr(least(s0, s3), 10) AS audit, CAST(left(least(s0, s3), 9) AS BIGINT) AS cost FROM r JOIN n ON n.g = r.g AND n.n_rows = r.i),
l AS (SELECT g, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM a WHERE audit <> ''),
m AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY p) AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY p) AS nth FROM l),
t AS (SELECT m.g, p, letter, nth, CASE WHEN letter = 'I' THEN NULL ELSE initial END AS initial, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text FROM m LEFT JOIN f ON f.g = m.g AND f.i = m.i WHERE letter <> 'D'),
w AS (SELECT *, max(CASE WHEN nth = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS led FROM t),
z AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM w GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows
FROM g LEFT JOIN n USING (g) LEFT JOIN a USING (g) LEFT JOIN z USING (g)
"""


OP13_SQL = _sql()
