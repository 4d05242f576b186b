import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from earshot.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
#: Next state for a row of each initial; states: nothing yet, after system, after user, after assistant.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def all_paths(rows):
    """The least (cost, audit, output) by a table over all places and states; ``rows`` are (initial, must go, extra cost)."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                to = 3 if state == 2 else 2
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, gone, extra in rows:
        after = defaultdict(list)
        for state, (cost, audit) in best.items():
            after[state].append((cost + 3, audit + "D"))
            if not gone:
                to = AFTER.get(initial, {}).get(state)
                if to is not None:
                    after[to].append((cost + extra, audit + "K"))
                after[3 if state == 2 else 2].append((cost + 2 + extra, audit + "R"))
        best = inserted({s: min(v) for s, v in after.items()})
    return min(best[s] for s in (0, 3) if s in best)


def test_search_finds_the_least_audit_whatever_the_segments():
    rng = random.Random(5)
    kinds = [("s", False, 0), ("u", False, 0), ("a", False, 0), ("x", False, 0), ("u", True, 0), ("a", True, 0), ("u", False, 1), ("a", False, 1), ("s", False, 1)]
    for k in range(1500):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(13))]
        codes = bytes(C.INITIALS.get(i, 0) + (C.GONE if g else C.CUT if e else 0) for i, g, e in rows)
        assert C.repaired_audit(codes) == C.repaired_audit(codes, 1 + k % 5) == all_paths(rows)
    rows = [rng.choice(kinds) for _ in range(3000)]
    codes = bytes(C.INITIALS.get(i, 0) + (C.GONE if g else C.CUT if e else 0) for i, g, e in rows)
    assert C.repaired_audit(codes, 500) == all_paths(rows)


def by_hand(rows):
    """Results for rows (turn, role, text) of one conversation that are in order."""
    white = " \t\n\x0b\f\r"
    seen, faults, coded = set(), [0, 0, 0], []
    for _, role, text in rows:
        end = text.rstrip(white)[-1:]
        if not end:
            faults[0] += 1
        elif (role, text) in seen:
            faults[1] += 1
        elif end not in ".!?":
            faults[2] += 1
        coded.append((role[:1], not end or (role, text) in seen, int(end not in ".!?")))
        seen.add((role, text))
    cost, audit = all_paths(coded)
    out, state, at = [], 0, 0
    for letter in audit:
        answer = "assistant" if state == 2 else "user"
        if letter == "I":
            out.append(f"{answer}:")
        else:
            _, role, text = rows[at]
            at += 1
            if letter == "K":
                out.append(f"{role}:{text}")
                answer = role
            elif letter == "R":
                out.append(f"{answer}:{text}")
        state = state if letter == "D" else {"s": 1, "u": 2, "a": 3}[answer[0]]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 30)):
            role = rng.choice(["user", "assistant", "system", None, "Xe", ""])
            text = rng.choice(["Yes.", "No", " \n", None, "", "Why?!  ", "è ende", "x" * 50_000 + ".", f"{turn} is it."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5]), role, text))
    rows += rows[:7]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(9) for c in ("code", "phase", "print", "dropped", "cost", "draw")})
    want = {}
    for damage in (False, True):
        groups = defaultdict(list)
        for conv, turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            groups[conv] += [] if draw == 0 else [(turn, "user" if draw == 4 else role, "" if draw == 1 else text.translate({33: None, 46: None, 63: None}) if draw == 2 else text)] * (2 if draw == 3 else 1)
        order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        want[damage] = {conv: by_hand(sorted(g, key=order)) for conv, g in groups.items()}
    for damage, got in ((False, C.repair_conversations(frame)), (True, C.repaired(C.damaged(frame)))):
        assert {r["conv_id"]: tuple(r)[1:-1] for r in got.collect()} == want[damage]


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert [tuple(r) for r in C.repaired(C.damaged(frame)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest(), 0)]
    assert C.repaired(C.damaged(frame.limit(0))).count() == 0 == C.repair_conversations(frame.limit(0)).count()


def test_other_ids_and_a_long_conversation(spark):
    n = 6000
    rows = [("long", k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(n)] + [("b", 0, "assistant", "Hm")]
    got = {r["conv_id"]: r for r in C.repair_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    whole = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:n])
    assert (got["long"]["cost"], got["long"]["audit"], got["long"]["repaired_sha256"]) == (0, "K" * n, hashlib.sha256(whole.encode()).hexdigest())
    assert (got["b"]["cost"], got["b"]["audit"]) == (3, "D")
