import random

import numpy as np
import pytest

from earshot.llm import decontamination as D


def words(t):
    low, high, data = D.words_of(t)
    return [data[a:b].decode() for a, b in zip(low, high)]


def brute(docs, items):
    """The best stretch of any length, by a table over whole texts in plain Python; equally good ones by their start."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            q = words(x)
            if not q or not w:
                continue
            row = [(0, k) for k in range(len(w) + 1)]
            for a in q:
                new = [(row[0][0] + 1, row[0][1])]
                for k, b in enumerate(w, 1):
                    new.append(min((row[k][0] + 1, row[k][1]), (new[-1][0] + 1, new[-1][1]), (row[k - 1][0] + (a != b), row[k - 1][1])))
                row = new
            if min(row)[0] <= D.allowed(len(q)):
                out[d, i] = min(row)
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    v = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(6, 60)))) for i in range(40)]
    docs = []
    for n in range(150):
        w = [rng.choice(v) for _ in range(rng.randint(0, 80))]
        if n % 2:
            x = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, len(x) // 6])):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.__setitem__(k, "new"), lambda: x.insert(k, "ins"), lambda: x.pop(k)])()
            c = rng.randrange(len(w) + 1)
            w[c:c] = [s.upper() if rng.random() < 0.1 else s + rng.choice(["", ",", "."]) for s in x]
        docs.append((n, " ".join(w)))
    return docs + [(500, None), (501, ""), (502, "!!!")], items + [(90, None), (91, "?"), (92, items[3][1])]


def test_recall_and_exactness_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start_word"]) for r in rows}
    assert len(rows) == len(got) and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 60
    assert all(got[k] == want[k] for k in got)
    exact = {k for k, v in want.items() if v[0] == 0}
    assert exact <= set(got)


def test_joined_path_equals_the_sent_one(spark, monkeypatch):
    docs, items = corpus(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, D.contaminated(d, i).collect()))
    monkeypatch.setattr(D, "SENT_KEYS", 0)
    assert sorted(map(tuple, D.contaminated(d.repartition(5), i).collect())) == want


def test_empty_tables_nulls_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([(1, text, 0), (1, text, 1), (None, "a " + text, 2)], "doc_id long, text string, start int")
    i = spark.createDataFrame([(4, text, "x"), (4, text, "y")], "item_id long, text string, keys string")
    assert sorted(map(tuple, D.contaminated(d, i).collect()), key=str) == [(1, 4, 0, 0), (None, 4, 0, 1)]
    assert D.contaminated(d.limit(0), i).count() == 0 and D.contaminated(d, i.limit(0)).count() == 0


def test_best_places_against_the_table():
    rng = random.Random(4)
    items, texts = [], []
    for _ in range(60):
        items.append([rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 7, 12]))])
        texts.append([rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))])
    edits, begin = D.best_places([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in texts])
    for x, t, e, k in zip(items, texts, edits.tolist(), begin.tolist()):
        found = brute([(0, " ".join(map(str, t)))], [(0, " ".join(map(str, x)))])
        assert (e, k) == found.get((0, 0), (e, k)) and (e <= D.allowed(len(x))) == bool(found)


@pytest.mark.parametrize("n", [5, 10, 15, 30, 60, 80, 120, 200])
def test_recall_of_walks_at_the_largest_number_of_edits(n):
    for size in {D.size_for(min(n, D.WINDOW))}:
        plan = D.plan_for(size)
        other = np.random.default_rng(99).integers(1, 2**31)
        assert min(D.recall(plan, kind, 300, seed=int(other)) for kind in ("substituted", "added", "dropped", "mixed")) >= 0.95


def test_added_and_dropped_words_against_brute_force(spark):
    rng = random.Random(2)
    v = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(300)]
    items, docs = [], []
    for n in (15, 20, 40, 60, 150):
        for kind in ("ins", "del", "mixed"):
            for _ in range(6):
                q = [rng.choice(v) for _ in range(n)]
                x = q[:]
                for _ in range(D.allowed(n)):
                    k = rng.randrange(1, len(x))
                    edit = kind if kind != "mixed" else rng.choice(["ins", "del", "sub"])
                    x[k : k + (edit != "ins")] = [] if edit == "del" else ["new"]
                docs.append((len(items), " ".join([rng.choice(v) for _ in range(20)] + x + [rng.choice(v) for _ in range(20)])))
                items.append((len(items), " ".join(q)))
    want = {}
    for d, i in zip(docs, items):
        want |= brute([d], [i])
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start_word"]) for r in rows}
    assert len(want) == len(docs) and all(got[k] == brute([docs[k[0]]], [items[k[1]]])[k] for k in got)
    assert len(got.keys() & want.keys()) >= 0.97 * len(want)


def test_very_long_items_and_texts(spark):
    """An item of 3,000 words, found whole in a text of 30,000 by its segments, also with a fifth of its words changed."""
    rng = random.Random(6)
    item = [f"v{rng.randrange(5000)}" for _ in range(3000)]
    around = [f"u{rng.randrange(5000)}" for _ in range(27000)]
    changed = [f"n{k}" if rng.random() < 0.18 else w for k, w in enumerate(item)]
    docs = [(1, " ".join(around[:9000] + item + around[9000:])), (2, " ".join(around[:50] + changed)), (3, " ".join(item[:1500])), (4, " ".join(around))]
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    got = {r["doc_id"]: (r["edits"], r["start_word"]) for r in rows}
    assert got[1] == (0, 9000) and got[2][0] == sum(a != b for a, b in zip(item, changed)) and set(got) == {1, 2}
