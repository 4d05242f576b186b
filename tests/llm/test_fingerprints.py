import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from earshot.llm import fingerprints as P

SCHEMA = "doc_id long, text string"


def vector(text):
    exact, bits, n = [0] * 8, [0] * 64, 0
    for line in (text or "").split("\n"):
        digest = hashlib.sha256(line.encode()).hexdigest()
        exact = [(e + int(digest[8 * k : 8 * k + 8], 16)) % 2**32 for k, e in enumerate(exact)]
        words = re.split(r"[\x20\x09-\x0D]+", line)
        for a, b in zip(words, [*words[1:], None]):
            pair = a if b is None else f"{a} {b}"
            if pair:
                h = int(hashlib.md5(pair.encode()).hexdigest()[:16], 16)
                bits = [x + (h >> k & 1) for k, x in enumerate(bits)]
                n += 1
    return exact, bits, n


def printed(text):
    exact, bits, n = vector(text)
    return "".join(f"{e:08x}" for e in exact) + "".join(f"{bits[k + 32]:08x}{bits[k]:08x}" for k in range(32)) + f"{n:08x}"


def near(a, b):
    if printed(a) == printed(b):
        return 1.0
    (_, x, n), (_, y, m) = vector(a), vector(b)
    x, y = [2 * v - n for v in x], [2 * v - m for v in y]
    q = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y)) / q)) if q else 0.0


def brute(rows):
    key = lambda r: hashlib.sha256(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest()
    docs = Counter((i, t or "") for i, t in rows)
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, key(r)), reverse=True)
    out = []
    for (i, text), (_, nxt) in zip(order, [*order[1:], *order[:1]]):
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        out += [(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(text), printed(edited), round(near(text, edited), 9), round(near(text, nxt), 9))] * docs[i, text]
    return sorted(out, key=repr)


def test_nulls_empty_long_ties_and_repeated_rows(spark):
    long = "\n".join(f"Zeile {k} ist größer als {k * k}." for k in range(20_000))
    rows = [(1, "eins zwei drei\nvier fünf"), (2, None), (3, ""), (None, "no id\nat all"), (None, None), (4, "x"), (5, "\n\n a  b \n"), (6, long), (7, "same text here"), (8, "same text here"), (9, "short")]
    rows += [(7, "same text here")] * 3 + [(7, "another text of that id"), (-(2**63), "least"), (2**63 - 1, "most 𝒙𝒚𝒛 of them")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "part", "vector", "copies", "next", "idx")})
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in P.edited_fingerprints(frame).collect()), key=repr)
    assert got == brute(rows)


def test_one_document_and_none(spark):
    one = [(3, "abcdef\ngh")]
    assert [tuple(r) for r in P.edited_fingerprints(spark.createDataFrame(one, SCHEMA)).collect()] == brute(one)
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paragraphs_come_and_go_without_a_look_at_the_others(spark):
    whole, part, rest = "b b\na\n\nc d e\nb b", "c d e\nb b", "a\n\nb b"
    rows = spark.createDataFrame([(1, whole), (2, part), (3, rest), (4, "b b\nb b\nc d e\n\na"), (5, whole), (6, None)], SCHEMA).withColumn("vector", F.lit("mine"))
    made = P.fingerprints(rows)
    assert sorted(made.columns) == ["doc_id", "fingerprint", "text", "vector"]
    prints = {r["doc_id"]: r["fingerprint"] for r in made.collect()}
    assert prints[1] == prints[4] == prints[5] == printed(whole) != prints[2]
    assert prints[6] == printed("")
    v = {k: made.filter(F.col("doc_id") == k).select(F.col("vector").alias(f"v{k}")) for k in (1, 2, 3)}
    both = v[1].crossJoin(v[2]).crossJoin(v[3]).select("v1", "v2", "v3", P.text_of(P.inserted("v2", "v3")).alias("sum"), P.text_of(P.deleted("v1", "v2")).alias("less"), P.deleted("v1", "v1").alias("none"), P.text_of(P.inserted(P.deleted(P.nothing(), F.col("v2")), F.col("v1"))).alias("wrapped"))
    r = both.first()
    assert (r["sum"], r["less"], r["wrapped"]) == (prints[1], prints[3], prints[3])
    assert r["none"] == [0] * P.WIDTH


def test_main_path_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], SCHEMA)
    for df in (P.edited_fingerprints(rows), P.fingerprints(rows)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
