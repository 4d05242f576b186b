import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from earshot.llm import bpe, decontamination, quality
from tests.llm.test_decontamination import brute as best
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_secret_scan import brute as spans

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    """Each stage by plain Python on what its predecessor kept; the classifier's decisions are its own query's."""
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.op10_quality_classifier(spark, SF).filter("predicted = 1").collect()}
    rows = [(i, t) for i, t in zip(docs.doc_id, docs.text) if i in good]
    kept = near(rows)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    words = lambda t: (lambda low, high, data: [data[a:b] for a, b in zip(low, high)])(*decontamination.words_of(t))
    items = [(k, t) for k, t in enumerate(pd.read_parquet(f"{SF}/benchmark.parquet").text)]
    sets = [set(words(t)) for _, t in items]

    def leaked(t):
        # The table over the whole text, for items most of whose words are in it at all.
        there = set(words(t))
        return bool(best([(0, t)], [x for x, s in zip(items, sets) if len(s & there) >= len(s) - decontamination.allowed(len(words(x[1])))]))

    rows = [(i, t) for i, t in rows if not leaked(t)]

    def redacted(t):
        out, at = [], 0
        for s in filter(None, spans(t).split(",")):
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                out += [t[at:a], "[REDACTED]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    want = {i: tok.encode(redacted(t), add_special_tokens=False).ids for i, t in rows}
    out = C.run(spark, SF)
    got = {r["doc_id"]: r["token_ids"] for r in out.collect()}
    assert got == want and 0 < len(got) < len(docs)
    assert set(docs.columns) - {"text"} <= set(out.columns)


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "token=abcdefghijklmnop here", "en", "s", 27), (None, "a null id with some words in it", "en", "s", 31), (5, "same words here once more and again", "en", "s", 35), (5, "same words here once more and again", "en", "s", 35)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).withColumn("extra", F.lit("e"))
    for _, stage in C.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() == (5 if stage is C.drop_near_duplicates else 6)
    r = C.redact_secrets(spark, docs, SF).filter("doc_id = 3").first()
    assert (r["text"], r["n_chars"]) == ("[REDACTED] here", 15)
    assert [n for n, _ in C.STAGES] and C.tokenize(spark, docs, SF).count() == 6
    assert C.drop_low_quality(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_empty_input(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0


def test_no_operator_hides_import_errors():
    from pathlib import Path

    root = Path(C.__file__).parent
    for p in [root / "corpus_pipeline.py", *(root / "earshot/llm").glob("*.py")]:
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError|Exception)", p.read_text()), p


def test_columns_with_clashing_names_and_very_long_texts(spark):
    rng = __import__("random").Random(1)
    long = " ".join(f"w{rng.randrange(9999)}" for _ in range(60_000))
    item = pd.read_parquet(f"{SF}/benchmark.parquet").text[0]
    rows = [(1, long), (2, long + " end"), (3, f"{long[:90_000]} {item} {long[:90_000][::-1]}"), (4, "token=abcdefghijklmnop " + long[::-1])]
    names = ["n_assign", "n_access", "n_hex", "secret_spans", "score", "predicted", "statistics", "kept", "component_id", "class", "edits", "__key", "__gone", "item_id", "blob", "row"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names}).withColumn("n_chars", F.length("text"))
    kept = {C.drop_near_duplicates: {1, 3, 4}, C.drop_contaminated: {1, 2, 4}, C.redact_secrets: {1, 2, 3, 4}}
    for stage, ids in kept.items():
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = {r["doc_id"]: r for r in out.collect()}
        assert set(found) == ids, stage
        assert all(r[n] == f"{n} of {i}" for i, r in found.items() for n in names)
        assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    low = C.drop_low_quality(spark, docs, SF)
    assert low.columns == docs.columns and all(r[n] == f"{n} of {r['doc_id']}" for r in low.collect() for n in names)
    out = C.tokenize(spark, docs.withColumn("decoded", F.lit("mine")), SF).collect()
    assert len(out) == 4 and all(r["decoded"] == "mine" and r["kept"] == f"kept of {r['doc_id']}" for r in out)


def test_rows_of_one_id_with_different_texts(spark):
    """The row with the smallest hash of its text stays, whatever the order of the rows."""
    rows = [(7, f"text number {k} with words of its own {k * k} {k + 5}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = docs.orderBy(F.xxhash64("text")).first()["text"]
    for parts in (1, 4):
        assert [r["text"] for r in C.drop_near_duplicates(spark, docs.repartition(parts), SF).collect()] == [want]
