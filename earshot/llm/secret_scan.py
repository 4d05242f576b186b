"""Secret scan over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A blob that the ledger already holds for
the rules' version is not scanned again; what is new is scanned once however many paths share it, its findings
join the ledger, and the ledger is joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters at least; it must end the match."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order that breaks ties.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULES_VERSION = "base-1"
LEDGER = "blob binary, rules string, kind string, kind_order int, start bigint, end bigint"


def content_address(text):
    """The blob's name: binary SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...], version: str) -> DataFrame:
    """Ledger rows of (blob, text) rows: one for each finding, and one with a null kind that says that the blob was scanned."""

    def pieces(order: int, rule: Rule):
        # Between the matches lie the pieces of a split; lengths of both add up to the matches' places.
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        gaps = F.transform(F.slice(F.split("text", rule.pattern, -1), 1, F.size(hits)), F.length)
        lengths = F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("hit"))
        tails = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length)
        rows = F.zip_with(
            lengths, tails, lambda x, tail: F.struct(F.lit(rule.kind).alias("kind"), F.lit(order).alias("kind_order"), x["gap"].alias("gap"), x["hit"].alias("hit"), (tail >= rule.least).alias("good"))
        )
        return F.when(F.col("text").rlike(rule.pattern), rows).otherwise(F.array().cast(FOUND))

    scanned = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(-1).alias("kind_order"), F.lit(0).alias("gap"), F.lit(0).alias("hit"), F.lit(True).alias("good"))).cast(FOUND)
    found = blobs.select("blob", F.posexplode(F.concat(scanned, *(pieces(i, r) for i, r in enumerate(rules)))).alias("at", "found")).select("blob", "at", "found.*")
    so_far = "sum(gap + hit) OVER (PARTITION BY blob, kind_order ORDER BY at)"
    placed = found.select("blob", F.lit(version).alias("rules"), "kind", "kind_order", F.expr(f"{so_far} - hit").alias("start"), F.expr(so_far).alias("end"), "good")
    return placed.filter("good").drop("good")


FOUND = "array<struct<kind:string,kind_order:int,gap:int,hit:int,good:boolean>>"


def scan_versions(versions: DataFrame, ledger_path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with ``versions`` and return its rows for ``rules_version``.

    ``versions`` has a row for each version of a path; only its column ``text`` matters here. The ledger is a
    Parquet folder that only grows, by one write per call: a failed call leaves it as it was. Null and empty
    texts are the same blob. Positions count code points, ends are exclusive.
    """
    spark = versions.sparkSession
    blobs = versions.select(content_address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = _ledger(spark, ledger_path)
    # Copies meet in the map tasks first, so a blob with very many paths crosses the shuffle once per task.
    unseen = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if known is not None:
        unseen = unseen.join(known.filter(F.col("rules") == rules_version).select("blob").distinct(), "blob", "left_anti")
    _scan(unseen, rules, rules_version).write.mode("append").parquet(ledger_path)
    return _ledger(spark, ledger_path).filter(F.col("rules") == rules_version)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings: a count for each kind and ``spans``, an array of (start, kind_order, kind, end) in order."""
    # As a set: two writers may have scanned one blob at the same time.
    found = ledger.filter("kind IS NOT NULL").groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "kind_order", "kind", "end"))).alias("spans"))

    def of(kind: str):
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter("spans", of(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    return found.select("blob", *counts, "spans")


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """``docs`` (any columns, among them text) with n_assign, n_access, n_hex and the array ``secret_spans``.

    Every input row comes back once, repeated rows too; a null text has no findings, a text of any length is scanned
    whole. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    ledger = scan_versions(docs, ledger_path or f"{shared_folder(spark)}/ledger")
    added = [f"n_{r.kind}" for r in RULES] + ["secret_spans"]
    kept = [c for c in docs.columns if c not in added]
    any_rule = F.lit(False)
    for r in RULES:
        any_rule = any_rule | F.coalesce(F.col("text").rlike(r.pattern), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("text"))
    # A text that no pattern matches has no findings: only the others meet the ledger, and few texts cross the shuffle.
    paths = rows.filter(any_rule).select("row", content_address(F.col("text")).alias("blob"))
    joined = paths.join(stored(findings_by_blob(ledger), "by_blob"), "blob", "left")
    none = F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>")
    hit = joined.select("row.*", *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in RULES), F.coalesce("spans", none).alias("secret_spans"))
    clean = rows.filter(~any_rule).select("row.*", *(F.lit(0).cast("bigint").alias(f"n_{r.kind}") for r in RULES), none.alias("secret_spans"))
    return hit.unionByName(clean)


def spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """Replace every span in ``secret_spans`` by ``mark``; overlapping spans become one mark."""
    # The spans are in order: each step keeps the text up to the next span that starts at or after the last end.
    step = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= acc["upto"], F.concat(acc["parts"], F.array(F.substring(F.col("text"), (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int"))))).otherwise(acc["parts"]).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(F.transform(acc["parts"], lambda p: F.concat(p, F.lit(mark))), ""), F.substring(F.col("text"), (acc["upto"] + 1).cast("int"), F.length("text"))),
    )
    return docs.withColumn("text", F.when(F.size("secret_spans") > 0, step).otherwise(F.col("text")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table over a ledger that it reaches in two deliveries: the source whose name comes first, then all rows.

    The second scan sees only blobs that the first has not scanned; a copy in another source is not scanned again.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    path = f"{shared_folder(spark)}/ledger"
    earliest = docs.agg(F.min("source")).first()[0]
    scan_versions(docs.filter(F.col("source") == F.lit(earliest)), path)
    ledger = scan_versions(docs, path)
    # Stored, so that the join can split a blob that very many paths share.
    found = stored(findings_by_blob(ledger).withColumn("spans", spans_text(F.col("spans"))), "by_blob")
    paths = docs.select("doc_id", content_address(F.col("text")).alias("blob"))
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in RULES]
    spans = F.coalesce("spans", F.lit(""))
    return paths.join(found, "blob", "left").select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), F.lower(F.hex("blob")).alias("blob_sha256"))


#: DuckDB: matches and the pieces between them give the places, as above.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k(kind, kind_order, pattern, grp, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
  ('hex', 2, '[0-9a-f]{16,}', 0, 16)),
a AS (SELECT rid, 'assign' AS kind, 0 AS kind_order, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS tails,
        string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
      UNION ALL SELECT rid, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT rid, 'hex', 2, regexp_extract_all(text, '[0-9a-f]{16,}', 0), regexp_extract_all(text, '[0-9a-f]{16,}', 0), string_split_regex(text, '[0-9a-f]{16,}') FROM d),
e AS (SELECT rid, kind, kind_order, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(tails) AS tail, unnest(gaps[:len(hits)]) AS gap FROM a WHERE len(hits) > 0),
p AS (SELECT rid, kind, kind_order, tail, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind_order ORDER BY i) AS stop FROM e),
f AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - n, kind_order) AS spans
      FROM p JOIN k USING (kind, kind_order) WHERE length(tail) >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob_sha256
FROM d LEFT JOIN f USING (rid)
"""
