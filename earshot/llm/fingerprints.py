"""Fingerprints of documents: a homomorphic hash of the multiset of their paragraphs, in DataFrame functions only.

Each paragraph hashes to a wide vector: lanes of its SHA-256, and for each of 64 lanes how many of its word pairs have
that bit set in their MD5. A document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two. So the order of paragraphs does not matter, a paragraph that comes or goes is added or taken away without a look
at the others, and documents that share paragraphs, or parts of them, have vectors that point the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.manifests import indexed

from .common import stored

#: Lanes of the paragraphs' SHA-256 (for equality), and bits of the word pairs' MD5 (for likeness).
EXACT, BITS = 8, 64
#: Every lane is modulo 2^32; two bits of a pair are counted in one long, 32 places apart.
MASK = (1 << 32) - 1
PAIRED = (1 << 32) + 1
#: A vector: the exact lanes, the counts of bits two by two, and the number of word pairs.
WIDTH = EXACT + BITS // 2 + 1


def _lanes() -> list[Column]:
    """Aggregates over rows (first, exact_0.., pair): the vector of the paragraphs that the rows come from."""
    exact = [F.sum(F.when(F.col("first"), F.col(f"exact_{k}")).otherwise(F.lit(0))) for k in range(EXACT)]
    bits = [F.sum(F.shiftrightunsigned("pair", k).bitwiseAND(F.lit(PAIRED))) for k in range(BITS // 2)]
    return [*exact, *(F.coalesce(b, F.lit(0)) for b in bits), F.count("pair")]


def _wrapped(vector: Column) -> Column:
    """Sums back into their lanes: each half of a long that counts two bits is modulo 2^32 by itself."""
    return F.transform(vector, lambda x, k: F.when((k >= EXACT) & (k < WIDTH - 1), x).otherwise(x.bitwiseAND(F.lit(MASK))))


def vectors(parts: DataFrame, *by: str) -> DataFrame:
    """(by..., vector): the summed vector of all paragraphs in the arrays ``paragraphs`` of the rows that agree in ``by``.

    A paragraph counts as often as it is there; a blank one has exact lanes and no word pairs.
    """
    rows = parts.select(*by, F.explode("paragraphs").alias("paragraph"))
    digest = rows.select(*by, "paragraph", F.sha2("paragraph", 256).alias("digest"), F.split("paragraph", r"[\x20\x09-\x0D]+").alias("words"))
    # Each word with the one after it, the last one by itself.
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    hashed = F.transform(F.filter(pairs, lambda x: x != ""), lambda x: F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("bigint"))
    lanes = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"exact_{k}") for k in range(EXACT)]
    spread = digest.select(*by, *lanes, hashed.alias("pairs")).select(*by, *(f"exact_{k}" for k in range(EXACT)), F.posexplode_outer("pairs").alias("at", "pair"))
    flat = spread.select(*by, *(f"exact_{k}" for k in range(EXACT)), (F.coalesce("at", F.lit(0)) == 0).alias("first"), "pair")
    summed = flat.groupBy(*by).agg(*(lane.alias(f"lane_{k}") for k, lane in enumerate(_lanes())))
    return summed.select(*by, _wrapped(F.array(*(f"lane_{k}" for k in range(WIDTH)))).alias("vector"))


def nothing() -> Column:
    """The vector of no paragraphs."""
    return F.array_repeat(F.lit(0).cast("bigint"), WIDTH)


def _halves(x: Column, y: Column, sign: int) -> Column:
    """Both 32-bit halves of two longs added or subtracted, each modulo 2^32."""
    low = (x.bitwiseAND(F.lit(MASK)) + sign * y.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
    high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(MASK))
    return F.shiftleft(high, 32).bitwiseOR(low)


def inserted(vector: Column, more: Column) -> Column:
    """The vector with the paragraphs of another added."""
    return F.zip_with(vector, more, lambda x, y: _halves(x, y, 1))


def deleted(vector: Column, less: Column) -> Column:
    """The vector with the paragraphs of another taken away."""
    return F.zip_with(vector, less, lambda x, y: _halves(x, y, -1))


def text_of(vector: Column) -> Column:
    """A vector as hexadecimal digits, eight for each lane (sixteen for a pair of lanes)."""
    return F.array_join(F.transform(vector, lambda x, k: F.lower(F.lpad(F.hex(x), F.when((k >= EXACT) & (k < WIDTH - 1), 16).otherwise(8), F.lit("0")))), "")


def _signs(vector: Column) -> Column:
    """For each bit how many more pairs have it than not, as doubles; the counts' lowest 32 bits stand for them."""
    n = F.element_at(vector, WIDTH).cast("double")
    counts = F.slice(vector, EXACT + 1, BITS // 2)
    low = F.transform(counts, lambda x: 2.0 * x.bitwiseAND(F.lit(MASK)) - n)
    return F.concat(low, F.transform(counts, lambda x: 2.0 * F.shiftrightunsigned(x, 32) - n))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the cosine of the counts of word pairs as their bits' surpluses tell it, at least 0; 1 for equal vectors.

    The surpluses' product estimates the counts' product, with an error of about 1 / sqrt(64) of the lengths.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.aggregate(
            F.array(F.struct(_signs(a).alias("a"), _signs(b).alias("b"))),
            F.lit(0.0),
            lambda _, s: F.try_divide(total(F.zip_with(s["a"], s["b"], lambda x, y: x * y)), F.sqrt(total(F.transform(s["a"], lambda x: x * x)) * total(F.transform(s["b"], lambda x: x * x)))),
            lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))),
        )
    )


def paragraphs(text: Column) -> Column:
    """The lines of a text, unchanged; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, among them text) with ``vector`` and ``fingerprint`` (columns of these names are replaced).

    Every row comes back; texts of any length are read whole, a null text counts as empty. Equal texts have equal
    fingerprints, and so have texts whose lines are the same in another order.
    """
    kept = [c for c in docs.columns if c not in ("vector", "fingerprint")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), "text")
    # Of equal texts one is hashed; stored, so that the join can split a text that very many rows share.
    distinct = rows.groupBy("content").agg(F.any_value("text").alias("text")).select("content", paragraphs(F.col("text")).alias("paragraphs"))
    made = stored(vectors(distinct, "content"), "vectors")
    return rows.select("row", "content").join(made, "content").select("row.*", "vector", text_of(F.col("vector")).alias("fingerprint"))


def _neighbours(keys: DataFrame) -> DataFrame:
    """(key, next): for each of ``keys`` (doc_id, key) the one that follows by falling doc_id, nulls last, and by falling key; the first after the last."""
    placed = stored(indexed(keys, ["doc_id", "key"]).select("key", "idx"), "order")
    # Places rise with the id, so the next document is the one place before.
    size = placed.agg(F.count("*").alias("size"))
    before = placed.crossJoin(F.broadcast(size)).select(F.col("key").alias("next"), F.pmod(F.col("idx") + 1, F.col("size")).alias("idx"))
    return stored(placed.join(before, "idx").select("key", "next"), "neighbours")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs`` (doc_id, text, any others).

    A document's edited text has its last third (floor(n_chars / 3) code points) replaced by as many from the start of
    the next document, or all of it. The next document is that of the next smaller doc_id, after the last the first;
    documents that share an id follow by falling SHA-256 of id and text, a null id comes last. Rows that agree in id
    and text are one document, which comes back once for each of them. A single document is its own next one. Null
    texts count as empty, texts of any length are read whole, other columns are not looked at; an empty table gives an
    empty one.

    The edited fingerprint is the sum of what both texts share and of the lines that the edit put in; lines that stay
    are hashed once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")), 256))
    keyed = rows.withColumn("key", key)
    order = _neighbours(keyed.select("doc_id", "key").distinct())
    # Used twice with the same columns, so that the texts cross one shuffle. The filter on copies holds for all rows.
    whole = keyed.groupBy("key").agg(F.any_value(F.struct("doc_id", "text")).alias("doc"), F.count("*").alias("copies")).filter("copies > 0")
    n, text = F.length("doc.text"), F.col("doc.text")
    sized = keyed.select("key", F.floor(F.length("text") / 3).cast("int").alias("third")).groupBy("key").agg(F.min("third").alias("third"))
    asked = order.join(sized, "key").select(F.col("key").alias("by"), F.col("next").alias("key"), "third")
    heads = whole.join(asked, "key").select(F.col("by").alias("key"), F.substring(text, F.lit(1), F.col("third")).alias("head"))
    both = whole.join(heads, "key").select("key", "doc.doc_id", "copies", text.alias("text"), n.cast("bigint").alias("n_chars"), F.concat(F.substring(text, F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head")).alias("edited"), (n - F.floor(n / 3).cast("int")).alias("kept"))
    lines = both.select("key", "doc_id", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("old"), paragraphs(F.col("edited")).alias("new"), F.size(F.split(F.substring("text", F.lit(1), F.col("kept")), "\n", -1)).alias("line"))
    cut = lambda c, frm: F.slice(c, frm, F.greatest(F.size(c), F.lit(1)))
    parts = F.array(
        F.struct(F.lit("both").alias("part"), F.slice("old", F.lit(1), F.col("line") - 1).alias("paragraphs")),
        F.struct(F.lit("old").alias("part"), cut("old", F.col("line")).alias("paragraphs")),
        F.struct(F.lit("new").alias("part"), cut("new", F.col("line")).alias("paragraphs")),
    )
    fixed = ["key", "doc_id", "copies", "n_chars", "edited_sha256"]
    summed = vectors(lines.select(*fixed, F.explode(parts).alias("p")).select(*fixed, "p.part", "p.paragraphs"), *fixed, "part")
    of = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("vector"))), nothing())
    split = summed.groupBy(*fixed).agg(of("both").alias("both"), of("old").alias("old"), of("new").alias("new"))
    made = stored(split.select(*fixed, inserted(F.col("both"), F.col("old")).alias("vector"), inserted(F.col("both"), F.col("new")).alias("edited")), "fingerprints")
    nexts = order.join(made.select(F.col("key").alias("next"), F.col("vector").alias("next_vector")), "next").select("key", "next_vector")
    out = made.join(nexts, "key").select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("vector")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"), "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    """The twin in DuckDB, which hashes all lines of both texts."""
    exact = ", ".join(f"CAST(sum(CASE WHEN nth = 1 THEN ('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT ELSE 0 END) AS BIGINT) & {MASK} AS e{k}" for k in range(EXACT))
    bits = ", ".join(f"CAST(count(*) FILTER ((pair >> {k}) & 1 = 1) AS BIGINT) AS b{k}" for k in range(BITS))
    digits = lambda c: f"lpad(lower(to_hex({c})), 8, '0')"
    words = [*(digits(f"e{k}") for k in range(EXACT)), *(f"{digits(f'b{k + 32}')} || {digits(f'b{k}')}" for k in range(32)), digits("n")]
    signs = ", ".join(f"2 * b{k} - n" for k in range(BITS))
    near = lambda a, b: f"CASE WHEN {a}.print = {b}.print THEN 1.0::DOUBLE ELSE coalesce(greatest(0, least(1, list_dot_product({a}.s, {b}.s) / nullif(sqrt(list_dot_product({a}.s, {a}.s) * list_dot_product({b}.s, {b}.s)), 0))), 0) END"
    return rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS i, count(*) OVER () AS size, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT d.i, CASE WHEN d.i = d.size THEN 1 ELSE d.i + 1 END AS nxt, d.doc_id, length(d.text) AS n_chars, d.text,
        substring(d.text, 1, length(d.text) - length(d.text) // 3) || substring(e.text, 1, length(d.text) // 3) AS edited FROM d JOIN d e ON e.i = CASE WHEN d.i = d.size THEN 1 ELSE d.i + 1 END),
l AS (SELECT i, 0 AS kind, unnest(string_split(text, chr(10))) AS line FROM x UNION ALL SELECT i, 1, unnest(string_split(edited, chr(10))) FROM x),
w AS (SELECT i, kind, sha256(line) AS digest, string_split_regex(line, '[\x20\x09-\x0D]+') AS w FROM l),
g AS (SELECT i, kind, digest, list_filter([CASE WHEN k < len(w) THEN w[k] || ' ' || w[k + 1] ELSE w[k] END FOR k IN range(1, len(w) + 1)], lambda p: p <> '') AS pairs FROM w),
q AS (SELECT i, kind, digest, unnest(range(1, greatest(len(pairs), 1) + 1)) AS nth, pairs FROM g),
h AS (SELECT i, kind, digest, nth, CASE WHEN nth <= len(pairs) THEN ('0x' || substr(md5(pairs[nth]), 1, 16))::UBIGINT END AS pair FROM q),
s AS (SELECT i, kind, {exact}, {bits}, CAST(count(pair) AS BIGINT) AS n FROM h GROUP BY i, kind),
f AS (SELECT i, kind, {" || ".join(words)} AS print, CAST([{signs}] AS DOUBLE[]) AS s FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next
FROM x JOIN f a ON a.i = x.i AND a.kind = 0 JOIN f b ON b.i = x.i AND b.kind = 1 JOIN f c ON c.i = x.nxt AND c.kind = 0
"""


OP11_SQL = _sql()
