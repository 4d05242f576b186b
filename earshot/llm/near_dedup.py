"""MinHash near-dedup of documents with compressed registers (HyperMinHash).

One hash per word shingle: its top bits choose a bucket, and of the smallest rest in the bucket a register keeps the
count of leading zeros and some bits of mantissa. Bands of registers make candidates, the share of equal registers,
corrected for chance collisions, estimates the similarity, and full shingle sets decide.

Work follows the number of different documents, not of pairs. Documents with one shingle set are one class. Each class
is first compared with one other, the smallest member of most of its bands; the links make parts. Only bands that
still hold several parts go on: they connect parts to groups, and in a group the classes outside the main part are
compared with the others in tiles of bounded size, which report one link for two parts and never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces, rolling, stored, word_bounds, word_hashes
from .components import components

SHINGLE = 5
#: Similarity that links, as a fraction of whole numbers.
LEAST = (75, 100)
#: 2^8 registers of 6 bits of leading zeros and 10 of mantissa. 48 bands of 5: at a similarity of 0.75, (1 - 0.75^5)^48 = 2e-6 is missed.
BUCKET_BITS, MANTISSA_BITS = 8, 10
BANDS, ROWS = 48, 5
#: Bytes of registers and sets in a block; a tile holds two blocks (one class at least).
BLOCK = 1_000_000
#: Standard deviations by which an estimate may fall short before a pair is dismissed without its sets: for a link, a chance below 1e-9.
SLACK = 6.0
#: Sets that are compared with one at a time, the likeliest first.
AT_ONCE = 32
#: Bytes of text that a task works on at a time.
CHUNK = 2_000_000

_REGISTERS = 1 << BUCKET_BITS
_PROBES = 16


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case; a shorter text is one shingle; none without words."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    low, high = word_bounds(data)
    if not len(low):
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(data, low, high), min(width, len(low))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; 0 stands for an empty bucket."""
    least = np.zeros((len(sets), _REGISTERS), np.uint64)
    edges = np.arange(_REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    for row, s in zip(least, sets):
        at = np.searchsorted(s, edges)
        inside = at < len(s)
        value = s[at[inside]]
        own = value >> np.uint64(64 - BUCKET_BITS) == np.flatnonzero(inside).astype(np.uint64)
        row[np.flatnonzero(inside)[own]] = (value[own] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return np.where(least > 0, ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa, np.uint64(0)).astype(np.uint16)


_PROBE = (mix(np.arange(1, _REGISTERS * _PROBES + 1, dtype=np.uint64)) % np.uint64(_REGISTERS)).astype(np.int64).reshape(_PROBES, _REGISTERS)
_SALT = mix(np.arange(1, _REGISTERS + 1, dtype=np.uint64) << np.uint64(20))


def filled(found: np.ndarray) -> np.ndarray:
    """Registers with empty ones filled, so that short texts can share bands: each takes a full one that its own fixed order of probes meets first, else the full one that a hash of its own makes smallest."""
    out = found.copy()
    full = found > 0
    for probe in _PROBE:
        take = (out == 0) & full[:, probe]
        out[take] = found[:, probe][take]
    for i in np.flatnonzero((out == 0).any(1) & full.any(1)):
        empty = np.flatnonzero(out[i] == 0)
        values = found[i][full[i]].astype(np.uint64)
        out[i, empty] = values[np.argmin(mix(values[None, :] ^ _SALT[empty, None]), 1)]
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    rows = filled(found)[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(found), 0)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys


#: Chance that registers of different hashes agree: leading zeros z with 4^-z, times the mantissa.
CHANCE = sum(4.0**-z for z in range(1, 30)) / (1 << MANTISSA_BITS)


def estimates(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of a row of registers to others, corrected for chance collisions, and the estimates' standard deviations at the threshold."""
    either = ((one > 0) | (many > 0)).sum(1)
    equal = ((one == many) & (one > 0)).sum(1)
    share = equal / np.maximum(either, 1)
    least = LEAST[0] / LEAST[1]
    return (share - CHANCE) / (1 - CHANCE), np.sqrt(least * (1 - least) / np.maximum(either, 1))


def links_among(part: list[int], asks: list[bool], found: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of parts, of the links between rows that ask and all other rows of a tile; rows of one part count as joined already."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, word, often = np.unique(flat, return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(word, kind="stable")]
    place, begin = np.cumsum(often) - often, np.cumsum(sizes) - sizes
    label = np.unique(part, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(asks).tolist():
        # A link leaves at most n - least shingles unshared, so of any n - least + 1 (the rarest) one is shared.
        own = word[begin[i] : begin[i] + sizes[i]]
        few = int(sizes[i]) + int(sizes[i]) * -LEAST[0] // LEAST[1] + 1
        if few < len(own):
            own = own[np.argpartition(often[own], few - 1)[:few]]
        own = own[often[own] > 1]
        length = often[own]
        other = np.unique(holders[np.repeat(place[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())])
        small, large = np.minimum(sizes[i], sizes[other]), np.maximum(sizes[i], sizes[other])
        other = other[(label[other] != label[i]) & (small * LEAST[1] >= large * LEAST[0])]
        near, spread = estimates(found[i], found[other])
        likely = near >= LEAST[0] / LEAST[1] - SLACK * spread
        other = other[likely][np.argsort(-near[likely], kind="stable")]
        while len(other):
            some, other = other[:AT_ONCE], other[AT_ONCE:]
            theirs = np.concatenate([sets[j] for j in some])
            at = np.searchsorted(sets[i], theirs)
            hit = np.zeros(len(theirs) + 1, np.int64)
            np.cumsum(sets[i][np.minimum(at, len(sets[i]) - 1)] == theirs, out=hit[1:])
            ends = np.cumsum(sizes[some])
            both = hit[ends] - hit[ends - sizes[some]]
            for j in some[both * LEAST[1] >= (sizes[i] + sizes[some] - both) * LEAST[0]].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((part[i], part[j]))
            other = other[label[other] != label[i]]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, high, low, bands): size, 128-bit fingerprint of the shingle set and its band keys, from (doc_id, text)."""

    def work(batches):
        for batch in pieces(batches, "text", CHUNK):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            with np.errstate(over="ignore"):
                high = np.array([np.add.reduce(mix(s)) for s in sets], np.uint64).view(np.int64)
                low = np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets], np.uint64).view(np.int64)
            keys = band_keys(registers(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(low), pa.FixedSizeListArray.from_arrays(keys.reshape(-1), BANDS).cast(pa.list_(pa.int64()))],
                ["doc_id", "n", "high", "low", "bands"],
            )

    return docs.mapInArrow(work, "doc_id bigint, n bigint, high bigint, low bigint, bands array<bigint>")


def _compared(tiles: DataFrame) -> DataFrame:
    """Links (a, b) between parts from rows (grp, i, j, part, asks, found, hashes); rows with equal (grp, i, j) meet in one tile."""

    def work(batches):
        tile, rows = None, []

        def settle():
            part, asks, found, sets = zip(*rows)
            found = np.frombuffer(b"".join(found), np.uint16).reshape(len(rows), -1)
            pairs = links_among(list(part), list(asks), found, [np.frombuffer(s, np.uint64) for s in sets])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], ["a", "b"])

        for batch in pieces(batches, "hashes", CHUNK):
            for g, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (g, i, j) != tile and rows:
                    yield settle()
                    rows = []
                tile = (g, i, j)
                rows.append(row)
        if rows:
            yield settle()

    rows = tiles.select("grp", "i", "j", "part", "asks", "found", "hashes").repartition("grp", "i", "j")
    return rows.sortWithinPartitions("grp", "i", "j").mapInArrow(work, "a bigint, b bigint")


def _payloads(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, found, hashes) of the ``members`` (id): size, registers and sorted shingle hashes of their texts."""

    def work(batches):
        for batch in pieces(batches, "text", CHUNK):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            found = registers(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in found], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "found", "hashes"])

    chosen = texts.select(F.col("doc_id").alias("id"), "text").join(members, "id", "left_semi")
    return chosen.mapInArrow(work, "id bigint, n bigint, found binary, hashes binary").filter("n > 0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any others).

    Rows that share an id are one node of the graph. A row without words has an empty set and is its own component.
    A null id links with nothing: its component is null, and it is kept. Texts of any length are compared whole, other
    columns, whatever their names, are not looked at. An empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(sketches(texts), "sketches")
    usable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "high", "low"]
    classes = stored(usable.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "classes")
    placed = stored(usable.join(classes, same, "left").select("doc_id", F.coalesce("first", "doc_id").alias("class"), "bands"), "placed")
    found = _components_of_classes(texts, placed.filter("doc_id = class"))
    ids = placed.select("doc_id", "class").distinct()
    # An id with several texts joins their classes.
    whole = ids.filter("doc_id <> class").select(F.col("doc_id").alias("id"), F.col("class").alias("parent"))
    by_class = ids.join(found.select(F.col("id").alias("class"), "component"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("component"))
    by_id = stored(by_class.groupBy("doc_id").agg(F.min("component").alias("component"), F.count_distinct("component").alias("several")), "by_id")
    if not by_id.filter("several > 1").isEmpty():
        joined = components(by_class.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))).unionByName(whole.select(F.col("id").alias("a"), F.col("parent").alias("b"))))
        by_id = stored(by_id.select("doc_id").join(joined, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "by_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("doc_id")).alias("key"))
    joined = out.join(by_id.select(F.col("doc_id").alias("key"), "component"), "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of_classes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the classes (class, bands) that share a band with another one."""
    keyed = classes.select(F.col("class").alias("id"), F.explode("bands").alias("band"))
    # Bands with one member go; the rest is stored, so that the join below can split a band that very many share.
    hubs = stored(keyed.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").drop("last"), "hubs")
    shared = stored(keyed.join(hubs, "band"), "shared")
    payloads = stored(_payloads(texts, shared.select("id").distinct()), "payloads")
    parts = _first_parts(shared, payloads)
    groups = _open_groups(shared, parts)
    found = components(stored(_compared(_tiles(payloads, parts, groups)), "more"))
    return parts.join(found.select(F.col("id").alias("part"), "component"), "part", "left").select("id", F.coalesce("component", "part").alias("component"))


def _blocks(weight):
    return F.greatest(F.ceil(weight / BLOCK), F.lit(1)).cast("int")


def _weight():
    """Bytes of a row of payloads."""
    return F.octet_length("hashes") + F.octet_length("found")


def _first_parts(shared: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, part) after each class has been compared with the one hub that it shares most bands with."""
    votes = shared.filter("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    stars = stored(votes.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("grp")), "stars")
    members = stored(payloads.join(stars, "id"), "starred")
    sizes = stored(members.groupBy("grp").agg(_blocks(F.sum(_weight())).alias("blocks")), "star_sizes")
    # A large star is cut in blocks, and its hub meets each of them.
    around = members.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("i"), F.col("id").alias("part"), F.lit(False).alias("asks"), "found", "hashes")
    hubs = payloads.join(sizes, F.col("id") == F.col("grp")).select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("id").alias("part"), F.lit(True).alias("asks"), "found", "hashes")
    found = components(stored(_compared(around.unionByName(hubs).withColumn("j", F.lit(0))), "links"))
    return stored(shared.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("part")), "parts")


def _open_groups(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, grp): the parts that meet another part in some band, in groups that are connected by such bands."""
    labelled = shared.join(parts, "id").select("band", "part").distinct()
    ends = stored(labelled.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").drop("high"), "open")
    meetings = labelled.join(ends, "band").filter("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b")).distinct()
    return components(meetings).select(F.col("id").alias("part"), F.col("component").alias("grp"))


def _tiles(payloads: DataFrame, parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows for ``_compared``: in each group, every class outside the group's main part asks all classes of the group.

    A group of up to BLOCK bytes is one tile. In a larger one, classes go first that cannot link with anything: those
    of whose shingles too many occur nowhere else in the group.
    """
    open_parts = stored(parts.join(groups, "part"), "open_parts")
    loaded = stored(payloads.join(open_parts, "id"), "loaded")
    first = loaded.groupBy("grp", "part").agg(F.sum(_weight()).alias("weight"))
    sized = stored(first.groupBy("grp").agg(F.max_by("part", F.struct("weight", -F.col("part"))).alias("main"), F.sum("weight").alias("weight")), "groups")
    asks = F.col("part") != F.col("main")
    row = ["grp", "part", "found", "hashes"]
    small = loaded.join(sized.filter(F.col("weight") <= BLOCK).select("grp", "main"), "grp").select(*row, asks.alias("asks"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    crowded = sized.filter(F.col("weight") > BLOCK).select("grp", "main")
    if crowded.isEmpty():
        return small
    large = stored(loaded.join(crowded, "grp").withColumn("row", F.monotonically_increasing_id()), "large")
    alone = _shingle_rows(large).groupBy("grp", "shingle").agg(F.count("*").alias("n"), F.min("row").alias("row")).filter("n = 1").groupBy("row").agg(F.count("*").alias("alone"))
    able = F.coalesce("alone", F.lit(0)) * LEAST[1] <= F.col("n") * (LEAST[1] - LEAST[0])
    left = stored(large.join(alone, "row", "left").filter(able).select("id", *row, "main"), "able")
    weights = stored(left.groupBy("grp").agg(_blocks(F.sum(_weight())).alias("all"), _blocks(F.sum(F.when(asks, _weight()).otherwise(0))).alias("outside")), "weights")
    placed = left.join(weights, "grp").withColumns({"i": F.pmod(F.xxhash64("id", F.lit(1)), F.col("outside")).cast("int"), "j": F.pmod(F.xxhash64("id"), F.col("all")).cast("int")})
    asking = placed.filter(asks).select(*row, F.lit(True).alias("asks"), "i", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    asked = placed.select(*row, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("i"), "j")
    return small.unionByName(asking).unionByName(asked)


def _shingle_rows(loaded: DataFrame) -> DataFrame:
    """(grp, row, shingle), a row for each shingle."""

    def work(batches):
        for batch in pieces(batches, "hashes", CHUNK):
            sets = [np.frombuffer(h, np.int64) for h in batch.column("hashes").to_pylist()]
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(np.concatenate(sets))], ["grp", "row", "shingle"])

    return loaded.select("grp", "row", "hashes").mapInArrow(work, "grp bigint, row bigint, shingle bigint")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS sh FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
