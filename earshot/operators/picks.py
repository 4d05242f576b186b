"""Which row goes with which: enrollment clips, interferers, noises, room responses, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.draws import distinct, ticket, uniform, whole
from earshot.functions.waves import let
from earshot.operators.manifests import indexed, numbered
from earshot.sources.store import stored


#: Utterances of a speaker that one row holds; those of a larger speaker are fetched one by one.
HELD = 1024


def enrolled(targets: DataFrame, utts: DataFrame, n: int = 5, seed: int = 0, held: int = HELD) -> DataFrame:
    """``targets`` (key, utt, spk, ...) with ``enroll``, up to ``n`` other rows of ``utts`` (uttid, spk, ...) of the target's speaker as structs, in the order drawn, and ``known``, whether the utterance is among them itself.

    Each speaker's utterances are numbered; a target draws different numbers, its own left out. Targets go once to the
    row of their speaker, which holds up to ``held`` utterances; those of larger speakers fetch only what they have drawn,
    by number. Of rows with equal ids the smallest counts. Both joins are merges: the pool's files are far smaller than
    its rows, so that by size it would be broadcast.
    """
    more = [c for c in utts.columns if c not in ("uttid", "spk")]
    named = utts.select(F.col("spk").cast("string").alias("spk"), F.col("uttid").cast("string").alias("uttid"), *more)
    named = named.groupBy("spk", "uttid").agg(F.min(F.struct(*more)).alias("__more")).select("spk", "uttid", "__more.*") if more else named.distinct()
    pool = stored(numbered(named, "spk", "uttid"), "pool")
    clip = F.struct("uttid", *more)
    asking = targets.withColumns({"spk": F.col("spk").cast("string"), "utt": F.col("utt").cast("string")})
    columns = asking.columns

    def draws(own: Column, size: Column) -> Column:
        """(nth, number) in the pool for each draw."""
        others = F.coalesce(size, F.lit(0)) - own.isNotNull().cast("int")
        past = lambda d: F.when(own.isNotNull() & (d["number"] >= own), 1).otherwise(0)
        return F.transform(distinct(F.col("key"), "enroll", others, n, seed), lambda d: F.struct(d["nth"].alias("nth"), (d["number"] + past(d)).alias("number")))

    small = pool.filter(F.col("size") <= held).groupBy("spk").agg(F.sort_array(F.collect_list(F.struct("number", clip.alias("clip")))).alias("__held"))
    small = small.select("spk", F.transform("__held", lambda c: c["clip"]).alias("__held"), F.size("__held").cast("bigint").alias("__size"))

    def whole_pools(rows: DataFrame) -> DataFrame:
        met = rows.join(small.hint("merge"), "spk", "left")
        place = F.array_position(F.transform("__held", lambda c: c["uttid"]), F.col("utt"))
        met = met.withColumn("__own", F.when(place > 0, place - 1))
        picked = F.transform(draws(F.col("__own"), F.col("__size")), lambda d: F.get(F.col("__held"), d["number"].cast("int")))
        return met.select(*columns, picked.alias("enroll"), F.col("__own").isNotNull().alias("known"))

    large = stored(pool.filter((F.col("number") == 0) & (F.col("size") > held)).select("spk", "size"), "large")
    if large.isEmpty():
        return whole_pools(asking)
    own = pool.select("spk", F.col("uttid").alias("utt"), F.col("number").alias("__own"))
    rows = asking.join(large, "spk").join(own.hint("merge"), ["spk", "utt"], "left").select(F.struct(*columns).alias("__row"), "key", "spk", "__own", "size")
    # Targets may be equal to each other: each keeps its own number, so that none loses or gains clips.
    rows = stored(rows.withColumn("__id", F.monotonically_increasing_id()), "asking")
    drawn = rows.select("__id", "spk", F.explode(draws(F.col("__own"), F.col("size"))).alias("d")).select("__id", "spk", "d.nth", "d.number")
    fetched = drawn.join(pool.select("spk", "number", clip.alias("clip")).hint("merge"), ["spk", "number"]).groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("nth", "clip"))).alias("__d"))
    many = rows.join(fetched, "__id", "left").select("__row.*", F.transform(F.coalesce("__d", F.array()), lambda x: x["clip"]).alias("enroll"), F.col("__own").isNotNull().alias("known"))
    return whole_pools(asking.join(large.select("spk"), "spk", "left_anti")).unionByName(many)


def enrollments(targets: DataFrame, utts: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """(key, spk, enroll, short_pool): ``n`` other utterances of the target's speaker, in the order drawn, see ``enrolled``.

    ``targets`` has (key, utt, spk), ``utts`` (uttid, spk). A speaker with fewer than ``n`` others gives what there is,
    flagged; equal targets give one row.
    """
    # Dealt by speaker, as the join asks, so that equal ones meet without a shuffle of their own.
    rows = enrolled(targets.select("key", "utt", "spk").repartition("spk").distinct(), utts.select("uttid", "spk"), n, seed)
    return rows.select("key", "spk", F.transform("enroll", lambda c: c["uttid"]).alias("enroll")).withColumn("short_pool", F.size("enroll") < n)


def by_length(pools: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """One clip for each key of (key, pos, utt, seconds): the "longest" or "shortest" by hundredths of a second, the first on ties; or one "any" by its ticket."""
    seconds = F.round("seconds", 2)
    if mode == "longest":
        order = F.struct(seconds.alias("s"), (-F.col("pos")).alias("p"))
    elif mode == "shortest":
        order = F.struct((-seconds).alias("s"), (-F.col("pos")).alias("p"))
    elif mode == "any":
        order = F.struct(ticket(F.concat_ws("/", "key", "utt"), "pick", seed).alias("s"), F.col("utt").cast("string").alias("p"))
    else:
        raise ValueError(f"no such mode: {mode}")
    return pools.groupBy("key").agg(F.max_by(F.struct("utt", "seconds"), order).alias("x")).select("key", "x.utt", "x.seconds")


def joined_clips(clips: DataFrame, least: float | None = None) -> DataFrame:
    """(key, utts, seconds): clips (key, pos, utt, seconds) one after another; with ``least``, only as many from the start as it takes to exceed it."""
    if least is not None:
        # A clip stays while what comes before it is not yet longer than the least.
        earlier = Window.partitionBy("key").orderBy("pos", "utt").rowsBetween(Window.unboundedPreceding, -1)
        clips = clips.withColumn("__before", F.sum("seconds").over(earlier)).filter("__before IS NULL OR __before <= " + repr(float(least)))
    own = F.sort_array(F.collect_list(F.struct("pos", "utt", "seconds")))
    rows = clips.groupBy("key").agg(own.alias("c"))
    return rows.select("key", F.transform("c", lambda x: x["utt"]).alias("utts"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x["seconds"]).alias("seconds"))


def drawn_until(clips: DataFrame, least: float, seed: int = 0) -> DataFrame:
    """Rows of (key, pos, utt, seconds) with ``nth``: each key's clips in a drawn order, one at least, and more while they are shorter than ``least`` together."""
    order = Window.partitionBy("key").orderBy(ticket(F.concat_ws("/", "key", "utt"), "enroll.order", seed).desc(), "utt")
    before = F.coalesce(F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    nth = F.row_number().over(order) - 1
    return clips.withColumns({"nth": nth, "__before": before}).filter((F.col("nth") == 0) | (F.col("__before") < least)).drop("__before")


def assigned(rows: DataFrame, pool: DataFrame, salt: str, key: str = "key", seed: int = 0) -> DataFrame:
    """``rows`` joined with one row of ``pool`` (idx from 0 on, ...) each, drawn uniformly. Draw first, fetch after: the join is on the drawn number."""
    size = pool.agg(F.count("*").alias("__size"))
    drawn = rows.crossJoin(F.broadcast(size)).withColumn("idx", whole(F.col(key), salt, F.col("__size"), seed)).drop("__size")
    return drawn.join(pool, "idx", "left")


def channel(key: Column, channels: Column, seed: int = 0) -> Column:
    """The channel of a room response, null for a response of one channel."""
    return F.when(channels > 1, whole(key, "channel", channels, seed))


def interferers(rows: DataFrame, tries: int = 8, seed: int = 0, beyond: bool = True) -> DataFrame:
    """``rows`` (key, idx, spk, all_spks) with another row whose speaker is none of the mixture's: other_idx, other_spk, use_mixture.

    Each row draws ``tries`` row numbers and takes the first that is allowed. The rare row for which none is draws among
    the numbers of all speakers but its mixture's, and takes that speaker's first row; where every speaker is in the
    mixture, the columns are null. Without ``beyond`` they are null after the last draw.
    """
    size = F.broadcast(rows.agg(F.count("*").alias("__size")))
    own = rows.select(F.col("idx").alias("other_idx"), F.col("spk").alias("other_spk"))

    def allowed(asking: DataFrame, low: int, high: int) -> DataFrame:
        """(key, other_idx, other_spk) by the first of the draws from ``low`` to ``high`` - 1 that is allowed."""
        probes = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: F.struct(i.alias("nth"), F.floor((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.concat(F.lit("other."), i.cast("string")), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0) * F.col("__size")).alias("other_idx")))
        asked = asking.crossJoin(size).select("key", "all_spks", F.explode(probes).alias("p")).select("key", "all_spks", "p.nth", "p.other_idx")
        met = asked.join(own, "other_idx").filter(~F.array_contains(F.split("all_spks", "-"), F.col("other_spk").cast("string")))
        return stored(met.groupBy("key").agg(F.min_by(F.struct("other_idx", "other_spk"), "nth").alias("o")).select("key", "o.*"), "allowed")

    # Most rows find theirs in the first draws; only those that do not draw again.
    chosen, asking, low = None, rows.select("key", "all_spks"), 0
    for high in sorted({min(2, tries), tries}):
        first = allowed(asking, low, high)
        chosen = first if chosen is None else chosen.unionByName(first)
        asking, low = stored(asking.join(first, "key", "left_anti"), "asking"), high
        if asking.isEmpty():
            break
    else:
        if beyond:
            chosen = chosen.unionByName(_by_speaker(rows, asking, seed))
    return rows.join(chosen, "key", "left").withColumn("use_mixture", F.when(F.col("other_idx").isNotNull(), uniform(F.col("key"), "use_mixture", seed) < 0.5))


def _by_speaker(rows: DataFrame, rest: DataFrame, seed: int) -> DataFrame:
    """(key, other_idx, other_spk) for ``rest`` (key, all_spks): a speaker's number is drawn from the numbers that are left when the mixture's are taken out."""
    names = rows.groupBy(F.col("spk").cast("string").alias("s")).agg(F.min("idx").alias("other_idx"), F.min("spk").alias("other_spk"))
    known = stored(indexed(names, "s", "n"), "speakers")
    size = known.agg(F.count("*").alias("size"))
    listed = rest.select("key", F.explode(F.array_distinct(F.split("all_spks", "-"))).alias("s")).join(known.select("s", "n"), "s", "left")
    taken = listed.groupBy("key").agg(F.sort_array(F.collect_list("n")).alias("taken")).crossJoin(F.broadcast(size))
    left = F.col("size") - F.size("taken")
    drawn = taken.filter(left > 0).select("key", F.aggregate("taken", whole(F.col("key"), "other", left, seed), lambda at, t: F.when(at >= t, at + 1).otherwise(at)).alias("n"))
    return drawn.join(known, "n").select("key", "other_idx", "other_spk")


def cases(rows: DataFrame, single: float, inactive: float, seed: int = 0) -> DataFrame:
    """``rows`` (key, ...) with their case: "inactive" (an interferer takes the mixture's place), "single" (the clean reference does) or "mixture"."""
    return rows.withColumn("case", F.when(uniform(F.col("key"), "inactive", seed) < inactive, "inactive").when(uniform(F.col("key"), "single", seed) < single, "single").otherwise("mixture"))


def shuffled(rows: DataFrame, size: int, key: str = "key", epoch: int = 0, seed: int = 0) -> DataFrame:
    """``rows`` with batch and pos: a shuffle by tickets, new in each epoch, cut into batches."""
    mixed = indexed(rows.withColumn("__ticket", ticket(F.col(key), f"shuffle.{epoch}", seed)), ["__ticket", key], "__idx")
    return mixed.select(*rows.columns, F.floor(F.col("__idx") / size).alias("batch"), (F.col("__idx") % size).alias("pos"))


#: Rounds of the permutation, and how often at most a number is sent round again.
ROUNDS, AGAIN = 6, 64


def permuted(index: Column, n: Column | int, epoch: int = 0, seed: int = 0, back: bool = False) -> Column:
    """The place in [0, n) of each index in [0, n) in a drawn order, or (``back``) the index at each place: by arithmetic alone, without a sort.

    A keyed Feistel permutation of pairs (left below a, right below b) with a * b at or just above n; an index that
    lands at n or above goes round again. Less than a numbers are at n or above, one in the root of n at most, so that
    64 more rounds always do up to n = 4096 and beyond it fail with a chance below 1e-100.
    """
    n = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")

    def drawn(r: Column, half: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(f"feistel.{epoch}"), r.cast("string"), half.cast("string"))), 1, 8), 16, 10).cast("bigint")

    def once(x: Column, a: Column, b: Column) -> Column:
        def turn(s: Column, r: Column) -> Column:
            left, right = F.floor(s / b).cast("bigint"), s % b
            by = (lambda half: -drawn(r, half)) if back else (lambda half: drawn(r, half))
            return F.when(r % 2 == 0, F.pmod(left + by(right), a) * b + right).otherwise(left * b + F.pmod(right + by(left), b))

        rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        return F.aggregate(F.array(*map(F.lit, rounds)), x, turn)

    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")

    def walk(v: Column) -> Column:
        least = F.least(v["a"] * v["b"] - v["n"], F.lit(AGAIN))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), least), once(v["x"], v["a"], v["b"]), lambda s, _: F.when(s < v["n"], s).otherwise(once(s, v["a"], v["b"])))

    sides = F.struct(index.cast("bigint").alias("x"), n.alias("n"), a.alias("a"), F.greatest(F.ceil(n / a).cast("bigint"), F.lit(1)).alias("b"))
    return let(sides, walk)


def permuted_batches(rows: DataFrame, size: int, n: Column | int, index: str = "idx", epoch: int = 0, seed: int = 0) -> DataFrame:
    """``rows`` with batch and pos in a drawn order of their ``index`` in [0, n), new in each epoch; rows stay where they are."""
    placed = rows.withColumn("__place", permuted(F.col(index), n, epoch, seed))
    return placed.select(*(f"`{c}`" for c in rows.columns), F.floor(F.col("__place") / size).alias("batch"), (F.col("__place") % size).alias("pos"))


def speaker_batches(utts: DataFrame, speakers: int, each: int, batches: int | None = None, seed: int = 0) -> DataFrame:
    """(batch, spk, uttid): every batch has ``speakers`` speakers and ``each`` utterances of each, without repetition within a batch.

    As many batches as the utterances fill, if their number is not given. Speakers with fewer utterances are left out;
    with fewer speakers than asked for, a batch has them all. Speakers and utterances are drawn by their numbers and
    fetched by joins, so a batch costs the same whatever the corpus.
    """
    named = utts.select(F.col("spk").cast("string").alias("spk"), F.col("uttid").cast("string").alias("uttid")).distinct()
    pool = stored(numbered(named, "spk", "uttid"), "pool")
    known = stored(indexed(pool.filter("number = 0").filter(F.col("size") >= each).select("spk", "size"), "spk", "n"), "speakers")
    batches = pool.count() // (speakers * each) if batches is None else batches
    rows = utts.sparkSession.range(batches).select(F.col("id").alias("batch")).crossJoin(F.broadcast(known.agg(F.count("*").alias("all"))))
    drawn = rows.select("batch", F.explode(distinct(F.col("batch"), "speaker", F.col("all"), speakers, seed)).alias("d")).select("batch", F.col("d.number").alias("n")).join(known, "n")
    picked = drawn.select("batch", "spk", F.explode(distinct(F.concat_ws("/", F.col("batch").cast("string"), "spk"), "utt", F.col("size"), each, seed)).alias("d"))
    return picked.select("batch", "spk", F.col("d.number").alias("number")).join(pool.select("spk", "number", "uttid"), ["spk", "number"]).select("batch", "spk", "uttid")


def padded_batches(rows: DataFrame, w: str = "w") -> DataFrame:
    """``rows`` (batch, ...) with ``w`` padded by zeros to the longest of its batch, and its own length."""
    longest = F.max(F.size(w)).over(Window.partitionBy("batch"))
    return rows.withColumn("length", F.size(w)).withColumn("__longest", longest).withColumn(w, F.concat(F.col(w), F.array_repeat(F.lit(0.0), (F.col("__longest") - F.col("length")).cast("int")))).drop("__longest")
