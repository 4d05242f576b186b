"""The dataset jobs in DuckDB, step by step: draws, cuts and the augmentation chain over lists of samples."""

from __future__ import annotations

from earshot.jobs import views
from earshot.jobs.augment import Chances


def draw(salt: str, key: str = "key", seed: int = 0) -> str:
    return f"('0x' || substr(md5('{seed}|{salt}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def between(salt: str, low: float, high: float, seed: int = 0) -> str:
    return f"({low!r}::DOUBLE + {draw(salt, seed=seed)} * {high - low!r}::DOUBLE)"


def chance(salt: str, p: float, seed: int = 0) -> str:
    return f"({draw(salt + '?', seed=seed)} < {p!r})"


def plan(c: Chances, seed: int = 0) -> str:
    """Columns of a plan over rows with a key."""
    size = "(SELECT count(*) FROM embeddings)"
    turned = {n: f"CASE WHEN {chance('response', c.response, seed)} THEN {between(n, -3 / 8, 3 / 8, seed)} END AS {n}" for n in ("a1", "a2", "b1", "b2")}
    return ", ".join(
        [
            f"CASE WHEN {chance('speed', c.speed, seed)} THEN {between('speed', *c.speeds, seed)} END AS speed",
            f"CASE WHEN {chance('rir', c.rir, seed)} THEN CAST(floor({draw('rir', seed=seed)} * {size}) AS BIGINT) END AS rir_at",
            f"CASE WHEN {chance('noise', c.noise, seed)} THEN CAST(floor({draw('noise', seed=seed)} * {size}) AS BIGINT) END AS noise_idx",
            f"CASE WHEN {chance('noise', c.noise, seed)} THEN {between('noise', *c.snrs, seed)} END AS snr",
            f"{draw('noise_at', seed=seed)} AS noise_at",
            *turned.values(),
            f"{between('volume', *c.volumes, seed)} AS volume" if c.volumes else "1.0::DOUBLE AS volume",
        ]
    )


def at_speed(w: str) -> str:
    """A list resampled by the column ``speed``: a Hann-windowed sinc of six zeros a side."""
    cut = "(least(speed, 1.0) * 0.99 / speed)"
    t = f"((i * speed - j) * {cut})"
    weight = f"CASE WHEN {t} = 0 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) END * pow(cos(pi() * {t} / 12), 2) * {cut}"
    near = "range(greatest(CAST(floor(i * speed) AS BIGINT) - 14, 0), least(CAST(ceil(i * speed) AS BIGINT) + 15, len(w)))".replace("len(w)", f"len({w})")
    return f"CASE WHEN speed IS NULL THEN {w} ELSE [coalesce(list_sum([{w}[j + 1] * {weight} FOR j IN {near} IF abs({t}) < 6]), 0) FOR i IN range(CAST(ceil(len({w}) / speed) AS BIGINT))] END"


def in_room(w: str) -> str:
    """A list convolved with the response ``h`` (of unit energy), without its delay."""
    return f"CASE WHEN h IS NULL THEN {w} ELSE [coalesce(list_sum([{w}[j + 1] * h[i + delay - j + 1] FOR j IN range(greatest(i + delay - len(h) + 1, 0), least(i + delay + 1, len({w})))]), 0) FOR i IN range(len({w}))] END"


def with_noise(w: str) -> str:
    """A list with the list ``added`` at the ratio ``snr`` of their norms."""
    norm = lambda x: f"sqrt(list_sum([v * v FOR v IN {x}]))"
    return f"CASE WHEN added IS NULL THEN {w} ELSE [{w}[i] + sqrt({norm(w)} / (pow(10, snr / 10) * {norm('added')} + 1e-8)) * added[i] FOR i IN range(1, len({w}) + 1)] END"


def turned(w: str) -> str:
    """A list through the filter of two poles and two zeros, then within one."""
    before = lambda n: f"{w}[CAST(i[1] AS BIGINT) - {n}]"
    past = lambda n: f"CASE WHEN len(acc) >= {n} THEN acc[len(acc) - {n - 1}] ELSE 0 END"
    # Index 0 would count from the end.
    x = lambda n: f"CASE WHEN i[1] > {n} THEN {before(n)} ELSE 0 END"
    step = f"list_append(acc, {x(0)} + b1 * {x(1)} + b2 * {x(2)} - a1 * {past(1)} - a2 * {past(2)})"
    run = f"list_reduce([[CAST(k AS DOUBLE)] FOR k IN range(1, len({w}) + 1)], lambda acc, i: {step}, CAST([] AS DOUBLE[]))"
    return f"CASE WHEN a1 IS NULL THEN {w} ELSE [greatest(-1, least(1, v)) FOR v IN {run}] END"


def louder(w: str) -> str:
    return f"CASE WHEN volume = 1 THEN {w} ELSE [greatest(-1, least(1, v * volume)) FOR v IN {w}] END"


def chain(rows: str, kept: str, c: Chances, seed: int = 0, tag: str = "") -> str:
    """CTEs from ``rows`` (key, w, clean, ``kept``...) to ``done{tag}`` (x, y besides): speed, room, noise, response, volume."""
    t = tag
    return f"""
p{t} AS (SELECT key, w, clean{kept}, {plan(c, seed)} FROM {rows}),
q{t} AS (SELECT p{t}.* EXCLUDE (w, clean), {at_speed("w")} AS x, {at_speed("clean")} AS y, CAST(n.embedding AS DOUBLE[]) AS noise,
  [v / sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) FOR v IN CAST(r.embedding AS DOUBLE[])] AS h
  FROM p{t} LEFT JOIN embeddings n ON n.vec_id = noise_idx LEFT JOIN embeddings r ON r.vec_id = rir_at),
d{t} AS (SELECT *, list_position([abs(v) FOR v IN h], list_max([abs(v) FOR v IN h])) - 1 AS delay, CAST(floor(noise_at * (len(noise) - len(x) + 1)) AS BIGINT) AS frm FROM q{t}),
e{t} AS (SELECT * EXCLUDE (x, y), {in_room("x")} AS x, {in_room("y")} AS y,
  CASE WHEN noise IS NULL THEN NULL WHEN len(noise) >= len(x) THEN list_slice(noise, frm + 1, frm + len(x)) ELSE [noise[i % len(noise) + 1] FOR i IN range(len(x))] END AS added FROM d{t}),
g{t} AS (SELECT * EXCLUDE (x), {with_noise("x")} AS x FROM e{t}),
i{t} AS (SELECT * EXCLUDE (x, y), {turned("x")} AS x, {turned("y")} AS y FROM g{t}),
done{t} AS (SELECT * EXCLUDE (x, y), {louder("x")} AS x, {louder("y")} AS y FROM i{t})"""


def cut(w: str, n: int) -> str:
    """``n`` samples at the column ``offset``, or the whole with zeros after it."""
    return f"CASE WHEN len({w}) > {n} THEN list_slice({w}, offset + 1, offset + {n}) ELSE list_concat({w}, [0.0::DOUBLE FOR _ IN range({n} - len({w}))]) END"


def enhancement(n: int, c: Chances = Chances()) -> str:
    return f"""WITH {views.TRIOS},
o AS (SELECT *, CAST(floor({draw("crop.0")} * greatest(len(clean) - {n} + 1, 1)) AS BIGINT) AS "offset" FROM t),
s AS (SELECT key, "offset", {cut("noisy", n).replace("offset", '"offset"')} AS w, {cut("clean", n).replace("offset", '"offset"')} AS clean FROM o), {chain("s", ', "offset"', c)}
SELECT key, "offset", round(speed, 6) AS speed, round(snr, 6) AS snr, noise_idx, CAST(unnest(range(len(x))) AS INTEGER) AS i, round(unnest(x), 5) + 0 AS process, round(unnest(y), 5) + 0 AS clean FROM done"""


def distance(c: Chances) -> str:
    side = lambda s: f"CASE WHEN list_sum({s}) = 0 THEN x ELSE {louder('s_' + s)} END"
    return f"""WITH {views.TRIOS},
s AS (SELECT key, noisy AS w, noisy AS clean, clean AS near, CASE WHEN key % 5 = 0 THEN [0.0::DOUBLE FOR _ IN enh] ELSE enh END AS far FROM t), {chain("s", ", near, far", c)},
f AS (SELECT *, {at_speed("near")} AS s_near, {at_speed("far")} AS s_far FROM done)
SELECT key, round(speed, 6) AS speed, round(snr, 6) AS snr, list_sum(near) = 0 AS near_inactive, list_sum(far) = 0 AS far_inactive, CAST(unnest(range(len(x))) AS INTEGER) AS i,
  round(unnest(x), 5) + 0 AS process, round(unnest({side("near")}), 5) + 0 AS near, round(unnest({side("far")}), 5) + 0 AS far FROM f"""


def extraction(single: float, inactive: float, c: Chances, e: Chances, tries: int = 8) -> str:
    """Target-speaker extraction over trios: a row's mixture has its speaker and the next one's number; the enhanced side is the enrollment."""
    size = "(SELECT count(*) FROM embeddings)"
    probes = ", ".join(f"CAST(floor({draw(f'other.{k}', 'key')} * {size}) AS BIGINT)" for k in range(tries))
    normal = f"(sqrt(-2 * ln(1 - {draw('level.u')})) * cos(2 * pi() * {draw('level.v')}))"
    level = f"round(-28 + sqrt(10) * {normal}, 1)"
    return f"""WITH {views.TRIOS},
a AS (SELECT key, generate_subscripts(o, 1) AS nth, unnest(o) AS other_idx, spk FROM (SELECT key, spk, [{probes}] AS o FROM t)),
b AS (SELECT a.key, arg_min(a.other_idx, nth) AS other_idx FROM a JOIN t ON t.key = a.other_idx WHERE t.spk <> a.spk AND t.spk <> a.spk + 1 GROUP BY a.key),
k AS (SELECT t.key, t.spk, t.noisy, t.clean, t.enh, o.noisy AS other_w, o.clean AS other_clean, b.other_idx, {draw("use_mixture", "t.key")} < 0.5 AS use_mixture,
  {draw("inactive", "t.key")} < {inactive} AND b.other_idx IS NOT NULL AS inactive, {draw("inactive", "t.key")} >= {inactive} AND {draw("single", "t.key")} < {single} AS alone
  FROM t LEFT JOIN b ON b.key = t.key LEFT JOIN t o ON o.key = b.other_idx),
s AS (SELECT key, other_idx, inactive, alone, CASE WHEN inactive THEN CASE WHEN use_mixture THEN other_w ELSE other_clean END WHEN alone THEN clean ELSE noisy END AS w, CASE WHEN inactive THEN noisy ELSE clean END AS clean FROM k), {chain("s", ", other_idx, inactive, alone", c)},
v AS (SELECT key, {level} AS enroll_level, list_slice(enh, 1, 240) AS w FROM t WHERE len(enh) >= 16),
z AS (SELECT key, enroll_level, [pow(10, enroll_level / 20) * (u / (list_sum([abs(x) FOR x IN w]) / len(w) + 1e-14)) FOR u IN w] AS w FROM v),
y AS (SELECT *, w AS clean FROM z), {chain("y", ", enroll_level", e, 1, "_e")},
r AS (SELECT d.*, CASE WHEN inactive THEN d.x ELSE d.y END AS target, m.enroll_level, CASE WHEN d.volume = 1 THEN m.x ELSE [greatest(-1, least(1, u * d.volume)) FOR u IN m.x] END AS enroll FROM done d LEFT JOIN done_e m ON m.key = d.key)
SELECT key, other_idx, inactive, alone, round(speed, 6) AS speed, round(snr, 6) AS snr, round(volume, 6) AS volume, enroll_level, CAST(unnest(range(greatest(len(x), len(enroll)))) AS INTEGER) AS i,
  round(unnest(x), 5) + 0 AS process, round(unnest(target), 5) + 0 AS clean, round(unnest(enroll), 5) + 0 AS enroll FROM r"""
