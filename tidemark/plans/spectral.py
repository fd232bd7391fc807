"""Queries over spectral transforms. Series are the ticks of each user by row number."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import core, fourier, stats
from tidemark.operators import spectral as sp

from .tables import query, r6, read, ticks
from .windows import R, rows

TAPS = [0.5, 0.3, 0.2]
D4 = sp.daubechies4()


def _values(taps):
    return "(VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(taps)) + ") taps(l, w)"


def _fir_sql(source: str, taps, column: str = "x", stretch: int = 1) -> str:
    """(series, row_ix, y) of a table (series, row_ix, column)."""
    return f"(SELECT a.series, a.row_ix, CASE WHEN count(*) = {len(taps)} THEN sum(w * b.{column}) ELSE sum(w * b.{column}) / sum(w) END AS y FROM {source} a JOIN {_values(taps)} ON true JOIN {source} b ON b.series = a.series AND b.row_ix = a.row_ix - {stretch} * l GROUP BY ALL)"


def _circular_sql(source: str, taps, column: str = "x", stretch: int = 1, sign: int = -1) -> str:
    n = f"(SELECT series, max(row_ix) + 1 AS n FROM {source} GROUP BY series)"
    return f"(SELECT a.series, a.row_ix, sum(w * b.{column}) AS y FROM {source} a JOIN {n} n ON n.series = a.series JOIN {_values(taps)} ON true JOIN {source} b ON b.series = a.series AND b.row_ix = ((a.row_ix + {sign} * {stretch} * l) % n + n) % n GROUP BY ALL)"


X = "x0 AS (SELECT series, row_ix, price AS x FROM " + R + ")"


@query("fir_convolution", f"WITH {X} SELECT series, row_ix, round(y, 6) AS filtered FROM {_fir_sql('x0', TAPS, stretch=2)}")
def fir_convolution(spark, d):
    return sp.fir(rows(spark, d), "series", "price", TAPS, 2).select("series", "row_ix", r6("filtered", "filtered"))


@query("low_pass_filter", f"WITH {X} SELECT series, row_ix, round(y, 6) AS filtered FROM {_fir_sql('x0', sp.low_pass(9, 0.2))}")
def low_pass_filter(spark, d):
    return sp.fir(rows(spark, d), "series", "price", sp.low_pass(9, 0.2)).select("series", "row_ix", r6("filtered", "filtered"))


MASKS, SIFTINGS = [[0.6, 0.4], [0.4, 0.3, 0.2, 0.1]], 2


def _emd_sql() -> str:
    ctes, rest = [X], "x0"
    levels = []
    for i, mask in enumerate(MASKS):
        mode = rest
        for s in range(SIFTINGS):
            name = f"m{i}_{s}"
            ctes.append(f"{name} AS MATERIALIZED (SELECT a.series, a.row_ix, a.x - f.y AS x FROM {mode} a JOIN {_fir_sql(mode, mask)} f USING (series, row_ix))")
            mode = name
        levels.append(f"SELECT series, row_ix, {len(MASKS) - i} AS level, x FROM {mode}")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT a.series, a.row_ix, a.x - b.x AS x FROM {rest} a JOIN {mode} b USING (series, row_ix))")
        rest = f"r{i}"
    levels.append(f"SELECT series, row_ix, 0 AS level, x FROM {rest}")
    return f"WITH {', '.join(ctes)} SELECT series, row_ix, level, round(x, 6) AS value FROM ({' UNION ALL '.join(levels)})"


@query("emd_decomposition", _emd_sql())
def emd_decomposition(spark, d):
    return sp.emd(rows(spark, d), "series", "price", MASKS, SIFTINGS).select("series", "row_ix", "level", r6("value", "value"))


@query("level_reconstruction", f"SELECT series, row_ix, round(price, 6) AS value FROM {R}")
def level_reconstruction(spark, d):
    levels = sp.emd(rows(spark, d), "series", "price", MASKS[:1], SIFTINGS)
    return sp.recompose(levels, ["series", "row_ix"]).select("series", "row_ix", r6("value", "value"))


@query("scaled_level_reconstruction", f"SELECT series, row_ix, round(price * 0.7, 6) AS value FROM {R}")
def scaled_level_reconstruction(spark, d):
    """Three levels, each centred and scaled by its own factors, summed without the transitional one and in their own units."""
    shares = F.array(*(F.struct(F.lit(i).alias("level"), (F.col("price") * s).alias("value")) for i, s in enumerate((0.5, 0.3, 0.2))))
    levels = rows(spark, d).select("series", "row_ix", F.explode(shares).alias("l")).select("series", "row_ix", "l.*")
    factors = stats.scaling(levels, ["level"], "value")
    scaled = levels.join(factors, "level").select("series", "row_ix", "level", ((F.col("value") - F.col("dc")) / F.col("sf")).alias("value"))
    return sp.recompose(scaled, ["series", "row_ix"], skip=1, factors=factors).select("series", "row_ix", r6("value", "value"))


@query("product_reconstruction", "SELECT o_custkey, round(exp(sum(ln(1 + (o_totalprice % 97) / 1000))), 6) AS value FROM orders GROUP BY 1")
def product_reconstruction(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("level"), (1 + (F.col("o_totalprice") % 97) / 1000).alias("value"))
    return sp.recompose(o, ["o_custkey"], product=True).select("o_custkey", r6("value", "value"))


@query("pass_through_levels", f"SELECT event_id, unnest(range(4)) AS level, round(price / 4, 6) AS value FROM {R}")
def pass_through_levels(spark, d):
    return ticks(spark, d).select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("level"), r6(F.col("price") / 4, "value"))


_NEEDED = 10


@query("mirrored_history", f"""WITH g AS (SELECT series, n, unnest(range(1, {_NEEDED + 1})) AS i FROM (SELECT DISTINCT series, n FROM {R}))
SELECT g.series, -g.i AS row_ix, round(r.price * (1.0 - g.i / {_NEEDED + 1}.0), 6) AS value FROM g JOIN {R} r ON r.series = g.series AND r.row_ix = CAST(round((g.n - 1) * abs(round(g.i / g.n) - g.i / g.n)) AS BIGINT)""")
def mirrored_history(spark, d):
    """Rows before the first one, mirrored at it and fading out with distance."""
    r = rows(spark, d)
    n = r.groupBy("series").agg((F.max("row_ix") + 1).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(_NEEDED).cast("long"))))
    phi = F.col("i") / F.col("n")
    source = n.withColumn("row_ix", F.round((F.col("n") - 1) * F.abs(F.round(phi) - phi)).cast("long"))
    got = source.join(r.select("series", "row_ix", "price"), ["series", "row_ix"])
    return got.select("series", (-F.col("i")).alias("row_ix"), r6(F.col("price") * (1.0 - F.col("i") / float(_NEEDED + 1)), "value"))


@query("palindrome_backfill", f"""WITH f AS (SELECT series, min(t) AS f FROM {{ticks}} GROUP BY series), p AS (SELECT r.series, f.f - (r.row_ix + 1) * 14400000000 AS t, r.price FROM {R} r JOIN f USING (series))
SELECT series, t, price FROM p WHERE (t // 86400000000 + 3) % 7 < 5""")
def palindrome_backfill(spark, d):
    """History before the first row in mirrored order, four hours a step, without weekends."""
    r = rows(spark, d)
    first = r.groupBy("series").agg(F.min("t").alias("f"))
    got = r.join(first, "series").select("series", (F.col("f") - (F.col("row_ix") + 1) * 4 * core.HOUR).alias("t"), "price")
    return got.filter(F.pmod(F.floor(F.col("t") / core.DAY) + 3, F.lit(7)) < 5)


def _modwt_sql() -> str:
    low, high = ([t / math.sqrt(2) for t in f] for f in (D4, sp.high_of(D4)))
    return f"""WITH {X}, w1 AS MATERIALIZED {_circular_sql('x0', high)}, v1 AS MATERIALIZED (SELECT series, row_ix, y AS x FROM {_circular_sql('x0', low)}),
w2 AS MATERIALIZED {_circular_sql('v1', high, stretch=2)}, v2 AS MATERIALIZED {_circular_sql('v1', low, stretch=2)}
SELECT w1.series, w1.row_ix, round(w1.y, 6) AS w1, round(w2.y, 6) AS w2, round(v2.y, 6) AS v FROM w1 JOIN w2 USING (series, row_ix) JOIN v2 USING (series, row_ix)"""


@query("modwt", _modwt_sql())
def modwt(spark, d):
    return sp.modwt(rows(spark, d), "series", "price", D4, 2).select("series", "row_ix", r6("w1", "w1"), r6("w2", "w2"), r6("v", "v"))


@query("modwt_inverse", f"SELECT series, row_ix, round(price, 5) AS value FROM {R}")
def modwt_inverse(spark, d):
    return sp.imodwt(sp.modwt(rows(spark, d), "series", "price", D4, 2), "series", D4, 2).select("series", "row_ix", F.round("value", 5).alias("value"))


def _even(spark, d):
    """Rows of each series without the last one of an odd number."""
    r = rows(spark, d)
    n = r.groupBy("series").agg((F.floor((F.max("row_ix") + 1) / 4) * 4).cast("long").alias("m"))
    return r.join(n, "series").filter("row_ix < m").drop("m")


EVEN = f"(SELECT series, row_ix, price AS x FROM {R} WHERE row_ix < n // 4 * 4)"


@query("dwt", f"WITH e AS {EVEN}, lo AS {_circular_sql('e', D4)}, hi AS {_circular_sql('e', sp.high_of(D4))} SELECT lo.series, lo.row_ix // 2 AS row_ix, round(lo.y, 6) AS low, round(hi.y, 6) AS high FROM lo JOIN hi USING (series, row_ix) WHERE lo.row_ix % 2 = 1")
def dwt(spark, d):
    return sp.dwt(_even(spark, d), "series", "price", D4).select("series", "row_ix", r6("low", "low"), r6("high", "high"))


@query("dwt_inverse", f"SELECT series, row_ix, round(x, 5) AS value FROM {EVEN}")
def dwt_inverse(spark, d):
    return sp.idwt(sp.dwt(_even(spark, d), "series", "price", D4), "series", D4).select("series", "row_ix", F.round("value", 5).alias("value"))


PADDED = f"""x0 AS (SELECT series, row_ix, price AS x FROM {R} UNION ALL SELECT series, unnest(range(n, CAST(ceil(n / 4) AS BIGINT) * 4)) AS row_ix, price FROM {R} WHERE row_ix = n - 1)"""


def _swt_sql() -> str:
    return f"""WITH {PADDED}, w1 AS MATERIALIZED {_circular_sql('x0', sp.high_of(D4))}, v1 AS MATERIALIZED (SELECT series, row_ix, y AS x FROM {_circular_sql('x0', D4)}),
w2 AS MATERIALIZED {_circular_sql('v1', sp.high_of(D4), stretch=2)}, v2 AS MATERIALIZED {_circular_sql('v1', D4, stretch=2)}
SELECT w1.series, w1.row_ix, round(w1.y, 5) AS w1, round(w2.y, 5) AS w2, round(v2.y, 5) AS v FROM w1 JOIN w2 USING (series, row_ix) JOIN v2 USING (series, row_ix)"""


def _swt(spark, d):
    return sp.swt(sp.padded(rows(spark, d), "series", "price", 2), "series", "value", D4, 2)


@query("stationary_wavelet_transform", _swt_sql())
def stationary_wavelet_transform(spark, d):
    """Two levels of each series, filled up to a multiple of four rows."""
    return _swt(spark, d).select("series", "row_ix", *(F.round(c, 5).alias(c) for c in ("w1", "w2", "v")))


@query("stationary_wavelet_inverse", f"SELECT series, row_ix, round(price, 5) AS value FROM {R}")
def stationary_wavelet_inverse(spark, d):
    """The rows that the series came with, without those filled in."""
    return sp.iswt(_swt(spark, d), "series", D4, 2).join(rows(spark, d).select("series", "row_ix"), ["series", "row_ix"], "left_semi").select("series", "row_ix", F.round("value", 5).alias("value"))


def _long_enough(spark, d):
    r = rows(spark, d)
    return r.join(r.groupBy("series").agg(F.max("row_ix").alias("last")).filter("last >= 3"), "series", "left_semi")


_SYMMETRIC = f"""(WITH k AS (SELECT series, n, unnest(range((n + 3) // 2)) AS k FROM (SELECT DISTINCT series, n FROM {R} WHERE n >= 4)), s AS (SELECT *, 2 * k + 1 - l AS src FROM k JOIN {{0}} ON true)
SELECT s.series, k AS row_ix, sum(w * price) AS y FROM s JOIN {R} r ON r.series = s.series AND r.row_ix = CASE WHEN src < 0 THEN -1 - src WHEN src >= s.n THEN 2 * s.n - 1 - src ELSE src END GROUP BY ALL)"""


@query("dwt_symmetric", f"SELECT a.series, a.row_ix, round(a.y, 5) AS low, round(b.y, 5) AS high FROM {_SYMMETRIC.replace("{0}", _values(D4))} a JOIN {_SYMMETRIC.replace("{0}", _values(sp.high_of(D4)))} b USING (series, row_ix)")
def dwt_symmetric(spark, d):
    return sp.dwt_symmetric(_long_enough(spark, d), "series", "price", D4).select("series", "row_ix", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("dwt_symmetric_inverse", f"SELECT series, row_ix, round(price, 5) AS value FROM {R} WHERE n >= 4")
def dwt_symmetric_inverse(spark, d):
    return sp.idwt_symmetric(sp.dwt_symmetric(_long_enough(spark, d), "series", "price", D4), "series", D4).select("series", "row_ix", F.round("value", 5).alias("value"))


def _packets_sql() -> str:
    ctes = [f"n0 AS (SELECT series, '' AS node, row_ix, x FROM {EVEN})"]
    for i in range(2):
        one = f"SELECT a.series, a.node || '{{0}}' AS node, a.row_ix // 2 AS row_ix, (a.x {{1}} b.x) * sqrt(0.5) AS x FROM n{i} a JOIN n{i} b ON a.series = b.series AND a.node = b.node AND b.row_ix = a.row_ix - 1 WHERE a.row_ix % 2 = 1"
        ctes.append(f"n{i + 1} AS ({one.format('0', '+')} UNION ALL {one.format('1', '-')})")
    return ", ".join(ctes)


@query("best_packet_basis")
def best_packet_basis(spark, d):
    """The packet nodes that cost least together, by series."""
    return sp.best_basis(_even(spark, d), "series", "price", sp.HAAR, 2).select("series", "node", r6("cost", "cost"))


@query("wavelet_packets", f"WITH {_packets_sql()} SELECT series, node, row_ix, round(x, 6) + 0.0 AS value FROM n2")
def wavelet_packets(spark, d):
    return sp.packets(_even(spark, d), "series", "price", sp.HAAR, 2).select("series", "node", "row_ix", (F.round("value", 6) + 0.0).alias("value"))


@query("continuous_wavelet_transform", f"WITH {X} SELECT series, row_ix, scale, round(y, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT *, {s}::DOUBLE AS scale FROM {_circular_sql('x0', sp.morlet(s))}" for s in (1.0, 2.0)) + ")")
def continuous_wavelet_transform(spark, d):
    return sp.cwt(rows(spark, d), "series", "price", [1.0, 2.0]).select("series", "row_ix", "scale", r6("value", "value"))


_SCALES = [2.0, 2.0**1.5, 4.0]


def _centred_sql(kind: str) -> str:
    parts = []
    for scale in _SCALES:
        taps = sp.mother(kind, scale)
        parts.append(f"SELECT y.series, ((y.row_ix - {len(taps) // 2}) % n + n) % n AS row_ix, {scale!r}::DOUBLE AS scale, y FROM {_circular_sql('x0', taps)} y JOIN (SELECT series, max(row_ix) + 1 AS n FROM x0 GROUP BY series) m ON m.series = y.series")
    return "(" + " UNION ALL ".join(parts) + ")"


@query("mother_wavelets", f"WITH {X} " + " UNION ALL ".join(f"SELECT '{kind}' AS mother, series, row_ix, round(scale, 6) AS scale, round(y, 6) + 0.0 AS value FROM {_centred_sql(kind)}" for kind in sp.MOTHERS))
def mother_wavelets(spark, d):
    """The centred transform by each mother wavelet at scales two to an octave."""
    out = None
    for kind in sp.MOTHERS:
        got = sp.cwt_centred(rows(spark, d), "series", "price", kind, _SCALES).select(F.lit(kind).alias("mother"), "series", "row_ix", r6("scale", "scale"), (F.round("value", 6) + 0.0).alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


def _complex_sql() -> str:
    parts = []
    for kind in ("morlet", "paul"):
        for scale in _SCALES:
            taps = sp.complex_mother(kind, scale)
            re, im = (_circular_sql("x0", part) for part in ([t.real for t in taps], [t.imag for t in taps]))
            at = f"((a.row_ix - {len(taps) // 2}) % n + n) % n"
            parts.append(
                f"""SELECT '{kind}' AS mother, a.series, {at} AS row_ix, round({scale!r}::DOUBLE, 6) AS scale, round(a.y, 6) + 0.0 AS re, round(b.y, 6) + 0.0 AS im
                FROM {re} a JOIN {im} b USING (series, row_ix) JOIN (SELECT series, max(row_ix) + 1 AS n FROM x0 GROUP BY series) m ON m.series = a.series"""
            )
    return f"WITH {X} " + " UNION ALL ".join(parts)


@query("complex_wavelet_transform", _complex_sql())
def complex_wavelet_transform(spark, d):
    """Real and imaginary coefficients of the two complex mother wavelets."""
    out = None
    for kind in ("morlet", "paul"):
        got = sp.cwt_complex(rows(spark, d), "series", "price", kind, _SCALES).select(F.lit(kind).alias("mother"), "series", "row_ix", r6("scale", "scale"), (F.round("value", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))
        out = got if out is None else out.unionByName(got)
    return out


@query("continuous_wavelet_inverse", f"WITH {X} SELECT series, row_ix, round(sum(y / sqrt(scale)) * {0.5 / (sp.MOTHERS['dog'][0] * sp.MOTHERS['dog'][1])!r}, 5) + 0.0 AS value FROM {_centred_sql('dog')} GROUP BY ALL")
def continuous_wavelet_inverse(spark, d):
    got = sp.icwt(sp.cwt_centred(rows(spark, d), "series", "price", "dog", _SCALES), "series", "dog", 0.5)
    return got.select("series", "row_ix", (F.round("value", 5) + 0.0).alias("value"))


_N = 4
_STFT = f"(SELECT a.series, a.row_ix AS frame, bin, sum(b.price * cos(2 * pi() * bin * (b.row_ix - a.row_ix) / {_N})) AS re, -sum(b.price * sin(2 * pi() * bin * (b.row_ix - a.row_ix) / {_N})) AS im FROM {R} a JOIN (SELECT unnest(range({_N // 2 + 1})) AS bin) ON true JOIN {R} b ON b.series = a.series AND b.row_ix >= a.row_ix AND b.row_ix < a.row_ix + {_N} WHERE a.row_ix + {_N} <= a.n GROUP BY ALL)"


def _frames(spark, d):
    return sp.stft(rows(spark, d), "series", "price", _N)


@query("short_time_fourier", f"SELECT series, frame, CAST(bin AS INTEGER) AS bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM {_STFT}")
def short_time_fourier(spark, d):
    return _frames(spark, d).select("series", "frame", "bin", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("short_time_fourier_inverse", f"SELECT series, row_ix, round(price, 5) AS value FROM {R} WHERE n >= {_N}")
def short_time_fourier_inverse(spark, d):
    return sp.istft(_frames(spark, d), "series", _N).select("series", "row_ix", F.round("value", 5).alias("value"))


@query("dft_magnitude", f"SELECT series, frame, CAST(bin AS INTEGER) AS bin, round(abs(re) + abs(im), 4) AS magnitude FROM {_STFT}")
def dft_magnitude(spark, d):
    return _frames(spark, d).select("series", "frame", "bin", F.round(F.abs("re") + F.abs("im"), 4).alias("magnitude"))


@query("spectral_centroid", f"SELECT series, frame, round(sum(bin / {_N} * (re * re + im * im)) / sum(re * re + im * im), 6) AS centroid FROM {_STFT} GROUP BY ALL")
def spectral_centroid(spark, d):
    return sp.centroid(_frames(spark, d), ["series", "frame"], _N).select("series", "frame", r6("centroid", "centroid"))


def _frames_sql(size: int) -> str:
    return f"""(SELECT a.series, a.row_ix AS frame, bin, sum(b.price * cos(2 * pi() * bin * (b.row_ix - a.row_ix) / {size})) AS re, -sum(b.price * sin(2 * pi() * bin * (b.row_ix - a.row_ix) / {size})) AS im
    FROM {R} a JOIN (SELECT unnest(range({size // 2 + 1})) AS bin) ON true JOIN {R} b ON b.series = a.series AND b.row_ix >= a.row_ix AND b.row_ix < a.row_ix + {size}
    WHERE a.row_ix + {size} <= a.n GROUP BY ALL)"""


@query("frame_peaks", f"""WITH m AS (SELECT series, frame, bin, abs(re) + abs(im) AS m FROM {_frames_sql(8)}),
p AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM m WINDOW w AS (PARTITION BY series, frame ORDER BY bin)),
s AS (SELECT series, frame, bin, m, m - (a + b) / 2 AS score FROM p WHERE m > a AND m > b)
SELECT series, frame, CAST(bin AS INTEGER) AS bin, round(m, 6) AS m, round(score, 6) AS score FROM (SELECT *, percent_rank() OVER (PARTITION BY series, frame ORDER BY score) AS place FROM s) WHERE place >= 0.5""")
def frame_peaks(spark, d):
    """Local maxima of frames of eight rows, the upper half of each by height over their neighbours."""
    got = sp.peaks(sp.stft(rows(spark, d), "series", "price", 8), ["series", "frame"], 0.5)
    return got.select("series", "frame", "bin", r6("m", "m"), r6("score", "score"))


_SPECTRUM = f"""(SELECT series, bin, n2 AS n, sum(price * cos(2 * pi() * ((bin * row_ix) % n2) / n2)) AS re, -sum(price * sin(2 * pi() * ((bin * row_ix) % n2) / n2)) AS im
FROM (SELECT series, row_ix, price, n // 2 * 2 AS n2, unnest(range(n // 2 + 1)) AS bin FROM {R} WHERE n >= 2 AND row_ix < n // 2 * 2) GROUP BY ALL)"""
_PEAKS = f"""s AS MATERIALIZED (SELECT series, bin, n, round(abs(re) + abs(im), 6) AS m FROM {_SPECTRUM}),
near AS (SELECT a.series, a.bin, a.m, a.n, max(b.bin) FILTER (b.bin < a.bin AND b.m >= a.m) AS before, min(b.bin) FILTER (b.bin > a.bin AND b.m >= a.m) AS behind FROM s a JOIN s b USING (series) GROUP BY ALL),
sides AS (SELECT *, coalesce(bin - before, 1000000000000) AS l, coalesce(behind - bin, 1000000000000) AS r FROM near),
peaks AS MATERIALIZED (SELECT *, width + m AS score FROM (SELECT *, greatest(0, least(least(l, r, n // 2 - bin), bin, l - 1)) + greatest(0, least(least(l, r, n // 2 - bin), r - 1)) AS width FROM sides) WHERE width > 0)"""


@query("series_spectrum", f"SELECT series, bin, n, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM {_SPECTRUM}")
def series_spectrum(spark, d):
    """The Fourier transform of each whole series."""
    got = fourier.spectrum(rows(spark, d), "series", "price")
    return got.select("series", "bin", "n", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("spectrum_peaks", f"WITH {_PEAKS} SELECT series, bin, m, CAST(width AS BIGINT) AS width, round(score, 6) AS score FROM peaks")
def spectrum_peaks(spark, d):
    """Broad and tall peaks of each whole series' spectrum."""
    m = fourier.magnitudes(fourier.spectrum(rows(spark, d), "series", "price"), 6)
    return fourier.broad_peaks(m, "series").select("series", "bin", "m", "width", r6("score", "score"))


@query("dominant_frequency", f"""WITH {_PEAKS}, one AS (SELECT series, score, min(bin) AS bin, any_value(n) AS n FROM peaks GROUP BY series, score),
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score) AS place, count(*) OVER (PARTITION BY series) AS of FROM one)
SELECT series, bin, round(0.5 * bin * 60 / n, 6) AS frequency FROM placed WHERE place - 1 = floor(0.9 * (of - 1))""")
def dominant_frequency(spark, d):
    """Half the frequency of the peak at nine tenths of each spectrum's peaks, at sixty samples a unit of time."""
    return fourier.dominant_frequency(rows(spark, d), "series", "price", 0.9, 60.0, digits=6).select("series", "bin", r6("frequency", "frequency"))


@query("vmd_filter_bank")
def vmd_filter_bank(spark, d):
    got = sp.rotation_bank(rows(spark, d), "series", "price", [0.1, 0.7, 1.9], block=256)
    return got.select("series", "row_ix", F.transform("modes", lambda x: F.round(x, 6)).alias("modes"))
