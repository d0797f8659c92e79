"""Windowed heart, skin-conductance and respiration features from sampled signals.

Peaks are local maxima of the whole recording (the largest sample within a half width, the earliest of
equal ones) that rise above a height measured in the window's own standard deviations. The local
extremes need only a bounded neighbourhood, so they are found once per chunk; each window then keeps
its candidate peaks in a short array (at most one per half width) and derives intervals from it.
One exchange leads from samples to finished windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tidemark.config import PhysioConfig
from tidemark.functions.numeric import finite
from tidemark.operators.sequence import CHUNK
from tidemark.operators.windows import WINDOW, explode_windows, window_bounds, window_chunks

SESSION = ("user_id", "task")
SIGNALS = ("ECG", "EDA", "RR")


def running_maximum(x: np.ndarray, reach: int) -> np.ndarray:
    """Maximum over the ``reach`` entries that end at each place (the place itself included)."""
    size = -(-len(x) // reach) * reach
    blocks = np.full(size, -np.inf)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, reach)
    ahead = np.maximum.accumulate(blocks, axis=1).ravel()
    behind = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = ahead.copy()
    out[reach - 1 :] = np.maximum(ahead[reach - 1 :], behind[: size - reach + 1])
    return out[: len(x)]


def local_peaks(values: np.ndarray, half_width: int) -> np.ndarray:
    """True where a sample is the maximum of its neighbourhood and no earlier sample there equals it.

    The first and the last sample are never peaks: the signal is not seen falling on both sides.
    """
    x = np.where(np.isnan(values), -np.inf, values)
    none = np.array([-np.inf])
    earlier = np.concatenate([none, running_maximum(x, half_width)[:-1]])
    later = np.concatenate([running_maximum(x[::-1], half_width)[::-1][1:], none])
    peaks = (x > earlier) & (x >= later) & ~np.isnan(values)
    peaks[[0, -1]] = False
    return peaks


def moving_mean(values: np.ndarray, half_width: int) -> np.ndarray:
    """Mean of the present samples within the half width on both sides."""
    known = ~np.isnan(values)
    sums = np.concatenate([[0.0], np.cumsum(np.where(known, values, 0.0))])
    counts = np.concatenate([[0], np.cumsum(known)])
    at = np.arange(len(values))
    low, high = np.maximum(at - half_width, 0), np.minimum(at + half_width + 1, len(values))
    n = counts[high] - counts[low]
    return np.where(n > 0, (sums[high] - sums[low]) / np.maximum(n, 1), np.nan)


def mark_peaks(rows: DataFrame, part: Sequence[str], idx: str, config: PhysioConfig) -> DataFrame:
    """Annotate samples with the tonic level and with flags for the local extremes of each signal.

    A sliding maximum over a thousand rows costs a thousand steps per row as a window frame, so the
    neighbourhoods are taken with numpy, one chunk (a fixed number of samples) at a time.
    """
    clean = rows.select(*part, idx, *[finite(s).alias(s) for s in SIGNALS])
    marks = ["_ecg_peak", "_scr_peak", "_breath_peak", "_breath_trough"]
    schema = StructType(
        [
            *clean.schema.fields,
            StructField("_tonic", DoubleType()),
            StructField("_phasic", DoubleType()),
            *[StructField(m, BooleanType()) for m in marks],
        ]
    )

    def mark(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(idx)
        ecg, eda, breath = (chunk.column(s).to_numpy().astype(float) for s in SIGNALS)
        tonic = moving_mean(eda, config.tonic_half_width)
        phasic = eda - tonic
        added = {
            "_tonic": tonic,
            "_phasic": phasic,
            "_ecg_peak": local_peaks(ecg, config.ecg_half_width),
            "_scr_peak": local_peaks(phasic, config.eda_half_width),
            "_breath_peak": local_peaks(breath, config.resp_half_width),
            "_breath_trough": local_peaks(-breath, config.resp_half_width),
        }
        for name, values in added.items():
            chunk = chunk.append_column(name, pa.array(values, from_pandas=True))
        return chunk

    return clean.groupBy(*part).applyInArrow(mark, schema)


def _points(flag: str, idx: str, value: str) -> Column:
    """Candidate extremes of one window in time order."""
    return F.sort_array(
        F.collect_list(F.when(F.col(flag), F.struct(F.col(idx).cast("bigint").alias("at"), F.col(value).alias("v"))))
    )


def _mean(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(items) > 0, total / F.size(items))


def _std_samp(items: Column) -> Column:
    m = _mean(items)
    squares = F.aggregate(items, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(items) > 1, F.sqrt(squares / (F.size(items) - 1)))


def _steps(items: Column) -> Column:
    """Differences of successive entries (empty below two)."""
    return F.transform(
        F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), lambda x, i: x - F.get(items, i)
    )


def _above(points: Column, floor: Column) -> Column:
    return F.filter(points, lambda p: p["v"] > floor)


def breath_depth(peak: Column) -> Column:
    """Height of a breathing peak over the last trough before it, NULL when there is none."""
    troughs = F.filter("_troughs", lambda t: t["at"] < peak["at"])
    return peak["v"] - F.get(troughs, F.size(troughs) - 1)["v"]


def _usable(signal: str, config: PhysioConfig) -> Column:
    return (F.col(f"_n_{signal}") >= config.rate) & (F.col(f"_sd_{signal}") >= config.min_std)


def physio_windows(
    samples: DataFrame,
    config: PhysioConfig = PhysioConfig(),
    keys: Sequence[str] = SESSION,
    idx: str = "sample_idx",
) -> DataFrame:
    """One row per full window of samples with heart, conductance and breathing features."""
    part = [*keys, CHUNK]
    length, step, per = config.length, config.step, config.windows_per_chunk
    reach = config.tonic_half_width + max(config.ecg_half_width, config.eda_half_width, config.resp_half_width)
    rows = window_chunks(samples, idx, length, step, per, pad=reach)
    marked = mark_peaks(rows, part, idx, config)
    stats = []
    for s in SIGNALS:
        stats += [
            F.count(s).alias(f"_n_{s}"),
            F.avg(s).alias(f"_mu_{s}"),
            F.stddev_pop(s).alias(f"_sd_{s}"),
        ]
    windows = (
        explode_windows(marked, idx, length, step, per)
        .groupBy(*part, WINDOW)
        .agg(
            F.count("*").alias("_n"),
            *stats,
            F.avg("_tonic").alias("_tonic_mean"),
            _points("_ecg_peak", idx, "ECG").alias("_beats"),
            _points("_scr_peak", idx, "_phasic").alias("_scr"),
            _points("_breath_peak", idx, "RR").alias("_peaks"),
            _points("_breath_trough", idx, "RR").alias("_troughs"),
        )
        .where(F.col("_n") == length)
    )
    return _physio_values(windows, config, keys)


def _physio_values(windows: DataFrame, config: PhysioConfig, keys: Sequence[str]) -> DataFrame:
    rate = F.lit(float(config.rate))
    high = {
        s: F.col(f"_mu_{s}") + F.lit(h) * F.col(f"_sd_{s}")
        for s, h in (("ECG", config.ecg_height), ("RR", config.resp_height))
    }
    beats = _above(F.col("_beats"), high["ECG"])
    scr = _above(F.col("_scr"), F.lit(config.scr_height) * F.col("_sd_EDA"))
    breaths = _above(F.col("_peaks"), high["RR"])
    picked = windows.withColumns({"_beats": beats, "_scr": scr, "_peaks": breaths})

    # Intervals between heart beats in ms, implausible ones left out.
    gaps = F.transform(_steps(F.transform("_beats", lambda p: p["at"])), lambda d: d / rate * 1000)
    kept = F.filter(gaps, lambda g: (g > 300) & (g < 2000))
    listed = picked.withColumns(
        {
            "_rr": F.when(_usable("ECG", config) & (F.size("_beats") >= 3), kept),
            "_depth": F.filter(F.transform("_peaks", breath_depth), lambda d: d.isNotNull()),
            "_cycle": F.transform(_steps(F.transform("_peaks", lambda p: p["at"])), lambda d: d / rate),
        }
    )
    enough = F.size("_rr") >= 2
    values = listed.withColumns(
        {
            "hr": F.when(enough, F.lit(60000.0) / _mean(F.col("_rr"))),
            "sdnn": F.when(enough, _std_samp(F.col("_rr"))),
            "rmssd": F.when(enough, F.sqrt(_mean(F.transform(_steps(F.col("_rr")), lambda d: d * d)))),
        }
    )
    eda, resp = _usable("EDA", config), _usable("RR", config)
    t_start, t_end = window_bounds(config.length, config.step, config.rate)
    unit = F.transform("_depth", lambda d: d / F.col("_sd_RR"))
    return values.select(
        *keys,
        WINDOW,
        t_start,
        t_end,
        "hr",
        "rmssd",
        "sdnn",
        F.when(eda, (F.col("_tonic_mean") - F.col("_mu_EDA")) / F.col("_sd_EDA")).alias("scl"),
        F.when(eda, F.size("_scr").cast("double")).alias("scr_count"),
        F.when(eda, _mean(F.transform("_scr", lambda p: p["v"] / F.col("_sd_EDA")))).alias("scr_amplitude_mean"),
        F.when(resp, F.lit(60.0) / _mean(F.col("_cycle"))).alias("resp_rate"),
        F.when(resp, _mean(unit)).alias("resp_amplitude_mean"),
        F.when(resp, _std_samp(unit)).alias("resp_variability"),
        F.when(F.col("hr").isNull(), F.lit(0.0))
        .when(F.col("hr").between(40, 180) & F.col("rmssd").isNotNull(), F.lit(1.0))
        .otherwise(F.lit(0.3))
        .alias("ecg_quality"),
    )


def normalized_windows(
    samples: DataFrame,
    value: str,
    length: int,
    step: int,
    keys: Sequence[str] = SESSION,
    idx: str = "sample_idx",
    windows_per_chunk: int = 32,
    min_std: float = 1e-6,
) -> DataFrame:
    """Every sample of every full window as z-score of its window; zeros where the window is constant."""
    # Samples travel once per chunk; their four windows are made behind the exchange.
    rows = window_chunks(samples, idx, length, step, windows_per_chunk).repartition(*keys, CHUNK)
    each = explode_windows(rows, idx, length, step, windows_per_chunk)
    window = Window.partitionBy(*keys, CHUNK, WINDOW)
    signal = finite(value)
    scored = each.withColumns(
        {
            "_n": F.count("*").over(window),
            "_mu": F.avg(signal).over(window),
            "_sd": F.stddev_pop(signal).over(window),
        }
    ).where(F.col("_n") == length)
    z = F.when(F.col("_sd") < min_std, F.lit(0.0)).otherwise((signal - F.col("_mu")) / F.col("_sd"))
    return scored.select(*keys, WINDOW, idx, z.alias("z"))
