"""Technical metrics of decoded pictures: rows of pixel bytes in, one row for each metric with its threshold and severity out.

Decoding and scaling to the analysis size come before (no image library is needed here). A picture is one row, so its metrics need no shuffle; batches
travel by Arrow, and a task holds one picture's arrays at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.sources.tables import table

S = SparkSession
#: Codes with the least or the greatest value that is not a violation; others have no threshold that can be violated.
AT_LEAST = {"rgb_entropy": 2.5, "luminance_std": 10.0, "laplacian_variance": 16.0}
AT_MOST = {"black_pixel_ratio": 0.90, "white_pixel_ratio": 0.90, "high_frequency_ratio": 0.32, "black_border_ratio": 0.03, "white_border_ratio": 0.03, "blockiness": 0.35}
#: Darkest and brightest grey that count as black and white; borders; edge thresholds; longest side of a spectrum.
BLACK, WHITE = 12, 243
BORDER_COVER, BORDER_DEPTH, BORDER_DROP = 0.995, 0.005, 0.60
EDGE_LOW, EDGE_HIGH = 100, 200
SPECTRUM_SIDE = 512


def on_white(rgba: np.ndarray) -> np.ndarray:
    """Colours over a white ground, cut to whole numbers."""
    share = rgba[..., 3:].astype(np.float32) / 255
    return (rgba[..., :3] * share + 255 * (1 - share)).astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of ITU-R BT.601 in 15-bit fixed point, rounded."""
    return ((rgb.astype(np.int64) @ np.array([9798, 19235, 3735]) + 16384) >> 15).astype(np.uint8)


def around(g: np.ndarray, edge: str = "reflect") -> Callable[[int, int], np.ndarray]:
    """Neighbours of all pixels at an offset; beyond the border the picture is mirrored without its outermost line (or repeats it)."""
    h, w = g.shape
    pads = [(1, 1) if n > 1 else (0, 0) for n in (h, w)]
    p = np.pad(np.pad(g.astype(np.int64), pads, mode=edge), [(0, 0) if n > 1 else (1, 1) for n in (h, w)], mode="edge")
    return lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def entropy(channel: np.ndarray) -> float:
    n = np.unique(channel, return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def laplacian_variance(g: np.ndarray) -> float:
    at = around(g)
    return float((at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * at(0, 0)).var())


def by_area(g: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` pixels a side: each new pixel is the mean of the area that it covers."""
    big = max(g.shape)
    if big <= most:
        return g.astype(np.float64)
    out = g.astype(np.float64)
    for axis, n in enumerate(g.shape):
        m = max(1, round(n * most / big))
        edges = np.arange(m + 1) * (n / m)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        low = np.minimum(edges.astype(int), n - 1)
        part = (edges - low).reshape([-1 if a == axis else 1 for a in range(2)])
        upto = total.take(low, axis) + out.take(low, axis) * part
        out = np.diff(upto, axis=axis) / (n / m)
    return np.rint(out)


def high_frequency_ratio(g: np.ndarray) -> float:
    """Share of the spectrum's power, without its mean, at a quarter of the shorter side or more from the centre."""
    x = by_area(g, SPECTRUM_SIDE)
    h, w = x.shape
    power = np.abs(np.fft.fft2(x)) ** 2
    power[0, 0] = 0
    total = power.sum()
    if total <= 1e-6 * x.size:  # a plain picture: only rounding is left
        return 0.0
    far = np.hypot((np.fft.fftfreq(h) * h)[:, None], (np.fft.fftfreq(w) * w)[None, :]) >= min(h, w) * 0.25
    return float(power[far].sum() / total)


def edges(g: np.ndarray) -> np.ndarray:
    """Edge pixels: peaks of the Sobel gradient (sum of both absolute parts) across its direction over the high threshold, and what hangs on them over the low."""
    at = around(g, "edge")
    dx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    dy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(dx) + np.abs(dy)
    wide = np.pad(size, 1)
    h, w = size.shape
    near = lambda y, x: wide[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(dy) < slope * np.abs(dx), np.abs(dy) * slope > np.abs(dx)
    same = (dx < 0) == (dy < 0)
    diagonal = np.where(same, (size > near(-1, -1)) & (size > near(1, 1)), (size > near(-1, 1)) & (size > near(1, -1)))
    peak = np.where(flat, (size > near(0, -1)) & (size >= near(0, 1)), np.where(steep, (size > near(-1, 0)) & (size >= near(1, 0)), diagonal))
    weak = peak & (size > EDGE_LOW)
    on = weak & (size > EDGE_HIGH)
    todo = list(zip(*np.nonzero(on), strict=True))
    while todo:
        y, x = todo.pop()
        for a in range(max(0, y - 1), min(h, y + 2)):
            for b in range(max(0, x - 1), min(w, x + 2)):
                if weak[a, b] and not on[a, b]:
                    on[a, b] = True
                    todo.append((a, b))
    return on


def _strip(cover: np.ndarray) -> int:
    """Depth of the run of covered lines from the start, 0 if it is too thin, everything, or fades out."""
    n = len(cover)
    bare = np.flatnonzero(cover < BORDER_COVER)
    depth = int(bare[0]) if len(bare) else n
    if depth == n or depth < max(1, -(-n * BORDER_DEPTH // 1)):
        return 0
    return depth if cover[:depth].mean() - cover[depth] >= BORDER_DROP else 0


def border_ratio(mask: np.ndarray) -> float:
    """The larger share of lines in two opposite strips that are covered; one strip alone is no border."""
    best = 0.0
    for cover in (mask.mean(1), mask.mean(0)):
        a, b = _strip(cover), _strip(cover[::-1])
        if a and b and a + b < len(cover):
            best = max(best, (a + b) / len(cover))
    return best


def blockiness(g: np.ndarray) -> float:
    """How much larger steps over the lines of a grid of eight are than other steps."""
    if min(g.shape) < 16:
        return 0.0
    total, count = np.zeros(2), np.zeros(2)
    for axis in (0, 1):
        step = np.abs(np.diff(g.astype(np.float64), axis=axis)).sum(1 - axis)
        on = (np.arange(len(step)) % 8 == 7).astype(int)
        total += np.bincount(on, step, 2)
        count += np.bincount(on, minlength=2) * g.shape[1 - axis]
    inner, line = total / np.maximum(count, 1)
    return float(max(0.0, (line - inner) / max(inner, 1.0)))


def metrics(rgba: np.ndarray) -> dict[str, float]:
    """All metrics of an array of height x width x 4 bytes (red, green, blue, alpha)."""
    rgb, alpha = on_white(rgba), rgba[..., 3]
    g = grey(rgb)
    top, low = rgb.max(2).astype(np.float64), rgb.min(2)
    return {
        "rgb_entropy": sum(entropy(rgb[..., c]) for c in range(3)) / 3,
        "black_pixel_ratio": float((g <= BLACK).mean()),
        "white_pixel_ratio": float((g >= WHITE).mean()),
        "luminance_std": float(g.std()),
        "laplacian_variance": laplacian_variance(g),
        "high_frequency_ratio": high_frequency_ratio(g),
        "edge_density": float(edges(g).mean()),
        "black_border_ratio": border_ratio(g <= BLACK),
        "white_border_ratio": border_ratio(g >= WHITE),
        "blockiness": blockiness(g),
        "transparent_pixel_ratio": float((alpha < 255).mean()),
        "fully_transparent_ratio": float((alpha == 0).mean()),
        "alpha_edge_ratio": float(((alpha > 0) & (alpha < 255)).mean()),
        "mean_saturation": float(np.rint(np.divide((top - low) * 255, top, out=np.zeros_like(top), where=top > 0)).mean() / 255),
    }


def measure_pixels(pictures: DataFrame) -> DataFrame:
    """(sample_id, code, value, threshold, severity, review_only) from (sample_id, width, height, pixels: binary of width x height x 4 bytes).

    A null, empty or torn picture gives one row of code ``metric_error`` without value; repeated ids give repeated rows; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, w, h, raw in zip(*(c for c in batch.columns), strict=True):
                i, w, h = i.as_py(), w.as_py() or 0, h.as_py() or 0
                buffer = raw.as_buffer() if raw.is_valid else b""
                if w < 1 or h < 1 or len(buffer) != 4 * w * h:
                    rows.append((i, "metric_error", None, None, "high", False))
                    continue
                for code, value in metrics(np.frombuffer(buffer, np.uint8).reshape(h, w, 4)).items():
                    bad = value < AT_LEAST[code] if code in AT_LEAST else code in AT_MOST and value > AT_MOST[code]
                    limit = 1.0 if code == "fully_transparent_ratio" else AT_LEAST.get(code, AT_MOST.get(code))
                    rows.append((i, code, value, limit, "medium" if bad else "info", code == "laplacian_variance"))
            schema = pa.schema([("sample_id", pa.int64()), ("code", pa.string()), ("value", pa.float64()), ("threshold", pa.float64()), ("severity", pa.string()), ("review_only", pa.bool_())])
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in schema.names}, schema=schema)

    return pictures.select("sample_id", "width", "height", "pixels").mapInArrow(run, "sample_id long, code string, value double, threshold double, severity string, review_only boolean")


SIDE = 32


def text_pictures(spark: S, sf: str) -> DataFrame:
    """Each text's bytes as a picture 32 pixels wide, its last line filled with zeros."""
    raw = F.encode("text", "UTF-8")
    line = 4 * SIDE
    lines = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / line)).cast("int")
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("sample_id"), F.lit(SIDE).alias("width"), lines.alias("height"), F.rpad(raw, lines * line, F.lit(b"\0")).alias("pixels"))


@query()
def pixel_metrics(spark: S, sf: str) -> DataFrame:
    """Metrics over the texts' bytes. Spectra and edges have no SQL; tests hold each metric against loops over pixels."""
    return measure_pixels(text_pictures(spark, sf)).withColumn("value", F.round("value", 9))



@query("SELECT doc_id AS sample_id, 32 AS width, CAST(greatest(1, ceil(octet_length(encode(text)) / 128.0)) AS INT) AS height, sha256(hex(encode(text)) || repeat('00', CAST(128 * greatest(1, ceil(octet_length(encode(text)) / 128.0)) - octet_length(encode(text)) AS INT))) AS digest FROM documents WHERE text IS NOT NULL")
def picture_digests(spark: S, sf: str) -> DataFrame:
    """Digest of each picture's pixels (hex)."""
    return text_pictures(spark, sf).select("sample_id", "width", "height", F.sha2(F.hex("pixels"), 256).alias("digest"))
