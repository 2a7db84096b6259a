"""Image kernels on arrays of bytes (height, width, channels in blue, green, red), and as columns over binary pixels.

Written with numpy alone. Equality to the last bit with a native image library
is not claimed; borders are reflected without repeating the edge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Estimated dots an inch by the longer side in pixels, and the default goal.
RESOLUTION_BANDS = ((500, 300), (700, 600), (900, 900))
HIGH_RESOLUTION = 1500
# Hues (0 to 180), saturation and value of red.
RED_HUES, RED_SATURATION, RED_VALUE = ((0, 15), (155, 180)), (30, 255), (30, 255)
# Width and height of an A4 page in millimetres.
A4 = (210, 297)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299).astype(np.uint8)


def _window_sums(x: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    padded = np.pad(x, r, mode="reflect" if min(x.shape) > r else "edge")
    total = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1))
    total[1:, 1:] = padded.cumsum(axis=0).cumsum(axis=1)
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def mean_threshold(image: np.ndarray, block: int = 25, c: float = 5) -> np.ndarray:
    g = grey(image).astype(float)
    return np.where(g > _window_sums(g, block) / block**2 - c, 255, 0).astype(np.uint8)


def gaussian(x: np.ndarray, size: int) -> np.ndarray:
    """Blur; an even size is raised by one."""
    size += 1 - size % 2
    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    kernel = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = x.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        padded = np.pad(out, pad, mode="reflect" if out.shape[axis] > r else "edge")
        out = sum(k * np.take(padded, np.arange(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def gaussian_threshold(image: np.ndarray, block: int = 25, c: float = 5) -> np.ndarray:
    g = grey(image).astype(float)
    return np.where(g > gaussian(g, block) - c, 255, 0).astype(np.uint8)


def sauvola(image: np.ndarray, window: int = 15, k: float = 0.5, dynamic: float = 128) -> np.ndarray:
    g = grey(image).astype(float)
    mean = _window_sums(g, window) / window**2
    deviation = np.sqrt(np.maximum(_window_sums(g * g, window) / window**2 - mean**2, 0))
    return np.where(g > mean * (1 + k * (deviation / dynamic - 1)), 255, 0).astype(np.uint8)


BINARIZE: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gaussian": gaussian_threshold, "mean": mean_threshold, "sauvola": sauvola}


def binarize(image: np.ndarray, method: str = "gaussian") -> np.ndarray:
    if method not in BINARIZE:
        raise ValueError(f"unknown method {method}; there are {', '.join(BINARIZE)}")
    return BINARIZE[method](image)


def denoise(image: np.ndarray, size: int = 3) -> np.ndarray:
    return np.rint(gaussian(image, size)).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue from 0 to 180, saturation and value from 0 to 255."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    v, low = image.max(axis=2).astype(float), image.min(axis=2).astype(float)
    d = v - low
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(v == r, (g - b) / d, np.where(v == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 30
        s = np.where(v > 0, d * 255 / v, 0)
    return np.stack([np.where(d > 0, h % 180, 0), s, v], axis=2)


def _dilate(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def _erode(mask: np.ndarray) -> np.ndarray:
    return ~_dilate(~mask) if mask.size else mask


def red_pixels(image: np.ndarray, hues: tuple[tuple[int, int], ...] = RED_HUES, saturation: tuple[int, int] = RED_SATURATION, value: tuple[int, int] = RED_VALUE) -> np.ndarray:
    x = hsv(image)
    red = np.zeros(image.shape[:2], bool)
    for lo, hi in hues:
        red |= (x[..., 0] >= lo) & (x[..., 0] <= hi)
    return red & (x[..., 1] >= saturation[0]) & (x[..., 1] <= saturation[1]) & (x[..., 2] >= value[0]) & (x[..., 2] <= value[1])


def remove_red(image: np.ndarray, hues: tuple[tuple[int, int], ...] = RED_HUES, saturation: tuple[int, int] = RED_SATURATION, value: tuple[int, int] = RED_VALUE) -> np.ndarray:
    """Red pixels become white, after opening and closing their mask with a cross."""
    red = red_pixels(image, hues, saturation, value)
    red = _erode(_dilate(_dilate(_erode(red))))
    out = image.copy()
    out[red] = 255
    return out


def scale_factor(height: int, width: int, target: int = HIGH_RESOLUTION) -> float:
    longest = max(height, width)
    now = next((dpi for most, dpi in RESOLUTION_BANDS if longest < most), HIGH_RESOLUTION)
    return max(1.0, target / now)


def _cubic(d: np.ndarray) -> np.ndarray:
    return np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3, 0))


def _lanczos(d: np.ndarray) -> np.ndarray:
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0)


def resize(image: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray] = _cubic, reach: int = 2) -> np.ndarray:
    """Interpolation by a kernel of the distance, cubic by default; edge pixels go on outside."""
    out = image.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        at = (np.arange(size) + 0.5) * n / size - 0.5
        base = np.floor(at).astype(int)
        total, weights = 0, 0
        for k in range(1 - reach, reach + 1):
            w = kernel(np.abs(at - base - k))
            shape = [1] * out.ndim
            shape[axis] = size
            total = total + np.take(out, np.clip(base + k, 0, n - 1), axis=axis) * w.reshape(shape)
            weights = weights + w.reshape(shape)
        out = total / weights
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers."""
    out = image.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        edges = np.arange(size + 1) * n / size
        covered = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
        out = np.moveaxis(np.tensordot(covered * size / n, out, (1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def adjust_resolution(image: np.ndarray, target: int = HIGH_RESOLUTION) -> np.ndarray:
    f = scale_factor(*image.shape[:2], target)
    return image if f == 1 else resize(image, int(image.shape[0] * f), int(image.shape[1] * f))


def _labels(mask: np.ndarray) -> np.ndarray:
    """For each pixel of the mask the least place in its component of eight neighbours, elsewhere -1."""
    h, w = mask.shape
    none = h * w
    label = np.full((h + 2, w + 2), none)
    label[1:-1, 1:-1] = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        least = label.copy()
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                least[1:-1, 1:-1] = np.minimum(least[1:-1, 1:-1], label[dy : dy + h, dx : dx + w])
        inner = np.append(np.where(mask, least[1:-1, 1:-1], none).ravel(), none)
        inner = np.where(inner < none, inner[inner], none)  # on to what the least place itself is joined to
        new = inner[:-1].reshape(h, w)
        if (new == label[1:-1, 1:-1]).all():
            return np.where(mask, new, -1)
        label[1:-1, 1:-1] = new


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Pixels where the gradient is greatest across its direction, at least low, and joined to one of high at least."""
    p = np.pad(grey(image).astype(float), 1, mode="edge")
    dx = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    dy = (p[2:, :-2] - p[:-2, :-2]) + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + (p[2:, 2:] - p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    h, w = size.shape
    m = np.pad(size, 1)
    at = lambda y, x: m[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    flat, steep, same = np.abs(dy) <= np.tan(np.pi / 8) * np.abs(dx), np.abs(dy) >= np.tan(3 * np.pi / 8) * np.abs(dx), dx * dy > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    weak = (size > low) & (size > before) & (size >= after)
    label = _labels(weak)
    return weak & np.isin(label, np.unique(label[weak & (size > high)]))


def text_height(image: np.ndarray) -> float | None:
    """The median height of what edges enclose, out of boxes of 6 to 99 pixels' height and 6 to 199 pixels' width that lie in no other box; null without any."""
    mask = edges(image)
    if not mask.any():
        return None
    y, x = np.nonzero(mask)
    _, of = np.unique(_labels(mask)[y, x], return_inverse=True)
    n = of.max() + 1
    top, left, bottom, right = np.full(n, mask.shape[0]), np.full(n, mask.shape[1]), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(top, of, y), np.minimum.at(left, of, x), np.maximum.at(bottom, of, y), np.maximum.at(right, of, x)
    inside = np.zeros(n, bool)
    for i in np.argsort(-(bottom - top) * (right - left)).tolist():
        if not inside[i]:
            inside |= (top > top[i]) & (left > left[i]) & (bottom < bottom[i]) & (right < right[i])
    h, w = bottom - top + 1, right - left + 1
    kept = ~inside & (h > 5) & (h < 100) & (w > 5) & (w < 200)
    return float(np.median(h[kept])) if kept.any() else None


def diagnose(image: np.ndarray) -> dict[str, float | None]:
    """Estimated dots an inch of an A4 page (the mean of both directions), sharpness (variance of the Laplacian), contrast, share of red pixels in percent, height of text in pixels."""
    g = grey(image).astype(float)
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    red = red_pixels(image).mean() * 100 if image.ndim == 3 and image.shape[2] == 3 else 0
    dpi = (g.shape[1] / A4[0] + g.shape[0] / A4[1]) * 25.4 / 2
    return {"dpi": dpi, "sharpness": float(laplacian.var()), "contrast": float(g.max() - g.min()), "red_percent": float(red), "text_height": text_height(image)}


def equalised(channel: np.ndarray, clip: float = 3, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation in tiles x tiles parts, histograms cut at clip times their mean, tables interpolated between the parts."""
    h, w = channel.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    pad = ((0, th * tiles - h), (0, tw * tiles - w))
    x = np.pad(channel, pad, mode="reflect" if all(n > p for n, (_, p) in zip(channel.shape, pad)) else "edge")
    parts = x.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(p, minlength=256) for p in parts])
    most = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for row, rest in zip(counts, (over % 256).tolist()):
        if rest:
            row[np.arange(0, 256, max(1, 256 // rest))[:rest]] += 1
    table = np.clip(np.rint(np.cumsum(counts, axis=1) * 255 / (th * tw)), 0, 255).reshape(tiles, tiles, 256)

    def between(n, size):
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = between(h, th)
    x0, x1, fx = between(w, tw)
    y0, y1, fy = y0[:, None], y1[:, None], fy[:, None]
    upper = table[y0, x0, channel] * (1 - fx) + table[y0, x1, channel] * fx
    lower = table[y1, x0, channel] * (1 - fx) + table[y1, x1, channel] * fx
    return np.clip(np.rint(upper * (1 - fy) + lower * fy), 0, 255).astype(np.uint8)


# From linear red, green and blue to the CIE coordinates of daylight, and its white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def more_contrast(image: np.ndarray, clip: float = 3, tiles: int = 8) -> np.ndarray:
    """Lightness equalised in tiles, colours as they were; a grey image is its own lightness."""
    if image.ndim == 2 or image.shape[2] == 1:
        return equalised(image.reshape(image.shape[:2]), clip, tiles).reshape(image.shape)
    rgb = image[..., ::-1] / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.clip(np.rint((116 * f[..., 1] - 16) * 255 / 100), 0, 255).astype(np.uint8)
    new = (equalised(light, clip, tiles) * 100 / 255 + 16) / 116
    f = f + (new - f[..., 1])[..., None]
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(rgb[..., ::-1] * 255), 0, 255).astype(np.uint8)


def preprocess(image: np.ndarray, watermark: bool = True, method: str | None = None, blur: int | None = None, target: int | None = HIGH_RESOLUTION) -> np.ndarray:
    """Watermark, binarisation, noise, resolution, in this order, each if asked for."""
    if watermark and image.ndim == 3 and image.shape[2] == 3:
        image = remove_red(image)
    if method:
        image = binarize(image, method)
    if blur:
        image = denoise(image, blur)
    return adjust_resolution(image, target) if target else image


def over_pixels(kernel: Callable[[np.ndarray], np.ndarray]):
    """A column function (pixels, height, width, channels) -> pixels; null pixels, or such that don't fit the size, give null."""

    @F.pandas_udf(T.BinaryType())
    def apply(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for p, h, w, c in zip(pixels, height, width, channels):
            fits = p is not None and len(p) == h * w * c and len(p) > 0
            out.append(kernel(np.frombuffer(p, np.uint8).reshape((h, w, c) if c > 1 else (h, w))).tobytes() if fits else None)
        return pd.Series(out, dtype=object)

    return apply


def measures():
    """A column function (pixels, height, width, channels) -> the struct of what diagnose() tells; null as in over_pixels()."""
    names = ("dpi", "sharpness", "contrast", "red_percent", "text_height")

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def apply(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, w, c in zip(pixels, height, width, channels):
            fits = p is not None and len(p) == h * w * c and len(p) > 0
            out.append(diagnose(np.frombuffer(p, np.uint8).reshape((h, w, c) if c > 1 else (h, w))) if fits else dict.fromkeys(names))
        return pd.DataFrame(out, columns=names).astype(float)

    return apply


def resolution_plan(height: Column, width: Column, target: int = HIGH_RESOLUTION) -> Column:
    """Struct of dpi, scale, new_height and new_width."""
    longest = F.greatest(height, width)
    dpi = F.when(longest < 500, 300).when(longest < 700, 600).when(longest < 900, 900).otherwise(HIGH_RESOLUTION)
    scale = F.greatest(F.lit(1.0), F.lit(float(target)) / dpi)
    return F.struct(dpi.cast("long").alias("dpi"), scale.alias("scale"), F.floor(height * scale).cast("long").alias("new_height"), F.floor(width * scale).cast("long").alias("new_width"))


def quality_bands(dpi: Column, sharpness: Column, contrast: Column, red: Column, height: Column) -> Column:
    """good, fair or poor for each measure."""
    up = lambda x, fair, good: F.when(x >= good, "good").when(x >= fair, "fair").otherwise("poor")
    return F.struct(up(dpi, 200, 300).alias("dpi"), up(sharpness, 100, 500).alias("sharpness"), up(contrast, 100, 150).alias("contrast"), F.when(red <= 3, "good").when(red <= 10, "fair").otherwise("poor").alias("red"), F.when(height.isNotNull(), up(height, 15, 25)).alias("text_height"))


def png(image: np.ndarray) -> bytes:
    """The image as a PNG file (grey, or colour given as blue, green, red)."""
    import struct
    import zlib

    colour = image.ndim == 3 and image.shape[2] == 3
    rows = image[..., ::-1] if colour else grey(image)
    h, w = rows.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows.reshape(h, -1)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if colour else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def compress_to_limit(image: np.ndarray, limit: int, encode: Callable[[np.ndarray, int], bytes], least: int = 50) -> bytes:
    """Lower quality from 95 by tens down to least, then at least's quality smaller from 0.9 to 0.3, then quality 30, until the file fits; the last try is returned if none does. encode(image, quality) gives a file."""
    for quality in range(95, least - 1, -10):
        if len(out := encode(image, quality)) <= limit:
            return out
    for tenths in range(9, 2, -1):
        small = shrink(image, max(1, image.shape[0] * tenths // 10), max(1, image.shape[1] * tenths // 10))
        if len(out := encode(small, least)) <= limit:
            return out
    return encode(small, 30)


def smart_save(image: np.ndarray, encode: Callable[[np.ndarray, int], bytes], limit: int = int(4.5 * 1024 * 1024)) -> tuple[bytes, str]:
    """A PNG file if it fits, else one that is compressed to the limit."""
    whole = png(image)
    return (whole, "png") if len(whole) <= limit else (compress_to_limit(image, limit, encode), "jpg")


def compression_totals(files, limit: int):
    """Totals of a batch (length, new_length, error): files, compressed, skipped because they fit, failed, bytes saved."""
    fits, failed = F.col("length") <= limit, F.col("error").isNotNull()
    return files.agg(F.count("*").alias("total"), F.count_if(~fits & ~failed).alias("compressed"), F.count_if(fits & ~failed).alias("skipped"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(~fits & ~failed, F.col("length") - F.col("new_length"))), F.lit(0)).alias("space_saved"))


def enhance(image: np.ndarray, least: int = 2000, contrast: float = 1.3, sharpness: float = 1.5) -> np.ndarray:
    """Grey, both sides at least so large, with more contrast around the mean, and sharper."""
    g = at_least(grey(image), least).astype(float)
    g = np.clip(g.mean() + contrast * (g - g.mean()), 0, 255)
    return np.clip(np.rint(g + (sharpness - 1) * (g - gaussian(g, 3))), 0, 255).astype(np.uint8)


def at_least(image: np.ndarray, least: int = 1000) -> np.ndarray:
    """Enlarged until both sides have so many pixels."""
    height, width = image.shape[:2]
    f = max(least / height, least / width)
    return image if min(height, width) >= least else resize(image, max(least, int(height * f)), max(least, int(width * f)), _lanczos, 3)


def compare_configs(pages, configs: dict[str, dict], read: Callable[[np.ndarray], str], keywords: tuple[str, ...], key: str = "page_id"):
    """(key, config, chars, keywords, error): each page (key, pixels, height, width, channels) preprocessed by each configuration, then read.

    configs: options of preprocess() by name, of which there are few; a page is
    sent to a worker once.
    """
    kind = dict(pages.dtypes)[key]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"key": [], "config": [], "chars": [], "keywords": [], "error": []}
            for k, p, h, w, c in zip(*(batch.column(x).to_pylist() for x in (key, "pixels", "height", "width", "channels"))):
                for name, options in configs.items():
                    text, error = "", None
                    try:
                        text = read(preprocess(np.frombuffer(p, np.uint8).reshape((h, w, c) if c > 1 else (h, w)), **options))
                    except Exception as failed:  # of the caller's reader, or of a page that is no image
                        error = str(failed)[:500]
                    for column, value in zip(out, (k, name, len(text), sum(x in text for x in keywords), error)):
                        out[column].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], type=batch.schema.field(key).type), pa.array(out["config"], pa.string()), pa.array(out["chars"], pa.int64()), pa.array(out["keywords"], pa.int64()), pa.array(out["error"], pa.string())], names=[key, "config", "chars", "keywords", "error"])

    return pages.select(key, "pixels", "height", "width", "channels").mapInArrow(work, f"`{key}` {kind}, config string, chars long, keywords long, error string")
