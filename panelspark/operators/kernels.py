"""Kernels over whole images: crop, resize, contrast, median, edges, dilation, filling, stacking and row slices.

An image is a row (img_id, h, w, channels, data) with ``data`` its bytes, row by row. Each kernel is a function of arrays
that one Arrow batch calls for each of its images; images are independent, so nothing is shuffled but what ``stack`` joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "img_id long, h int, w int, channels int, data binary"
_NAMES, _TYPES = ["img_id", "h", "w", "channels", "data"], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
#: Shares of red, green and blue in 2**14 parts of gray; the edge directions' limit, tan(22.5 deg) in 2**15 parts.
GRAY_PARTS, GRAY_BITS, SLOPE, SLOPE_BITS = (4899, 9617, 1868), 14, 13573, 15
#: Margin of a text box in its mask, least side of what is masked, edge limits of a mask and of rows.
BOX_MARGIN, LEAST_SIDE, MASK_EDGES, ROW_EDGES = 5, 5, (50, 150), (30, 100)


def gray(rgb: np.ndarray) -> np.ndarray:
    """One gray level for each pixel, rounded; gray images stay."""
    if rgb.ndim == 2:
        return rgb
    return ((rgb.astype(np.int32) @ np.array(GRAY_PARTS, np.int32) + (1 << GRAY_BITS - 1)) >> GRAY_BITS).astype(np.uint8)


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The part of a box that lies in the image; it may be empty."""
    x1, y1 = max(0, x1), max(0, y1)
    return image[y1 : max(y1, y2), x1 : max(x1, x2)]


def _lanczos(size: int, out: int, lobes: int) -> np.ndarray:
    """Weights[out, size] of a windowed sinc; shrinking widens it, the border repeats."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale - 0.5
    reach = int(np.ceil(lobes * wide))
    at = np.floor(centre).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
    off = (at - centre[:, None]) / wide
    weight = np.where(np.abs(off) < lobes, np.sinc(off) * np.sinc(off / lobes), 0)
    weight /= weight.sum(axis=1, keepdims=True)
    table = np.zeros((out, size))
    np.add.at(table, (np.arange(out)[:, None], at.clip(0, size - 1)), weight)
    return table


def resize(image: np.ndarray, h: int, w: int, lobes: int = 4) -> np.ndarray:
    """The image at another size, by Lanczos weights along either side."""
    if 0 in image.shape[:2] or not h or not w:
        return np.zeros((h, w, *image.shape[2:]), np.uint8)
    rows = np.tensordot(_lanczos(image.shape[0], h, lobes), image.astype(float), axes=(1, 0))
    both = np.moveaxis(np.tensordot(_lanczos(image.shape[1], w, lobes), rows, axes=(1, 1)), 0, 1)
    return np.floor(both + 0.5).clip(0, 255).astype(np.uint8)


def equalize(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each tile's histogram is cut at ``clip`` times its mean, the excess is dealt
    over all levels, and pixels blend the curves of the four nearest tiles."""
    h, w = image.shape
    if not h or not w:
        return image
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(image, ((0, th * grid - h), (0, tw * grid - w)), mode="symmetric" if th * grid <= 2 * h and tw * grid <= 2 * w else "edge")
    tiles = padded.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, -1)
    count = np.stack([np.bincount(t, minlength=256) for t in tiles])
    limit = max(1, int(clip * th * tw / 256))
    excess = np.maximum(count - limit, 0).sum(axis=1)
    count = np.minimum(count, limit) + (excess // 256)[:, None]
    for k, rest in enumerate(excess % 256):  # what is left goes to levels at equal steps
        if rest:
            count[k, np.arange(0, 256, max(1, 256 // rest))[:rest]] += 1
    curve = np.floor(np.cumsum(count, axis=1) * (255 / (th * tw)) + 0.5).clip(0, 255).reshape(grid, grid, 256)
    y, x = (np.arange(h) / th - 0.5)[:, None], (np.arange(w) / tw - 0.5)[None]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    at = lambda a, b: curve[a.clip(0, grid - 1), b.clip(0, grid - 1), image]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def _neighbours(image: np.ndarray, reach: int = 1, mode: str = "edge", **more) -> np.ndarray:
    """A view [h, w, side, side] of each pixel's square."""
    side = 2 * reach + 1
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, reach, mode=mode, **more), (side, side))


def median3(image: np.ndarray) -> np.ndarray:
    """The middle of each pixel's 3 x 3 square; the border repeats."""
    if not image.size:
        return image
    return np.partition(_neighbours(image).reshape(*image.shape, 9), 4, axis=2)[:, :, 4]


def dilate(mask: np.ndarray, side: int = 5, times: int = 1) -> np.ndarray:
    """The greatest value of each pixel's square, so many times; beyond the border there is nothing."""
    reach = side // 2 * times
    for axis in (0, 1):
        if mask.shape[axis]:
            wide = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
            mask = np.lib.stride_tricks.sliding_window_view(np.pad(mask, wide), 2 * reach + 1, axis=axis).max(axis=2)
    return mask


def _spread(seed: np.ndarray, allowed: np.ndarray, corners: bool) -> np.ndarray:
    """All allowed pixels that a path of allowed neighbours joins to a seed. Each round visits only new pixels."""
    h, w = allowed.shape
    reached = np.zeros((h + 2, w + 2), bool)
    reached[1:-1, 1:-1] = seed & allowed
    free = np.zeros_like(reached)
    free[1:-1, 1:-1] = allowed
    free, flat = (free & ~reached).ravel(), reached.ravel()
    steps = [1, -1, w + 2, -w - 2] + ([w + 3, w + 1, -w - 3, -w - 1] if corners else [])
    new = np.flatnonzero(flat)
    while len(new):
        near = np.unique(np.concatenate([new + s for s in steps]))
        new = near[free[near]]
        flat[new] = True
        free[new] = False
    return flat.reshape(h + 2, w + 2)[1:-1, 1:-1]


def canny(image: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges by Canny's method: gradients of 3 x 3 Sobel sums, their absolute sum as strength, only ridges across the
    gradient's direction, and of those what is over ``high`` or joined to it by pixels over ``low``."""
    if not image.size:
        return np.zeros(image.shape, bool)
    n = _neighbours(image.astype(np.int64))
    smooth = np.array([1, 2, 1])
    dx = (n[:, :, :, 2] - n[:, :, :, 0]) @ smooth
    dy = (n[:, :, 2, :] - n[:, :, 0, :]) @ smooth
    strength = np.abs(dx) + np.abs(dy)
    m = _neighbours(strength, mode="constant")
    ax, ay = np.abs(dx), np.abs(dy) << SLOPE_BITS
    flat = ay < ax * SLOPE
    steep = ay > ax * SLOPE + (ax << SLOPE_BITS + 1)
    down = (dx ^ dy) >= 0  # the gradient points to the lower right or the upper left
    before = np.where(flat, m[:, :, 1, 0], np.where(steep, m[:, :, 0, 1], np.where(down, m[:, :, 0, 0], m[:, :, 0, 2])))
    after = np.where(flat, m[:, :, 1, 2], np.where(steep, m[:, :, 2, 1], np.where(down, m[:, :, 2, 2], m[:, :, 2, 0])))
    straight = flat | steep
    ridge = (strength > low) & (strength > before) & np.where(straight, strength >= after, strength > after)
    return _spread(ridge & (strength > high), ridge, True)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with the holes of its shapes: all that no path of background, side by side, joins to the border."""
    border = np.ones(mask.shape, bool)
    border[1:-1, 1:-1] = False
    return ~_spread(border, ~mask.astype(bool), False)


def text_mask(image: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Where text stands in its boxes: edges, dilated twice, with their holes; boxes overlap by union."""
    level = gray(image)
    out = np.zeros(level.shape, bool)
    for x1, y1, x2, y2 in boxes:
        x1, y1 = max(0, x1 - BOX_MARGIN), max(0, y1 - BOX_MARGIN)
        x2, y2 = min(level.shape[1], x2 + BOX_MARGIN), min(level.shape[0], y2 + BOX_MARGIN)
        if x2 - x1 >= LEAST_SIDE and y2 - y1 >= LEAST_SIDE:
            out[y1:y2, x1:x2] |= filled(dilate(canny(level[y1:y2, x1:x2], *MASK_EDGES), 5, 2))
    return out


def array_of(h: int, w: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape((h, w) if channels == 1 else (h, w, channels))


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int]]:
    for i in range(batch.num_rows):
        k, *rest = (batch.column(c)[i].as_py() for c in _NAMES)
        yield k, array_of(*rest), i


def each_image(images: DataFrame, kernel: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """The images after a kernel, which gets the array and the row's other ``columns``. Images without data drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, image, i in _images(batch):
                out = np.ascontiguousarray(kernel(image, *(batch.column(c)[i].as_py() for c in columns)).astype(np.uint8))
                row = (k, *out.shape[:2], out.shape[2] if out.ndim == 3 else 1, out.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)

    return images.where("data is not null").select(*_NAMES, *columns).mapInArrow(run, IMAGE)


def pixels(images: DataFrame) -> DataFrame:
    """(img_id, y, x, g) of gray images, for the operators over pixels in long form."""
    byte = F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    rows = images.where("h * w > 0").select("img_id", "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    return rows.select("img_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), byte.alias("g"))


def row_activity(images: DataFrame) -> DataFrame:
    """(img_id, y, row_std, edge_density): each pixel row's deviation and its share of edges, by Canny's method."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, image, _ in _images(batch):
                level = gray(image)
                edges = canny(level, *ROW_EDGES)
                n = len(level)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(level.std(axis=1, dtype=np.float64)), pa.array(edges.mean(axis=1))], ["img_id", "y", "row_std", "edge_density"])

    return images.where("h * w > 0").select(*_NAMES).mapInArrow(run, "img_id long, y int, row_std double, edge_density double")


def stacked(images: DataFrame, strip: str, order: str) -> DataFrame:
    """One image for each ``strip``: its images below each other in ``order``, all as wide as the first. A strip is one
    task's work; what is gathered is bounded by the strips' target height (see ``folds.merge_groups``)."""

    def run(table: pa.Table) -> pa.Table:
        ordered = table.take(pa.compute.sort_indices(table, sort_keys=[(order, "ascending"), ("img_id", "ascending")])).combine_chunks()
        parts = [image for b in ordered.to_batches() for _, image, _ in _images(b)]
        w = parts[0].shape[1]
        parts = [p if p.shape[1] == w else resize(p, int(p.shape[0] * (w / p.shape[1])), w, 3) for p in parts]
        out = np.concatenate(parts)
        return pa.table([pa.array([v], t) for v, t in zip((ordered.column(strip)[0].as_py(), *out.shape[:2], parts[0].shape[2] if parts[0].ndim == 3 else 1, out.tobytes()), _TYPES)], names=_NAMES)

    rows = images.where("data is not null and h * w > 0").select(F.col(strip).cast("long").alias(strip), *dict.fromkeys([order, *_NAMES]))
    return rows.groupBy(strip).applyInArrow(run, IMAGE)


def row_slices(images: DataFrame, cuts: DataFrame) -> DataFrame:
    """(img_id, part, h, w, channels, data): the rows [y1, y2) of each image for each of its (img_id, part, y1, y2).

    A slice of rows is a slice of bytes, so this is a join and a substring."""
    both = images.join(cuts, "img_id")
    low, high = F.greatest("y1", F.lit(0)), F.least("y2", "h")
    wide = F.col("w") * F.col("channels")
    return both.select("img_id", "part", F.greatest(high - low, F.lit(0)).cast("int").alias("h"), "w", "channels", F.substring("data", (low * wide + 1).cast("int"), F.greatest((high - low) * wide, F.lit(0)).cast("int")).alias("data"))


def from_pixels(rows: DataFrame) -> DataFrame:
    """Images from (img_id, y, x, g): whole rectangles of gray pixels."""
    lines = rows.groupBy("img_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "g"))), lambda p: F.lpad(F.hex(p["g"]), 2, "0")), "").alias("line"), F.count("*").cast("int").alias("w"))
    return lines.groupBy("img_id").agg(F.count("*").cast("int").alias("h"), F.max("w").alias("w"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "")).alias("data"))
