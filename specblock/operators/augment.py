"""Seeded augmentations.

Randomness is keyed on (seed, image id, place in the list), so results do not
depend on how images are dealt out, and a task that runs again repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from specblock.frames import Frames, rounded
from specblock.operators import geometry
from specblock.operators.adaptive import coefficient_column

NAMES = ("hflip", "vflip", "rotate", "rot90", "rot180", "rot270", "brightness_jitter", "contrast_jitter", "noise", "crop")


def uniform(seed: int, place: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) for each image."""
    return low + (high - low) * (F.pmod(F.xxhash64(F.lit(seed), F.lit(place), F.col("image_id")), F.lit(1 << 52)) / float(1 << 52))


def brightness_jitter(frames: Frames, max_offset: float = 30.0, seed: int = 0, place: int = 0, chosen: Column | None = None) -> Frames:
    """Brightness moved by a number of levels within -max_offset..max_offset, of each image its own."""
    if max_offset == 0:
        return frames
    offset = uniform(seed, place, -max_offset, max_offset)
    step = F.rint((offset * 8.0).cast("float") / F.col("q")[0]).cast("int")
    moved = F.concat(F.array((F.col("coef")[0].cast("int") + F.col("__step")).cast("smallint")), F.slice("coef", 2, 63))
    blocks = frames.blocks.withColumn("__step", step)
    here = (F.col("channel") == "Y") & (F.lit(True) if chosen is None else chosen)
    return frames.with_blocks(blocks.withColumn("coef", F.when(here, moved).otherwise(F.col("coef"))).drop("__step"))


def contrast_jitter(frames: Frames, max_factor: float = 0.3, seed: int = 0, place: int = 0, chosen: Column | None = None) -> Frames:
    """Contrast by a factor within 1 - max_factor..1 + max_factor, 0.01 at least."""
    if max_factor == 0:
        return frames
    blocks = frames.blocks.withColumn("__f", F.greatest(F.lit(0.01), 1 + uniform(seed, place, -max_factor, max_factor)).cast("float"))
    scaled = F.transform("coef", lambda c, k: F.when(k == 0, c).otherwise(rounded(c.cast("float") * F.col("__f"))))
    coef = scaled if chosen is None else F.when(chosen, scaled).otherwise(F.col("coef"))
    return frames.with_blocks(blocks.withColumn("coef", coef).drop("__f"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_normals(seed: int, place: int, ids: np.ndarray, brow: np.ndarray, bcol: np.ndarray) -> np.ndarray:
    """64 standard normal numbers a block, a function of its keys alone (counter-based, Box-Muller)."""
    own = np.full(len(ids), (seed * 1_000_003 + place) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for part in (ids, brow, bcol):
        own = _mixed(own + np.uint64(0x9E3779B97F4A7C15)) ^ part.astype(np.int64).view(np.uint64)
    counters = _mixed(own)[:, None] + np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    uniform = (_mixed(_mixed(counters)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    radius, angle = np.sqrt(-2 * np.log(1 - uniform[:, :32])), 2 * np.pi * uniform[:, 32:]
    return np.concatenate((radius * np.cos(angle), radius * np.sin(angle)), axis=1)


def gaussian_noise(frames: Frames, sigma: float = 3.0, seed: int = 0, place: int = 0, chosen: Column | None = None) -> Frames:
    """Normal noise on luma but DC; a block's own noise depends on its image and place only."""
    if sigma == 0:
        return frames
    names = frames.blocks.columns
    at = {c: names.index(c) for c in names}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coef = batch.column(at["coef"]).flatten().to_numpy().reshape(-1, 64).astype(np.float32)
            ids, brow, bcol = (batch.column(at[c]).to_numpy() for c in ("image_id", "brow", "bcol"))
            luma = np.flatnonzero((np.array(batch.column(at["channel"]).to_pylist()) == "Y") & batch.column(len(names)).to_numpy(zero_copy_only=False))
            coef[luma, 1:] += (sigma * block_normals(seed, place, ids[luma], brow[luma], bcol[luma])[:, 1:]).astype(np.float32)
            columns = [coefficient_column(coef) if c == "coef" else batch.column(at[c]) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = frames.blocks.withColumn("__chosen", F.lit(True) if chosen is None else chosen)
    return frames.with_blocks(rows.mapInArrow(work, frames.blocks.schema))


def parse_augmentation(spec: str | dict) -> dict:
    """{'name': ..., key: number, ...} of `name:key=number,...` or of a dict."""
    if isinstance(spec, dict):
        return dict(spec)
    name, _, rest = spec.partition(":")
    out: dict = {"name": name.strip()}
    for pair in filter(None, (p.strip() for p in rest.split(","))):
        key, _, value = pair.partition("=")
        number = float(value)
        out[key.strip()] = int(number) if number.is_integer() else number
    return out


def _turned(name: str, spec: dict):
    if name == "hflip":
        return geometry.horizontal_flip
    if name == "vflip":
        return geometry.vertical_flip
    degrees = spec.get("degrees", {"rot90": 90, "rot180": 180, "rot270": 270}.get(name, 90))
    return lambda frames: geometry.rotate(frames, int(degrees))


def _random_crop(frames: Frames, rows: int, cols: int, seed: int, place: int) -> Frames:
    """A crop whose start each image draws by itself; images that are too small keep their size."""
    grid = frames.images.select("image_id", F.ceil(F.col("height") / 8).cast("int").alias("lh"), F.ceil(F.col("width") / 8).cast("int").alias("lw"))
    start = lambda n, size, k: F.floor(uniform(seed, place + k) * (F.greatest(F.lit(0), F.col(n) - size) + 1)).cast("int")
    grid = grid.withColumns({"r0": start("lh", rows, 1000), "c0": start("lw", cols, 2000), "h": F.least(F.col("lh"), F.lit(rows)), "w": F.least(F.col("lw"), F.lit(cols))})
    blocks = frames.blocks.join(grid, "image_id")
    edges = {}
    for axis, n, whole, first, size in (("brow", "bh", "lh", "r0", "h"), ("bcol", "bw", "lw", "c0", "w")):
        low = F.floor(F.col(first) * (F.col(n) / F.col(whole))).cast("int")
        many = F.least(F.greatest(F.lit(1), F.floor(F.col(size) * (F.col(n) / F.col(whole)))).cast("int"), F.col(n) - low)
        edges[axis], edges[n] = low, many
    inside = (F.col("brow") >= edges["brow"]) & (F.col("brow") < edges["brow"] + edges["bh"]) & (F.col("bcol") >= edges["bcol"]) & (F.col("bcol") < edges["bcol"] + edges["bw"])
    moved = {"brow": F.col("brow") - edges["brow"], "bcol": F.col("bcol") - edges["bcol"], "bh": edges["bh"], "bw": edges["bw"]}
    images = frames.images.join(grid.select("image_id", "h", "w"), "image_id").withColumns({"height": F.col("h") * 8, "width": F.col("w") * 8}).drop("h", "w")
    return Frames(images, blocks.where(inside).withColumns(moved).select(frames.blocks.columns))


class AugmentationPipeline:
    """Specs applied in order, each with its probability p (1 by default); unknown names are ignored."""

    def __init__(self, specs: list[str | dict], seed: int = 0):
        self.augmentations = [parse_augmentation(s) for s in specs]
        self.seed = seed

    def reseed(self, seed: int) -> None:
        self.seed = seed

    def __call__(self, frames: Frames) -> Frames:
        for place, spec in enumerate(self.augmentations):
            if spec["name"] in NAMES:
                frames = self._one(frames, spec, place)
        return frames

    def _one(self, frames: Frames, spec: dict, place: int) -> Frames:
        name, p = spec["name"], spec.get("p", 1.0)
        chosen = uniform(self.seed, 10_000 + place) <= p
        if name == "brightness_jitter":
            return brightness_jitter(frames, spec.get("max_offset", 20), self.seed, place, chosen)
        if name == "contrast_jitter":
            return contrast_jitter(frames, spec.get("max_factor", 0.3), self.seed, place, chosen)
        if name == "noise":
            return gaussian_noise(frames, spec.get("sigma", 3.0), self.seed, place, chosen)
        change = (lambda f: _random_crop(f, spec.get("block_rows", 4), spec.get("block_cols", 4), self.seed, place)) if name == "crop" else _turned(name, spec)
        if p >= 1:
            return change(frames)
        yes = change(Frames(frames.images.where(chosen), frames.blocks.where(chosen)))
        return Frames(yes.images.unionByName(frames.images.where(~chosen)), yes.blocks.unionByName(frames.blocks.where(~chosen)))
