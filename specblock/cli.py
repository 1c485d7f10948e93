"""Command line: python -m specblock.cli COMMAND ...

One file or a whole folder goes in; operators run as one Spark plan over all.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock.frames import Frames
from specblock.operators import adaptive, analysis, apps, augment, features, geometry, pointwise, resize
from specblock.session import local_session
from specblock.sources import images

VERSION = "0.1.0"


def _operators() -> dict:
    """Name: (help, arguments, function of frames and parsed arguments)."""
    number = lambda name, default, kind=float: (name, {"type": kind, "default": default})
    return {
        "blur": ("Gaussian blur", [number("--sigma", 2.0), ("--channels", {"choices": ["all", "luma", "chroma"], "default": "all"}), ("--cross-block", {"action": "store_true"})], lambda f, a: pointwise.blur(f, a.sigma, a.channels, a.cross_block)),
        "sharpen": ("raise high frequencies", [number("--amount", 1.5)], lambda f, a: pointwise.sharpen(f, a.amount)),
        "brightness": ("move the level", [number("--offset", 30.0)], lambda f, a: pointwise.adjust_brightness(f, a.offset)),
        "contrast": ("scale contrast", [number("--factor", 1.5)], lambda f, a: pointwise.adjust_contrast(f, a.factor)),
        "downscale": ("shrink by a power of two", [number("--factor", 2, int)], lambda f, a: adaptive.downscale(f, a.factor)),
        "edges": ("edge map", [("--method", {"choices": ["laplacian", "gradient"], "default": "laplacian"})], lambda f, a: pointwise.detect_edges(f, a.method)),
        "rotate": ("rotate clockwise", [number("--degrees", 90, int)], lambda f, a: geometry.rotate(f, a.degrees)),
        "convert": ("any format to JPEG coefficients", [], lambda f, a: f),
        "augment": (
            "flip, then brightness, contrast and noise",
            [("--flip", {"choices": ["none", "h", "v"], "default": "none"}), number("--brightness", 0.0), number("--contrast", 0.0), number("--noise", 0.0), number("--seed", 0, int)],
            _augmented,
        ),
    }


def _augmented(frames: Frames, a: argparse.Namespace) -> Frames:
    if a.flip != "none":
        frames = geometry.horizontal_flip(frames) if a.flip == "h" else geometry.vertical_flip(frames)
    frames = augment.brightness_jitter(frames, a.brightness, a.seed)
    return augment.gaussian_noise(augment.contrast_jitter(frames, a.contrast, a.seed), a.noise, a.seed)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="specblock", description="Image analytics on block coefficients.")
    top.add_argument("--version", action="version", version=VERSION)
    noise = top.add_mutually_exclusive_group()
    noise.add_argument("-v", "--verbose", action="store_true")
    noise.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(where, name: str, text: str, *arguments):
        sub = where.add_parser(name, help=text)
        sub.add_argument("input")
        for flag, options in arguments:
            sub.add_argument(flag, **options)
        return sub

    for name, (text, arguments, _) in _operators().items():
        sub = command(commands, name, text, *arguments)
        sub.add_argument("-o", "--output", required=True, help="folder for the JPEG files")
        sub.add_argument("--quality", type=int, default=85 if name == "convert" else None)
        sub.add_argument("--timing", action="store_true")
    as_json = ("--json", {"action": "store_true"})
    command(commands, "info", "size, quality and statistics", as_json)
    command(commands, "inspect", "the coefficients of one block", ("--block", {"required": True, "help": "row,column"}), as_json)
    command(commands, "quality", "estimated quality")
    data = commands.add_parser("dataset").add_subparsers(dest="part", required=True)
    command(data, "prepare", "images to a block store", ("--output", {"required": True}), ("--quality", {"type": int, "default": 85}))
    command(data, "info", "files, classes and sizes", as_json)
    command(data, "bench", "feature throughput", ("--mode", {"choices": list(features.MODES), "default": "y_only"}))
    uses = commands.add_parser("apps").add_subparsers(dest="part", required=True)
    command(uses, "dedup", "groups of near-duplicates", ("--max-distance", {"type": int, "default": 5}), as_json)
    command(uses, "forensics", "signs of double compression", ("--threshold", {"type": float, "default": 12.0}), as_json)
    command(uses, "thumbnail", "DC thumbnails as PNG files", ("--output", {"required": True}), ("--size", {"type": int, "default": None}))
    return top


def load(spark: SparkSession, path: str, quality: int = 85) -> Frames:
    """JPEG files by their coefficients, other formats through pixels; told apart by content."""
    kinds = images.binary_files(spark, path, "*").select(images.detect_format(F.col("content")).alias("kind"), "path").where("kind is not null")
    found = {r[0] for r in kinds.select("kind").distinct().collect()}
    if not found:
        raise images.InvalidImageError(f"no image in {path}")
    if found == {"jpeg"}:
        return images.read_jpeg(spark, path)
    other = images.convert_to_dct(spark, path, quality)
    if "jpeg" not in found:
        return other
    own = images.read_jpeg(spark, path, permissive=True)
    rest = other.images.join(own.images.select("image_id"), "image_id", "left_anti")
    return Frames(own.images.unionByName(rest), own.blocks.unionByName(other.blocks.join(rest.select("image_id"), "image_id", "left_semi")))


def info(frames: Frames) -> DataFrame:
    """Size, components and statistics, one row an image."""
    out = frames.images.select("image_id", "path", "width", "height", "num_components", F.size("quant_tables").alias("num_tables"))
    for report in (analysis.estimate_quality, analysis.dct_stats, analysis.detect_blur, analysis.estimate_noise):
        out = out.join(report(frames), "image_id")
    return out


def _block(frames: Frames, at: str) -> DataFrame:
    row, col = (int(x) for x in at.split(","))
    luma = frames.images.select("image_id", F.ceil(F.col("height") / 8).alias("lh"), F.ceil(F.col("width") / 8).alias("lw"))
    rows = frames.blocks.join(luma, "image_id")
    scaled = lambda x, n, whole: F.floor(F.lit(x) * F.col(n) / F.col(whole))
    here = F.when(F.col("channel") == "Y", (F.col("brow") == row) & (F.col("bcol") == col)).otherwise((F.col("brow") == scaled(row, "bh", "lh")) & (F.col("bcol") == scaled(col, "bw", "lw")))
    return rows.where(here).select("image_id", "channel", "brow", "bcol", "coef")


def _tell(rows: DataFrame, as_json: bool) -> None:
    for text in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        record = json.loads(text["j"])
        print(json.dumps(record) if as_json else "  ".join(f"{k}={v}" for k, v in record.items()))


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    part = getattr(args, "part", None)
    if part == "info":
        _tell(images.dataset_info(images.binary_files(spark, args.input)), args.json)
        return
    if args.command == "convert":
        frames = images.convert_to_dct(spark, args.input, args.quality)
        args.quality = None
    else:
        frames = load(spark, args.input)
    if args.command in _operators():
        began = time.perf_counter()
        done = _operators()[args.command][2](frames, args)
        images.write_jpeg(done, args.output, args.quality).write.format("noop").mode("overwrite").save()
        if args.timing:
            print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)
    elif args.command == "info":
        _tell(info(frames), args.json)
    elif args.command == "inspect":
        _tell(_block(frames, args.block), args.json)
    elif args.command == "quality":
        _tell(analysis.estimate_quality(frames), False)
    elif part == "prepare":
        images.write_store(Frames(images.labelled(frames.images), frames.blocks), args.output)
    elif part == "bench":
        began, n = time.perf_counter(), features.tensors(frames, args.mode).count()
        print(f"{n / (time.perf_counter() - began):.1f} images/s")
    elif part == "dedup":
        _tell(apps.duplicate_groups(frames, args.max_distance), args.json)
    elif part == "forensics":
        _tell(apps.detect_double_compression(frames, args.threshold), args.json)
    elif part == "thumbnail":
        thumbnail = apps.dc_thumbnail(frames)
        sized = resize.sized_thumbnail(thumbnail, frames, args.size) if args.size else thumbnail
        images.write_png(sized, args.output).write.format("noop").mode("overwrite").save()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or local_session()
    session.sparkContext.setLogLevel("INFO" if args.verbose else "OFF" if args.quiet else "ERROR")
    try:
        run(args, session)
    except (ValueError, images.BlockError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
