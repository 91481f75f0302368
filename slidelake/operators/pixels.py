"""Tile pixels: colours and sizes normalised, levels built, sums taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.pyramid import n_levels
from slidelake.sources import storage

#: Bytes of pixels that a task holds before it hands them on.
HELD = 32 << 20
LEVEL = "path string, scene long, level int, ty long, tx long, th long, tw long, px binary"


def normalise(tiles: DataFrame) -> DataFrame:
    """RGB tiles of exactly (th, tw, 3) from decoded BGR ones of (got_h, got_w, 3).

    What a short read lacks is white; what it has too much is cut off. Keeps the other columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = []
            for data, gh, gw, h, w in zip(b["px"], b["got_h"], b["got_w"], b["th"], b["tw"]):
                if data is None:
                    px.append(None)
                    continue
                rgb = np.frombuffer(data, np.uint8).reshape(int(gh), int(gw), 3)[..., ::-1]
                out = np.full((int(h), int(w), 3), 255, np.uint8)
                part = rgb[: int(h), : int(w)]
                out[: part.shape[0], : part.shape[1]] = part
                px.append(out.tobytes())
            yield b.assign(px=px)

    return tiles.mapInPandas(run, tiles.schema)


def _mean(tiles: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """One (h, w, c) image of the means of 2 x 2 pixels of up to four tiles (ty, tx, pixels) that lie in a square."""
    grid = {(y % 2, x % 2): image for y, x, image in tiles}
    rows = [np.concatenate([grid[y, x] for x in (0, 1) if (y, x) in grid], axis=1) for y in (0, 1) if (y, 0) in grid]
    image = np.concatenate(rows, axis=0).astype(np.int64)
    h, w = image.shape[:2]
    odd = np.pad(image, ((0, h % 2), (0, w % 2), (0, 0)))
    count = np.pad(np.ones((h, w, 1), np.int64), ((0, h % 2), (0, w % 2), (0, 0)))
    add = lambda a: a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]
    n = add(count)
    return ((2 * add(odd) + n) // (2 * n)).astype(np.uint8)


@dataclass
class _Tile:
    path: str
    scene: int
    level: int
    ty: int
    tx: int
    image: np.ndarray
    n_levels: int

    def row(self) -> tuple:
        return (self.path, self.scene, self.level, self.ty, self.tx, *self.image.shape[:2], self.image.tobytes(), self.n_levels)


def morton(y: str, x: str, bits: int = 20) -> Column:
    """The bits of two numbers in turn: tiles of one square, of any power of two, follow one another."""
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (m, i) -> m | shiftleft(shiftright({x}, i) & 1, 2 * i) | shiftleft(shiftright({y}, i) & 1, 2 * i + 1))")


def levels_above(tiles: DataFrame, up: int) -> DataFrame:
    """The next `up` levels above (h, w, 3) tiles of one level, by the mean of 2 x 2 pixels; rows of LEVEL and n_levels.

    tiles: LEVEL and n_levels, at which a slide ends. Means are rounded half up; an odd last row
    or column is averaged alone, and each level is the mean of the one below. The squares of
    2**up x 2**up tiles are dealt out by one shuffle and read in the order of their Morton
    numbers, so a task holds up to four tiles of each level, however many it makes.
    """
    columns = [c.split()[0] for c in LEVEL.split(", ")] + ["n_levels"]

    def raised(children: Iterator[_Tile]) -> Iterator[_Tile]:
        """Of each four tiles that come together their parent; a slide's last tile goes through."""
        for key, four in groupby(children, lambda t: (t.path, t.scene, t.level, t.ty // 2, t.tx // 2)):
            four = list(four)
            if four[0].level + 1 >= four[0].n_levels:
                yield from four
                continue
            parent = _Tile(key[0], key[1], key[2] + 1, key[3], key[4], _mean([(t.ty, t.tx, t.image) for t in four]), four[0].n_levels)
            made.append(parent.row())
            yield parent

    made: list[tuple] = []

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read() -> Iterator[_Tile]:
            for b in batches:
                for r in b.itertuples():
                    yield _Tile(r.path, r.scene, int(r.level), int(r.ty), int(r.tx), np.frombuffer(r.px, np.uint8).reshape(int(r.th), int(r.tw), 3), int(r.n_levels))

        made.clear()
        top = read()
        for _ in range(up):
            top = raised(top)
        held = done = 0
        for _ in top:
            held, done = held + sum(len(row[7]) for row in made[done:]), len(made)
            if held > HELD:
                yield pd.DataFrame(made, columns=columns)
                made.clear()
                held = done = 0
        yield pd.DataFrame(made, columns=columns)

    square = [F.shiftright("ty", up).alias("gy"), F.shiftright("tx", up).alias("gx")]
    dealt = tiles.where("n_levels > level + 1").select(*columns).repartition(storage.tasks(tiles.sparkSession), "path", "scene", *square)
    return dealt.sortWithinPartitions("path", "scene", morton("ty", "tx")).mapInPandas(build, f"{LEVEL}, n_levels int")


def next_level(tiles: DataFrame, tile: int) -> DataFrame:
    """The level above tiles of one level (LEVEL), four to one; of slides that have one tile only, too."""
    return levels_above(tiles.withColumn("n_levels", F.col("level") + 2), 1).drop("n_levels")


def build_pyramid(level0: DataFrame, tile: int, folder: str, geometry: DataFrame | None = None, up: int = 3) -> list[str]:
    """Writes the levels above level 0 of all slides, `up` of them in a pass; gives the passes' folders (LEVEL).

    A slide ends at its own last level, the first that fits one tile. Sizes come from geometry
    (path, scene, width, height), or from the tiles, which are then read twice. Each pass reads
    back the highest level of the one before, so no level is computed twice; there are as many
    passes as the largest slide's levels need.
    """
    spark, paths = level0.sparkSession, []
    if geometry is None:
        sizes = level0.groupBy("path", "scene").agg(F.max(F.col("tx") * tile + F.col("tw")).alias("width"), F.max(F.col("ty") * tile + F.col("th")).alias("height"))
    else:
        sizes = geometry.select("path", F.col("scene").cast("long").alias("scene"), "width", "height")
    sizes = storage.stored(sizes.select("path", "scene", n_levels(tile=tile).alias("n_levels")), f"{folder}/sizes")
    n, most = sizes.agg(F.count("*"), F.coalesce(F.max("n_levels"), F.lit(0))).first()
    now = level0.join(F.broadcast(sizes) if n <= 100_000 else sizes, ["path", "scene"])
    for level in range(0, most - 1, up):
        paths.append(f"{folder}/above={level}")
        made = storage.stored(levels_above(now, min(up, most - 1 - level)), paths[-1])
        now = made.where(F.col("level") == level + up)
    return paths


def channel_sums(tiles: DataFrame, channels: str = "rgb") -> DataFrame:
    """In place of px the sums of each tile's pixels, sum_r, sum_g and sum_b for the channels r, g and b; null without pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [np.frombuffer(p, np.uint8).reshape(-1, len(channels)).sum(0, dtype=np.int64) if p is not None else [None] * len(channels) for p in b["px"]]
            yield b.drop(columns="px").assign(**{f"sum_{c}": pd.array([s[i] for s in sums], "Int64") for i, c in enumerate(channels)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema if f.name != "px")
    return tiles.mapInPandas(run, f"{schema}, {', '.join(f'sum_{c} long' for c in channels)}")
