"""User kernels on array blocks: each target tile with the source window that covers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import IncompatibleAreas
from gridloom.plans.area import AreaSpec


def tiles(area: AreaSpec, size: int) -> list[tuple[int, slice, slice]]:
    """Numbered row and column slices that cut an area into tiles."""
    out = []
    for r in range(0, area.height, size):
        for c in range(0, area.width, size):
            out.append((len(out), slice(r, min(area.height, r + size)), slice(c, min(area.width, c + size))))
    return out


def resample_blocks(kernel: Callable, data: DataFrame, source: AreaSpec, target: AreaSpec, value: str = "value", tile: int = 256, fill: float = np.nan) -> DataFrame:
    """``row, col`` and ``value`` from ``kernel(source_block, source_area, target_area)`` for each target tile.

    The driver plans which source window each tile needs; source pixels are
    listed under the tiles that need them (an equi-join on the small table of
    windows) and each group makes one array. The kernel returns the tile's array;
    ``fill`` pixels are left out. Tiles without a source are not made.
    """
    spark = data.sparkSession
    plan = []
    for number, rows, cols in tiles(target, tile):
        try:
            s_cols, s_rows = source.slices_over(target.subset(rows, cols))
        except IncompatibleAreas:
            continue
        plan.append((number, rows.start, rows.stop, cols.start, cols.stop, s_rows.start, s_rows.stop, s_cols.start, s_cols.stop))
    names = ["tile", "r0", "r1", "c0", "c1", "sr0", "sr1", "sc0", "sc1"]
    schema = f"row int, col int, {value} double"
    if not plan:
        return spark.createDataFrame([], schema)
    # windows meet pixels by coarse cells, so that no pixel is compared with every window
    step = tile
    windows = spark.createDataFrame(plan, ", ".join(f"{n} int" for n in names))
    cells = windows.withColumn("_i", F.explode(F.expr(f"sequence(sr0 div {step}, (sr1 - 1) div {step})"))).withColumn("_j", F.explode(F.expr(f"sequence(sc0 div {step}, (sc1 - 1) div {step})")))
    pixels = data.select("row", "col", value).withColumns({"_i": F.expr(f"cast(row div {step} as int)"), "_j": F.expr(f"cast(col div {step} as int)")})
    met = pixels.join(cells, ["_i", "_j"]).where("row >= sr0 and row < sr1 and col >= sc0 and col < sc1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[names].iloc[0].astype(int)
        block = np.full((one.sr1 - one.sr0, one.sc1 - one.sc0), np.nan)
        block[pdf["row"] - one.sr0, pdf["col"] - one.sc0] = pdf[value]
        own = target.subset(slice(one.r0, one.r1), slice(one.c0, one.c1))
        out = np.asarray(kernel(block, source.subset(slice(one.sr0, one.sr1), slice(one.sc0, one.sc1)), own), float)
        if out.shape != own.shape:
            raise ValueError(f"the kernel made {out.shape}, the tile is {own.shape}")
        keep = ~np.isnan(out) if np.isnan(fill) else out != fill
        r, c = np.nonzero(keep)
        return pd.DataFrame({"row": (r + one.r0).astype(np.int32), "col": (c + one.c0).astype(np.int32), value: out[keep]})

    return met.groupBy("tile").applyInPandas(run, schema)
