"""The table of place fields: for each cell its map, information against shifts, fields, stability, and whether it is a place cell."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .controls import classified
from .fields import binned_array, find_fields, mean_rate, pearson, peak_bin, rate_maps, shift_null, skaggs_information, total


def _mean_where(rate: Column, inside: Column, wanted: bool) -> Column:
    kept = F.filter(F.arrays_zip(rate.alias("r"), inside.alias("in")), lambda x: x["r"].isNotNull() & (x["in"] if wanted else ~x["in"]))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["r"]), F.size(kept).cast("double"))


def place_field_table(cells: DataFrame, running: DataFrame, shifts: Callable[[tuple, int], np.ndarray], *, n_bins: int, bin_width: float = 1.0, slot_s: float = 1.0, sigma: float = 1.0, circular: bool = True, min_occupancy: float = 0.1,
                      threshold_frac: float = 0.2, min_width: float = 0.0, max_width_frac: float = 1.0, digits: int = 7, **criteria) -> DataFrame:
    """session, cluster_id and all that a cell is judged by; one row for each cell with a spike in a running slot.

    cells: session, cluster_id, slot, k (spikes). running: session, slot (0, 1, ... in compressed running time), bin, lap. Two maps
    of every other lap, each over its own occupancy, give the stability; shifts of running time the p value (``shift_null``).
    Widths are in units of ``bin_width``; a field is at most ``max_width_frac`` of the track. criteria: of ``controls.classified``.
    """
    key = ["session", "cluster_id"]
    laps = running.select("session", "lap").distinct()
    halves = laps.withColumn("half", (F.row_number().over(Window.partitionBy("session").orderBy("lap")) - 1) % 2)
    slots = running.join(halves, ["session", "lap"])
    spikes = cells.groupBy(*key, "slot").agg(F.sum("k").alias("k")).join(slots, ["session", "slot"])
    maps = lambda rows, occupied, keys, by: rate_maps(binned_array(rows, keys, "bin", n_bins, F.col("k")), binned_array(occupied, by, "bin", n_bins, F.lit(float(slot_s)), "occupancy"), by, n_bins=n_bins, sigma=sigma, circular=circular, min_occupancy=min_occupancy)
    whole = maps(spikes, slots, key, ["session"])
    every = cells.select(*key).distinct().crossJoin(cells.sparkSession.range(2).select(F.col("id").cast("int").alias("half"))).withColumns({"bin": F.lit(0), "k": F.lit(0)})  # a half without spikes has a map of zeros
    two = maps(spikes.select(*key, "half", "bin", "k").unionByName(every), slots, [*key, "half"], ["session", "half"])
    two = two.groupBy(*key).agg(F.max(F.when(F.col("half") == 0, F.col("rate"))).alias("_a"), F.max(F.when(F.col("half") == 1, F.col("rate"))).alias("_b"))
    stable = two.select(*key, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), pearson(F.col("_a"), F.col("_b"))).alias("stability"))
    active = spikes.groupBy(*key).agg(F.countDistinct("lap").alias("n_laps_active")).join(laps.groupBy("session").agg(F.count(F.lit(1)).alias("n_laps")), "session")
    null = shift_null(cells, running, ["cluster_id"], shifts, n_bins=n_bins, slot_s=slot_s, sigma=sigma, circular=circular, min_occupancy=min_occupancy, digits=digits).select(*key, "null_mean", "info_z", "p")
    found = find_fields(F.col("rate"), n_bins, threshold_frac=threshold_frac, min_bins=min_width / bin_width, max_bins=max_width_frac * n_bins, circular=circular)
    rows = whole.withColumn("_fields", F.coalesce(found, F.expr("cast(array() as array<struct<first: int, n: int>>)")))
    inside = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.exists("_fields", lambda f: F.pmod(b - f["first"], F.lit(n_bins)) < f["n"]))
    rows = rows.withColumn("_in", inside)
    info, mean = skaggs_information(F.col("rate"), F.col("occupancy")), mean_rate(F.col("rate"), F.col("occupancy"))
    widths = F.transform("_fields", lambda f: f["n"])
    rows = rows.select(
        *key, total(F.col("counts")).cast("long").alias("n_spikes"), mean.alias("mean_rate"), F.array_max("rate").alias("peak_rate"), peak_bin(F.transform("rate", lambda r: F.round(r, 9))).alias("peak_bin"),
        info.alias("info"), (info * mean).alias("info_per_second"), F.size("_fields").alias("n_fields"), (F.aggregate(widths, F.lit(0), lambda a, n: a + n.cast("int")) * bin_width).alias("field_width"), (F.array_max(widths) * bin_width).alias("largest_field_width"),
        _mean_where(F.col("rate"), F.col("_in"), True).alias("in_field_rate"), _mean_where(F.col("rate"), F.col("_in"), False).alias("out_field_rate"),
    )
    return classified(rows.join(null, key).join(stable, key).join(active, key), **criteria)
