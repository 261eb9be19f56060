"""Training-set jobs over manifests: scoring, curation, splits, materialised paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import clamp, round_to
from plansift.operators.gates import compact

# fixed values: room classes 0 background, 1 outdoor, 2 wall; icon classes 1 window, 2 door
NOT_ROOMS = [0, 1, 2]
WALL, OUTDOOR = 2, 1
OPENING_ICONS = [1, 2]
# fixed values: score changes by flag
PENALTY = {
    "no_walls": 30, "no_rooms": 30, "wall_ratio_too_low": 15, "wall_ratio_too_high": 15, "no_openings": 10,
    "sparse_heatmaps": 5, "tiny_image": 5, "oversized_image": 5, "limited_room_diversity": 5,
}
CRITICAL = ["no_walls", "no_rooms", "wall_ratio_too_low", "wall_ratio_too_high", "tiny_image"]


def class_pixels(runs: DataFrame) -> DataFrame:
    """Pixels per sample, channel and class from runs."""
    return runs.groupBy("sample_id", "channel", "cls").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))


def sample_counts(pixels: DataFrame) -> DataFrame:
    """The class-set sums A12 scores: wall, room, outdoor, opening and icon pixels, distinct room classes."""
    room, icon = F.col("channel") == 0, F.col("channel") == 1

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("pixels"))), F.lit(0))

    is_room = room & ~F.col("cls").isin(NOT_ROOMS)
    return pixels.groupBy("sample_id").agg(
        total(room).alias("total"), total(room & (F.col("cls") == WALL)).alias("wall"),
        total(room & (F.col("cls") == OUTDOOR)).alias("outdoor"), total(is_room).alias("room"),
        total(icon & F.col("cls").isin(OPENING_ICONS)).alias("opening"), total(icon & (F.col("cls") != 0)).alias("icon"),
        F.count_if(is_room).alias("rooms"),
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Wall, room and opening share of all pixels of a sample."""
    return counts.withColumns({f"{n}_ratio": round_to(F.col(n) / F.greatest("total", F.lit(1)), 6) for n in ("wall", "room", "opening")})


def score_samples(counts: DataFrame) -> DataFrame:
    """Nine flags and the additive score, clamped to 0..100.

    ``counts``: total, wall, room, opening, rooms, channels, points, h, w.
    """
    ratio = F.col("wall") / F.greatest("total", F.lit(1))
    short, long = F.least("h", "w"), F.greatest("h", "w")
    flags = compact(
        F.when(F.col("wall") == 0, "no_walls"),
        F.when(F.col("room") == 0, "no_rooms"),
        F.when(F.col("opening") == 0, "no_openings"),
        F.when(F.col("points") < 4, "sparse_heatmaps"),
        F.when(ratio < 0.01, "wall_ratio_too_low"),
        F.when(ratio > 0.60, "wall_ratio_too_high"),
        F.when(short < 96, "tiny_image"),
        F.when(long > 2048, "oversized_image"),
        F.when(F.col("rooms") < 2, "limited_room_diversity"),
    )

    def points(cond: Column, n) -> Column:
        return F.when(cond, n).otherwise(0)

    gained = (
        points(F.col("wall") > 0, 15) + points((F.col("wall") > 0) & ratio.between(0.03, 0.35), 10)
        + points(F.col("room") > 0, F.lit(10) + F.least(F.col("rooms") * 5, F.lit(20)))
        + points(F.col("opening") > 0, 15)
        + F.when(F.col("channels") >= 6, 15).when(F.col("channels") >= 2, 8).otherwise(0)
        + points(short >= 128, 10) + points(long <= 1024, 5)
    )
    table = F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])
    lost = F.aggregate("flags", F.lit(0), lambda acc, f: acc + table[f])
    return counts.withColumn("flags", flags).withColumn("quality_score", clamp(gained - lost, 0, 100).cast("int"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Long table (kind, name, value): dataset counts, flag counts and the score statistics."""
    per_dataset = audit.groupBy("dataset").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("dataset").alias("kind"), F.col("dataset").alias("name"), "value")
    per_flag = audit.select(F.explode("flags").alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("flag").alias("kind"), "name", "value")
    stats = audit.agg(
        F.count(F.lit(1)).cast("double").alias("sample_count"),
        round_to(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("average_quality_score"),
        F.min("quality_score").cast("double").alias("min_quality_score"),
        F.max("quality_score").cast("double").alias("max_quality_score"),
    )
    names = ["sample_count", "average_quality_score", "min_quality_score", "max_quality_score"]
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("s"))
    return per_dataset.unionByName(per_flag).unionByName(
        long.select(F.lit("score").alias("kind"), "s.name", "s.value").filter("value IS NOT NULL")
    )


def should_drop(min_score: int = 35, require_openings: bool = False) -> Column:
    """critical flag, missing openings when required, or a low score."""
    critical = F.arrays_overlap("flags", F.array(*map(F.lit, CRITICAL)))
    missing = F.array_contains("flags", "no_openings") if require_openings else F.lit(False)
    return critical | missing | (F.col("quality_score") < min_score)


def curate(manifest: DataFrame, audit: DataFrame, **rule) -> DataFrame:
    """J18 + F06: manifest rows with their audit; ``keep`` tells which stay."""
    scored = audit.select("sample_id", "flags", "quality_score")
    return manifest.join(scored, "sample_id").withColumn("keep", ~should_drop(**rule))


def curation_summary(curated: DataFrame) -> DataFrame:
    """Kept and dropped per dataset."""
    return curated.groupBy("dataset").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def _order_hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))


def assign_splits(
    manifest: DataFrame, seed: int = 13, train: float = 0.8, val: float = 0.1, bucket_digits: int = 3
) -> DataFrame:
    """Reproducible split per dataset in hash order.

    Ranks inside one dataset would need one sorted partition for it, and a
    dataset may hold a third of all rows. So rows are counted per hash prefix
    (16^digits buckets per dataset), the bucket starts come from a window over
    those few counts, and only the rank inside one bucket is a row window.
    """
    hashed = manifest.withColumn("_h", _order_hash(seed)).withColumn("_b", F.substring("_h", 1, bucket_digits))
    buckets = hashed.groupBy("dataset", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("dataset").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        "dataset", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("dataset")).alias("total"),
    )
    n_train, n_val = split_sizes(F.col("total"), train, val)
    inside = F.row_number().over(Window.partitionBy("dataset", "_b").orderBy("_h", "sample_id"))
    ranked = hashed.withColumn("_r", inside).join(starts, ["dataset", "_b"]).withColumn("rank", F.col("_start") + F.col("_r"))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_b", "_n", "_start", "_r", "total")


def split_sizes(total: Column, train: float, val: float) -> tuple[Column, Column]:
    """Train and validation sizes; from three samples on every split gets at least one."""
    t, v = (total * F.lit(train)).cast("long"), (total * F.lit(val)).cast("long")
    test = total - t - v
    t1 = F.when(v == 0, F.greatest(t - 1, F.lit(1))).otherwise(t)
    v1 = F.greatest(v, F.lit(1))
    t2 = F.when(test == 0, F.greatest(t1 - 1, F.lit(1))).otherwise(t1)
    n_train = F.when(total >= 3, t2).otherwise(F.least(total, F.lit(1)))
    n_val = F.when(total >= 3, v1).otherwise(F.lit(0))
    return n_train, n_val


def split_summary(splits: DataFrame) -> DataFrame:
    """Rows per split with the datasets in it."""
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("datasets")
    )


def materialize_paths(manifest: DataFrame, include_preview: bool = False) -> DataFrame:
    """Paths of the materialised layout; the preview path is null when previews stay out."""
    root = F.concat_ws("/", F.lit("samples"), "dataset", F.col("sample_id").cast("string"))
    preview = F.when(F.col("preview_path").isNotNull(), F.concat_ws("/", root, F.lit("preview.png"))) if include_preview else F.lit(None).cast("string")
    files = {"image_path": "image.png", "label_path": "label.npy", "heatmaps_path": "heatmaps.json", "meta_path": "meta.json"}
    return manifest.withColumns({**{k: F.concat_ws("/", root, F.lit(v)) for k, v in files.items()}, "preview_path": preview})


def rewrite_splits(splits: DataFrame, materialized: DataFrame) -> DataFrame:
    """Split rows replaced by their materialised entry; rows without one are dropped."""
    return splits.select("sample_id", "split").join(materialized, "sample_id")


def pending_folders(folders: DataFrame, done: DataFrame, start: int, end: int) -> DataFrame:
    """numbered folders in range that have no finished output yet."""
    return folders.filter(F.col("folder").between(start, end)).join(done, "folder", "left_anti")


def labelling_totals(outcomes: DataFrame, unit_cost: float = 0.045) -> DataFrame:
    """Done, skipped and failed items with the cost of the done ones."""
    return outcomes.agg(
        F.count_if(F.col("outcome") == "done").alias("done"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        round_to(F.count_if(F.col("outcome") == "done") * unit_cost, 6).alias("total_cost"),
    )


def union_manifests(**manifests: DataFrame) -> DataFrame:
    """All manifests by column name, each row with the manifest it came from."""
    out = None
    for name, rows in manifests.items():
        tagged = rows.withColumn("manifest", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


# -- label metrics -------------------------------------------------------------


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n"))


def class_iou(pairs: DataFrame) -> DataFrame:
    """IoU per class present in either column; the mean is class -1."""
    cells = confusion(pairs)
    per_class = cells.select("n", "pred", "truth", F.explode(F.array_distinct(F.array("pred", "truth"))).alias("cls")).groupBy("cls").agg(
        (F.coalesce(F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("iou")
    )
    mean = per_class.agg(F.lit(-1).alias("cls"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("iou"))
    return per_class.unionByName(mean).select("cls", round_to("iou", 6).alias("iou"))


def pixel_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of equal labels per head."""
    return pairs.groupBy("head").agg(round_to(F.avg((F.col("pred") == F.col("truth")).cast("double")), 6).alias("accuracy"))


def class_weights(pixels: DataFrame, cap: float = 10.0) -> DataFrame:
    """Median frequency over frequency, capped; the upper median for even counts.

    The class list is a fixed, short vocabulary, so its frequencies fit one row.
    """
    total = pixels.agg(F.sum("pixels").alias("total"))
    freq = pixels.join(F.broadcast(total)).withColumn("freq", F.when(F.col("total") > 0, F.col("pixels") / F.col("total")).otherwise(1.0))
    median = freq.agg(F.sort_array(F.collect_list("freq")).alias("fs")).select(
        F.element_at("fs", (F.floor(F.size("fs") / 2) + 1).cast("int")).alias("median"))
    return freq.join(F.broadcast(median)).select(
        "cls", round_to(F.least(F.col("median") / (F.col("freq") + 1e-10), F.lit(cap)), 6).alias("weight"))
