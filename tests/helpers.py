"""Small fixtures and brute-force twins for the operators that have no SQL twin."""

from pyspark.sql import functions as F

from plansift.operators import config

WALL = "plan_id long, wall_id string, ord long, orientation string, coord double, s double, e double, thickness double, confidence double, is_exterior boolean, side string"


def walls(spark, rows, plan=1):
    data = [(plan, f"w{i}", i, o, float(c), float(s), float(e), 4.0, 0.9, False, None) for i, (o, c, s, e) in enumerate(rows)]
    return config.with_default_config(spark.createDataFrame(data, WALL))


H, V = "horizontal", "vertical"
BOX = [(H, 0, 0, 200), (H, 120, 0, 200), (V, 0, 0, 120), (V, 200, 0, 120)]


def runs_of(pixels):
    """Set of (x, y) -> merged runs (y, x0, x1)."""
    out = []
    for y in sorted({p[1] for p in pixels}):
        xs = sorted(p[0] for p in pixels if p[1] == y)
        start = prev = xs[0]
        for x in xs[1:] + [None]:
            if x is None or x != prev + 1:
                out.append((y, start, prev))
                start = x
            prev = x
    return out


def mask(spark, pixels, plan=1):
    return spark.createDataFrame([(plan, y, a, b) for y, a, b in runs_of(pixels)], "plan_id long, y long, x0 long, x1 long")


def pixels_of(df):
    return {(x, r.y) for r in df.collect() for x in range(r.x0, r.x1 + 1)}


def frame(spark, w, h, plan=1):
    return spark.createDataFrame([(plan, w, h)], "plan_id long, w long, h long")
