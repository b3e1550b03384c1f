"""GPS fields by definitions, against the rules row by row."""

import numpy as np
from pyspark.sql import functions as F

from aerolytics.operators import gps

FIELDS = "log_id long, frame_type string, pos int, name string, predictor int"


def test_neighbours_share_the_home_position(spark):
    rows = [([7, 7],), ([7, 7, 7],), ([7, 7, 7, 7],), ([0, 7, 10, 7],), ([],), ([10],)]
    found = spark.createDataFrame(rows, "c array<int>").select(gps.paired_codes(F.col("c")).alias("c")).collect()
    assert [list(r.c) for r in found] == [[7, 256], [7, 256, 7], [7, 256, 7, 256], [0, 7, 10, 7], [], [10]]


def test_fields_by_definitions_equal_the_rules(spark):
    dice = np.random.default_rng(3)
    layouts = {1: [("time", 10), ("GPS_coord[0]", 7), ("GPS_coord[1]", 7)], 2: [("GPS_coord[0]", 7), ("GPS_coord[1]", 7), ("alt", 8), ("time", 10)], 3: [("alt", 0)], 4: []}
    columns = ["time", "GPS_coord_0", "GPS_coord_1", "alt"]
    fixes, homes, main, expected = [], [], [], {}
    for log, layout in layouts.items():
        home, at = (0, 0), 0
        codes = dict(zip([n.replace("[0]", "_0").replace("[1]", "_1") for n, _ in layout], [c if n != "GPS_coord[1]" else 256 for n, c in layout]))
        for s in range(300):
            kind = dice.choice(list("GHMMM"))
            if kind == "H":
                home = int(dice.integers(10**9)), int(dice.integers(10**9))
                homes.append((log, s, *home))
            elif kind == "M":
                valid, time = bool(dice.random() < 0.8), int(dice.integers(2**40))
                at = time if valid else 0
                main.append((log, s, valid, time))
            else:
                own = [None if dice.random() < 0.05 else int(dice.integers(-1_000, 1_000)) for _ in columns]
                fixes.append((log, s, *own))
                added = {7: home[0], 256: home[1], 10: at, 8: 1500, 0: 0}
                expected[log, s] = tuple(None if x is None or c not in codes else x + added[codes[c]] for c, x in zip(columns, own))
    definitions = spark.createDataFrame([(log, "G", i, n, c) for log, layout in layouts.items() for i, (n, c) in enumerate(layout)], FIELDS)
    frames = spark.createDataFrame(fixes, "log_id long, stream_seq long, time long, GPS_coord_0 long, GPS_coord_1 long, alt long").repartition(3)
    sides = spark.createDataFrame(homes, "log_id long, stream_seq long, home_0 long, home_1 long"), spark.createDataFrame(main, "log_id long, stream_seq long, valid boolean, time long")
    for rows in (17, 100_000):
        found = gps.rebuild_gps(frames, *sides, definitions, rows=rows).collect()
        assert {(r.log_id, r.stream_seq): tuple(r[f"{c}_value"] for c in columns) for r in found} == expected
    assert gps.rebuild_gps(frames.where("false"), *sides, definitions).count() == 0
