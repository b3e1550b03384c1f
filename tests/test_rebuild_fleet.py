"""Rebuilding logs of several layouts in one call against the rules, row by row."""

import numpy as np

from aerolytics.operators import frames as fr

FIELDS = "log_id long, frame_type string, pos int, name string, signed int, width int, predictor int, encoding int"
COLUMNS = ["a", "b_1", "motor_0"]


def plain_rebuild(rows, rules):
    """Values of each row of one log: (kind, constants, residuals) under {column: (i, p, signed, wraps)}."""
    held, out = {}, []
    for kind, config, residuals in rows:
        made = {}
        for c in sorted(residuals, key=lambda c: c != "motor_0"):
            if c not in rules:
                made[c] = None
                continue
            i, p, signed, wraps = rules[c]
            code, x = (i if kind == "I" else p), residuals[c]
            constant = {4: config[0], 11: config[1], 9: config[2], 8: 1500, 5: made.get("motor_0") or 0}.get(code, 0)
            if x is not None and not (kind == "I" and code in (1, 2, 3)):
                prior = held.get(c)
                history = 0 if kind == "I" or prior is None else {1: prior[0], 2: 2 * prior[0] - prior[1], 3: (prior[0] + prior[1]) // 2}.get(code, 0)
                x += constant + history
                if wraps:
                    x %= 2**32
                    x -= 2**32 if signed and x >= 2**31 else 0
                if kind == "I":
                    held[c] = x, x
                elif prior is not None:
                    held[c] = x, prior[0]
            else:
                x = None
            made[c] = x
        out.append(tuple(made[c] for c in COLUMNS))
    return out


def test_logs_of_several_layouts_equal_the_rules(spark):
    dice = np.random.default_rng(8)
    layouts = [
        {"a": (0, 3, 1, True), "b_1": (8, 2, 0, True), "motor_0": (4, 1, 1, True)},
        {"motor_0": (11, 9, 1, True), "a": (5, 5, 1, False)},
        {"b_1": (0, 1, 1, False), "a": (9, 8, 0, True), "motor_0": (0, 0, 1, True)},
    ]
    raw, definitions, expected = [], [], {}
    for log in range(9):
        layout, rows = layouts[log % 3], []
        for s in range(int(dice.integers(1, 150))):
            kind = "I" if dice.random() < 0.06 else "P"
            residuals = {c: None if dice.random() < 0.02 else int(dice.integers(-3_000, 3_000)) * int(dice.choice([1, 1, 1, 700_000])) for c in COLUMNS}
            rows.append((kind, (1_000 + log, 40 + log, 1_500 + log), residuals))
            raw.append((log, s, kind, *rows[-1][1], *(residuals[c] for c in COLUMNS)))
        expected |= {(log, s): v for s, v in enumerate(plain_rebuild(rows, layout))}
        for place, (c, (i, p, signed, wraps)) in enumerate(layout.items()):
            name = c.replace("_0", "[0]").replace("_1", "[1]")
            definitions += [(log, t, place, name, signed, 4, code, 0 if wraps else 6) for t, code in (("I", i), ("P", p))]
    df = spark.createDataFrame(raw, "log_id long, stream_seq long, frame_type string, minthrottle int, motor_output_low int, vbatref int, a long, b_1 long, motor_0 long").repartition(5)
    found = fr.rebuild_fleet(df, spark.createDataFrame(definitions, FIELDS))
    assert {(r.log_id, r.stream_seq): tuple(r[f"{c}_value"] for c in COLUMNS) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow")) and "_segment" in plan


def test_logs_without_definitions_and_odd_codes(spark):
    df = spark.createDataFrame([(1, 0, "I", 5), (1, 1, "P", 6), (2, 0, "I", 7), (2, 1, "P", 8)], "log_id long, stream_seq long, frame_type string, a long")
    df = df.selectExpr("*", "0 as minthrottle", "0 as motor_output_low", "0 as vbatref")
    definitions = spark.createDataFrame([(2, "I", 0, "a", 1, 4, 1, 0), (2, "P", 0, "a", 1, 4, 77, 0)], FIELDS)
    assert sorted((r.log_id, r.stream_seq, r.a_value) for r in fr.rebuild_fleet(df, definitions).collect()) == [(1, 0, None), (1, 1, None), (2, 0, None), (2, 1, 8)]
    assert fr.rebuild_fleet(df.where("false"), definitions).count() == 0
