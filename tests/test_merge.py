"""The merge of observations in ranges against a plain fold, with a hot site, and the plan that it runs."""

import random

from tessera.operators import records

SCHEMA = "site string, key string, pos long, value string, confidence string, source_url string, dirty boolean, verified boolean"
RANK = {"high": 2, "medium": 1}


def fold(rows):
    out = {}
    for site, key, pos, value, conf, url, dirty, verified in sorted(rows, key=lambda r: r[2]):
        value = value or ""
        c = out.get((site, key))
        if c is None:
            out[site, key] = [value, conf, pos, dirty, verified, []]
        elif not value:
            continue
        elif not c[0]:
            out[site, key] = [value, conf, pos, False, c[4], c[5]]
        elif value == c[0]:
            continue
        elif c[3] or c[4]:
            c[5].append(value)
        elif RANK.get(conf, 0) > RANK.get(c[1], 0):
            out[site, key] = [value, conf, pos, False, False, c[5]]
    return out


def observed(seed, n):
    dice, place, rows = random.Random(seed), {}, []
    for _ in range(n):
        k = ("hot", "a") if dice.random() < 0.5 else (f"s{dice.randrange(40)}", dice.choice("ab"))
        place[k] = place.get(k, -1) + dice.randrange(1, 4)
        # mostly low at first, so that takers lie in late ranges
        conf = dice.choices(["low", "medium", "high", "odd", None], [80, 3, 1, 5, 1])[0]
        first = place[k] < 4
        rows.append((*k, place[k], dice.choice(["", None, "A", "A", "B", "C"]) if dice.random() < 0.7 else "A", conf, "u", first and dice.random() < 0.2, first and dice.random() < 0.2))
    dice.shuffle(rows)
    return rows


def test_any_width_gives_the_fold(spark):
    for seed, width in ((1, 2), (2, 3), (3, 8), (4, 4096)):
        rows = observed(seed, 3000)
        df, want = spark.createDataFrame(rows, SCHEMA).repartition(4), fold(rows)
        cells = records.merge(df, width)
        assert {(r.site, r.key): (r.value, r.confidence, r.pos, r.dirty, r.verified) for r in cells.collect()} == {k: tuple(c[:5]) for k, c in want.items()}
        got = {}
        for r in records.conflicts(df, cells, width).orderBy("pos").collect():
            got.setdefault((r.site, r.key), []).append(r.incoming)
        assert got == {k: c[5] for k, c in want.items() if c[5]}


def test_few_survive(spark):
    rows = [("hot", "k", p, f"v{p % 7}", ("low", "medium", "high")[p % 3], "u", False, False) for p in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = records.survivors(df, 1000)
    assert once.count() <= 20 * 10 and records.survivors(once, 1_000_000).count() <= 10
    plan = once._jdf.queryExecution().toString()
    assert "hashpartitioning(site" in plan and "__range" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert records.merge(none).count() == 0 and records.conflicts(none).count() == 0
