"""Stored samples give the baselines that reading the history gives."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from assay.operators import samples
from tests.test_state import START

SCHEMA = "clause_id int, metric string, run_id string, run_key string, started_at timestamp, measured double"


def measures(seed, clauses=6):
    draw = random.Random(seed)
    rows = []
    for clause in range(clauses):
        for _ in range(draw.choice([3, 40, 180])):
            n = len(rows)
            hours = draw.choice((draw.randint(0, 1000), 24 * draw.randint(0, 40)))
            key = draw.choice([None, None, "k", f"k{draw.randint(0, 9)}"])
            value = None if draw.random() < 0.2 else float(draw.randint(0, 50))
            rows.append((clause, draw.choice(["sum", "avg"]), f"r{n:05d}", key, START + timedelta(hours=hours), value))
    return rows


def asked(spark, rows):
    kinds = [("previous run", 1), ("same weekday", 1), ("last runs", 5), ("last runs", 30)]
    keys = sorted({(r[0], "sum") for r in rows})  # a clause asks for its own metric
    return [spark.createDataFrame([(*k, kind, n) for k in keys], "clause_id int, metric string, baseline string, runs int") for kind, n in kinds]


def plainly(rows, kind, n, now, key):
    """(clause, metric) -> (value, newest run) as the history has them."""
    out = {}
    for clause, metric in {(r[0], "sum") for r in rows}:
        mine = [r for r in rows if r[:2] == (clause, metric) and r[4] < now and r[5] is not None and (key is None or r[3] != key)]
        mine.sort(key=lambda r: (r[4], r[2]), reverse=True)
        if kind == "same weekday":
            limit = now.replace(hour=0, minute=0) - timedelta(days=6)
            mine = [r for r in mine if r[4] <= limit and r[4].weekday() == now.weekday()]
        if len(mine) >= n:
            out[clause, metric] = (sum(r[5] for r in mine[:n]) / n, mine[0][2], min(r[4] for r in mine[:n]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_stored_baselines_equal_those_of_the_history(spark, seed):
    rows = measures(seed)
    draw = random.Random(seed)
    history = spark.createDataFrame(rows, SCHEMA)
    batch = history.where(F.col("run_id").isin(*[r[2] for r in rows if draw.random() < 0.3]))
    earlier = history.join(batch.select("run_id"), "run_id", "left_anti")
    table = samples.newest_samples(earlier)
    table = samples.advance_samples(table, batch)
    table.write.parquet(folder := samples_folder(spark))
    table = spark.read.parquet(folder)
    assert sorted(map(str, table.collect())) == sorted(map(str, samples.newest_samples(history).collect()))
    for now, key in ((START + timedelta(days=50), None), (START + timedelta(days=41, hours=7), "k"), (START + timedelta(days=20), "k3")):
        at = F.lit(now).cast("timestamp")
        for wanted in asked(spark, rows):
            kind, n = wanted.first()["baseline"], wanted.first()["runs"]
            got = samples.stored_baselines(table, wanted, at, key, history)
            want = plainly(rows, kind, n, now, key)
            found = sorted((r.clause_id, round(r.previous, 9), r.previous_run, r.oldest) for r in got.collect())
            assert found == sorted((c, round(v, 9), run, old) for (c, _), (v, run, old) in want.items()), (now, key, kind, n)


def samples_folder(spark):
    from assay.sources.results import shared_folder

    return shared_folder(spark)


def test_a_newest_run_reads_no_history(spark):
    rows = [(1, "sum", f"r{i:03d}", None, START + timedelta(hours=i), float(i)) for i in range(500)]
    history = spark.createDataFrame(rows, SCHEMA)
    table = samples.newest_samples(history)
    assert len(table.first()["ring"]) == samples.RING and len(table.first()["days"]) == 14
    now = F.lit(START + timedelta(hours=500)).cast("timestamp")
    wanted = spark.createDataFrame([(1, "sum", "last runs", 100)], samples.WANTED.replace("clause_id string", "clause_id int"))
    (row,) = samples.stored_baselines(table, wanted, now).collect()
    assert (row.previous, row.samples, row.previous_run) == (pytest.approx(449.5), 100, "r499")
    early = F.lit(START + timedelta(hours=50)).cast("timestamp")
    (row,) = samples.stored_baselines(table, wanted.withColumn("runs", F.lit(10)), early, history=history).collect()
    assert row.previous == pytest.approx(44.5)
    with pytest.raises(Exception, match="older samples are needed of clause 1"):
        samples.stored_baselines(table, wanted, early).collect()


def test_clauses_whose_results_went_are_rebuilt(spark):
    rows = [(c, "sum", f"r{i:03d}", None, START + timedelta(hours=i), float(i)) for c in (1, 2) for i in range(150)]
    history = spark.createDataFrame(rows, SCHEMA)
    left = history.where("not (clause_id = 1 and run_id = 'r149')")
    table = samples.advance_samples(samples.newest_samples(history), history.limit(0), left.where("clause_id = 1").select("clause_id"), left)
    assert sorted(map(str, table.collect())) == sorted(map(str, samples.newest_samples(left).collect()))


