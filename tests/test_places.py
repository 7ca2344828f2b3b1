"""Order checks and row numbers of files of many splits, without moving a row."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import END, START, put
from tidemark.contracts import ContractError
from tidemark.sources import csv, places


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path):
    return places.placed(spark.read.schema("n long, t long, s long").option("header", True).csv(path))


def brute(rows, column, strict):
    out, last = [], None
    for n, row in enumerate(rows):
        v = row[column]
        if v is not None:
            if last is not None and (v < last or (strict and v == last)):
                out.append((n, v, last))
            last = v
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_issues_and_numbers_of_many_splits(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    files, rows, t = [], [], 0
    for f in range(4):
        own = []
        for _ in range(rnd.choice([0, 1, 60, 200])):
            t += rnd.choice([0, 1, 1, 1, 2, -1 if rnd.random() < 0.1 else 1])
            blank = seed == 3 and rnd.random() < 0.7
            own.append((len(rows) + len(own), None if blank else t, t if rnd.random() < 0.9 else None))
        rows += own
        files.append(own)
        text = "n,t,s\n" + "".join(",".join("" if x is None else str(x) for x in r) + "\n" for r in own)
        put(tmp_path, f"part-{f}.csv", text)
    df = read(spark, str(tmp_path))
    if len(rows) > 60:
        assert df.select("place.file", "place.block").distinct().count() > 5  # really many splits
    assert {r.n: r.ingest for r in places.numbered(df).collect()} == {n: n for n in range(len(rows))}
    issues = places.order_issues(df, places.Rule("t", F.col("t")), places.Rule("s", F.col("s"), strict=True))
    got = {(r.code, r.ingest, r.value, r.prior) for r in places.numbered(issues, df).collect()}
    assert got == {(c, *x) for c, k, strict in (("t", 1, False), ("s", 2, True)) for x in brute(rows, k, strict)}


def test_a_fault_on_a_border_is_found(spark, tmp_path, small_splits):
    for bad in range(1, 60):
        times = [10 * k for k in range(60)]
        times[bad] = times[bad - 1] - 1
        path = put(tmp_path, f"t{bad}.csv", "n,t,s\n" + "".join(f"{k},{t},\n" for k, t in enumerate(times)))
        if bad % 7 == 0 or bad < 4:
            (found,) = places.numbered(places.order_issues(read(spark, path), places.Rule("t", F.col("t"))), read(spark, path)).collect()
            assert (found.ingest, found.value, found.prior) == (bad, times[bad], times[bad - 1])


def test_no_rows(spark, tmp_path):
    path = put(tmp_path, "none.csv", "n,t,s\n")
    df = read(spark, path)
    assert places.order_issues(df, places.Rule("t", F.col("t"))).collect() == [] and places.numbered(df).collect() == []


def test_sources_of_many_splits(spark, tmp_path, small_splits):
    ms = int(START.timestamp() * 1000)
    lines = [f"{ms + 5 * k},1.1,1.2\n" for k in range(200)]
    got = csv.ticks(spark, put(tmp_path, "a.csv", "time_msc,bid,ask\n" + "".join(lines)), START, END)
    assert got.rdd.getNumPartitions() > 1
    assert [(r.source_seq, r.time.microsecond) for r in got.orderBy("source_seq").collect()] == [(k, 5000 * k % 1_000_000) for k in range(200)]
    for k in (2, 57, 120, 199):
        bad = lines[:k] + [f"{ms + max(0, 5 * k - 6)},1.1,1.2\n"] + lines[k + 1 :]
        with pytest.raises(ContractError, match=f"row {k} .*step_back"):
            csv.ticks(spark, put(tmp_path, "b.csv", "time_msc,bid,ask\n" + "".join(bad)), START, END)
    first = lines[:40] + [f"{ms},1.3,1.2\n"] + lines[41:90] + [f"{ms},1.1,1.2\n"] + lines[91:]
    with pytest.raises(ContractError, match="row 40 .*bad_quote"):  # the first of several, though others lie in other splits
        csv.ticks(spark, put(tmp_path, "c.csv", "time_msc,bid,ask\n" + "".join(first)), START, END)
    numbers = ["time_msc,bid,ask,source_row_seq\n"] + [f"{ms + k},1.1,1.2,{2 * k}\n" for k in range(100)]
    assert csv.ticks(spark, put(tmp_path, "d.csv", "".join(numbers)), START, END).count() == 100
    numbers[77] = f"{ms + 76},1.1,1.2,150\n"
    with pytest.raises(ContractError, match="row 76 .*step_back"):
        csv.ticks(spark, put(tmp_path, "e.csv", "".join(numbers)), START, END)
    head = "signal_id,decision_time_utc,action\n"
    decisions = [f"d{k},2026-01-05T{k // 60:02}:{k % 60:02}:00Z,long\n" for k in range(100)]
    assert csv.decisions(spark, put(tmp_path, "f.csv", head + "".join(decisions)), START, END).count() == 100
    for k, text, code in ((64, decisions[30].replace("d30", "x"), "not_chronological"), (30, decisions[64].replace("01:04", "00:30"), "bad_id")):
        with pytest.raises(ContractError, match=code):
            csv.decisions(spark, put(tmp_path, "g.csv", head + "".join(decisions[:k] + [text] + decisions[k + 1 :])), START, END)
