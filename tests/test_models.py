"""The recurrent net, the area under the curve, and scans by dialect and pruned directories."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.operators import direction, recurrent
from bellwether.sources import prices as price_files
from bellwether.sources import readers


def test_slope_of_the_net():
    rng = np.random.default_rng(1)
    flat = recurrent.started(3) + rng.normal(0, 0.1, len(recurrent.started(3)))
    x, y = rng.normal(size=(5, 4, 3)), np.array([0, 1, 1, 0, 1.0])
    loss, slope = recurrent.loss_and_slope(flat, x, y)
    for at in rng.choice(len(flat), 40, replace=False).tolist() + [len(flat) - 1, len(flat) - 2]:
        moved = flat.copy()
        moved[at] += 1e-6
        assert (recurrent.loss_and_slope(moved, x, y)[0] - loss) / 1e-6 == pytest.approx(slope[at], abs=1e-4)


def test_net_learns_what_a_line_cannot_part(spark):
    """A rise follows if exactly one of the last two values is high."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1600):
        steps = rng.integers(0, 2, (10, 3)).astype(float)
        target = int(steps[-1, 0] != steps[-2, 0])
        rows.append((f"T{i % 7}", datetime(2024, 1, 1) + timedelta(days=i), target, False, steps.ravel().tolist()))
    schema = "ticker string, trade_date timestamp, target int, is_last boolean, steps array<double>"
    samples = spark.createDataFrame(rows, schema).repartition(2)
    train, test = direction.split_samples(samples)
    found = recurrent.scored(test, recurrent.fit_recurrent(train))
    plain = test.withColumn("p_up", direction.p_up(direction.fit_direction(train)))
    right = F.avg(((F.col("p_up") > 0.5).cast("int") == F.col("target")).cast("double"))
    assert found.agg(right).first()[0] > 0.95 > 0.65 > plain.agg(right).first()[0]


def test_net_without_samples(spark):
    none = spark.createDataFrame([], "ticker string, trade_date timestamp, close double")
    sentiment = spark.createDataFrame([], "company string, normalized_sentiment double")
    assert recurrent.predict_recurrent(none, sentiment).isEmpty()
    assert tuple(direction.direction_area(none, sentiment).first()) == (0, 0, None)
    assert recurrent.compared_models(none, sentiment).isEmpty()


@pytest.mark.parametrize("ties", [True, False])
def test_area_is_the_share_of_right_pairs(spark, ties):
    rng = random.Random(4)
    rows = [(rng.choice((0.1, 0.5, 0.5001, 1.0)) if ties else rng.random() ** 6, rng.randrange(2)) for _ in range(300)]
    rows += [(None, 1), (0.2, None)]
    row = direction.area_under_curve(spark.createDataFrame(rows, "score double, label int").repartition(3)).first()
    up, down = ([s for s, y in rows if y == k and s is not None] for k in (1, 0))
    won = sum((a > b) + (a == b) / 2 for a in up for b in down)
    assert (row.positives, row.negatives) == (len(up), len(down))
    assert row.area == pytest.approx(won / (len(up) * len(down)))


def test_area_without_one_kind(spark):
    one = spark.createDataFrame([(0.3, 1)], "score double, label int")
    assert tuple(direction.area_under_curve(one).first()) == (1, 0, None)
    assert tuple(direction.area_under_curve(one.limit(0)).first()) == (0, 0, None)


def test_scan_lines_keeps_rejected_rows(spark, tmp_path, rows):
    header = "Company;Date;Text"
    (tmp_path / "a.csv").write_text(f'{header}\nA;2024-01-01;"x; y"\nB;2024-01-02;z;more;yet\n\nC;2024\n', "utf-8")
    (tmp_path / "b.csv").write_text(f"{header}\n;2024-01-03;é\n", "utf-8")
    kept, rejected = readers.scan_lines(spark, str(tmp_path), ["company", "timestamp"])
    assert kept.columns == ["company", "timestamp", "text"]
    assert rows(kept) == sorted(
        [("A", "2024-01-01", "x; y"), ("C", "2024", None), (None, "2024-01-03", "é")], key=str
    )
    assert rows(rejected) == [("B;2024-01-02;z;more;yet", 5)]
    with pytest.raises(ValueError):
        readers.scan_lines(spark, str(tmp_path), ["company", "nothing"])
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("\n")
    with pytest.raises(ValueError):
        readers.scan_lines(spark, str(tmp_path / "empty"), ["company"])


def test_dialects():
    assert readers.detect_dialect("a,b", ["a"], {})[0]["sep"] == ","
    assert readers.detect_dialect("a\tb;c", ["a"], {})[0]["sep"] == "\t"
    assert readers.detect_dialect('"a;x";b', ["b"], {}) == ({"sep": ";", "quote": '"'}, ["a;x", "b"])
    assert readers.detect_dialect('"a;b', ["b"], {}) == ({"sep": ";", "quote": "\u0000"}, ['"a', "b"])


def test_list_prunes_directories(spark, tmp_path):
    days = [(f"T{t}", datetime(2024, 1, 1) + timedelta(days=i), 1.0) for t in range(20) for i in range(3)]
    bars = spark.createDataFrame(days, "ticker string, trade_date timestamp, close double")
    path = str(tmp_path / "prices")
    price_files.write_price_table(bars, path)
    wanted = spark.createDataFrame([(f"T{t}", t) for t in range(20)], "ticker string, n int").filter("n < 2")
    found = price_files.prices_of(spark, path, wanted)
    assert found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_many_tickers_share_directories(spark, tmp_path, rows, monkeypatch):
    days = [(f"T{t}" if t else None, datetime(2024, 1, 1) + timedelta(days=200 * i), float(t)) for t in range(40) for i in range(3)]
    bars = spark.createDataFrame(days, "ticker string, trade_date timestamp, close double")
    listed = [("T3", 1), ("T3", 2), ("T17", 1), ("none", 1), (None, 1), ("T5", 9)]
    wanted = spark.createDataFrame(listed, "ticker string, n int").filter("n < 5")
    seen = []
    for most in (100, 4):
        monkeypatch.setattr(price_files, "DIRECTORIES", most)
        path = tmp_path / f"prices{most}"
        price_files.write_price_table(bars, str(path))
        assert len([p for p in path.iterdir() if p.is_dir()]) <= 40 and (most > 4 or len(list(path.glob("*/*.parquet"))) <= 8)
        found, whole = price_files.prices_of(spark, str(path), wanted, "2024-02-01"), price_files.read_price_table(spark, str(path))
        seen.append((found.columns, rows(found), whole.columns, rows(whole), whole.schema["ticker"].dataType))
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert seen[0] == seen[1]
    assert len(seen[0][1]) == 4 and len(seen[0][3]) == 120


def test_samples_lie_in_files_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(direction, "FILE_ROWS", 100)
    days = [(f"T{t}", datetime(2024, 1, 1) + timedelta(days=i), float(i * 7 % 11 + t)) for t in range(9) for i in range(90)]
    prices = spark.createDataFrame(days, "ticker string, trade_date timestamp, close double")
    sentiment = spark.createDataFrame([], "company string, normalized_sentiment double")
    samples = direction.written_samples(direction.model_rows(prices, sentiment))
    files = samples.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) > 600 and max(r["count"] for r in files) <= 100


def test_joined_layers_equal_single_ones():
    """One layer after the other, step by step, in plain form."""
    rng = np.random.default_rng(7)
    x, flat = rng.normal(size=(70, 10, 3)), recurrent.started(3) + rng.normal(0, 0.1, len(recurrent.started(3)))
    sizes = [int(np.prod(s)) for s in recurrent.shapes(3)]
    parts = [w.reshape(s) for w, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), recurrent.shapes(3), strict=True)]
    given, n = x, recurrent.CELLS
    for w, b in zip(parts[0:-2:2], parts[1:-2:2], strict=True):
        h, c, states = np.zeros((len(x), n)), np.zeros((len(x), n)), []
        for t in range(x.shape[1]):
            z = np.concatenate((given[:, t], h), axis=1) @ w + b
            i, f, o = (1 / (1 + np.exp(-z[:, k * n : (k + 1) * n])) for k in range(3))
            c = f * c + i * np.tanh(z[:, 3 * n :])
            h = o * np.tanh(c)
            states.append(h)
        given = np.stack(states, axis=1)
    plain = 1 / (1 + np.exp(-(given[:, -1] @ parts[-2] + parts[-1])))
    assert recurrent.chances(flat, x) == pytest.approx(plain, abs=1e-12)
    assert len(recurrent.chances(flat, x[:0])) == 0


def test_passes_over_written_samples_hash_no_days(spark):
    days = [(f"T{t}", datetime(2024, 1, 1) + timedelta(days=i), float(i * 7 % 11 + t)) for t in range(4) for i in range(60)]
    prices = spark.createDataFrame(days, "ticker string, trade_date timestamp, close double")
    sentiment = spark.createDataFrame([], "company string, normalized_sentiment double")
    samples = direction.written_samples(direction.model_rows(prices, sentiment)).filter("known")
    read = direction.split_samples(samples)
    hashed = direction.split_samples(samples.select("ticker", "trade_date", "is_last", "target"))
    for part, again in zip(read, hashed, strict=True):
        assert "md5" not in part._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" in again._jdf.queryExecution().optimizedPlan().toString()
        keys = [sorted(tuple(r) for r in p.select("ticker", "trade_date").collect()) for p in (part, again)]
        assert keys[0] == keys[1] and keys[0]
