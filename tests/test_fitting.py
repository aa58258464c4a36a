"""Training that stops and goes on."""

import shutil

import numpy as np
import pytest

from epochal.operators import fitting


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    return spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)] + [([0.0, 0.0, 0.0], None)], "x array<double>, y int").repartition(5).cache()


def layers(run):
    return run.layers(run.epochs())


def test_resumed_equals_straight(rows, tmp_path):
    """Stopped after each of its epochs, or broken in the middle of one, a run gives what one without a stop gives."""
    model = fitting.Network(3, 3, 8)
    straight = fitting.fit(rows, model, str(tmp_path / "a"), 6)
    for n in (1, 2, 3):
        stopped = fitting.fit(rows, model, str(tmp_path / "b"), n)
    shutil.copytree(tmp_path / "b" / "layers" / "epoch=1", tmp_path / "b" / "layers" / "epoch=4")  # layers without their loss
    assert stopped.epochs() == 3
    stopped = fitting.fit(rows, model, str(tmp_path / "b"), 6)
    assert stopped.epochs() == 6 and np.allclose(stopped.losses(), straight.losses())
    for k, v in layers(straight).items():
        assert np.allclose(layers(stopped)[k], v)
    assert stopped.parameters().count() == 6 * sum(v.size for v in model.initial().values())


def test_gradient_against_differences(rows):
    model = fitting.Network(3, 3, 4)
    at = model.initial()
    gradient, loss, n = fitting.summed(rows, model, at)
    assert n == 400
    for k, place in (("hidden", (1, 2)), ("out", (4, 0)), ("out", (0, 1))):
        moved = {name: v.copy() for name, v in at.items()}
        moved[k][place] += 1e-6
        assert gradient[k][place] == pytest.approx((fitting.summed(rows, model, moved)[1] - loss) / 1e-6, rel=1e-3)


def test_it_learns_and_stops_early(rows, tmp_path):
    run = fitting.fit(rows, fitting.Network(3, 3, 16, rate=1.0), str(tmp_path / "a"), 25)
    assert run.losses()[-1] < 0.85 * run.losses()[0]
    still = fitting.fit(rows, fitting.Network(3, 3, 4, rate=0.0), str(tmp_path / "b"), 50, patience=3)
    assert still.epochs() == 4
    assert fitting.fit(rows, fitting.Network(3, 3, 4, rate=0.0), str(tmp_path / "b"), 50, patience=3).epochs() == 4


def test_warm_start_by_name(rows, tmp_path):
    """Layers of the same name and shape are taken, others begin anew."""
    first = fitting.fit(rows, fitting.Network(3, 3, 8), str(tmp_path / "a"), 2)
    other = fitting.Network(5, 3, 8, rate=0.0, seed=9)
    warm = fitting.fit(rows, other, str(tmp_path / "b"), 1, warm=first)
    assert np.allclose(layers(warm)["hidden"], layers(first)["hidden"])
    assert np.allclose(layers(warm)["out"], other.initial()["out"])


def test_integers_do_not_depend_on_partitions(spark, rows, tmp_path):
    whole = rows.selectExpr("transform(x, v -> cast(floor(100 * v) as long)) as x", "y")
    one, two = (fitting.fit(df, fitting.Perceptron(3, 3), str(tmp_path / n), 3) for n, df in (("a", whole.coalesce(1)), ("b", whole.repartition(11))))
    assert (layers(one)["scores"] == layers(two)["scores"]).all() and layers(one)["scores"].dtype == np.int64
    none = fitting.fit(whole.limit(0), fitting.Perceptron(3, 3), str(tmp_path / "c"), 2)
    assert not layers(none)["scores"].any() and none.losses() == [0.0, 0.0]
