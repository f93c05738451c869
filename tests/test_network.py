"""The pitch network against nested loops."""

import json
import math

import numpy as np
import pytest

from tessela.operators import network
from tessela.operators.network import Conv, Dense
from tessela.sources import assets

LAYERS = [Conv("c1", 4), Conv("c2"), Dense("d")]


def some_weights(rng, sizes, length):
    """Weights of convolutions (name, width, filters, stride) and a dense layer (name, units)."""
    out, channels = {}, 1
    for name, *form in sizes:
        if len(form) == 3:
            width, filters, stride = form
            out |= {f"{name}/kernel": rng.normal(size=(width, 1, channels, filters)), f"{name}/bias": rng.normal(size=filters)}
            out |= {f"{name}/{p}": rng.normal(size=filters) for p in ("gamma", "beta", "moving_mean")} | {f"{name}/moving_variance": rng.uniform(0.1, 2, filters)}
            channels, length = filters, -(-length // stride) // 2
        else:
            out |= {f"{name}/kernel": rng.normal(size=(length * channels, form[0])) / 5, f"{name}/bias": rng.normal(size=form[0])}
    return out


def loops(x, w, layers):
    rows = [[v] for v in x]
    for layer in layers:
        k, b = w[f"{layer.name}/kernel"], w[f"{layer.name}/bias"]
        if isinstance(layer, Dense):
            flat = [v for r in rows for v in r]
            return [1 / (1 + math.exp(-(sum(v * k[i][u] for i, v in enumerate(flat)) + b[u]))) for u in range(k.shape[1])]
        width, n = k.shape[0], math.ceil(len(rows) / layer.stride)
        left = max(0, (n - 1) * layer.stride + width - len(rows)) // 2
        made = []
        for o in range(n):
            line = []
            for f in range(k.shape[3]):
                total = b[f]
                for t in range(width):
                    i = o * layer.stride + t - left
                    if 0 <= i < len(rows):
                        total += sum(rows[i][c] * k[t][0][c][f] for c in range(k.shape[2]))
                norm = (max(0.0, total) - w[f"{layer.name}/moving_mean"][f]) / math.sqrt(w[f"{layer.name}/moving_variance"][f] + 1e-3)
                line.append(w[f"{layer.name}/gamma"][f] * norm + w[f"{layer.name}/beta"][f])
            made.append(line)
        rows = [[max(p, q) for p, q in zip(made[2 * i], made[2 * i + 1], strict=True)] for i in range(len(made) // 2)]
    raise AssertionError


@pytest.mark.parametrize("length", [32, 36, 45])
def test_against_nested_loops(length):
    rng = np.random.default_rng(length)
    w = some_weights(rng, [("c1", 9, 3, 4), ("c2", 4, 2, 1), ("d", 5)], length)
    x = rng.normal(size=(3, length))
    got = network.Network(w, LAYERS).activations(x)
    assert np.allclose(got, [loops(row, w, LAYERS) for row in x], atol=1e-12)


def test_shape_of_the_pitch_network():
    rng = np.random.default_rng(1)
    sizes = [("conv1", 512, 128, 4), *((f"conv{i}", 64, n, 1) for i, n in ((2, 16), (3, 16), (4, 16), (5, 32), (6, 64))), ("classifier", 360)]
    w = {k: v.astype(np.float32) for k, v in some_weights(rng, sizes, 1024).items()}
    assert w["classifier/kernel"].shape == (256, 360)
    out = network.Network(w, network.PITCH_LAYERS).activations(rng.normal(size=(2, 1024)))
    assert out.shape == (2, 360) and out.dtype == np.float32 and ((out >= 0) & (out <= 1)).all()


def test_frames_of_a_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    w = some_weights(rng, [("c1", 9, 3, 4), ("c2", 4, 2, 1), ("d", 5)], 32)
    rows = [(i // 10, i, rng.normal(size=32).tolist() if i != 13 else None) for i in range(60)]
    frames = spark.createDataFrame(rows, "clip_id int, frame_no int, samples array<double>")
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, values array<double>")
    for r in network.activations(frames, table, LAYERS).collect():
        x = rows[r.frame_no][2]
        assert (r.a is None) if x is None else np.allclose(r.a, loops(x, w, LAYERS), atol=1e-9)
    assert network.activations(frames.limit(0), table, LAYERS).collect() == []
    monkeypatch.setattr(network, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError, match="at most 10"):
        network.activations(frames, table, LAYERS)


def test_weights_of_a_saved_network(spark, tmp_path):
    rng = np.random.default_rng(3)
    w = {k: v.astype("<f4") for k, v in some_weights(rng, [("c1", 9, 3, 4), ("d", 5)], 32).items()}
    names = [(k, "x_" + (k if k.split("/")[1] in ("kernel", "bias") else k.replace("/", "_BN/"))) for k in w]
    raw = b"".join(w[k].tobytes() for k, _ in names)
    (tmp_path / "g1").write_bytes(raw[:100])
    (tmp_path / "g2").write_bytes(raw[100:])
    listed = [{"name": n, "shape": list(w[k].shape), "dtype": "float32"} for k, n in names]
    (tmp_path / "model.json").write_text(json.dumps({"weightsManifest": [{"paths": ["g1", "g2"], "weights": listed}]}))
    got = network.gathered(assets.layer_weights(spark, str(tmp_path), prefix="x_"))
    assert got.keys() == w.keys() and all(np.array_equal(got[k], w[k]) for k in w)
