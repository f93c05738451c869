"""Band-limited resampling against a direct sum, by tones, and in blocks."""

import math

import numpy as np
import pytest

from tessela.functions import resample


def direct(x, rate, to):
    """Each output as a sum over all samples."""
    wide, cut = resample.CROSSINGS * max(1.0, rate / to), min(1.0, to / rate)
    out = []
    for m in range(math.ceil(len(x) * to / rate - 1e-9)):
        p = m * rate / to
        total = weight = 0.0
        for k in range(math.floor(p - wide) - 1, math.ceil(p + wide) + 2):
            d = p - k
            if abs(d) < wide - 1e-12:
                w = np.sinc(cut * d) * (0.42 + 0.5 * math.cos(math.pi * d / wide) + 0.08 * math.cos(2 * math.pi * d / wide))
                weight += w
                total += w * (x[k] if 0 <= k < len(x) else 0.0)
        out.append(total / weight)
    return np.array(out)


@pytest.mark.parametrize(("rate", "to"), [(44100, 16000), (8000, 16000), (48000, 16000), (16000, 16000), (22051, 16000), (7, 3)])
def test_against_a_direct_sum(rate, to):
    x = np.random.default_rng(rate).uniform(-1, 1, 150)
    got = resample.resampled(x, rate, to)
    assert len(got) == math.ceil(150 * to / rate) and (rate == to or np.allclose(got, direct(x, rate, to), atol=1e-9))
    assert len(resample.resampled(np.zeros(0), rate, to)) == 0


@pytest.mark.parametrize("rate", [44100, 48000, 22050, 8000])
def test_tones_keep_their_amplitude(rate):
    n = rate
    for share in (0.01, 0.2, 0.5, 0.8, 0.9):
        f = share * min(rate, 16000) / 2
        y = resample.resampled(np.sin(2 * np.pi * f * np.arange(n) / rate), rate, 16000)[2000:-2000]
        t = np.arange(2000, 2000 + len(y)) / 16000
        a = 2 * abs(np.mean(y * np.exp(-2j * np.pi * f * t)))
        assert abs(20 * math.log10(a)) < 0.1, (f, a)
    if rate > 16000:  # above the new limit nothing is left to fold back
        y = resample.resampled(np.sin(2 * np.pi * 9200 * np.arange(n) / rate), rate, 16000)[2000:-2000]
        assert np.abs(y).max() < 0.001


@pytest.mark.parametrize("block", [100, 256])
def test_blocks_equal_the_whole(spark, block):
    rng = np.random.default_rng(3)
    clips = {f"c{rate}-{n}": (rate, rng.uniform(-1, 1, n)) for rate in (44100, 16000, 8000) for n in (1, 99, 100, 101, 999, 2048)}
    rows = [(c, s, rate, x[s * block : (s + 1) * block].tolist()) for c, (rate, x) in clips.items() for s in range(-(-len(x) // block))]
    got = {}
    for r in resample.resample_blocks(spark.createDataFrame(rows, "clip_id string, seq long, sr int, samples array<double>"), block, 16000).orderBy("clip_id", "seq").collect():
        assert r["first"] == sum(len(p) for p in got.get(r.clip_id, []))
        got.setdefault(r.clip_id, []).append(r.samples)
    for c, (rate, x) in clips.items():
        assert np.allclose(np.concatenate(got[c]), resample.resampled(x, rate, 16000), atol=1e-12), c


def test_short_blocks_are_refused(spark):
    rows = [("a", s, 44100, [0.0] * 50) for s in range(3)]
    with pytest.raises(Exception, match="shorter than the filter"):
        resample.resample_blocks(spark.createDataFrame(rows, "clip_id string, seq long, sr int, samples array<double>"), 50, 16000).collect()
