"""WAV parsing, the voice gate, and batch plans."""

import struct
import wave
from collections import Counter

import numpy as np
import pytest

from textloom.operators import curate
from textloom.sources import audio


def _float_wav(x, rate=audio.RATE):
    data = np.asarray(x, "<f4").tobytes()
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(4000) / 10).astype("<f4")
    assert (audio.samples_of(_float_wav(x)) == x).all()
    (tmp_path / "a.wav").write_bytes(_float_wav(x))
    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(audio.RATE)
        f.writeframes((x * 32767).astype("<i2").tobytes())
    rows = audio.read_wav(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.window_no, len(r.samples)) for r in rows) == [(n, i, k) for n in ("a.wav", "b.wav") for i, k in enumerate((1600, 1600, 800))]
    for bad in (b"", b"RIFF", _float_wav(x)[:-1], _float_wav(x, 8000), _float_wav(x) + b"x"):
        with pytest.raises(ValueError):
            audio.samples_of(bad)


def test_voice_gate():
    gate = audio.VoiceGate(rate=10, preroll_s=0.3)
    assert gate.accept([1, 2], False)["forward"] is None
    assert gate.accept([3, 4], False)["forward"] is None
    got = gate.accept([5], True)
    assert got["started"] and got["forward"].tolist() == [2, 3, 4, 5]
    assert gate.accept([6], True)["forward"].tolist() == [6]
    end = gate.accept([7], False)
    assert end["ended"] and end["forward"].tolist() == [7]
    assert gate.accept([], True) == {"forward": None, "started": False, "ended": False}
    byw = audio.VoiceGate(rate=10, preroll_s=0.4, window=2)
    for w in ([1, 1], [2, 2], [3, 3]):
        byw.accept(w, False)
    assert byw.accept([4, 4], True)["forward"].tolist() == [2, 2, 3, 3, 4, 4]


def test_plan_batch():
    plan = curate.plan_batch({"a": 6, "b": 3, "c": 1}, {"a": 4}, 20, 100)
    assert Counter(s for _, s in plan) == {"a": 2, "b": 3, "c": 1}
    assert [i for i, _ in plan] == list(range(100, 106))
    assert plan == curate.plan_batch({"a": 6, "b": 3, "c": 1}, {"a": 4}, 20, 100)
    assert {s for _, s in curate.plan_batch({"a": 6, "b": 3, "c": 1}, {"a": 4}, 2, 0)} <= {"b", "c"}
