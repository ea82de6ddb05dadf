import math
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella import sample_values, topk_items
from tessella.errors import CodecError, CubeError
from tessella.functions.sketches import CentroidSketch, KmvSketch, SampleSketch, TopKSketch, sketch_of
from tessella.functions.states import CAPABILITIES, AverageState, QuantileState, VarianceState

WORDS = st.lists(st.text(max_size=6), max_size=40)


def fed(state, xs):
    for x in xs:
        state.add(x)
    return state


def test_golden_bytes():
    assert KmvSketch(8).extend(["alpha", "beta", "gamma"]).to_bytes().hex() == "4b4d56010800000003000000f6299d6fbff7700041f6df977ffffa285aab25f6b50369be"
    top = TopKSketch(4, [("beta", 2.5), ("alpha", 1.0)])
    assert top.to_bytes().hex() == "54504b0104000000020000000000000000000440040062657461000000000000f03f0500616c706861"
    sample = SampleSketch(4).extend(["alpha", "beta"])
    assert sample.to_bytes().hex() == "534d5001040000000200000041f6df977ffffa280400626574615aab25f6b50369be0500616c706861"
    assert CentroidSketch(1, [1.0, -2.0]).to_bytes().hex() == "43545201010000000000000002000000000000000000f03f00000000000000c0"
    assert fed(AverageState(), [1.5]).to_bytes().hex() == "41564702000000000000f83f0100000000000000dff5fa2d"
    assert fed(VarianceState(), [2.0]).to_bytes().hex() == "564152020100000000000000000000000000004000000000000000002a68d08b"
    assert topk_items(top.to_bytes()) == [("beta", 2.5), ("alpha", 1.0)] and sample_values(sample.to_bytes()) == ["beta", "alpha"]
    assert top.to_json() == '[{"key":"beta","score":2.5},{"key":"alpha","score":1.0}]'


@given(WORDS, WORDS, WORDS)
def test_kmv_laws(a, b, c):
    x, y, z = (KmvSketch(16).extend(w) for w in (a, b, c))
    assert x.merge(y).hashes == y.merge(x).hashes and x.merge(x).hashes == x.hashes
    assert x.merge(y).merge(z).hashes == x.merge(y.merge(z)).hashes == KmvSketch(16).extend(a + b + c).hashes
    assert KmvSketch.from_bytes(x.to_bytes()) == x and 0 <= x.jaccard(y) <= 1.0001


def test_kmv_estimates():
    x, y = KmvSketch().extend(str(i) for i in range(20_000)), KmvSketch().extend(str(i) for i in range(10_000, 30_000))
    assert abs(x.estimate() / 20_000 - 1) < 0.12 and abs(x.union_estimate(y) / 30_000 - 1) < 0.12 and 0.1 < x.jaccard(y) < 0.6
    assert KmvSketch().extend("abc").estimate() == 3.0 and KmvSketch().estimate() == 0.0
    with pytest.raises(CodecError):
        KmvSketch(4)


@pytest.mark.parametrize("state", [KmvSketch(8).extend(["a"]), TopKSketch(3, [("a", 1.0)]), SampleSketch(3).extend(["a"]), CentroidSketch(1, [1.0])])
def test_sketches_reject_broken_bytes(state):
    raw = state.to_bytes()
    assert sketch_of(raw) == state
    for bad in (raw[:-1], raw + b"\0", b"ZZZ" + raw[3:], raw[:3] + b"\x07" + raw[4:]):
        with pytest.raises(CodecError):
            sketch_of(bad)


def test_long_keys_do_not_wrap():
    with pytest.raises(CodecError):
        TopKSketch(2, [("x" * 70_000, 1.0)]).to_bytes()


def test_merges():
    assert TopKSketch(2, [("a", 1.0)]).merge(TopKSketch(2, [("a", 1.0), ("b", 2.0)])).items == [("a", 2.0), ("b", 2.0)]
    assert CentroidSketch(1, [1.0, 0.0]).merge(CentroidSketch(1, [0.0, 1.0])).mean() == [0.5, 0.5] and CentroidSketch().mean() is None
    with pytest.raises(CodecError):
        CentroidSketch(1, [1.0]).merge(CentroidSketch(1, [1.0, 2.0]))


@given(st.lists(st.floats(-1e6, 1e6), max_size=30), st.lists(st.floats(-1e6, 1e6), max_size=30))
def test_partitioned_states_agree(a, b):
    for make in (AverageState, VarianceState, lambda: QuantileState(0.5)):
        whole, parts = fed(make(), a + b), fed(make(), a).merge(fed(make(), b))
        if isinstance(whole, AverageState):
            assert whole.count == parts.count and (whole.value() is None or math.isclose(whole.value(), parts.value(), rel_tol=1e-9, abs_tol=1e-6))
        elif isinstance(whole, VarianceState):
            assert whole.count == parts.count and math.isclose(whole.m2, parts.m2, rel_tol=1e-6, abs_tol=1e-3)
        else:
            assert whole == parts and type(whole).from_bytes(whole.to_bytes()) == whole


def test_states_edges():
    q = fed(QuantileState(10.0), [1, 2, 15, 95])
    assert [q.quantile(p) for p in (0, 0.5, 1)] == [5.0, 5.0, 95.0] and QuantileState(1.0).quantile(0.5) is None
    with pytest.raises(CubeError):
        q.merge(QuantileState(11.0))
    for state in (AverageState(), VarianceState(), QuantileState(1.0)):
        with pytest.raises(CubeError):
            state.add(float("inf"))
    assert fed(VarianceState(), [1.0]).present() == '{"count":1,"mean":1.0,"populationVariance":0.0,"sampleVariance":null}' and VarianceState().present() is None
    raw = fed(AverageState(), [1.5]).to_bytes()
    assert AverageState.from_bytes(raw[:3] + b"\x01" + raw[4:-4]).value() == 1.5
    for bad in (raw[:-1] + bytes([raw[-1] ^ 1]), raw[:5] + bytes([raw[5] ^ 1]) + raw[6:], b"AV"):
        with pytest.raises(CodecError):
            AverageState.from_bytes(bad)
    assert zlib.crc32(raw[:-4]) == int.from_bytes(raw[-4:], "little")
    assert not any(c[2] and c[3] for c in CAPABILITIES.values())


def test_many_hashes_at_once_are_the_hashes_one_by_one():
    from tessella.functions.blake3 import blake3, blake3_many

    inputs = [bytes(range(256)) * 8, *[b"x" * n for n in (0, 1, 63, 64, 65, 127, 128, 1023, 1024, 1025, 3000)], b"abc"]
    assert blake3_many(inputs) == [blake3(b) for b in inputs] and blake3_many([]) == []
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
