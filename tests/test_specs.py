import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella import validate_spec
from tessella.errors import CodecError, CubeError, SpecError
from tessella.functions import encoding as enc
from tessella.functions.blake3 import blake3
from tessella.plans.shapes import attributes, generate_xunits, shapes
from tessella.rules import keeps, most_dimensions
from tessella.spec import CubeSpec
from tessella.xunits import XUnit, YPath, scrub, unscrub

BASE = {"apiVersion": "v1", "name": "c", "dimensions": [{"name": "geo", "levels": ["country", "city"]}, {"name": "gender"}, {"name": "platform", "levels": ["device", "browser"]}], "measures": [{"name": "n", "agg": "count"}]}
TEMPORAL = {"eventTime": "ts", "baseResolution": "1d", "allowedLateness": "6h", "rollups": ["7d"]}
ROW = {"geo": ["CZ", "Brno"], "gender": ["F"], "platform": ["phone", "fox"]}


def spec(**more):
    return CubeSpec.from_dict(BASE | more)


def problems(**more):
    with pytest.raises(SpecError) as e:
        spec(**more)
    return " | ".join(e.value.problems)


def test_paths_and_cells():
    p = YPath.parse("/geo/country=CZ/city=a___b")
    assert p.attrs == (("country", "CZ"), ("city", "a/b")) and str(p) == "/geo/country=CZ/city=a___b"
    x = XUnit.parse("/z/a=1,/b/c=2")
    assert x.dims == ["b", "z"] and str(x) == "/b/c=2,/z/a=1" and str(x.without("b")) == "/z/a=1"
    assert str(XUnit.parse("/G")) == "/G" and x.has("z") and x.path("q") is None
    assert str(YPath("t", (("year", None),))) == "/t/year"
    for bad in ("", "geo", "/", "/geo//a=1"):
        with pytest.raises(CubeError):
            XUnit.parse(bad)
    with pytest.raises(CubeError):
        XUnit.parse("/a/x=1,/a/x=2")


@given(st.text(alphabet="ab/=,é ", max_size=12))
def test_scrubbing_round_trip(v):
    assert unscrub(scrub(v)) == v
    if v:
        assert YPath.parse(str(YPath("d", (("a", v),)))).attrs == (("a", v),)


def test_spec_problems_come_together():
    text = problems(name="", dimensions=[{"name": "a/b"}, {"name": "a/b", "levels": ["x", "x"]}], filterRules=[{"type": "top_level", "dim": "q"}, {"type": "max_dimensions", "n": 0}], measures=[{"name": "m", "agg": "sum"}, {"name": "m", "agg": "top_k", "input": "x"}, {"name": "k", "agg": "min", "input": "x", "by": "y"}], maxDictionaryEntries=0)
    for part in ("no name", "holds one of", "two dimensions", "two levels", "unknown dimension 'q'", "keeps no cell", "sum needs an input", "top_k needs 'by'", "only top_k takes", "two measures", "maxDictionaryEntries"):
        assert part in text


def test_versions_and_state():
    assert "temporal section needs" in problems(temporal=TEMPORAL)
    v2 = {"apiVersion": "cubism/v2alpha1", "temporal": TEMPORAL}
    assert spec(**v2).temporal.lateness == 6 * 3_600_000_000
    assert "needs a temporal section" in problems(apiVersion="cubism/v2alpha1")
    assert "neither" in problems(apiVersion="v9")
    for change, part in [({"timezone": "CET"}, "only 'UTC'"), ({"baseResolution": "month"}, "calendar"), ({"rollups": ["36h"]}, "no multiple"), ({"rollups": ["1h"]}, "not coarser"), ({"eventTime": " "}, "eventTime is empty")]:
        assert part in problems(**v2 | {"temporal": TEMPORAL | change})
    m = lambda **s: [{"name": "m", "agg": "quantile", "input": "x", "state": s}]
    assert "state parameters need" in problems(measures=m(quantileBinWidth=1.0))
    assert "needs state.quantileBinWidth" in problems(**v2, measures=m())
    assert "kmvSize is for" in problems(**v2, measures=m(quantileBinWidth=1.0, kmvSize=64))
    assert "finite" in problems(**v2, measures=m(quantileBinWidth=-1.0))
    assert "no temporal state" in problems(**v2, measures=[{"name": "m", "agg": "top_k", "input": "x", "by": "y"}])
    for wrong in ({"surprise": 1}, {"filterRules": [{"type": "nope"}]}, {"filterRules": [{"type": "top_level", "dim": "geo", "n": 1}]}):
        with pytest.raises(SpecError):
            spec(**wrong)


def test_yaml_json_and_hash():
    s = spec(filterRules=[{"type": "and", "rules": [{"type": "not_alone", "dim": "geo"}]}], includeGlobal=True)
    again = CubeSpec.from_yaml(s.to_yaml())
    assert again == s and again.spec_hash() == s.spec_hash() and len(s.spec_hash()) == 32
    assert spec().spec_hash() != s.spec_hash() and validate_spec(s.to_yaml()) == "c"


def test_lattice_counts():
    assert len(generate_xunits(spec(), ROW)) == 17
    assert len(generate_xunits(spec(filterRules=[{"type": "max_dimensions", "n": 3}], includeGlobal=True), ROW)) == 18
    assert len(generate_xunits(spec(filterRules=[{"type": "min_dimensions", "n": 3}]), ROW)) == 4
    assert len(shapes(spec())) == 17


RULE = st.deferred(lambda: st.one_of(
    st.builds(lambda n: {"type": "max_dimensions", "n": n}, st.integers(1, 3)), st.builds(lambda n: {"type": "min_dimensions", "n": n}, st.integers(0, 3)),
    st.builds(lambda t, d: {"type": t, "dim": d}, st.sampled_from(["contains_dim", "top_level", "not_alone", "only_with"]), st.sampled_from(["geo", "gender", "platform"])),
    st.builds(lambda t, d: {"type": t, "dims": d}, st.sampled_from(["contains_all_dims", "not_together"]), st.lists(st.sampled_from(["geo", "gender"]), max_size=2)),
    st.just({"type": "not_with_attribute", "dim": "gender", "other_dim": "geo", "attr": "city"}),
    st.builds(lambda t, r: {"type": t, "rules": r}, st.sampled_from(["and", "or"]), st.lists(RULE, max_size=2)),
))


@given(st.lists(RULE, max_size=3), st.booleans())
def test_pruned_lattice_is_the_filtered_one(rules, glob):
    s = spec(filterRules=rules, includeGlobal=glob)
    assert list(map(str, generate_xunits(s, ROW))) == list(map(str, generate_xunits(s, ROW, pruned=False)))


def test_rules_that_are_vacuous():
    shape = {"geo": ("country",)}
    assert keeps({"type": "and", "rules": []}, shape) and not keeps({"type": "or", "rules": []}, shape) and not keeps({"type": "not_together", "dims": []}, shape)
    assert most_dimensions([{"type": "and", "rules": [{"type": "max_dimensions", "n": 2}]}, {"type": "max_dimensions", "n": 3}]) == 2
    assert most_dimensions([{"type": "or", "rules": [{"type": "max_dimensions", "n": 1}]}]) is None
    assert attributes(spec(), (0, 2, 1)) == {"geo": ("country", "city"), "platform": ("device",)}


def test_canonical_bytes():
    raw = enc.canonical_bytes(XUnit.parse("/geo/country=CZ"))
    assert raw.hex() == "43585501000000010000000367656f0000000100000007636f756e7472790600000002435a"
    assert enc.content_id(XUnit.parse("/geo/country=CZ")).hex() == "bed9c102177b3a386d76f139182452ae0f343c8760bf439d66aca37ad547fc4a"
    values = [("a", None), ("b", True), ("c", -5), ("d", 1.5), ("e", "x"), ("f", b"\0")]
    assert enc.decode_canonical(enc.canonical([("d", values)])) == [("d", values)]
    assert enc.encode_value(-0.0) == enc.encode_value(0.0) and str(enc.decode_unit(raw)) == "/geo/country=CZ"
    for bad in (raw[:-1], raw + b"\0", b"XXX" + raw[3:]):
        with pytest.raises(CodecError):
            enc.decode_canonical(bad)
    with pytest.raises(CodecError):
        enc.encode_value(float("nan"))


def test_blake3_of_many_chunks():
    #: Published test vectors, input bytes i mod 251.
    known = {0: "af1349b9f5f9a1a6", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2048: "e776b6028c7cd22a", 3072: "b98cb0ff3623be03", 31744: "62b6960e1a44bcc1"}
    for n, start in known.items():
        assert blake3(bytes(i % 251 for i in range(n))).hex().startswith(start)
