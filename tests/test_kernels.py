import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantaloom.functions import codebooks, kernels
from quantaloom.functions.formats import BLOCK
from quantaloom.operators import blocks, packing
from quantaloom.plans import file_queries
from quantaloom.plans.queries import QUERIES


def stand_in(dim, count, alphabet):
    """A grid for tests: the points of least norm."""
    points = np.array(list(itertools.product(alphabet, repeat=dim)), np.int32)
    return points[np.lexsort((*points.T[::-1], (points * points).sum(axis=1)))[:count]]


for _name, (_dim, _count, *_) in codebooks.SHAPES.items():
    codebooks.use_grid(_name, stand_in(_dim, _count, (-1, 0, 1) if _name.startswith("IQ1") else (8, 25, 43) if _name.startswith("IQ2") else (4, 12, 20, 28, 36, 44, 52, 62) if _name == "IQ3_XXS" else (1, 3, 5, 7, 9, 11, 13, 15)))

ALL = sorted(n for n in BLOCK)
#: Largest relative error on normal values, with importances.
LIMIT = {"Q2_K": 0.3, "Q3_K": 0.16, "Q4_K": 0.08, "Q5_K": 0.04, "Q6_K": 0.02, "Q8_K": 0.01, "Q8_0": 0.007, "Q8_1": 0.007, "Q4_0": 0.1, "Q4_1": 0.09, "Q5_0": 0.05, "Q5_1": 0.045, "IQ4_NL": 0.08, "IQ4_XS": 0.085, "IQ3_S": 0.15, "IQ3_XXS": 0.2, "IQ2_S": 0.26, "IQ2_XS": 0.3, "IQ2_XXS": 0.35, "IQ1_S": 0.55, "IQ1_M": 0.55, "F32": 0, "F16": 1e-3, "BF16": 4e-3, "MXFP4": 0.13, "MXFP4_OCP": 0.13, "NVFP4": 0.11, "NVFP4_GGUF": 0.11, "MXFP8": 0.035, "FP8_E4M3": 0.035, "FP8_E5M2": 0.065}


def sample(rows=6, cols=512, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(rows, cols)) * 0.1).astype("f4"), rng.uniform(0.1, 2, cols).astype("f4")


@pytest.mark.parametrize("name", ALL)
def test_error_and_size(name):
    x, g = sample()
    y = kernels.roundtrip(name, x, g)
    assert y.shape == x.shape and np.isfinite(y).all()
    if name in LIMIT:
        assert np.sqrt((g * (x - y) ** 2).sum() / (g * x * x).sum()) <= LIMIT[name]
    if name not in ("NVFP4", "FP8_E4M3", "FP8_E5M2"):
        block, size = BLOCK[name]
        assert kernels.quantize(name, x, g).shape == (6, 512 // block * size)


@pytest.mark.parametrize("name", ALL)
def test_edge_blocks(name):
    zero, one = np.zeros((1, 256), "f4"), np.zeros((1, 256), "f4")
    one[0, 10] = 1.5
    g = np.ones(256, "f4")
    assert (kernels.roundtrip(name, zero, g) == 0).all()
    y = kernels.roundtrip(name, one, g)
    assert np.isfinite(y).all()
    if name not in ("Q1_0", "IQ1_S", "IQ1_M"):
        assert abs(y[0, 10] - 1.5) < 0.6


@pytest.mark.parametrize("name", ["Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K", "IQ4_NL"])
def test_importance_helps(name):
    x, _ = sample(20)
    g = np.where(np.arange(512) % 7 == 0, 50, 0.05).astype("f4")
    err = lambda y: (g * (x - y) ** 2).sum()
    assert err(kernels.roundtrip(name, x, g)) < err(kernels.roundtrip(name, x))


def test_refusals():
    x, g = sample()
    for bad in (lambda: kernels.quantize("Q4_K", x[:, :100]), lambda: kernels.quantize("IQ2_XXS", x), lambda: kernels.quantize("NVFP4", x), lambda: kernels.dequantize("FP8_E4M3", x, 5), lambda: kernels.quantize("Q4_0", x[:, :0])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("table", [kernels.E4M3, kernels.E5M2, kernels.E2M1])
def test_codes_round_trip(table):
    codes = np.arange(len(table), dtype=np.uint8)
    for sign in (0, 8 if len(table) == 8 else 128):
        values = kernels.decode_mini(codes | sign, table)
        assert (kernels.encode_mini(values, table) == (codes | sign)).all()


def test_small_floats():
    assert kernels.E4M3[-1] == 448 and kernels.E5M2[-1] == 57344
    x = np.array([0.25, 0.75, 2.5, 5.0, 7.0, -0.25], "f4")
    assert kernels.decode_mini(kernels.encode_mini(x, kernels.E2M1, "down"), kernels.E2M1).tolist() == [0, 0.5, 2, 4, 6, 0]
    assert kernels.e8m0(np.array([1.0, 1.99, 0.0, np.inf, -1])).tolist() == [127, 127, 0, 0, 0]
    assert kernels.decode_mini(np.array([0x7F], np.uint8), kernels.E4M3)[0] != kernels.decode_mini(np.array([0x7F], np.uint8), kernels.E4M3)[0]
    assert np.isinf(kernels.decode_mini(np.array([0x7C], np.uint8), kernels.E5M2)[0])


def test_refinement_is_never_worse():
    x, g = sample(16)
    w = np.tile(g.reshape(-1, 32), (16, 1))
    b = x.reshape(-1, 32)
    err = lambda raw: (w * (b - kernels.dec_mxfp4(raw)) ** 2).sum()
    assert err(kernels.enc_mxfp4(b, w, True)) <= err(kernels.enc_mxfp4(b, w))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4, width=32), min_size=256, max_size=256))
def test_any_values(values):
    x = np.array([values], "f4")
    for name in ("Q4_0", "Q8_0", "TQ1_0", "TQ2_0", "Q4_K", "Q6_K", "MXFP8"):
        y = kernels.roundtrip(name, x)
        assert np.isfinite(y).all()
    top = np.abs(x).max()
    assert np.abs(kernels.roundtrip("Q8_0", x) - x).max() <= top / 127 * 0.56 + 1e-6 + top * 1e-3
    assert (kernels.roundtrip("TQ1_0", x) == kernels.roundtrip("TQ2_0", x)).all()


@pytest.mark.parametrize("name", ["Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1", "Q2_0", "Q1_0", "TQ2_0", "Q8_K", "MXFP4", "MXFP8", "F16", "BF16", "FP8_E4M3", "NVFP4"])
def test_columns_equal_kernels(spark, name):
    x, _ = sample(4, 256, 3)
    rows = spark.createDataFrame([("t", i, r.tolist()) for i, r in enumerate(x)], "tensor string, row long, x array<float>")
    got = {r["row"]: [y["v"] for y in r["e"]] for r in blocks.roundtrip(rows, name).collect()}
    assert np.array_equal(np.array([got[i] for i in range(4)], "f4"), kernels.roundtrip(name, x))


def test_pack_unpack(spark):
    x, g = sample(5)
    rows = [("a", i, r.tolist(), "Q4_K", g.tolist()) for i, r in enumerate(x)] + [("b", i, r.tolist(), "Q8_0", None) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "tensor string, row long, x array<float>, fmt string, g array<float>").repartition(3)
    packed = packing.pack(frame)
    raw = {(r["tensor"], r["row"]): bytes(r["raw"]) for r in packed.collect()}
    assert raw["a", 2] == kernels.quantize("Q4_K", x, g)[2].tobytes() and raw["b", 4] == kernels.quantize("Q8_0", x)[4].tobytes()
    back = packing.unpack(packed.join(frame.select("tensor", "row", "fmt"), ["tensor", "row"]).selectExpr("*", "512 as cols"))
    assert np.allclose(next(r["x"] for r in back.collect() if (r["tensor"], r["row"]) == ("b", 0)), kernels.roundtrip("Q8_0", x)[0])
    cost = {(r["tensor"], r["fmt"]): r for r in packing.costs(frame.drop("fmt", "row"), ["Q4_K", "Q8_0", "IQ2_XXS"]).collect()}
    assert ("b", "IQ2_XXS") not in cost and ("a", "IQ2_XXS") in cost
    assert cost["b", "Q8_0"]["err"] < cost["b", "Q4_K"]["err"] and cost["b", "Q8_0"]["bytes"] == 5 * 512 // 32 * 34


def half(raw):
    return float(np.frombuffer(bytes(raw), "<f2")[0])


def scalar(name, raw, points):
    """One block, value by value, from the format's description."""
    word = lambda at, n: int.from_bytes(bytes(raw[at : at + n]), "little")
    eight = lambda seven: [-1 if seven >> i & 1 else 1 for i in range(7)] + [-1 if bin(seven).count("1") % 2 else 1]
    out = []
    for ib in range(8):
        if name == "IQ2_XXS":
            aux = word(2 + 8 * ib + 4, 4)
            for j in range(4):
                out += [half(raw[:2]) * (0.5 + (aux >> 28)) * 0.25 * p * s for p, s in zip(points[raw[2 + 8 * ib + j]], eight(aux >> 7 * j & 127), strict=True)]
        elif name == "IQ2_XS":
            for j in range(4):
                q, scale = word(2 + 8 * ib + 2 * j, 2), raw[66 + ib] >> 4 * (j // 2) & 15
                out += [half(raw[:2]) * (0.5 + scale) * 0.25 * p * s for p, s in zip(points[q & 511], eight(q >> 9), strict=True)]
        elif name == "IQ2_S":
            for j in range(4):
                k = raw[2 + 4 * ib + j] + ((raw[66 + ib] >> 2 * j & 3) << 8)
                signs, scale = raw[34 + 4 * ib + j], raw[74 + ib] >> 4 * (j // 2) & 15
                out += [half(raw[:2]) * (0.5 + scale) * 0.25 * p * (-1 if signs >> i & 1 else 1) for i, p in enumerate(points[k])]
        elif name == "IQ3_XXS":
            aux = word(66 + 4 * ib, 4)
            for j in range(4):
                both = [*points[raw[2 + 8 * ib + 2 * j]], *points[raw[3 + 8 * ib + 2 * j]]]
                out += [half(raw[:2]) * (0.5 + (aux >> 28)) * 0.5 * p * s for p, s in zip(both, eight(aux >> 7 * j & 127), strict=True)]
        elif name == "IQ3_S":
            scale = raw[106 + ib // 2] >> 4 * (ib % 2) & 15
            for j in range(8):
                k = raw[2 + 8 * ib + j] + ((raw[66 + ib] >> j & 1) << 8)
                signs = raw[74 + 4 * ib + j // 2] >> 4 * (j % 2)
                out += [half(raw[:2]) * (1 + 2 * scale) * p * (-1 if signs >> i & 1 else 1) for i, p in enumerate(points[k])]
        elif name == "IQ1_S":
            high = word(34 + 2 * ib, 2)
            for j in range(4):
                out += [half(raw[:2]) * (2 * (high >> 12 & 7) + 1) * (p + (-0.125 if high >> 15 else 0.125)) for p in points[raw[2 + 4 * ib + j] + ((high >> 3 * j & 7) << 8)]]
        else:
            scales = [word(48 + 2 * i, 2) for i in range(4)]
            d = half(sum((s >> 12) << 4 * i for i, s in enumerate(scales)).to_bytes(2, "little"))
            for j in range(4):
                h = raw[32 + 2 * ib + j // 2] >> 4 * (j % 2) & 15
                step = scales[ib // 2] >> 6 * (ib % 2) + 3 * (j // 2) & 7
                out += [d * (2 * step + 1) * (p + (-0.125 if h & 8 else 0.125)) for p in points[raw[4 * ib + j] + ((h & 7) << 8)]]
    return out


@pytest.mark.parametrize("name", codebooks.SHAPES)
def test_codebook_layouts(name):
    rng = np.random.default_rng(3)
    points = codebooks.grid(name)
    raw = rng.integers(0, 256, (20, codebooks.SHAPES[name][-1]), dtype=np.uint8)
    if name == "IQ1_M":
        raw[:, 55] &= 0x3F  # halves that are numbers
    else:
        raw[:, 1] &= 0x3F
    got = codebooks.decode(name, raw)
    want = np.array([scalar(name, [int(b) for b in r], points.tolist()) for r in raw])
    assert np.allclose(got, want, rtol=1e-6, atol=0)
    assert (codebooks.join(name, *codebooks.fields(name, raw)) == raw).all()


def test_codebooks_need_grids(monkeypatch):
    near = codebooks.neighbours(np.array([[0.0], [1], [2], [-1]]), np.array([[0.0]]), 2)[0]
    assert near.tolist() == [0, 1, 3]
    with pytest.raises(ValueError):
        codebooks.use_grid("IQ3_S", np.zeros((3, 4)))
    monkeypatch.setattr(codebooks, "_GIVEN", {})
    for run in (lambda: kernels.quantize("IQ3_S", np.ones((1, 256), np.float32)), lambda: kernels.dequantize("IQ3_S", np.zeros((1, 110), np.uint8), 256)):
        with pytest.raises(ValueError, match="needs its grid"):
            run()


def test_scale_codes():
    x = np.array([0, -1, 1e-4, 0.0009765, 0.015, 1, 1.0625, 239, 247.9, 248, 255, 256, 300, 448, 1e9, np.nan], np.float32)
    assert kernels.ue4m3(x).tolist() == [0, 0, 0, 0, 7, 56, 57, 119, 119, 0x7E, 0x7E, 0x7E, 0x7E, 0x7E, 0x7E, 0]
    assert kernels.ue4m3_value(np.array([0, 8, 56, 0x7E, 0x7F])).tolist() == [0, 2**-6, 1, 448, 0]


def test_no_clip_holds_every_value():
    x = (np.random.default_rng(5).normal(size=(64, 32)) * 3).astype(np.float32)
    for encode, decode in ((kernels.enc_mxfp4, kernels.dec_mxfp4), (kernels.enc_mxfp4_ocp, kernels.dec_mxfp4_ocp)):
        scales = [kernels.e8m0_value(raw[:, 0] if encode is kernels.enc_mxfp4 else raw[:, 16]) for raw in (encode(x), encode(x, no_clip=True))]
        top = np.abs(x).max(axis=1)
        assert (top <= 6 * scales[1]).all() and (top > 3 * scales[1]).all() and (top > 6 * scales[0]).any()
        assert np.abs(decode(encode(x, no_clip=True)) - x).max() <= scales[1].max()


def short(spark, folder, count):
    """A table of embeddings whose last row of four vectors is not whole."""
    rng = np.random.default_rng(count)
    x = rng.normal(size=(count, 64)).astype("f4")
    rows = [(i, v.astype(float).tolist(), i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    return x


@pytest.mark.parametrize("name", file_queries.KERNELS)
def test_kernel_queries_take_a_short_last_row(spark, tmp_path, name):
    x = short(spark, tmp_path, 46)
    got = {r["tensor"]: (r["rows"], r["error"]) for r in QUERIES[f"kernel_{name.lower()}"](spark, str(tmp_path)).collect()}
    want = {}
    for t in range(10):
        own = [x[4 * r : 4 * r + 4].ravel() for r in range(t, 12, 10)]
        back = [kernels.roundtrip(name, np.pad(v, (0, 256 - len(v)))[None])[0, : len(v)] for v in own]
        error = sum(((v.astype("f8") - y) ** 2).sum() for v, y in zip(own, back, strict=True)) / sum((v.astype("f8") ** 2).sum() for v in own)
        want[f"emb.{t}"] = (len(own), pytest.approx(error, abs=6e-5))
    assert got == want and got["emb.1"][0] == 2
