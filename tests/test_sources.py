import json
import struct

import numpy as np
import pytest

from quantaloom.functions import kernels
from quantaloom.functions.formats import ID
from quantaloom.plans import api
from quantaloom.sources import calibration, gguf, safetensors


def model(path, layers=2):
    rng = np.random.default_rng(1)
    kv = [("general.architecture", "String", "loom"), ("loom.block_count", "U32", layers), ("test.counts", "Array<U32>", [1, 2, 3]), ("test.names", "Array<String>", ["a", "é"]), ("test.nested", "Array<Array<U8>>", [[1], [2, 3]]), ("test.big", "U64", 2**63 + 1), ("general.file_type", "U32", 1)]
    shapes = [("token_embd.weight", [8, 256]), ("output_norm.weight", [256]), ("output.weight", [4, 256])]
    for b in range(layers):
        shapes += [(f"blk.{b}.attn_norm.weight", [256]), (f"blk.{b}.attn_q.weight", [16, 256]), (f"blk.{b}.ffn_up.weight", [16, 256]), (f"blk.{b}.ffn_down_exps.weight", [2, 8, 256])]
    tensors, values = [], {}
    for name, dims in shapes:
        tensors.append(gguf.Tensor(name, dims, 1))
        values[name] = rng.normal(size=dims).astype("f2").astype("f4")
    chunks = (c for t in tensors for c in (values[t.name].astype("<f2").tobytes(), None))
    gguf.write(str(path), kv, tensors, chunks)
    return kv, tensors, values


def test_gguf_round_trip(spark, tmp_path):
    path = tmp_path / "m.gguf"
    kv, tensors, values = model(path)
    header = gguf.read_header(str(path))
    assert header.version == 3 and header.kv == [(k, t, v) for k, t, v in kv] and [t.name for t in header.tensors] == [t.name for t in tensors]
    listed = {r["name"]: r for r in gguf.read(spark, str(path)).collect()}
    assert listed["blk.0.ffn_down_exps.weight"]["dims"] == [2, 8, 256] and listed["token_embd.weight"]["nbytes"] == 8 * 512
    got = {(r["name"], r["row"]): r["x"] for r in gguf.read(spark, str(path), "values", ["blk.1.attn_q.weight"]).collect()}
    assert len(got) == 16 and np.array_equal(np.array(got["blk.1.attn_q.weight", 3], "f4"), values["blk.1.attn_q.weight"][3])
    rows = gguf.read(spark, str(path), "rows").select("name", "row", "raw").repartition(3)
    gguf.save(rows, gguf.read_header(str(path)).tensors, header.kv, str(tmp_path / "again.gguf"))
    assert (tmp_path / "again.gguf").read_bytes() == path.read_bytes()


def test_gguf_refusals(tmp_path):
    path = tmp_path / "m.gguf"
    model(path)
    with pytest.raises(FileExistsError):
        gguf.write(str(path), [], [], [])
    with pytest.raises(ValueError, match="never"):
        gguf.write(str(tmp_path / "x.gguf"), [], [gguf.Tensor("t", [16], 0x8000)], [])
    with pytest.raises(ValueError, match="instead"):
        gguf.write(str(tmp_path / "y.gguf"), [], [gguf.Tensor("t", [16], 0)], [b"1", None])
    (tmp_path / "bad").write_bytes(b"nope")
    with pytest.raises(ValueError):
        gguf.read_header(str(tmp_path / "bad"))
    (tmp_path / "cut").write_bytes(path.read_bytes()[:60])
    with pytest.raises(ValueError, match="truncated"):
        gguf.read_header(str(tmp_path / "cut"))


def test_quantize_inspect_search(spark, tmp_path):
    path = str(tmp_path / "m.gguf")
    _, _, values = model(path)
    tensors, roles, layout = api.inspect(spark, path)
    assert layout.first()["n_layers"] == 2 and {r["role"] for r in roles.collect()} >= {"attn_q", "norm", "TOTAL"}
    plan = {r["name"]: r for r in api.quantize(spark, path, str(tmp_path / "q.gguf")).collect()}
    assert plan["blk.0.attn_q.weight"]["out_id"] == ID["Q5_K"] and plan["blk.0.attn_norm.weight"]["action"] == "copy" and plan["blk.0.ffn_up.weight"]["out_id"] == ID["Q4_K"]
    got = gguf.read(spark, str(tmp_path / "q.gguf"), "rows", ["blk.0.ffn_up.weight"]).orderBy("row").collect()
    assert bytes(got[5]["raw"]) == kernels.quantize("Q4_K", values["blk.0.ffn_up.weight"])[5].tobytes()
    kv = dict((k, v) for k, _, v in gguf.read_header(str(tmp_path / "q.gguf")).kv)
    assert kv["general.file_type"] == ID["Q4_K"] and kv["test.big"] == 2**63 + 1
    loose, text = api.search(spark, path, 10**9)
    tight, _ = api.search(spark, path, 1)
    assert {r["bits"] for r in loose.collect()} <= {"Q5_K", "Q6_K", "Q8_0", "Q4_K"} and all(r["over_budget"] for r in tight.collect())
    assert sum(r["bytes"] for r in loose.collect()) > sum(r["bytes"] for r in tight.collect()) and "blk.0.attn_q.weight" in text
    assert api.pareto(spark, path).count() >= 3


def st_file(path, tensors):
    header, data = {}, b""
    for name, dtype, shape, raw in tensors:
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


def test_safetensors(spark, tmp_path):
    codes = bytes([0x10, 0x32, 0x54, 0x76, 0x98, 0xBA, 0xDC, 0xFE])
    st_file(tmp_path / "a.safetensors", [("x", "F32", [2, 2], np.array([1, -2, 3.5, 0], "<f4").tobytes()), ("l.weight", "U8", [1, 8], codes), ("l.weight_scale", "F8_E4M3", [1, 1], bytes([0x7E])), ("l.weight_scale_2", "F32", [], np.array([1 / 448], "<f4").tobytes())])
    eight = kernels.encode_mini(np.full(4, 2.0, "f4"), kernels.E4M3).tobytes()
    st_file(tmp_path / "b.safetensors", [("f.weight", "F8_E4M3", [2, 2], eight), ("f.weight_scale", "F32", [], np.array([3], "<f4").tobytes()), ("x", "F32", [1, 2], np.array([7, 8], "<f4").tobytes())])
    got = {r["name"]: r for r in safetensors.read(spark, str(tmp_path)).collect()}
    assert got["x"]["dims"] == [1, 2]  # the later shard's stands
    assert [r["x"] for r in safetensors.read(spark, str(tmp_path), "values", ["x"]).collect()] == [[7.0, 8.0]]
    assert np.allclose(safetensors.load_nvfp4(str(tmp_path), "l"), [[0, 0.5, 1, 1.5, 2, 3, 4, 6, 0, -0.5, -1, -1.5, -2, -3, -4, -6]])
    assert (safetensors.load_fp8(str(tmp_path), "f") == 6).all()
    layers = {r["prefix"]: r for r in safetensors.scaled_layers(safetensors.read(spark, str(tmp_path))).collect()}
    assert layers["f"]["granularity"] == "tensor" and layers["l"]["global_scale"] == "l.weight_scale_2"
    (tmp_path / "c.safetensors").write_bytes(struct.pack("<Q", 999) + b"{}")
    with pytest.raises(ValueError):
        safetensors.read_header(str(tmp_path / "c.safetensors"))


def test_safetensors_writer(spark, tmp_path):
    tensors = [(f"t{i}", "F32", [2, 4], lambda i=i: np.full(8, i, "<f4").tobytes()) for i in range(5)]
    folder = str(tmp_path / "out")
    assert len(set(safetensors.write(folder, tensors, 64, dry_run=True)["weight_map"].values())) == 3
    safetensors.write(folder, tensors, 64, {"format": "pt"})
    assert len(safetensors.shards(folder)) == 3
    assert sorted(r["x"][0] for r in safetensors.read(spark, folder, "values").where("row = 1").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        safetensors.write(folder, tensors, 64)


def test_imatrix_forms(spark, tmp_path):
    entries = [("a.weight", 128, [1.0, 2.0, 0.5, 4.0]), ("b.weight", 64, [3.0, 0.0])]
    flat = str(tmp_path / "flat.dat")
    calibration.write_imatrix(flat, entries)
    tensors = [t for n, _, g in entries for t in (gguf.Tensor(f"{n}.in_sum2", [len(g)], 0), gguf.Tensor(f"{n}.counts", [1], 0))]
    chunks = [c for _, calls, g in entries for c in (np.array(g, "<f4").tobytes(), None, np.array([calls], "<f4").tobytes(), None)]
    boxed = str(tmp_path / "im.gguf")
    gguf.write(boxed, [("general.type", "String", "imatrix")], tensors, chunks)
    for path in (flat, boxed):
        assert sorted((r["tensor"], r["ncall"], r["g"]) for r in calibration.read_imatrix(spark, path).collect()) == entries
    summary = {r["tensor"]: r for r in calibration.imatrix_summary(calibration.read_imatrix(spark, flat)).collect()}
    assert summary["b.weight"]["unusable"] == 1 and summary["a.weight"]["high"] == 4
    (tmp_path / "cut.dat").write_bytes((tmp_path / "flat.dat").read_bytes()[:-2])
    with pytest.raises(ValueError):
        calibration.read_imatrix(spark, str(tmp_path / "cut.dat"))


def capture(spark, jitter):
    rows = [(i, i % 32, [float(((7 * i + 3 * v) % 11) * 0.3 + v * jitter) for v in range(32)]) for i in range(10)]
    return spark.createDataFrame(rows, calibration.CAPTURE)


def test_logits_and_divergence(spark, tmp_path):
    calibration.write_logits(f"{tmp_path}/reference.rqlg", capture(spark, 0.0), 32)
    for name, jitter in (("same", 0.0), ("near", 0.02), ("far", 0.05)):
        calibration.write_logits(f"{tmp_path}/{name}.rqlg", capture(spark, jitter), 32)
    evaluator = api.DumpEvaluator(str(tmp_path))
    mean = {n: evaluator.score(spark, n).first()["mean"] for n in ("same", "near", "far")}
    assert mean["same"] == pytest.approx(0, abs=1e-12) and 0 < mean["near"] < mean["far"]
    from quantaloom.operators import metrics

    top = metrics.top_k(calibration.read_logits(spark, f"{tmp_path}/near.rqlg"), 4)
    calibration.write_logits(f"{tmp_path}/top.rqlg", top, 32, 4)
    assert calibration.read_logits(spark, f"{tmp_path}/top.rqlg").select("ids").collect() == top.select("ids").collect()
    with pytest.raises(Exception, match="captures differ"):
        metrics.divergence(capture(spark, 0.0), capture(spark, 0.0).where("pos < 5")).collect()
    with pytest.raises(ValueError):
        calibration.write_logits(f"{tmp_path}/bad.rqlg", capture(spark, 0.0), 31)
    np.arange(8, dtype="<f4").tofile(f"{tmp_path}/raw.bin")
    assert calibration.read_raw_logits(spark, f"{tmp_path}/raw.bin", 4).count() == 2
    with pytest.raises(ValueError):
        calibration.read_raw_logits(spark, f"{tmp_path}/raw.bin", 3)


def test_reports(spark, tmp_path):
    (tmp_path / "ppl").write_text("ppl = 9.0\nFinal estimate: PPL = 4.6921 +/- 0.24358\ndone\n")
    (tmp_path / "ppl2").write_text("Final estimate: PPL = 5.0 ± 0.1\n")
    a, b = calibration.read_ppl(spark, str(tmp_path / "ppl")), calibration.read_ppl(spark, str(tmp_path / "ppl2"))
    assert a.first()["ppl"] == 4.6921 and a.first()["err"] == 0.24358 and b.first()["err"] == 0.1
    delta = api.ppl_compare(a, b).first()
    assert delta["delta"] == pytest.approx(0.3079) and not delta["within_noise"]
    (tmp_path / "kld").write_text("Mean    KLD:   0.010000 ±   0.000100\nMaximum KLD:   1.234\n99.9%   KLD: 0.5\n99.0%   KLD:   0.1\nMedian  KLD:   0.002\nSame top p:  95.000 ± 0.100 %\n")
    r = calibration.read_kl_report(spark, str(tmp_path / "kld")).first()
    assert (r["mean"], r["max"], r["p99"], r["median"], r["top1"], r["rms"]) == (0.01, 1.234, 0.1, 0.002, 0.95, None)
    (tmp_path / "none").write_text("nothing\n")
    for reader in (calibration.read_ppl, calibration.read_kl_report):
        with pytest.raises(Exception, match="no "):
            reader(spark, str(tmp_path / "none")).collect()


def test_sensitivity_table(spark, tmp_path):
    rows = [(0, "attn_q", ["blk.0.attn_q.weight"], 400, [("Q4_K", 100, 0.02), ("Q6_K", 200, 0.004)])]
    entries = spark.createDataFrame(rows, "pos int, key string, members array<string>, source_bytes long, points array<struct<bits:string,bytes:long,kl:double>>")
    calibration.write_sensitivity(f"{tmp_path}/s.json", entries)
    assert calibration.read_sensitivity(spark, f"{tmp_path}/s.json").collect() == entries.collect()
    (tmp_path / "old.json").write_text('{"schema": 2, "entries": []}')
    with pytest.raises(ValueError):
        calibration.read_sensitivity(spark, f"{tmp_path}/old.json")


def test_streams(spark, tmp_path):
    from quantaloom.streaming import divergence

    near = capture(spark, 0.05).selectExpr("timestamp_seconds(pos * 100) as ts", "pos", "target", "logits")
    near.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(near.schema).parquet(f"{tmp_path}/in")
    q = divergence.running(stream, capture(spark, 0.0)).writeStream.outputMode("complete").format("memory").queryName("kl").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) as n, max(max) as m from kl").first()
    assert got["n"] == 10 and got["m"] > 0
