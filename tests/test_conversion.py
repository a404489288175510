import json

import numpy as np
import pytest

from quantaloom.operators import convert
from quantaloom.plans import conversion
from quantaloom.sources import safetensors


def folder(path, width=8):
    rng = np.random.default_rng(1)
    path.mkdir()
    tensors = [("lm_head.weight", "F32", [3, 4], rng.normal(size=12).astype("<f4").tobytes())]
    for i in range(2):
        for p in ("gate", "up", "down"):
            shape = [4, width] if p == "down" else [width, 4]
            tensors.append((f"model.layers.{i}.mlp.{p}_proj.weight", "F32", shape, np.arange(4 * width, dtype="<f4").tobytes()))
    safetensors.write(str(path), [(n, t, s, lambda raw=raw: raw) for n, t, s, raw in tensors], 10**6)
    (path / "config.json").write_text(json.dumps({"model_type": "m", "hidden_size": 4, "num_hidden_layers": 2, "intermediate_size": width, "architectures": ["MForCausalLM"]}))
    (path / "tokenizer.json").write_text("{}")


def test_materialise(spark, tmp_path):
    folder(tmp_path / "in")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    plan = conversion.materialise(spark, source, target, 2, 1, "m", "m_moe", 200, dry_run=True)
    assert plan.count() == 15 and not (tmp_path / "out").exists()
    conversion.materialise(spark, source, target, 2, 1, "m", "m_moe", 200)
    got = {e.name: e for e in safetensors.catalog(target)}
    gate_up = safetensors.widen(safetensors.payload(got["model.layers.0.mlp.experts.gate_up_proj"]), "F32").reshape(2, 8, 4)
    dense = np.arange(32).reshape(8, 4)
    assert np.array_equal(gate_up[1], np.concatenate([dense[4:], dense[4:]]))
    down = safetensors.widen(safetensors.payload(got["model.layers.1.mlp.experts.down_proj"]), "F32").reshape(2, 4, 4)
    assert np.array_equal(down[1], 2 * np.arange(32).reshape(4, 8)[:, 4:])
    assert len(safetensors.shards(target)) > 1 and (tmp_path / "out" / "tokenizer.json").exists()
    moved = json.loads((tmp_path / "out" / "config.json").read_text())
    assert moved["moe_intermediate_size"] == 4 and moved["shared_expert_intermediate_size"] == 1 and "intermediate_size" not in moved and moved["architectures"] == ["MMoeForCausalLM"]
    shared = got["model.layers.1.mlp.shared_expert.down_proj.weight"]
    assert list(shared.shape) == [4, 1] and not any(safetensors.payload(shared))
    router = safetensors.widen(safetensors.payload(got["model.layers.0.mlp.gate.weight"]), "F32")
    assert np.array_equal(router, convert.router_values("model.layers.0.mlp", 8, 0.02))
    assert json.loads((tmp_path / "out" / conversion.MANIFEST).read_text())["requires_training"] is True
    with pytest.raises(FileExistsError):
        conversion.materialise(spark, source, target, 2, 1, "m", "m_moe", 200)
    with pytest.raises(ValueError, match="inside"):
        conversion.materialise(spark, source, f"{source}/sub", 2, 1, "m", "m_moe", 200)


def test_refuses_unsound_layers(tmp_path):
    folder(tmp_path / "in")
    entries = safetensors.catalog(str(tmp_path / "in"))
    assert len(conversion.dense_layers(entries, 4, 8)) == 2
    with pytest.raises(ValueError):
        conversion.dense_layers([e for e in entries if "0.mlp.up" not in e.name], 4, 8)
    with pytest.raises(ValueError):
        conversion.dense_layers(entries, 4, 16)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Q4_K", 10), ("b", "Q4_K", 5), ("c", "Q8_0", 7)], "name string, bits string, bytes long")
    assert {r["bits"]: r["bytes"] for r in conversion.output_report(rows).collect()} == {"Q4_K": 15, "Q8_0": 7}
    tagged = spark.createDataFrame([("a", "x", 100), ("z", "x", 1)], "name string, role string, nbytes long")
    assert conversion.search_report(rows, tagged).first()["bytes"] == 11
    listed = spark.createDataFrame([("k__Q4_K", "k", 5)], "id string, key string, bytes long")
    conversion.write_manifest(f"{tmp_path}/m.json", listed)
    assert conversion.read_manifest(spark, f"{tmp_path}/m.json").select(*listed.columns).collect() == listed.collect()


def test_config_of_a_model_with_vision():
    text = {"model_type": "m_text", "num_hidden_layers": 1, "hidden_size": 4, "intermediate_size": 8, "layer_types": ["full_attention"]}
    config = {"model_type": "m", "text_config": text, "vision_config": {"model_type": "m_vision"}, "architectures": ["MForConditionalGeneration"]}
    moved = convert.migrate_config(config, 2, 1, "m", "m_moe")
    assert moved["text_config"] == {"model_type": "m_moe_text", "num_hidden_layers": 1, "hidden_size": 4, "layer_types": ["full_attention"], "num_experts": 2, "num_experts_per_tok": 1, "moe_intermediate_size": 4, "shared_expert_intermediate_size": 1, "output_router_logits": True, "router_aux_loss_coef": 0.001}
    assert moved["model_type"] == moved["vision_config"]["model_type"] == "m_moe" and moved["architectures"] == ["MMoeForConditionalGeneration"]
    for broken in ({"vision_config": None}, {"text_config": text | {"layer_types": ["sliding"]}}, {"text_config": text | {"hidden_size": 0}}, {"quantization_config": {}}, {"text_config": text | {"initializer_range": 0}}):
        with pytest.raises(ValueError):
            convert.migrate_config(config | broken, 2, 1, "m", "m_moe")
