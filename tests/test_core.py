import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantaloom.functions import formats as fm
from quantaloom.functions.text import parse_size
from quantaloom.operators import alloc, catalog, convert, recipe
from quantaloom.plans.oracle import oracle
from quantaloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = duck.sql(oracle()[name])
    at = [rel.columns.index(c) for c in columns]
    assert len(rel.columns) == len(columns)
    rows = lambda xs: sorted((tuple(0.0 if v == 0 and isinstance(v, float) else v for v in x) for x in xs), key=str)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracle()) <= set(__spark_entry__.queries())


def test_formats():
    bpw = lambda n: fm.BLOCK[n][1] * 8 / fm.BLOCK[n][0]
    assert (bpw("Q8_0"), bpw("Q4_0"), bpw("Q4_K"), bpw("Q6_K"), bpw("Q2_K")) == (8.5, 4.5, 4.5, 6.5625, 2.625)
    assert fm.ladder("Q8_0, q4_k") == ["Q4_K", "Q8_0"] and len(fm.LADDERS["full"]) == 19
    assert fm.canonical("FP8") == "FP8_E4M3"
    with pytest.raises(ValueError):
        fm.canonical("Q9_X")
    assert [parse_size(s) for s in ("450M", "1.5 KiB", "12")] == [450 << 20, 1536, 12]
    with pytest.raises(ValueError):
        parse_size("many")


@pytest.mark.parametrize(
    ("name", "role", "quantizable"),
    [
        ("blk.3.attn_norm_2.weight", "norm", False),
        ("blk.3.attn_norm_2x.weight", "unknown", True),
        ("blk.3.attn_q_a_norm.weight", "norm", False),
        ("blk.0.nextn.hnorm.weight", "mtp", False),
        ("blk.0.ffn_up.7.weight", "routed_expert.up", True),
        ("blk.0.ssm_a.weight", "ssm_param", False),
        ("blk.0.attn_v.bias", "attn_v", False),
        ("rope_freqs.weight", "unknown", False),
        ("output.weight", "lm_head", True),
        ("token_embd.bias", "embedding", False),
    ],
)
def test_roles(spark, name, role, quantizable):
    r = catalog.with_roles(spark.createDataFrame([(name,)], "name string"), 4).first()
    assert (r["role"], r["quantizable"]) == (role, quantizable)


def test_recipe_bounds():
    assert recipe.depth_bounds(">= 0.75") == (0.75, False, None, False)
    assert recipe.depth_bounds("< 0.25") == (None, False, 0.25, True)
    assert recipe.depth_bounds("0.25..0.5")[::2] == (0.25, 0.5)
    assert recipe.expert_bounds("0..=15") == (0, 15) and recipe.expert_bounds(">= 3") == (3, None)
    with pytest.raises(ValueError):
        recipe.depth_bounds("deep")


def tagged(spark, names):
    return catalog.with_roles(spark.createDataFrame([(n,) for n in names], "name string"), 4)


def test_last_match_wins_and_floors(spark):
    rules = {"defaults": {"bits": "Q4_K"}, "rule": [{"role": "router", "bits": "F16"}, {"role": "attn_q", "bits": "Q6_K"}, {"name": ["blk.1.attn_q.weight"], "bits": "Q8_0", "imatrix": False}]}
    got = {r["name"]: r for r in recipe.resolve(tagged(spark, ["blk.0.attn_q.weight", "blk.1.attn_q.weight", "blk.0.ffn_gate_inp.weight"]), rules).collect()}
    assert got["blk.0.attn_q.weight"]["bits"] == "Q6_K" and got["blk.1.attn_q.weight"]["bits"] == "Q8_0" and not got["blk.1.attn_q.weight"]["imatrix"]
    low = {**rules, "rule": [{"role": "router", "bits": "Q4_K"}]}
    with pytest.raises(ValueError, match="ffn_gate_inp"):
        recipe.enforce(recipe.resolve(tagged(spark, ["blk.0.ffn_gate_inp.weight"]), low), low)
    loose = low | {"floors": {"router": "Q4_K", "dense_path": "Q4_K"}}
    recipe.enforce(recipe.resolve(tagged(spark, ["blk.0.ffn_gate_inp.weight"]), loose), loose)


def curve(spark, points):
    return spark.createDataFrame([(n, f"b{i}", s, float(c)) for n, ps in points.items() for i, (s, c) in enumerate(ps)], "name string, bits string, bytes long, cost double")


def test_slack_fill(spark):
    c = alloc.normalise(curve(spark, {"a": [(100, 10), (200, 9), (300, 1)]}))
    assert alloc.allocate(c, 250, fill=False).first()["bytes"] == 100
    assert alloc.allocate(c, 250).first()["bytes"] == 200
    assert alloc.allocate(c, 50).first()["over_budget"]


def test_front(spark):
    c = alloc.normalise(curve(spark, {"a": [(100, 10), (200, 4), (400, 1)], "b": [(50, 8), (150, 3), (250, 2.5)]}))
    front = sorted(map(tuple, alloc.pareto(c).collect()))
    assert len(front) >= 3 and front[0][0] == 150 and front[-1][0] == 650
    assert all(a[1] > b[1] for a, b in zip(front, front[1:], strict=False))
    for size, cost in front:
        chosen = alloc.allocate(c, size, fill=False).collect()
        assert sum(r["cost"] for r in chosen) <= cost + 1e-9
    same = alloc.normalise(curve(spark, {"a": [(100, 5), (200, 5)]}))
    assert alloc.allocate(same, 10_000).first()["bytes"] == 100


def test_greedy_close_to_best():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(40):
        points, hulls = [], set()
        for n in "abcd":
            size, cost = rng.randint(20, 60), rng.uniform(8, 20)
            own = []
            for k in range(4):
                own.append((n, k, size, cost))
                size, cost = size + rng.randint(20, 90), cost - rng.uniform(0.3, 5)
            points += own
            keep = [p for p in own if not any(a[1] < p[1] < b[1] and (a[3] - p[3]) / (p[2] - a[2]) <= (a[3] - b[3]) / (b[2] - a[2]) for a in own for b in own)]
            hulls |= {(p[0], p[1]) for p in keep}
        by = {n: [p for p in points if p[0] == n] for n in "abcd"}
        for budget in (420, 500, 640):
            at, _, used = alloc.choose(points, hulls, budget)
            cost = sum(by[n][k][3] for n, k in at.items())
            best = min((sum(p[3] for p in c) for c in itertools.product(*by.values()) if sum(p[2] for p in c) <= budget), default=None)
            if best is not None:
                assert used <= budget and cost <= best + 6.0


def test_split_experts_and_router(spark):
    rows = spark.createDataFrame([("t", r, [float(r * 8 + c) for c in range(8)]) for r in range(4)], "tensor string, row long, x array<float>")
    up = {(r["expert"], r["row"]): r["x"] for r in convert.split_experts(rows, 2, 2, False).collect()}
    assert up[1, 0] == [16.0 + c for c in range(8)]
    down = {(r["expert"], r["row"]): r["x"] for r in convert.split_experts(rows, 2, 4, True, 0.5).collect()}
    assert down[1, 1] == [6.0, 6.5, 7.0, 7.5]
    v = convert.router_values("router", 1000, 0.1)
    assert (abs(v) <= 0.1).all() and (convert.router_values("router", 10, 0.1) == v[:10]).all() and abs(v.mean()) < 0.01


def test_migrate_config():
    sizes = {"num_hidden_layers": 2, "hidden_size": 32}
    out = convert.migrate_config({"model_type": "m", "intermediate_size": 64, "architectures": ["MForCausalLM"]} | sizes, 8, 2, "m", "m_moe")
    assert out["moe_intermediate_size"] == 8 and out["architectures"] == ["MMoeForCausalLM"]
    for bad in ({"model_type": "x", "intermediate_size": 64}, {"model_type": "m", "intermediate_size": 63}, {"model_type": "m", "intermediate_size": 64, "quantization_config": {}}):
        with pytest.raises(ValueError):
            convert.migrate_config(bad | sizes, 8, 2, "m", "m_moe")


def test_moe_plan_and_audit(spark):
    rows = [(f"model.layers.{i}.mlp.{p}_proj.weight", [64, 32] if p != "down" else [32, 64], 30) for i in range(2) for p in ("gate", "up", "down")] + [("lm_head.weight", [10, 32], 30)]
    source = spark.createDataFrame(rows, "name string, dims array<long>, type_id int")
    out = convert.moe_plan(source, 4, 32, 64)
    got = {r["name"]: r for r in out.collect()}
    assert got["model.layers.1.mlp.experts.down_proj"]["dims"] == [4, 32, 16] and len(got) == 15
    replaced = source.where(F.col("name").contains(".mlp.")).select("name")
    assert convert.audit(source, out.drop("action"), replaced).count() == 0
    assert convert.audit(source, out.drop("action").where("name <> 'lm_head.weight'"), replaced).first()["problem"] == "missing"


@pytest.mark.parametrize("groups", [50_000, 0])
def test_quantiles_of_nearest_rank(spark, monkeypatch, groups):
    import random

    from quantaloom.operators import metrics

    monkeypatch.setattr(metrics, "BROADCAST_GROUPS", groups)
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 0.5, rng.random()])) for g in range(3) for _ in range(rng.choice([1, 2, 5001]))]
    frame = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in metrics.quantiles(frame, "v", {"a": 0.5, "b": 0.99, "c": 0.0}, "g").collect()}
    for g in range(3):
        own = sorted(v for k, v in rows if k == g)
        assert [got[g][c] for c in "abc"] == [own[int((len(own) - 1) * q + 0.5)] for q in (0.5, 0.99, 0.0)]


@pytest.mark.parametrize("name", ["rt_q1_0", "rt_tq1_0", "rt_tq2_0", "rt_q8_k"])
def test_wide_round_trips_take_missing_vectors(spark, tmp_path, name):
    import random

    rng = random.Random(8)
    ids = [i for i in range(90) if i not in (9, 14, 30, 31, 88)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 10) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(oracle()[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert sum(r["n"] for r in got) == 64 * len(ids)
