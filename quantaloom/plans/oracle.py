"""The queries again, as DuckDB SQL over the same tables, written apart from the DataFrame code."""

from __future__ import annotations

from quantaloom.functions import formats as fm
from quantaloom.operators.catalog import OFF_DENSE_PATH, WHOLE, role_rows
from quantaloom.operators.recipe import rule_rows
from quantaloom.plans import inputs


def _list(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return _list(v)
    return repr(v)


FORMATS = f"formats AS (SELECT * FROM {fm.values()})"
CATALOG = f"""cat AS (SELECT p_partkey pos, CASE WHEN p_partkey % 41 = 0 THEN {_list(inputs.WHOLES)}[p_partkey % {len(inputs.WHOLES)} + 1]
  ELSE 'blk.' || (p_partkey % {inputs.LAYERS}) || '.' || {_list(inputs.PARTS)}[p_partkey % {len(inputs.PARTS)} + 1] END AS name,
  CAST(p_size AS BIGINT) AS "rows", CAST({_list(inputs.COLS)}[p_partkey % {len(inputs.COLS)} + 1] AS BIGINT) AS cols, {_list(inputs.SOURCES)}[p_partkey % {len(inputs.SOURCES)} + 1] AS type_id,
  CAST(p_size AS BIGINT) * {_list(inputs.COLS)}[p_partkey % {len(inputs.COLS)} + 1] AS n_elems FROM part)"""
_ROLES = ", ".join(f"('{s}', '{r}')" for s, r in role_rows())
_NORM = "regexp_replace(name, '\\.(weight|bias)$', '')"
TAGGED = f"""{CATALOG}, roles(suffix, exact) AS (VALUES {_ROLES}),
names AS (SELECT *, regexp_extract(name, '^blk\\.([0-9]+)\\.(.+)$', 1) blk, regexp_extract(name, '^blk\\.([0-9]+)\\.(.+)$', 2) suffix, {_NORM} base FROM cat),
norms AS (SELECT *, base LIKE '%\\_norm' ESCAPE '\\' OR (strpos(base, '_norm_') > 0 AND regexp_full_match(substr(base, strpos(base, '_norm_') + 6), '[0-9]+')) AS is_norm,
  name LIKE '%.bias' is_bias, regexp_extract(name, '^(token_embd|output|output_norm)\\.(weight|bias)$', 1) whole, name LIKE 'rope\\_freqs%' ESCAPE '\\' rope,
  regexp_extract(suffix, '^ffn_(gate|up|down)\\.([0-9]+)\\.weight$', 1) part, regexp_extract(suffix, '^ffn_(gate|up|down)\\.([0-9]+)\\.weight$', 2) ex FROM names),
tagged AS (SELECT n.pos, n.name, n.rows, n.cols, n.n_elems, n.type_id,
  CASE WHEN whole <> '' THEN CASE whole {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WHOLE.items())} END WHEN rope OR blk = '' THEN 'unknown' WHEN n.suffix LIKE 'nextn.%' THEN 'mtp'
    WHEN exact IS NOT NULL THEN exact WHEN ex <> '' THEN 'routed_expert.' || part WHEN is_norm THEN 'norm' ELSE 'unknown' END AS role,
  CASE WHEN whole IN ('output', 'output_norm') THEN 1.0::DOUBLE WHEN whole = '' AND blk <> '' THEN CAST(CAST(CAST(blk AS BIGINT) / {inputs.LAYERS}.0::DOUBLE AS FLOAT) AS DOUBLE) ELSE 0.0::DOUBLE END AS depth,
  CASE WHEN ex <> '' THEN CAST(ex AS BIGINT) END AS expert, coalesce(exact LIKE 'routed_expert%', false) AS packed_expert,
  CASE WHEN whole IN ('token_embd', 'output') THEN NOT is_bias WHEN rope THEN false WHEN blk <> '' AND n.suffix LIKE 'nextn.%' THEN NOT (n.suffix LIKE '%norm%' OR is_bias) WHEN exact = 'ssm_param' THEN false ELSE NOT is_norm AND NOT is_bias END AS quantizable
  FROM norms n LEFT JOIN roles r ON n.suffix = r.suffix),
tags AS (SELECT *, role NOT IN ({", ".join(repr(r) for r in OFF_DENSE_PATH)}) AS dense_path FROM tagged),
{FORMATS}, sized AS (SELECT t.*, type_name, n_elems // block * block_bytes AS nbytes FROM tags t JOIN formats USING (type_id))"""
HUMAN = "CASE WHEN {b} >= 1099511627776 THEN printf('%.2f TiB', {b} / 1099511627776.0::DOUBLE) WHEN {b} >= 1073741824 THEN printf('%.2f GiB', {b} / 1073741824.0::DOUBLE) WHEN {b} >= 1048576 THEN printf('%.2f MiB', {b} / 1048576.0::DOUBLE) WHEN {b} >= 1024 THEN printf('%.2f KiB', {b} / 1024.0::DOUBLE) ELSE printf('%d B', CAST({b} AS BIGINT)) END"

_RULES = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rule_rows(inputs.rules()))
RESOLVED = f"""{TAGGED}, rules(idx, roles, names, lo, lo_open, hi, hi_open, elo, ehi, bits, imatrix) AS (VALUES {_RULES}),
hits AS (SELECT t.pos, t.name, max_by(struct_pack(b := r.bits, i := r.imatrix), r.idx) m FROM tags t JOIN rules r ON
  (r.roles IS NULL OR len(list_filter(r.roles, lambda p: p = t.role OR ((p LIKE '%.*' OR p NOT LIKE '%.%') AND (t.role = replace(p, '.*', '') OR starts_with(t.role, replace(p, '.*', '') || '.'))))) > 0)
  AND (r.names IS NULL OR list_contains(r.names, t.name))
  AND (r.lo IS NULL OR t.depth > CAST(r.lo AS FLOAT)::DOUBLE OR (NOT r.lo_open AND t.depth = CAST(r.lo AS FLOAT)::DOUBLE))
  AND (r.hi IS NULL OR t.depth < CAST(r.hi AS FLOAT)::DOUBLE OR (NOT r.hi_open AND t.depth = CAST(r.hi AS FLOAT)::DOUBLE))
  AND ((r.elo IS NULL AND r.ehi IS NULL) OR coalesce(CASE WHEN t.packed_expert THEN 0 ELSE t.expert END >= r.elo AND (r.ehi IS NULL OR CASE WHEN t.packed_expert THEN 0 ELSE t.expert END <= r.ehi), false))
  GROUP BY ALL),
resolved AS (SELECT t.*, coalesce(m.b, 'Q4_K') AS bits, coalesce(m.i, true) AS imatrix, f.type_id AS target_id, f.block_bytes * 8.0::DOUBLE / f.block AS target_bpw
  FROM tags t LEFT JOIN hits h USING (pos) JOIN formats f ON f.type_name = coalesce(m.b, 'Q4_K'))"""

W64 = "w AS (SELECT 'emb.' || label AS t, vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS x FROM embeddings)"
W256 = "w AS (SELECT 'emb.' || ((vec_id // 4) % 10) AS t, vec_id // 4 AS r, (vec_id % 4) * 64 + generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS x FROM embeddings)"


def _mini(v: str, low: int, mantissa: int, top: float) -> str:
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({v}::DOUBLE))), {low}) - {mantissa})"
    return f"(CASE WHEN {v} = 0 THEN 0::FLOAT ELSE CAST(sign({v}::DOUBLE) * least(round_even(abs({v}::DOUBLE) / {unit}, 0) * {unit}, {top}::DOUBLE) AS FLOAT) END)"


def _f16(v: str) -> str:
    return _mini(v, -14, 10, 65504.0)


def _e4m3(v: str) -> str:
    return _mini(v, -6, 3, 448.0)


def _e2m1(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN -1::FLOAT ELSE 1::FLOAT END * CASE WHEN abs({v}) <= 0.25 THEN 0 WHEN abs({v}) <= 0.75 THEN 0.5 WHEN abs({v}) <= 1.25 THEN 1 WHEN abs({v}) <= 1.75 THEN 1.5 WHEN abs({v}) <= 2.5 THEN 2 WHEN abs({v}) <= 3.5 THEN 3 WHEN abs({v}) <= 5 THEN 4 ELSE 6 END::FLOAT)"


def _trunc(v: str) -> str:
    return f"CAST(trunc({v}) AS BIGINT)"


def _away(v: str) -> str:
    return f"CAST(sign(({v})::DOUBLE) * floor(abs(({v})::DOUBLE) + 0.5) AS BIGINT)"


_AMAX, _SMAX = "max(abs(x))", "first(x ORDER BY abs(x) DESC, c)"
_E8 = "greatest(CAST(floor(log2({a}::DOUBLE)) AS BIGINT) + 127 - {k}, 0)"


def _shared(k: int) -> str:
    return f"CASE WHEN {_AMAX} > 0 THEN CAST(pow(2.0::DOUBLE, {_E8.format(a=_AMAX, k=k)} - 127) AS FLOAT) ELSE CAST(pow(2.0::DOUBLE, -127) AS FLOAT) END"


#: format -> (scale d of a block, second scale m, code from x, d, i = 1/d, m, value from q)
_SCALED: dict[str, tuple[str, str, str, str]] = {
    "Q8_0": (f"{_AMAX} / 127::FLOAT", "0::FLOAT", _away("x * i"), f"q::FLOAT * {_f16('d')}"),
    "Q4_0": (f"{_SMAX} / -8::FLOAT", "0::FLOAT", f"least({_trunc('x * i + 8.5::FLOAT')}, 15)", f"(q - 8)::FLOAT * {_f16('d')}"),
    "Q5_0": (f"{_SMAX} / -16::FLOAT", "0::FLOAT", f"least({_trunc('x * i + 16.5::FLOAT')}, 31)", f"(q - 16)::FLOAT * {_f16('d')}"),
    "Q4_1": ("(max(x) - min(x)) / 15::FLOAT", "min(x)", f"least({_trunc('(x - m) * i + 0.5::FLOAT')}, 15)", f"q::FLOAT * {_f16('d')} + {_f16('m')}"),
    "Q5_1": ("(max(x) - min(x)) / 31::FLOAT", "min(x)", _trunc("(x - m) * i + 0.5::FLOAT"), f"q::FLOAT * {_f16('d')} + {_f16('m')}"),
    "Q2_0": (_AMAX, "0::FLOAT", f"least(greatest({_away('x * i')} + 1, 0), 3)", f"(q - 1)::FLOAT * {_f16('d')}"),
    "TQ2_0": (_AMAX, "0::FLOAT", f"least(greatest({_away('x * i')} + 1, 0), 2)", f"(q - 1)::FLOAT * {_f16('d')}"),
    "Q1_0": ("list_reduce(list_prepend(0::FLOAT, list(abs(x) ORDER BY c)), lambda a, v: (a + v)::FLOAT) / 128::FLOAT", "0::FLOAT", "CAST(x >= 0 AS BIGINT)", f"(2 * q - 1)::FLOAT * {_f16('d')}"),
    "Q8_K": (f"-127::FLOAT / nullif({_SMAX}, 0)", "0::FLOAT", "least(CAST(round_even((d * x)::DOUBLE, 0) AS BIGINT), 127)", "i * q::FLOAT"),
    "MXFP4": (_shared(2), "0::FLOAT", f"CAST({_e2m1('(x * i)')} * 2 AS BIGINT)", "(q / 2.0::DOUBLE)::FLOAT * d"),
    "MXFP8": (_shared(8), "0::FLOAT", f"CAST({_e4m3('(x * i)')}::DOUBLE * 512 AS BIGINT)", "(q / 512.0::DOUBLE)::FLOAT * d"),
    "FP8_E4M3": (f"greatest({_AMAX} / 448::FLOAT, 1.1754943508222875e-38::FLOAT)", "0::FLOAT", f"CAST({_e4m3('(x * i)')}::DOUBLE * 512 AS BIGINT)", "(q / 512.0::DOUBLE)::FLOAT * d"),
    "FP8_E5M2": (f"greatest({_AMAX} / 57344::FLOAT, 1.1754943508222875e-38::FLOAT)", "0::FLOAT", f"CAST({_mini('(x * i)', -14, 2, 57344.0)}::DOUBLE * 65536 AS BIGINT)", "(q / 65536.0::DOUBLE)::FLOAT * d"),
    "F16": ("0::FLOAT", "0::FLOAT", "0", _f16("x")),
    "BF16": ("0::FLOAT", "0::FLOAT", "0", _mini("x", -126, 7, 3.3895313892515355e38)),
}
_SCALED |= {"Q8_1": _SCALED["Q8_0"], "TQ1_0": _SCALED["TQ2_0"]}


def coded(name: str, wide: bool = False) -> str:
    """CTEs up to e(t, r, c, x, q, v)."""
    d, m, q, v = _SCALED[name]
    block = fm.BLOCK[name][0]
    part = "0" if name.startswith("FP8") else f"c // {block}"
    return f"""{W256 if wide else W64}, b AS (SELECT *, {part} AS b FROM w),
s AS (SELECT t, r, b, CAST({d} AS FLOAT) AS d, CAST({m} AS FLOAT) AS m FROM b GROUP BY t, r, b),
j AS (SELECT b.*, coalesce(d, 0) AS d, m, CASE WHEN coalesce(d, 0) <> 0 THEN (1::FLOAT / d)::FLOAT ELSE 0::FLOAT END AS i FROM b JOIN s USING (t, r, b)),
k AS (SELECT *, {q} AS q FROM j), e AS (SELECT *, CAST({v} AS FLOAT) AS v FROM k)"""


def _report(name: str) -> str:
    block, size = fm.BLOCK[name]
    return f"""SELECT t AS tensor, count(*) AS n, count(*) // {block} * {size} AS bytes, CAST(sum(q) AS BIGINT) AS code_sum, CAST(sum(abs(q)) AS BIGINT) AS code_abs,
round(sum((x::DOUBLE - v::DOUBLE) * (x::DOUBLE - v::DOUBLE)), 6) AS sq_err, round(sum(x::DOUBLE * x::DOUBLE), 6) AS energy FROM e GROUP BY t"""


NVFP4 = f"""WITH {W64}, g AS (SELECT t, CAST(CASE WHEN max(abs(x)) > 0 THEN max(abs(x)) / 2688::FLOAT ELSE 1 END AS FLOAT) AS g FROM w GROUP BY t), b AS (SELECT *, c // 16 AS b FROM w),
s AS (SELECT t, r, b, CAST(CAST(max(abs(x)) / 6::FLOAT AS FLOAT) / any_value(g) AS FLOAT) AS l, any_value(g) AS g FROM b JOIN g USING (t) GROUP BY t, r, b),
j AS (SELECT b.*, CAST({_e4m3("l")} * g AS FLOAT) AS d FROM b JOIN s USING (t, r, b)),
k AS (SELECT *, {_e2m1("(x * CASE WHEN d <> 0 THEN (1::FLOAT / d)::FLOAT ELSE 0::FLOAT END)")} AS u FROM j), e AS (SELECT *, CAST(u * 2 AS BIGINT) AS q, CAST(u * d AS FLOAT) AS v FROM k) {_report("NVFP4")}"""
TILE = f"""WITH {W64}, b AS (SELECT *, r // 16 AS y, c // 32 AS z FROM w), s AS (SELECT t, y, z, greatest(CAST(max(abs(x)) / 448::FLOAT AS FLOAT), 1.1754943508222875e-38::FLOAT) AS d FROM b GROUP BY t, y, z),
k AS (SELECT b.*, d, {_e4m3("CAST(x / d AS FLOAT)")} AS u FROM b JOIN s USING (t, y, z)), e AS (SELECT *, CAST(u::DOUBLE * 512 AS BIGINT) AS q, CAST(u * d AS FLOAT) AS v FROM k) {_report("FP8_E4M3")}"""
IMATRIX = "im AS (SELECT t, c, sum(x::DOUBLE * x::DOUBLE) AS g, count(*) AS n FROM w GROUP BY t, c)"
SYNTH = """pts AS (SELECT concat_ws('.', p_brand, p_size % 5) AS name, 'r' || (p_partkey % 7) AS bits, CAST(100 * (p_partkey % 7 + 1) + sum(p_size) % 40 AS BIGINT) AS bytes,
  trunc(64.0::DOUBLE / (p_partkey % 7 + 1) + count(*) % 9) AS cost FROM part GROUP BY concat_ws('.', p_brand, p_size % 5), p_partkey % 7),
one AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY name, bytes ORDER BY cost, bits) = 1),
low AS (SELECT *, min(cost) OVER (PARTITION BY name ORDER BY bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM one),
cur AS (SELECT name, bits, bytes, cost, CAST(row_number() OVER (PARTITION BY name ORDER BY bytes) - 1 AS INT) AS lvl FROM low WHERE best IS NULL OR cost < best),
hull AS (SELECT * FROM cur j WHERE NOT EXISTS (SELECT 1 FROM cur a, cur k WHERE a.name = j.name AND k.name = j.name AND a.lvl < j.lvl AND k.lvl > j.lvl
  AND (a.cost - j.cost) / (j.bytes - a.bytes) <= (a.cost - k.cost) / (k.bytes - a.bytes))),
moves AS (SELECT *, lag(cost) OVER (PARTITION BY name ORDER BY bytes) - cost AS gain, bytes - lag(bytes) OVER (PARTITION BY name ORDER BY bytes) AS delta FROM hull)"""
CAPTURES = f"""{coded("Q4_0")}, l AS (SELECT r AS pos, c, x::DOUBLE * 8 AS a, v::DOUBLE * 8 AS b FROM e),
z AS (SELECT pos, max(a) AS ma, max(b) AS mb FROM l GROUP BY pos), lse AS (SELECT pos, any_value(ma) + ln(sum(exp(a - ma))) AS la, any_value(mb) + ln(sum(exp(b - mb))) AS lb FROM l JOIN z USING (pos) GROUP BY pos),
p AS (SELECT pos, c, a, b, a - la AS p, b - lb AS q FROM l JOIN lse USING (pos)),
dv AS (SELECT pos, greatest(sum(exp(p) * (p - q)), 0) AS kl, arg_max(c, (p, -c)) = arg_max(c, (q, -c)) AS same_top, CASE WHEN pos % 10 <> 3 THEN max(CASE WHEN c = pos % 64 THEN p END) END AS lp_ref, CASE WHEN pos % 10 <> 3 THEN max(CASE WHEN c = pos % 64 THEN q END) END AS lp_cand FROM p GROUP BY pos)"""
_HF = f"""hf AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 29 = 0 THEN 'lm_head.weight' WHEN p_partkey % 31 = 0 THEN 'model.visual.blocks.' || p_partkey || '.proj.weight'
  ELSE 'model.layers.' || (p_partkey % 24) || '.' || ['self_attn.q_proj.weight', 'mlp.experts.gate_up_proj', 'mlp.experts.down_proj', 'mlp.gate.weight', 'input_layernorm.weight', 'linear_attn.conv1d.weight', 'mlp.shared_expert.up_proj.weight', 'mlp.shared_expert_gate.weight'][p_partkey % 8 + 1] END AS name,
  CAST(p_size AS BIGINT) AS y, CAST({_list(inputs.COLS)}[p_partkey % 5 + 3] AS BIGINT) AS x, CASE WHEN p_partkey % 37 = 0 THEN 8 ELSE 30 END AS type_id FROM part),
hd AS (SELECT *, CASE WHEN name LIKE '%layernorm%' THEN 1 WHEN name LIKE '%experts%' THEN 3 ELSE 2 END AS rank, CASE WHEN name LIKE '%layernorm%' THEN 1 WHEN name LIKE '%experts%' THEN 4 * y ELSE y END AS nrows FROM hf)"""
PACK = f"""{_HF}, {FORMATS}, a AS (SELECT hd.*, nrows * x AS n, type_name, is_float, CASE WHEN rank < 2 THEN 'vector' WHEN starts_with(name, 'model.visual.') OR contains(name, '.visual.') THEN 'vision' WHEN ends_with(name, 'mlp.gate.weight') THEN 'router'
  WHEN contains(name, '.shared_expert.') THEN 'shared_expert' WHEN ends_with(name, 'conv1d.weight') THEN 'conv1d' WHEN ends_with(name, 'mlp.experts.gate_up_proj') OR ends_with(name, 'mlp.experts.down_proj') THEN 'expert'
  WHEN ends_with(name, 'embed_tokens.weight') OR ends_with(name, 'lm_head.weight') THEN 'embed_head' ELSE 'attention' END AS pack_role,
  CASE WHEN pack_role IN ('vector', 'vision', 'router', 'shared_expert', 'conv1d') THEN 'passthrough' ELSE pack_role END AS kind, nrows * x // block * block_bytes AS nbytes FROM hd JOIN formats USING (type_id)),
t AS (SELECT *, CASE WHEN is_float THEN kind ELSE 'passthrough' END AS pack_class, NOT is_float AND kind <> 'passthrough' AS warning, CASE WHEN NOT is_float OR kind = 'passthrough' THEN type_id WHEN kind = 'expert' THEN 12 ELSE 14 END AS target FROM a),
f AS (SELECT t.*, x % g.block <> 0 AS fell_back, CASE WHEN x % g.block = 0 THEN target WHEN x % h.block = 0 THEN g.primary_id ELSE 1 END AS actual_id FROM t JOIN formats g ON g.type_id = target JOIN formats h ON h.type_id = g.primary_id),
plan AS (SELECT f.*, u.type_name AS actual_name, CASE WHEN pack_class = 'passthrough' THEN nbytes ELSE n // u.block * u.block_bytes END AS packed_bytes FROM f JOIN formats u ON u.type_id = actual_id)"""
ENTRIES = f"""{TAGGED}, q AS (SELECT * FROM sized WHERE quantizable),
ent AS (SELECT min(pos) * 2 AS pos, role AS key, NULL::VARCHAR[] AS members, sum(nbytes)::BIGINT AS source_bytes FROM q GROUP BY role UNION ALL
  SELECT min(pos) * 2 + 1, 'set.' || role, list(DISTINCT name), sum(nbytes)::BIGINT FROM q WHERE pos % 7 = 0 GROUP BY role),
tn AS (SELECT name, role, sum(nbytes)::BIGINT AS own FROM q GROUP BY name, role),
hit AS (SELECT tn.name, tn.role, 0 AS level, e.pos FROM tn JOIN ent e ON e.key = tn.name UNION ALL
  SELECT tn.name, tn.role, 1, e.pos FROM tn JOIN (SELECT pos, unnest(members) AS member FROM ent) e ON e.member = tn.name UNION ALL SELECT tn.name, tn.role, 2, e.pos FROM tn JOIN ent e ON e.key = tn.role),
first_hit AS (SELECT name, role, min(level * 1000000000 + pos) AS m FROM hit GROUP BY name, role),
found AS (SELECT tn.name, tn.role, tn.own, CAST(m // 1000000000 AS INT) AS level, e.pos, e.key, e.source_bytes FROM tn LEFT JOIN first_hit h ON h.name = tn.name AND h.role = tn.role LEFT JOIN ent e ON e.pos = m % 1000000000)"""


def _kquant_candidates() -> str:
    rungs = ", ".join(f"({i}, {fm.ID[n]}, '{n}')" for i, n in enumerate(fm.LADDERS["kquant"]))
    return f"""WITH {TAGGED}, lad(rung, rid, rname) AS (VALUES {rungs}), s AS (SELECT * FROM sized JOIN lad ON true WHERE quantizable AND type_name IN ('F32', 'F16', 'BF16')),
f AS (SELECT s.*, cols % g.block <> 0 AS fell, CASE WHEN cols % g.block = 0 THEN rid WHEN cols % h.block = 0 THEN g.primary_id ELSE 1 END AS aid FROM s JOIN formats g ON g.type_id = rid JOIN formats h ON h.type_id = g.primary_id)
SELECT regexp_replace(role || '__' || rname, '[^A-Za-z0-9._-]', '_', 'g') AS id, role AS key, CAST(rung AS INT) AS rung, CAST(sum(n_elems // u.block * u.block_bytes) AS BIGINT) AS bytes, count(*) AS members, count(*) FILTER (fell) AS fell_back, array_to_string(list_sort(list(DISTINCT u.type_name)), ',') AS actual
FROM f JOIN formats u ON u.type_id = aid GROUP BY role, rung, rname"""


def _fallback(table: str, extra: str) -> str:
    return f"""{table}, f AS (SELECT t.*, cols % g.block <> 0 AS fell_back, CASE WHEN cols % g.block = 0 THEN target WHEN cols % h.block = 0 THEN g.primary_id ELSE 1 END AS actual_id FROM t JOIN formats g ON g.type_id = target JOIN formats h ON h.type_id = g.primary_id) {extra}"""


def _embedding_curves() -> str:
    rungs = ("Q2_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1", "Q8_0")
    one = lambda n: f"SELECT * FROM (WITH {coded(n)} SELECT t AS name, '{n}' AS bits, count(*) // {fm.BLOCK[n][0]} * {fm.BLOCK[n][1]} AS bytes, round(sum((x::DOUBLE - v::DOUBLE) * (x::DOUBLE - v::DOUBLE)) * 1000) AS cost FROM e GROUP BY t)"
    return f"""WITH pts AS ({" UNION ALL ".join(map(one, rungs))}), one AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY name, bytes ORDER BY cost, bits) = 1),
low AS (SELECT *, min(cost) OVER (PARTITION BY name ORDER BY bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM one)
SELECT name, bits, bytes, cost, CAST(row_number() OVER (PARTITION BY name ORDER BY bytes) - 1 AS INT) AS lvl FROM low WHERE best IS NULL OR cost < best"""


_GGUF_BLOCKS = ["F32", "F16", "BF16", "Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1"]


def _files() -> dict[str, str]:
    """What the file queries must give: the same figures from the relations that were written."""
    summed = "SELECT t AS tensor, count(DISTINCT r) AS rows, round(sum(v::DOUBLE * v::DOUBLE), 5) AS energy FROM e GROUP BY t"
    plain = f"WITH {W64}, e AS (SELECT *, x AS v FROM w)"
    turns = ", ".join(f"({i}, '{n}', {fm.BLOCK[n][0]}, {fm.BLOCK[n][1]})" for i, n in enumerate(_GGUF_BLOCKS))
    labels = "lab AS (SELECT 'emb.' || label AS name, count(*) AS n, row_number() OVER (ORDER BY 'emb.' || label) - 1 AS pos FROM embeddings GROUP BY label)"
    small = f"{W64}, {IMATRIX}"
    out = {f"gguf_{n.lower()}": f"WITH {coded(n)} {summed}" if n != "F32" else f"{plain} {summed}" for n in _GGUF_BLOCKS}
    layers = "SELECT 'blk.' || substr(t, 5) || '.ffn_up.weight' AS tensor, count(DISTINCT r) AS rows, round(sum(v::DOUBLE * v::DOUBLE), 5) AS energy FROM e GROUP BY t"
    return out | {
        "gguf_tensors": f"WITH {labels}, f(i, type_name, block, size) AS (VALUES {turns}) SELECT CAST(pos AS INT) AS pos, name, n AS rows, CAST(64 AS BIGINT) AS cols, type_name, CAST(n * 64 // block * size AS BIGINT) AS nbytes, CAST(0 AS BIGINT) AS misaligned FROM lab JOIN f ON i = pos % {len(_GGUF_BLOCKS)}",
        "gguf_kv": f"""WITH {labels} SELECT 0 AS pos, 'general.architecture' AS key, 'String' AS vtype, 'loom' AS value UNION ALL SELECT 1, 'loom.block_count', 'U32', count(*)::VARCHAR FROM lab UNION ALL SELECT 2, 'loom.big', 'U64', '9223372036854775809'
UNION ALL SELECT 3, 'loom.names', 'Array<String>', '[' || string_agg('"' || name || '"', ', ' ORDER BY pos) || ']' FROM lab""",
        "safetensors_values": f"{plain} {summed}",
        "safetensors_tensors": f"""WITH RECURSIVE {labels}, go AS (SELECT pos, name, n, n * 256 AS filled, 1 AS shard FROM lab WHERE pos = 0 UNION ALL
SELECT l.pos, l.name, l.n, CASE WHEN filled + l.n * 256 > 300000 THEN l.n * 256 ELSE filled + l.n * 256 END, CASE WHEN filled + l.n * 256 > 300000 THEN shard + 1 ELSE shard END FROM go JOIN lab l ON l.pos = go.pos + 1)
SELECT name, 'F32' AS dtype, n AS rows, CAST(64 AS BIGINT) AS cols, CAST(n * 256 AS BIGINT) AS nbytes, CAST(shard AS INT) AS shard FROM go""",
        "imatrix_file": f"WITH {small} SELECT t AS tensor, CAST(any_value(n) AS BIGINT) AS ncall, count(*) AS n, round(sum(g::FLOAT::DOUBLE), 2) AS total FROM im GROUP BY t",
        "logits_file": f"WITH {W64} SELECT r AS pos, CASE WHEN r % 10 <> 3 THEN r % 64 END AS target, round(sum(x::DOUBLE), 5) AS total FROM w WHERE r < 200 GROUP BY r",
        "sensitivity_file": f"WITH {ENTRIES} SELECT key, coalesce(len(members), 0)::BIGINT AS members, source_bytes, 'Q4_K' AS bits, source_bytes // 2 AS bytes, round((0.004 * (1 + pos % 5))::DOUBLE, 6) AS kl FROM ent",
        "quantize_plan": f"WITH {labels} SELECT replace(name, 'emb.', 'blk.') || '.ffn_up.weight' AS name, 'quantize' AS action, 'Q5_0' AS out_name FROM lab",
        "quantize_values": f"WITH {coded('Q8_0')} {layers}",
    }


def oracle() -> dict[str, str]:
    ladder = ", ".join(f"({fm.ID[n]})" for n in fm.LADDERS["full"] + fm.LADDERS["blockfloat"])
    full = ", ".join(f"({i}, {fm.ID[n]}, {fm.BLOCK[n][1] * 8 / fm.BLOCK[n][0]!r}::DOUBLE)" for i, n in enumerate(fm.LADDERS["full"]))
    sql = {
        "fmt_packed_size": f"WITH {CATALOG}, {FORMATS} SELECT pos, name, type_name, n_elems, n_elems // block * block_bytes AS nbytes, round(block_bytes * 8.0::DOUBLE / block, 6) AS bpw, {HUMAN.format(b='(n_elems // block * block_bytes)')} AS size FROM cat JOIN formats USING (type_id)",
        "fmt_fallback": _fallback(f"WITH {CATALOG}, {FORMATS}, lad(target) AS (VALUES {ladder}), t AS (SELECT * FROM cat, lad)", "SELECT pos, CAST(target AS INT) AS target_id, CAST(actual_id AS INT) AS actual_id, u.type_name AS actual_name, fell_back, CASE WHEN n_elems % u.block = 0 THEN n_elems // u.block * u.block_bytes END AS nbytes FROM f JOIN formats u ON u.type_id = actual_id"),
        "role_tag": f"WITH {TAGGED} SELECT pos, name, role, round(depth, 6) AS depth, expert, packed_expert, quantizable, dense_path FROM tags",
        "role_report": f"WITH {TAGGED}, g AS (SELECT coalesce(role, 'TOTAL') AS role, count(*) AS tensors, CAST(sum(nbytes) AS BIGINT) AS bytes, CAST(sum(n_elems) AS BIGINT) AS params FROM sized GROUP BY ROLLUP (role)) SELECT *, round(bytes * 8.0::DOUBLE / params, 6) AS bpw, {HUMAN.format(b='bytes')} AS size FROM g",
        "type_report": f"WITH {TAGGED} SELECT type_name, CAST(sum(nbytes) AS BIGINT) AS bytes, count(*) AS tensors FROM sized GROUP BY type_name",
        "dominant_type": f"WITH {TAGGED}, g AS (SELECT type_id, CAST(sum(nbytes) AS BIGINT) AS bytes FROM sized GROUP BY type_id) SELECT type_id, bytes FROM g ORDER BY bytes DESC, type_id DESC LIMIT 1",
        "layout_parse": "SELECT 'loom' AS arch, CAST(max(p_size) AS BIGINT) AS n_layers, 8::BIGINT AS expert_count, 2::BIGINT AS expert_used, 0::BIGINT AS shared_count, true AS is_moe FROM part",
        "recipe_resolve": f"WITH {RESOLVED} SELECT pos, name, bits, imatrix, target_id, NOT quantizable AS copy_unchanged FROM resolved",
        "floor_violations": f"WITH {RESOLVED}, v AS (SELECT name, role, bits, 'F16' AS floor FROM resolved WHERE quantizable AND role = 'router' AND target_bpw + 1e-9 < 16 UNION ALL SELECT name, role, bits, 'Q5_K' FROM resolved WHERE quantizable AND dense_path AND target_bpw + 1e-9 < 5.5) SELECT *, count(*) AS tensors FROM v GROUP BY ALL",
        "rt_nvfp4": NVFP4,
        "rt_fp8_tile": TILE,
        "imatrix_build": f"WITH {W64}, {IMATRIX} SELECT t AS tensor, max(n) AS ncall, CAST(count(*) AS INT) AS channels, round(min(g), 6) AS low, round(max(g), 6) AS high, CAST(count(*) FILTER (g <= 0) AS INT) AS unusable FROM im GROUP BY t",
        "imatrix_coverage": f"WITH {TAGGED}, k AS (SELECT DISTINCT 'blk.' || (p_partkey % {inputs.LAYERS}) || '.attn_q.weight' AS name FROM part WHERE p_size > 25) SELECT count(*) FILTER (name IN (SELECT name FROM k)) AS matched, count(*) FILTER (name NOT IN (SELECT name FROM k)) AS missing FROM tags WHERE quantizable",
        "proxy_cost_abs": f"WITH {coded('Q4_0')}, {IMATRIX} SELECT e.t AS tensor, round(greatest(sum(greatest(g, 1e-12) * x::DOUBLE * x::DOUBLE), 1e-12), 6) AS energy, round(sum(greatest(g, 1e-12) * (x::DOUBLE - v::DOUBLE) * (x::DOUBLE - v::DOUBLE)), 6) AS cost FROM e JOIN im ON e.t = im.t AND e.c = im.c GROUP BY e.t",
        "proxy_cost_rel": f"WITH {coded('Q4_0')} SELECT t AS tensor, round(sqrt(sum((x::DOUBLE - v::DOUBLE) * (x::DOUBLE - v::DOUBLE)) / sum(x::DOUBLE * x::DOUBLE)), 6) AS cost FROM e GROUP BY t",
        "curve_points": _fallback(f"WITH {TAGGED}, lad(rung, target, bpw) AS (VALUES {full}), t AS (SELECT * FROM (SELECT name || '@' || cols AS name, max(n_elems) AS n_elems, cols FROM tags WHERE quantizable GROUP BY ALL), lad WHERE bpw + 1e-9 >= 4.5)", "SELECT name, n_elems, cols, CAST(rung AS INT) AS rung, CAST(actual_id AS INT) AS actual_id, CASE WHEN n_elems % u.block = 0 THEN n_elems // u.block * u.block_bytes END AS bytes FROM f JOIN formats u ON u.type_id = actual_id QUALIFY row_number() OVER (PARTITION BY name, actual_id ORDER BY rung) = 1"),
        "embedding_curves": _embedding_curves(),
        "curve_normalize": f"WITH {SYNTH} SELECT name, bits, bytes, cost, lvl FROM cur",
        "curve_hull": f"WITH {SYNTH} SELECT name, lvl, bits, bytes, cost FROM hull",
        "curve_steps": f"WITH {SYNTH} SELECT name, lvl, bits, gain, delta, round(gain / delta, 9) AS ratio FROM moves WHERE gain > 0 AND delta > 0",
        "pareto_front": f"""WITH {SYNTH}, r AS (SELECT gain / delta AS ratio, sum(delta) AS d, sum(gain) AS g FROM moves WHERE gain > 0 AND delta > 0 GROUP BY gain / delta), fl AS (SELECT sum(bytes) AS fb, sum(cost) AS fc FROM hull WHERE lvl = 0),
a AS (SELECT CAST(fb + 1000 + sum(d) OVER w AS BIGINT) AS bytes, fc - sum(g) OVER w AS cost FROM r, fl WINDOW w AS (ORDER BY ratio DESC RANGE UNBOUNDED PRECEDING) UNION ALL SELECT CAST(fb + 1000 AS BIGINT), fc FROM fl) SELECT bytes, min(cost) AS cost FROM a GROUP BY bytes""",
        "kl_dense": f"WITH {CAPTURES} SELECT pos, round(kl, 6) AS kl, same_top, round(lp_ref, 6) AS lp_ref, round(lp_cand, 6) AS lp_cand FROM dv",
        "kl_stats": f"""WITH {CAPTURES}, st AS (SELECT round(kl, 9) AS kl, same_top, lp_ref, lp_cand, row_number() OVER (ORDER BY round(kl, 9)) - 1 AS i, count(*) OVER () AS n FROM dv)
SELECT count(*) AS n, round(avg(kl), 6) AS mean, {", ".join(f"round(max(kl) FILTER (i = floor((n - 1) * {q}::DOUBLE + 0.5)), 6) AS {a}" for q, a in ((0.5, "median"), (0.9, "p90"), (0.99, "p99")))}, round(max(kl), 6) AS max, round(sqrt(avg(kl * kl)), 6) AS rms, round(avg(same_top::INT), 6) AS top1, round(exp(-avg(lp_ref)), 6) AS ppl_ref, round(exp(-avg(lp_cand)), 6) AS ppl_cand FROM st""",
        "topk_logits": f"WITH {CAPTURES}, tk AS (SELECT pos, c, a FROM p QUALIFY row_number() OVER (PARTITION BY pos ORDER BY a DESC, c) <= 5) SELECT pos, CASE WHEN pos % 10 <> 3 THEN CAST(pos % 64 AS INT) END AS target, string_agg(c::VARCHAR, ',' ORDER BY a DESC, c) AS ids, round(any_value(la), 6) AS lse FROM tk JOIN lse USING (pos) GROUP BY pos",
        "kl_sparse": f"""WITH {CAPTURES}, rk AS (SELECT pos, c, p FROM p QUALIFY row_number() OVER (PARTITION BY pos ORDER BY a DESC, c) <= 16), ck AS (SELECT pos, c, q FROM p QUALIFY row_number() OVER (PARTITION BY pos ORDER BY b DESC, c) <= 16),
tl AS (SELECT pos, ln(greatest((1 - sum(exp(q))) / 48, 2.2250738585072014e-308)) AS tail FROM ck GROUP BY pos) SELECT rk.pos, round(greatest(sum(exp(p) * (p - coalesce(q, tail))), 0), 6) AS kl FROM rk JOIN tl ON tl.pos = rk.pos LEFT JOIN ck ON ck.pos = rk.pos AND ck.c = rk.c GROUP BY rk.pos""",
        "top1_agreement": f"WITH {CAPTURES} SELECT count(*) AS n, count(*) FILTER (same_top) AS same FROM dv",
        "perplexity": f"WITH {CAPTURES}, st AS (SELECT count(lp_ref) AS n, exp(-avg(lp_ref)) AS a, exp(-avg(lp_cand)) AS b FROM dv) SELECT n, round(a, 6) AS ppl_ref, round(b, 6) AS ppl_cand, round(b - a, 6) AS delta, round((b - a) / a * 100, 5) AS percent, abs(b - a) <= sqrt(0.5) AS within_noise FROM st",
        "sensitivity_groups": f"WITH {TAGGED} SELECT role || '@d' || least(CAST(floor(depth * 4) AS INT), 3) || '/4' AS key, count(*) AS members, CAST(sum(nbytes) AS BIGINT) AS source_bytes, round(avg(depth), 6) AS depth, sha256(string_agg(name, ',' ORDER BY name)) AS names FROM sized WHERE quantizable AND type_name IN ('F32', 'F16', 'BF16') GROUP BY 1",
        "candidates": _kquant_candidates(),
        "sens_lookup": f"WITH {ENTRIES} SELECT name, role, level, key AS entry_key, source_bytes FROM found",
        "sens_apply": f"""WITH {ENTRIES}, pt AS (SELECT found.*, x.bits, own // x.k AS bytes, x.c AS cost FROM found, (VALUES ('Q3_K', 5, 0.3::DOUBLE), ('Q4_K', 4, 0.2::DOUBLE), ('Q6_K', 2, 0.05::DOUBLE)) x(bits, k, c)),
m AS (SELECT *, CASE WHEN key IS NOT NULL AND bits <> 'Q3_K' THEN CASE bits WHEN 'Q4_K' THEN 0.02::DOUBLE ELSE 0.004::DOUBLE END * (1 + pos % 5) * least(own::DOUBLE / source_bytes, 1) END AS measured FROM pt),
sc AS (SELECT sum(measured) / sum(cost) FILTER (measured IS NOT NULL) AS s FROM m) SELECT name, role, bits, bytes, round(coalesce(measured, cost * s), 6) AS cost, measured IS NOT NULL AS matched FROM m, sc""",
        "shard_plan": f"""WITH RECURSIVE {TAGGED}, o AS (SELECT row_number() OVER (ORDER BY pos) AS i, pos, nbytes FROM sized),
fold AS (SELECT i, pos, nbytes, 0 AS shard, nbytes AS filled FROM o WHERE i = 1 UNION ALL SELECT o.i, o.pos, o.nbytes, CASE WHEN filled + o.nbytes > 2000000 THEN shard + 1 ELSE shard END, CASE WHEN filled + o.nbytes > 2000000 THEN o.nbytes ELSE filled + o.nbytes END FROM fold JOIN o ON o.i = fold.i + 1)
SELECT shard, count(*) AS tensors, CAST(sum(nbytes) AS BIGINT) AS bytes, min(pos) AS first FROM fold GROUP BY shard""",
        "pack_totals": f"WITH {PACK} SELECT count(*) AS tensors, CAST(sum(nbytes) AS BIGINT) AS source_bytes, CAST(sum(packed_bytes) AS BIGINT) AS packed_bytes, CAST(sum(CASE WHEN pack_role <> 'vision' THEN packed_bytes ELSE 0 END) AS BIGINT) AS resident_bytes, round(sum(nbytes)::DOUBLE / sum(packed_bytes)::DOUBLE, 6) AS smaller FROM plan",
        "pack_fallbacks": f"WITH {PACK} SELECT x AS cols, actual_name, count(*) AS tensors FROM plan WHERE fell_back AND pack_class <> 'passthrough' GROUP BY ALL",
        "pack_plan": f"WITH {PACK} SELECT pos, name, pack_role, pack_class, nrows AS \"rows\", x AS cols, actual_name, fell_back, packed_bytes, warning FROM plan",
        "pack_report": f"""WITH {PACK}, g AS (SELECT pack_class, actual_name, count(*) AS n, sum(nbytes) AS s, sum(packed_bytes) AS p, count(*) FILTER (fell_back) AS f FROM plan GROUP BY ALL)
SELECT pack_class, CAST(sum(n) AS BIGINT) AS tensors, CAST(sum(s) AS BIGINT) AS source_bytes, CAST(sum(p) AS BIGINT) AS packed_bytes, CAST(sum(f) AS BIGINT) AS fell_back, '{{' || string_agg('"' || actual_name || '":' || n, ',' ORDER BY actual_name) || '}}' AS formats, round(sum(p)::DOUBLE / sum(s)::DOUBLE, 6) AS ratio FROM g GROUP BY pack_class""",
        "aligned_offsets": f"WITH {TAGGED} SELECT pos, name, nbytes AS bytes, CAST(coalesce(sum((nbytes + 31) // 32 * 32) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sized",
        "moe_split": f"WITH {W64} SELECT t AS tensor, CAST(c // 16 AS BIGINT) AS expert, count(DISTINCT r) AS \"rows\", round(sum(CAST(x * 0.5::FLOAT AS FLOAT)::DOUBLE * CAST(x * 0.5::FLOAT AS FLOAT)::DOUBLE), 6) AS energy FROM w GROUP BY ALL",
        "moe_audit": f"""WITH {_HF}, src AS (SELECT name, min(pos) AS pos FROM hd GROUP BY name), o AS (SELECT name, pos FROM src WHERE pos % 11 <> 0 UNION ALL SELECT name, pos FROM src WHERE pos % 17 = 0), c AS (SELECT name, count(*) AS n FROM o GROUP BY name),
j AS (SELECT s.name, s.pos, c.n, s.pos % 5 = 0 AS gone, (s.pos % 13 = 0 AND s.pos % 11 <> 0) AS retyped, (s.pos % 17 = 0) AS twice FROM src s LEFT JOIN c USING (name)),
r AS (SELECT name, CASE WHEN n > 1 THEN 'repeated' WHEN NOT gone AND n IS NULL THEN 'missing' WHEN gone AND n IS NOT NULL THEN 'left over' WHEN NOT gone AND retyped THEN 'changed' END AS problem FROM j) SELECT * FROM r WHERE problem IS NOT NULL""",
        "attention_layout": f"""WITH {_HF}, g AS (SELECT CAST(regexp_extract(name, 'layers\\.([0-9]+)\\.', 1) AS BIGINT) AS layer, bool_or(name LIKE '%self\\_attn.%' ESCAPE '\\') AS f, bool_or(name LIKE '%linear\\_attn.%' ESCAPE '\\') AS l FROM hd WHERE name LIKE 'model.layers.%' GROUP BY 1),
k AS (SELECT i AS layer, CASE WHEN coalesce(f, false) AND NOT coalesce(l, false) THEN 'full_attention' WHEN coalesce(l, false) AND NOT coalesce(f, false) THEN 'linear_attention' ELSE 'invalid' END AS found, CASE WHEN i % 4 = 3 THEN 'full_attention' ELSE 'linear_attention' END AS declared FROM range(24) x(i) LEFT JOIN g ON g.layer = i) SELECT CAST(layer AS BIGINT) AS layer, found, declared, found = declared AS sound FROM k""",
        "candidate_names": "SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]', '_', 'g') AS id FROM part",
        "event_blocks": f"""WITH i AS (SELECT event_type AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value::FLOAT AS x FROM events), n AS (SELECT t, count(*) // 64 * 64 AS m FROM i GROUP BY t),
w AS (SELECT i.t, i // 32 AS b, x FROM i JOIN n ON n.t = i.t AND i < m), s AS (SELECT t, b, CAST(max(abs(x)) / 127::FLOAT AS FLOAT) AS d FROM w GROUP BY t, b), k AS (SELECT t, {_away("x * CASE WHEN d <> 0 THEN (1::FLOAT / d)::FLOAT ELSE 0::FLOAT END")} AS q FROM w JOIN s USING (t, b))
SELECT t AS tensor, count(*) AS n, count(*) // 32 * 34 AS bytes, CAST(sum(q) AS BIGINT) AS code_sum, CAST(sum(abs(q)) AS BIGINT) AS code_abs FROM k GROUP BY t""",
    }
    from quantaloom.plans.queries import ROUND_TRIPS

    for name, width in ROUND_TRIPS.items():
        if name in _SCALED:
            sql.setdefault(f"rt_{name.lower()}", f"WITH {coded(name, width == 256)} {_report(name)}")
    return sql | _files()
