"""Codebook formats: grid points, signs or shifts, and small scales, in the published block layouts.

The grids were fitted to data by the formats' authors and follow from no rule, so they are a parameter:
`use_grid` or `load_grids` gives them, and without its grid a format can be neither read nor written. The
driver's grids travel with each job (`given`, at most some 300 KB).

A value is d * unit(scale) * (grid value + shift) * sign. Encoding tries scales for each run of values, takes
the weighted nearest grid points, and rounds the scales to the block's steps.
"""

from __future__ import annotations

import functools

import numpy as np

f4 = np.float32

#: name -> values per grid point, points, values per scale, scale steps, bytes per 256 values
SHAPES = {
    "IQ2_XXS": (8, 256, 32, 16, 66),
    "IQ2_XS": (8, 512, 16, 16, 74),
    "IQ2_S": (8, 1024, 16, 16, 82),
    "IQ3_XXS": (4, 256, 32, 16, 98),
    "IQ3_S": (4, 512, 32, 16, 110),
    "IQ1_S": (8, 2048, 32, 8, 50),
    "IQ1_M": (8, 2048, 16, 8, 56),
}
#: Formats whose eighth sign follows from the parity of seven, and those with shifts in place of signs.
PARITY, SHIFTED = ("IQ2_XXS", "IQ2_XS", "IQ3_XXS"), {"IQ1_S": 32, "IQ1_M": 8}
SHIFT = f4(0.125)
_GIVEN: dict[str, np.ndarray] = {}


def use_grid(name: str, points: np.ndarray) -> None:
    """Give a format its grid: points of some values each."""
    dim, count, *_ = SHAPES[name]
    if points.shape != (count, dim):
        raise ValueError(f"{name} has {count} points of {dim} values")
    _GIVEN[name] = points.astype(f4)


def load_grids(path: str) -> None:
    """Give all grids of an .npz file, one array per format."""
    with np.load(path) as file:
        for name in file.files:
            use_grid(name, file[name])


def given() -> dict[str, np.ndarray]:
    return dict(_GIVEN)


def take(grids: dict[str, np.ndarray]) -> None:
    """The driver's grids, in a worker."""
    _GIVEN.update(grids)


def grid(name: str) -> np.ndarray:
    if name not in _GIVEN:
        raise ValueError(f"{name} needs its grid: use_grid or load_grids")
    return _GIVEN[name]


def neighbours(points: np.ndarray, x: np.ndarray, shells: int) -> list[np.ndarray]:
    """For each x the points within its nearest `shells` distinct distances, by (distance, place)."""
    d2 = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    out = []
    for row in d2:
        rank = np.unique(row, return_inverse=True)[1]
        near = np.flatnonzero(rank < shells)
        out.append(near[np.lexsort((near, row[near]))])
    return out


def _unit(name: str, steps: np.ndarray) -> np.ndarray:
    if name.startswith("IQ2"):
        return (steps + 0.5) * 0.25
    return (steps + 0.5) * 0.5 if name == "IQ3_XXS" else 2.0 * steps + 1


def _steps(name: str, size: np.ndarray) -> np.ndarray:
    """The step whose unit is nearest to a size."""
    at = size / 0.25 - 0.5 if name.startswith("IQ2") else size / 0.5 - 0.5 if name == "IQ3_XXS" else (size - 1) / 2
    return np.clip(np.rint(at), 0, SHAPES[name][3] - 1).astype(np.int64)


# ---- layouts: (d as half bits, grid places, scale steps, eight signs per group or shifted-down flags per point) ----


def _u2(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<u2").astype(np.int64)


def _u4(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<u4").astype(np.int64)


def _spread(values: np.ndarray, bits: int, count: int) -> np.ndarray:
    """count fields of so many bits from each value, the lowest first."""
    return (values[..., None] >> np.arange(count) * bits & (1 << bits) - 1).reshape(len(values), -1)


def _gather(fields: np.ndarray, bits: int, count: int) -> np.ndarray:
    return (fields.reshape(len(fields), -1, count) << np.arange(count) * bits).sum(axis=2)


def _even(seven: np.ndarray) -> np.ndarray:
    """Eight signs from seven: an even number of them is set."""
    return seven | (sum(seven >> i for i in range(7)) & 1) << 7


def fields(name: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    b = raw.astype(np.int64)
    if name == "IQ2_XXS":
        group, aux = b[:, 2:].reshape(-1, 8, 8), _u4(raw[:, 2:]).reshape(len(raw), 8, 2)[:, :, 1]
        out = group[:, :, :4].reshape(len(raw), 32), aux >> 28, _even(_spread(aux, 7, 4))
    elif name == "IQ2_XS":
        q = _u2(raw[:, 2:66])
        out = q & 511, _spread(b[:, 66:], 4, 2), _even(q >> 9)
    elif name == "IQ2_S":
        out = b[:, 2:34] | _spread(b[:, 66:74], 2, 4) << 8, _spread(b[:, 74:], 4, 2), b[:, 34:66]
    elif name == "IQ3_XXS":
        aux = _u4(raw[:, 66:])
        out = b[:, 2:66], aux >> 28, _even(_spread(aux, 7, 4))
    elif name == "IQ3_S":
        out = b[:, 2:66] | _spread(b[:, 66:74], 1, 8) << 8, _spread(b[:, 106:], 4, 2), b[:, 74:106]
    elif name == "IQ1_S":
        high = _u2(raw[:, 34:])
        out = b[:, 2:34] | _spread(high, 3, 4) << 8, high >> 12 & 7, np.repeat(high >> 15, 4, axis=1)
    else:
        high, scales = _spread(b[:, 32:48], 4, 2), _u2(raw[:, 48:])
        return _gather(scales >> 12, 4, 4)[:, 0], b[:, :32] | (high & 7) << 8, _spread(scales & 0xFFF, 3, 4), high >> 3
    return _u2(raw[:, :2])[:, 0], *out


def join(name: str, d: np.ndarray, k: np.ndarray, steps: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The bytes of blocks with these fields."""
    n = len(k)
    out = np.zeros((n, SHAPES[name][4]), np.uint8)

    def put(at: int, values: np.ndarray, kind: str = "<u1") -> None:
        data = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, -1)
        out[:, at : at + data.shape[1]] = data

    if name != "IQ1_M":
        put(0, d[:, None], "<u2")
    if name == "IQ2_XXS":
        aux = _gather(code & 127, 7, 4) | steps << 28
        put(2, np.concatenate([k.reshape(n, 8, 4).astype(np.uint8), aux.astype("<u4").view(np.uint8).reshape(n, 8, 4)], axis=2).reshape(n, -1))
    elif name == "IQ2_XS":
        put(2, k | (code & 127) << 9, "<u2")
        put(66, _gather(steps, 4, 2))
    elif name == "IQ2_S":
        for at, values in ((2, k & 255), (34, code), (66, _gather(k >> 8, 2, 4)), (74, _gather(steps, 4, 2))):
            put(at, values)
    elif name == "IQ3_XXS":
        put(2, k)
        put(66, _gather(code & 127, 7, 4) | steps << 28, "<u4")
    elif name == "IQ3_S":
        for at, values in ((2, k & 255), (66, _gather(k >> 8, 1, 8)), (74, code), (106, _gather(steps, 4, 2))):
            put(at, values)
    elif name == "IQ1_S":
        put(2, k & 255)
        put(34, _gather(k >> 8, 3, 4) | steps << 12 | code[:, ::4] << 15, "<u2")
    else:
        put(0, k & 255)
        put(32, _gather(k >> 8 | code << 3, 4, 2))
        put(48, _gather(steps, 3, 4) | _spread(d[:, None], 4, 4) << 12, "<u2")
    return out


def decode(name: str, raw: np.ndarray) -> np.ndarray:
    points, run = grid(name), SHAPES[name][2]
    d, k, steps, code = fields(name, raw)
    d = d.astype("<u2").view("<f2").astype(f4)
    scale = (d[:, None] * _unit(name, steps).astype(f4)).astype(f4)
    q = points[k].reshape(len(raw), 256)
    if name in SHIFTED:
        q = q + np.repeat(np.where(code, -SHIFT, SHIFT), 8, axis=1)
    else:
        q = q * np.where(code[..., None] >> np.arange(8) & 1, f4(-1), f4(1)).reshape(len(raw), 256)
    return (q * np.repeat(scale, run, axis=1)).astype(f4)


def _nearest(x: np.ndarray, w: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The weighted nearest grid point of every row, a bounded number of rows at a time."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        a, b = x[i : i + 4096], w[i : i + 4096]
        out[i : i + 4096] = (b @ (points * points).T - 2 * (a * b) @ points.T).argmin(axis=1)
    return out


def _picked(name: str, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs in units of the grid: places, shifted-down flags per point, and the values picked."""
    points, dim = grid(name), SHAPES[name][0]
    shape = (len(y), -1)
    a, b = y.reshape(-1, dim), w.reshape(-1, dim)
    if name not in SHIFTED:
        k = _nearest(a, b, points)
        return k.reshape(shape), np.zeros((len(y), y.shape[1] // dim), np.int64), points[k].reshape(shape)
    span = SHIFTED[name] // dim
    ks = [_nearest(a - s, b, points) for s in (SHIFT, -SHIFT)]
    qs = [points[k] + s for k, s in zip(ks, (SHIFT, -SHIFT), strict=True)]
    errors = [(b * (a - q) ** 2).sum(axis=1).reshape(-1, span).sum(axis=1) for q in qs]
    down = np.repeat(errors[1] < errors[0], span)
    return np.where(down, ks[1], ks[0]).reshape(shape), down.astype(np.int64).reshape(shape), np.where(down[:, None], qs[1], qs[0]).reshape(shape)


def _weights(x: np.ndarray, g: np.ndarray | None) -> np.ndarray:
    if g is None:
        return x * x + f4(0.25) * (x * x).mean(axis=1, keepdims=True)
    return (g * np.sqrt(2 * (x * x).mean(axis=1, keepdims=True) + x * x)).astype(f4)


def encode(name: str, x: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    _, _, run, count, _ = SHAPES[name]
    points, n = grid(name), len(x)
    w = _weights(x, g)
    sign = np.ones_like(x) if name in SHIFTED else np.where(x < 0, -1, 1).astype(f4)
    if name in PARITY:  # the eighth sign follows from parity: flip the cheapest where it would not
        eights, cost = sign.reshape(-1, 8), (w * x * x).reshape(-1, 8)
        odd = (eights < 0).sum(axis=1) % 2 == 1
        eights[odd, cost.argmin(axis=1)[odd]] *= -1
        sign = eights.reshape(n, 256)
    y, wr = (x * sign).reshape(-1, run), w.reshape(-1, run).astype(f4)
    top = np.abs(y).max(axis=1)
    live = top > 1e-12
    best, scale = np.full(len(y), np.inf), np.zeros(len(y), f4)
    for trial in np.linspace(0.55, 1.25, 12):
        inv = np.where(live, f4(np.abs(points).max() * trial) / np.where(live, top, 1), 0).astype(f4)
        q = _picked(name, y * inv[:, None], wr)[2]
        qq = (wr * q * q).sum(axis=1)
        s = np.maximum(np.where(qq > 0, (wr * q * y).sum(axis=1) / np.where(qq > 0, qq, 1), 0), 0).astype(f4)
        err = (wr * (y - s[:, None] * q) ** 2).sum(axis=1)
        better = live & (err < best)
        best[better], scale[better] = err[better], s[better]
    scale = scale.reshape(n, -1)
    d = (scale.max(axis=1) / f4(_unit(name, np.array(count - 1)))).astype("<f2")
    half = d.astype(f4)
    steps = _steps(name, scale / np.where(half > 0, half, 1)[:, None])
    fine = (half[:, None] * _unit(name, steps)).astype(f4).reshape(-1)
    inv = np.where(fine > 0, 1 / np.where(fine > 0, fine, 1), 0).astype(f4)
    k, down, _ = _picked(name, y * inv[:, None], wr)
    code = down.reshape(n, -1) if name in SHIFTED else _gather((sign < 0).astype(np.int64), 1, 8)
    return join(name, d.view("<u2").astype(np.int64), k.reshape(n, -1), steps, code)


ENCODERS = {name: functools.partial(encode, name) for name in SHAPES}
DECODERS = {name: functools.partial(decode, name) for name in SHAPES}
