"""Block kernels in NumPy: rows of values to packed bytes and back, many blocks at a time.

Every kernel takes blocks as a (count, size) array and works on all of them at once;
only the short lane axis is walked in order, in single precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quantaloom.functions.formats import BLOCK, FP8, ID

f4 = np.float32
EPS = f4(1e-15)


def _sum(a: np.ndarray) -> np.ndarray:
    """Sums along the last axis, term by term in single precision."""
    return np.add.accumulate(a.astype(f4, copy=False), axis=-1, dtype=f4)[..., -1]


def _inverse(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d != 0, f4(1) / d, f4(0)).astype(f4)


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, f4(0)).astype(f4)


def _f16(d: np.ndarray) -> np.ndarray:
    return d.astype(np.float16).astype(f4)


def _half(d: np.ndarray) -> np.ndarray:
    """Two bytes per value."""
    return np.ascontiguousarray(d.astype("<f2")).view(np.uint8).reshape(*d.shape, 2)


def _unhalf(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).view("<f2")[..., 0].astype(f4)


def _signed_max(x: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, np.abs(x).argmax(axis=-1)[..., None], -1)[..., 0]


def _away(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, np.floor(v + f4(0.5)), np.ceil(v - f4(0.5))).astype(np.int32)


def _nibbles(q: np.ndarray) -> np.ndarray:
    """First half in low nibbles, second half in high ones."""
    h = q.shape[-1] // 2
    return (q[..., :h] | q[..., h:] << 4).astype(np.uint8)


def _unnibbles(b: np.ndarray) -> np.ndarray:
    return np.concatenate([b & 15, b >> 4], axis=-1).astype(np.int32)


def _adjacent(q: np.ndarray) -> np.ndarray:
    return (q[..., 0::2] | q[..., 1::2] << 4).astype(np.uint8)


def _unadjacent(b: np.ndarray) -> np.ndarray:
    return np.stack([b & 15, b >> 4], axis=-1).reshape(*b.shape[:-1], -1).astype(np.int32)


def _join(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([p.reshape(len(p), -1).astype(np.uint8) for p in parts], axis=1)


# ---- legacy ----------------------------------------------------------------------------------


def q_signed(x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    d = (_signed_max(x) / f4(-half)).astype(f4)
    return d, np.minimum(np.trunc(x * _inverse(d)[:, None] + f4(half + 0.5)).astype(np.int32), 2 * half - 1)


def q_affine(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = x.min(axis=1)
    d = ((x.max(axis=1) - m) / f4(levels)).astype(f4)
    return d, m, np.minimum(np.trunc((x - m[:, None]) * _inverse(d)[:, None] + f4(0.5)).astype(np.int32), levels)


def _five(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = np.packbits((q >> 4 & 1).astype(np.uint8), axis=1, bitorder="little")
    return high, _nibbles(q & 15)


def _unfive(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _unnibbles(low) | np.unpackbits(np.ascontiguousarray(high), axis=1, bitorder="little").astype(np.int32) << 4


def enc_q4_0(x, g=None):
    d, q = q_signed(x, 8)
    return _join(_half(d), _nibbles(q))


def dec_q4_0(b):
    return (_unnibbles(b[:, 2:]) - 8).astype(f4) * _unhalf(b[:, :2])[:, None]


def enc_q4_1(x, g=None):
    d, m, q = q_affine(x, 15)
    return _join(_half(d), _half(m), _nibbles(q))


def dec_q4_1(b):
    return _unnibbles(b[:, 4:]).astype(f4) * _unhalf(b[:, :2])[:, None] + _unhalf(b[:, 2:4])[:, None]


def enc_q5_0(x, g=None):
    d, q = q_signed(x, 16)
    return _join(_half(d), *_five(q))


def dec_q5_0(b):
    return (_unfive(b[:, 2:6], b[:, 6:]) - 16).astype(f4) * _unhalf(b[:, :2])[:, None]


def enc_q5_1(x, g=None):
    d, m, q = q_affine(x, 31)
    return _join(_half(d), _half(m), *_five(q))


def dec_q5_1(b):
    return _unfive(b[:, 4:8], b[:, 8:]).astype(f4) * _unhalf(b[:, :2])[:, None] + _unhalf(b[:, 2:4])[:, None]


def _q8(x):
    d = (np.abs(x).max(axis=1) / f4(127)).astype(f4)
    return d, _away(x * _inverse(d)[:, None])


def enc_q8_0(x, g=None):
    d, q = _q8(x)
    return _join(_half(d), q.astype(np.int8).view(np.uint8))


def enc_q8_1(x, g=None):
    d, q = _q8(x)
    return _join(_half(d), _half(d * q.sum(axis=1).astype(f4)), q.astype(np.int8).view(np.uint8))


def dec_q8(b, at):
    return np.ascontiguousarray(b[:, at:]).view(np.int8).astype(f4) * _unhalf(b[:, :2])[:, None]


def enc_q1_0(x, g=None):
    return _join(_half(_sum(np.abs(x)) / f4(x.shape[1])), np.packbits(x >= 0, axis=1, bitorder="little"))


def dec_q1_0(b):
    bits = np.unpackbits(np.ascontiguousarray(b[:, 2:]), axis=1, bitorder="little")
    return (2 * bits.astype(f4) - 1) * _unhalf(b[:, :2])[:, None]


def _quads(q: np.ndarray) -> np.ndarray:
    return (q[:, 0::4] | q[:, 1::4] << 2 | q[:, 2::4] << 4 | q[:, 3::4] << 6).astype(np.uint8)


def _unquads(b: np.ndarray) -> np.ndarray:
    return np.stack([b >> s & 3 for s in (0, 2, 4, 6)], axis=-1).reshape(len(b), -1).astype(np.int32)


def enc_q2_0(x, g=None):
    d = np.abs(x).max(axis=1)
    return _join(_half(d), _quads(np.clip(_away(x * _inverse(d)[:, None]) + 1, 0, 3)))


def dec_q2_0(b):
    return (_unquads(b[:, 2:]) - 1).astype(f4) * _unhalf(b[:, :2])[:, None]


# ---- ternary ---------------------------------------------------------------------------------


def _trits(x):
    d = np.abs(x).max(axis=1)
    return d, np.clip(_away(x * _inverse(d)[:, None]) + 1, 0, 2)


def _planes(q: np.ndarray) -> np.ndarray:
    """Four planes of 32 in two bits each, per 128 values."""
    p = q.reshape(len(q), -1, 4, 32)
    return (p[:, :, 0] | p[:, :, 1] << 2 | p[:, :, 2] << 4 | p[:, :, 3] << 6).reshape(len(q), -1).astype(np.uint8)


def _unplanes(b: np.ndarray) -> np.ndarray:
    p = b.reshape(len(b), -1, 1, 32)
    return np.concatenate([p >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(b), -1).astype(np.int32)


def enc_tq2_0(x, g=None):
    d, q = _trits(x)
    return _join(_planes(q), _half(d))


def dec_tq2_0(b):
    return (_unplanes(b[:, :64]) - 1).astype(f4) * _unhalf(b[:, 64:])[:, None]


#: Lanes of TQ1_0: first value, lane width, trits per byte.
_TRIT_LANES = [(0, 32, 5), (160, 16, 5), (240, 4, 4)]


def enc_tq1_0(x, g=None):
    d, q = _trits(x)
    out = []
    for at, lane, n in _TRIT_LANES:
        digits = q[:, at : at + lane * n].reshape(len(q), n, lane)
        number = np.zeros((len(q), lane), np.int32)
        for i in range(5):
            number = number * 3 + (digits[:, i] if i < n else 0)
        out.append((number * 256 + 242) // 243)
    return _join(*out, _half(d))


def dec_tq1_0(b):
    out, at = [], 0
    for _, lane, n in _TRIT_LANES:
        part = b[:, at : at + lane].astype(np.int32)
        out += [(part * 3**i % 256) * 3 >> 8 for i in range(n)]
        at += lane
    return (np.concatenate(out, axis=1) - 1).astype(f4) * _unhalf(b[:, 52:])[:, None]


# ---- searches of the super-block formats -----------------------------------------------------


def search_symmetric(x, levels, w):
    """(scale, codes from 0) of least weighted squared error among 19 trial scales; codes run from -levels to levels - 1."""
    top = _signed_max(x)
    live = np.abs(top) >= EPS
    best, scale = np.full(len(x), f4(-1), f4), np.zeros(len(x), f4)
    codes = np.zeros(x.shape, np.int32)
    for trial in (0, *range(-9, 0), *range(1, 10)):
        inv = _divide(-f4(levels + 0.1 * trial) if trial else -f4(levels), top)
        q = np.clip(np.rint(inv[:, None] * x), -levels, levels - 1).astype(np.int32)
        lx, l2 = _sum(w * x * q), _sum(w * (q * q).astype(f4))
        better = live & (l2 > 0) & ((lx * lx > best * l2) if trial else True)
        s = _divide(lx, l2)
        scale[better], best[better], codes[better] = s[better], (s * lx)[better], q[better]
    codes += levels
    return np.where(live, scale, 0).astype(f4), np.where(live[:, None], codes, levels)


def search_refine(x, levels):
    """As search_symmetric, from one scale refined lane by lane five times with weights x^2."""
    top = _signed_max(x)
    live = np.abs(top) >= EPS
    q = np.clip(np.rint(_divide(-f4(levels), top)[:, None] * x), -levels, levels - 1).astype(np.int32)
    w = x * x
    lx, l2 = _sum(w * x * q), _sum(w * (q * q).astype(f4))
    for _ in range(5):
        moved = False
        for i in range(x.shape[1]):
            wi, xi, qi = w[:, i], x[:, i], q[:, i].astype(f4)
            a, b = lx - wi * xi * qi, l2 - wi * qi * qi
            new = np.clip(np.rint(xi * _divide(b, a)), -levels, levels - 1)
            c, e = a + wi * xi * new, b + wi * new * new
            better = (a > 0) & (new != qi) & (e > 0) & (c * c * l2 > lx * lx * e)
            q[better, i] = new[better].astype(np.int32)
            lx, l2 = np.where(better, c, lx), np.where(better, e, l2)
            moved |= bool(better.any())
        if not moved:
            break
    return np.where(live, _divide(lx, l2), 0).astype(f4), np.where(live[:, None], q + levels, levels)


def search_affine(x, levels, w, low, step, tries, absolute):
    """(scale, minimum as a positive offset, codes) of least error among trial scales, each with its least-squares minimum."""
    m, top = np.minimum(x.min(axis=1), 0).astype(f4), x.max(axis=1)
    live = top > m
    sw, sx = _sum(w), _sum(w * x)
    inv = _divide(f4(levels), top - m)
    scale = _inverse(inv)

    def error(q, s, lo):
        diff = s[:, None] * q + lo[:, None] - x
        return _sum(w * (np.abs(diff) if absolute else diff * diff))

    codes = np.clip(np.rint(inv[:, None] * (x - m[:, None])), 0, levels).astype(f4)
    best, low_best = error(codes, scale, m), m.copy()
    for i in range(tries + 1):
        inv = _divide(f4(low + step * i + levels), top - m)
        q = np.clip(np.rint(inv[:, None] * (x - m[:, None])), 0, levels).astype(f4)
        l1, l2, xl = _sum(w * q), _sum(w * q * q), _sum(w * q * x)
        det = sw * l2 - l1 * l1
        s, lo = _divide(sw * xl - sx * l1, det), _divide(l2 * sx - l1 * xl, det)
        s = np.where(lo > 0, _divide(xl, l2), s).astype(f4)
        lo = np.minimum(lo, 0).astype(f4)
        e = error(q, s, lo)
        better = live & (det > 0) & (e < best)
        codes[better], scale[better], low_best[better], best[better] = q[better], s[better], lo[better], e[better]
    return np.where(live, scale, 0).astype(f4), -low_best, np.where(live[:, None], codes, 0).astype(np.int32)


def search_positive(x, levels, w):
    """(scale, codes 0..levels) for values of at least 0."""
    top = x.max(axis=1)
    live = top > EPS

    def coded(inv):
        return np.clip(np.rint(inv[:, None] * x), 0, levels).astype(f4)

    def error(inv):
        diff = x - _inverse(inv)[:, None] * coded(inv)
        return _sum(w * diff * diff)

    inv = _divide(f4(levels), top)
    best = error(inv)
    for trial in (-4, -3, -2, -1, 1, 2, 3, 4):
        other = _divide(f4(levels + 0.1 * trial), top)
        e = error(other)
        better = e < best
        inv, best = np.where(better, other, inv).astype(f4), np.where(better, e, best)
    q = coded(inv)
    lx, l2 = _sum(w * x * q), _sum(w * q * q)
    for _ in range(5):
        moved = False
        for i in range(x.shape[1]):
            a, b = lx - w[:, i] * x[:, i] * q[:, i], l2 - w[:, i] * q[:, i] * q[:, i]
            new = np.clip(np.rint(x[:, i] * _divide(b, a)), 0, levels).astype(f4)
            c, e = a + w[:, i] * x[:, i] * new, b + w[:, i] * new * new
            better = (a > 0) & (b > 0) & (new != q[:, i]) & (e > 0) & (c * c * l2 > lx * lx * e)
            q[better, i] = new[better]
            lx, l2 = np.where(better, c, lx), np.where(better, e, l2)
            moved |= bool(better.any())
        if not moved:
            break
    return np.where(live, _divide(lx, l2), 0).astype(f4), np.where(live[:, None], q, 0).astype(np.int32)


def _recode(x, d, offset, low, high, codes):
    """Codes again under the stored scales; blocks of scale 0 keep theirs."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.clip(np.rint((x + offset) / d), low, high)
    return np.where(d != 0, np.nan_to_num(q), codes).astype(np.int32)


def _importance(x, g, factor):
    sigma = f4(factor) * _sum(x * x) / f4(256)
    return (g * np.sqrt(sigma[:, None] + x * x)).astype(f4)


def _sub(x, n):
    return x.reshape(-1, n)


# ---- K formats -------------------------------------------------------------------------------


def enc_q2_k(x, g=None):
    n = len(x)
    parts = _sub(x, 16)
    if g is None:
        scale, low, q = search_affine(parts, 3, np.abs(parts), -0.5, 0.1, 15, True)
        scale, low = scale.reshape(n, 16), low.reshape(n, 16)
        tops = scale.max(axis=1), low.max(axis=1)
        ls, lm = (np.clip(np.rint(_divide(f4(15), t)[:, None] * v), 0, 15).astype(np.int32) for t, v in zip(tops, (scale, low), strict=True))
        d, dm = (t / f4(15) for t in tops)
    else:
        w = _sub(_importance(x, g, 1), 16)
        scale, low, q = search_affine(parts, 3, w, -0.9, 0.05, 36, False)
        sw = _sum(w).reshape(n, 16)
        d, ls = search_positive(scale.reshape(n, 16), 15, sw)
        dm, lm = search_positive(low.reshape(n, 16), 15, sw)
    fine, offset = (np.repeat(_f16(a)[:, None] * b, 16, axis=1) for a, b in ((d, ls), (dm, lm)))
    q = _recode(x, fine, offset, 0, 3, q.reshape(n, 256))
    return _join(ls | lm << 4, _planes(q), _half(d), _half(dm))


def dec_q2_k(b):
    s, q = b[:, :16], _unplanes(b[:, 16:80])
    d, dm = _unhalf(b[:, 80:82]), _unhalf(b[:, 82:84])
    return np.repeat(d[:, None] * (s & 15), 16, axis=1) * q - np.repeat(dm[:, None] * (s >> 4), 16, axis=1)


def enc_q3_k(x, g=None):
    n = len(x)
    parts = _sub(x, 16)
    if g is None:
        scale, q = search_refine(parts, 4)
        scale = scale.reshape(n, 16)
        inv = _divide(f4(-32), _signed_max(scale))
        ls = np.clip(np.rint(inv[:, None] * scale), -32, 31).astype(np.int32) + 32
        d = _inverse(inv)
    else:
        w = _sub(_importance(x, g, 2), 16)
        scale, q = search_symmetric(parts, 4, w)
        d, ls = search_symmetric(scale.reshape(n, 16), 32, _sum(w).reshape(n, 16))
    q = _recode(x, np.repeat(_f16(d)[:, None] * (ls - 32), 16, axis=1), 0, -4, 3, q.reshape(n, 256) - 4) + 4
    high = np.packbits((q > 3).reshape(n, 8, 32), axis=1, bitorder="little").reshape(n, 32)
    packed = np.zeros((n, 12), np.int32)
    packed[:, :8] = ls[:, :8] & 15 | (ls[:, 8:] & 15) << 4
    for j in range(16):
        packed[:, 8 + j % 4] |= ls[:, j] >> 4 << 2 * (j // 4)
    return _join(high, _planes(q & 3), packed, _half(d))


def dec_q3_k(b):
    n = len(b)
    high = np.unpackbits(np.ascontiguousarray(b[:, :32]).reshape(n, 1, 32), axis=1, bitorder="little").reshape(n, 256).astype(np.int32)
    q = _unplanes(b[:, 32:96]) + 4 * high - 4
    p = b[:, 96:108].astype(np.int32)
    ls = np.concatenate([p[:, :8] & 15, p[:, :8] >> 4], axis=1)
    for j in range(16):
        ls[:, j] |= (p[:, 8 + j % 4] >> 2 * (j // 4) & 3) << 4
    return np.repeat(_unhalf(b[:, 108:])[:, None] * (ls - 32), 16, axis=1) * q


def _pack_six(ls, lm):
    out = np.zeros((len(ls), 12), np.int32)
    out[:, :4], out[:, 4:8] = ls[:, :4], lm[:, :4]
    out[:, 8:] = ls[:, 4:] & 15 | (lm[:, 4:] & 15) << 4
    out[:, :4] |= ls[:, 4:] >> 4 << 6
    out[:, 4:8] |= lm[:, 4:] >> 4 << 6
    return out


def _unpack_six(b):
    p = b.astype(np.int32)
    ls = np.concatenate([p[:, :4] & 63, p[:, 8:] & 15 | p[:, :4] >> 6 << 4], axis=1)
    lm = np.concatenate([p[:, 4:8] & 63, p[:, 8:] >> 4 | p[:, 4:8] >> 6 << 4], axis=1)
    return ls, lm


def _q45(x, g, levels, search):
    n = len(x)
    parts = _sub(x, 32)
    if g is None:
        w = np.sqrt(_sum(parts * parts) / f4(32))[:, None] + np.abs(parts)
        scale, low, q = search_affine(parts, levels, w, *search, False)
        scale, low = scale.reshape(n, 8), low.reshape(n, 8)
        tops = scale.max(axis=1), low.max(axis=1)
        ls, lm = (np.clip(np.rint(_divide(f4(63), t)[:, None] * v), 0, 63).astype(np.int32) for t, v in zip(tops, (scale, low), strict=True))
        d, dm = (t / f4(63) for t in tops)
    else:
        w = _sub(_importance(x, g, 2), 32)
        scale, low, q = search_affine(parts, levels, w, -0.9, 0.05, 36, False)
        sw = _sum(w).reshape(n, 8)
        d, ls = search_positive(scale.reshape(n, 8), 63, sw)
        dm, lm = search_positive(low.reshape(n, 8), 63, sw)
    fine, offset = (np.repeat(_f16(a)[:, None] * b, 32, axis=1) for a, b in ((d, ls), (dm, lm)))
    return d, dm, _pack_six(ls, lm), _recode(x, fine, offset, 0, levels, q.reshape(n, 256))


def _pairs64(q):
    p = q.reshape(len(q), 4, 2, 32)
    return (p[:, :, 0] | p[:, :, 1] << 4).reshape(len(q), 128)


def _unpairs64(b):
    p = b.reshape(len(b), 4, 1, 32)
    return np.concatenate([p & 15, p >> 4], axis=2).reshape(len(b), 256).astype(np.int32)


def _dec45(d, dm, scales, q):
    ls, lm = _unpack_six(scales)
    return np.repeat(d[:, None] * ls, 32, axis=1) * q - np.repeat(dm[:, None] * lm, 32, axis=1)


def enc_q4_k(x, g=None):
    d, dm, s, q = _q45(x, g, 15, (-1.0, 0.1, 20))
    return _join(_half(d), _half(dm), s, _pairs64(q))


def dec_q4_k(b):
    return _dec45(_unhalf(b[:, :2]), _unhalf(b[:, 2:4]), b[:, 4:16], _unpairs64(b[:, 16:]))


def enc_q5_k(x, g=None):
    d, dm, s, q = _q45(x, g, 31, (-0.5, 0.1, 15))
    high = np.packbits((q > 15).reshape(len(q), 8, 32), axis=1, bitorder="little").reshape(len(q), 32)
    return _join(_half(d), _half(dm), s, high, _pairs64(q & 15))


def dec_q5_k(b):
    high = np.unpackbits(np.ascontiguousarray(b[:, 16:48]).reshape(len(b), 1, 32), axis=1, bitorder="little").reshape(len(b), 256).astype(np.int32)
    return _dec45(_unhalf(b[:, :2]), _unhalf(b[:, 2:4]), b[:, 4:16], _unpairs64(b[:, 48:]) | high << 4)


def enc_q6_k(x, g=None):
    n = len(x)
    parts = _sub(x, 16)
    w = parts * parts if g is None else _sub(np.broadcast_to(g, x.shape).astype(f4), 16)
    scale, q = search_symmetric(parts, 32, w)
    scale = scale.reshape(n, 16)
    top = _signed_max(scale)
    inv = np.where(np.abs(top) >= EPS, _divide(f4(-128), top), 0).astype(f4)
    d = _inverse(inv)
    ls = np.minimum(np.rint(inv[:, None] * scale), 127).astype(np.int32)
    q = _recode(x, np.repeat(_f16(d)[:, None] * ls, 16, axis=1), 0, -32, 31, q.reshape(n, 256) - 32) + 32
    q = np.where((inv == 0)[:, None], 0, q)
    p = q.reshape(n, 2, 4, 32)
    low = np.stack([p[:, :, 0] & 15 | (p[:, :, 2] & 15) << 4, p[:, :, 1] & 15 | (p[:, :, 3] & 15) << 4], axis=2)
    return _join(low, _planes((q >> 4).reshape(n, 256)), ls.astype(np.int8).view(np.uint8), _half(d))


def dec_q6_k(b):
    n = len(b)
    low = b[:, :128].reshape(n, 2, 2, 32).astype(np.int32)
    q = np.stack([low[:, :, 0] & 15, low[:, :, 1] & 15, low[:, :, 0] >> 4, low[:, :, 1] >> 4], axis=2).reshape(n, 256)
    q = (q | _unplanes(b[:, 128:192]) << 4) - 32
    ls = np.ascontiguousarray(b[:, 192:208]).view(np.int8).astype(f4)
    return np.repeat(_unhalf(b[:, 208:])[:, None] * ls, 16, axis=1) * q


def enc_q8_k(x, g=None):
    inv = _divide(f4(-127), _signed_max(x))
    q = np.minimum(np.rint(inv[:, None] * x), 127).astype(np.int8)
    sums = q.reshape(len(x), 16, 16).sum(axis=2, dtype=np.int16)
    return _join(_inverse(inv).astype("<f4").view(np.uint8).reshape(-1, 4), q.view(np.uint8), np.ascontiguousarray(sums.astype("<i2")).view(np.uint8))


def dec_q8_k(b):
    return np.ascontiguousarray(b[:, :4]).view("<f4") * np.ascontiguousarray(b[:, 4:260]).view(np.int8).astype(f4)


# ---- floats ----------------------------------------------------------------------------------


def _mini_table(exponents: int, mantissa: int, bias: int, finite: int) -> np.ndarray:
    """Values of all codes of a small float without sign, up to the largest finite code."""
    codes = np.arange(finite + 1)
    e, m = codes >> mantissa, codes & (1 << mantissa) - 1
    return np.where(e > 0, np.ldexp(1.0 + m / (1 << mantissa), e - bias), np.ldexp(m / (1 << mantissa), 1 - bias))


E4M3 = _mini_table(4, 3, 7, 0x7E)
E5M2 = _mini_table(5, 2, 15, 0x7B)
E2M1 = np.array([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0])


def encode_mini(x: np.ndarray, table: np.ndarray, tie: str = "even") -> np.ndarray:
    """Nearest code with the sign in the bit above; saturates. tie: to the even code, or 'down' to the smaller."""
    size = np.abs(x.astype(np.float64))
    cuts = (table[1:] + table[:-1]) / 2
    code = np.searchsorted(cuts, size, "left")
    if tie == "even":
        up = np.searchsorted(cuts, size, "right")
        code = np.where((up != code) & (code % 2 == 1), up, code)
    code = np.where(np.isnan(x), len(table) - 1, code)
    return (code | np.signbit(x).astype(np.int64) << (3 if len(table) == 8 else 7)).astype(np.uint8)


def decode_mini(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = 3 if len(table) == 8 else 7
    size = code & (1 << bits) - 1
    value = np.where(size < len(table), table[np.minimum(size, len(table) - 1)], np.inf if len(table) == 0x7C else np.nan)
    if len(table) == 0x7C:
        value = np.where(size > 0x7C, np.nan, value)
    return np.where(code >> bits, -value, value).astype(f4)


def e8m0(x: np.ndarray) -> np.ndarray:
    """The exponent byte of a single: truncates; what is not positive and finite is 0."""
    bits = np.ascontiguousarray(x.astype(f4)).view(np.uint32) >> np.uint32(23)
    return np.where((x > 0) & np.isfinite(x), bits, 0).astype(np.int32)


def e8m0_value(code: np.ndarray) -> np.ndarray:
    return np.ldexp(1.0, code.astype(np.int32) - 127).astype(f4)


def ue4m3(x: np.ndarray) -> np.ndarray:
    """Unsigned E4M3 code of a scale: ties go up; from 256 on, where the exponent would be the highest, 0x7E."""
    size = np.where(x > 0, np.minimum(x, f4(448)), 0).astype(f4)
    bits = size.view(np.uint32)
    normal = (bits >> np.uint32(20)).astype(np.int64) + (bits >> np.uint32(19) & np.uint32(1)) - (120 << 3)
    small = np.clip(np.floor(size * f4(512) + f4(0.5)), 0, 7)
    return np.where(normal < 8, small, np.where(normal >= 0x78, 0x7E, normal)).astype(np.uint8)


def ue4m3_value(code: np.ndarray) -> np.ndarray:
    """The scale of a code; the code that would be no number is 0."""
    return np.where(code >= 0x7F, 0, E4M3[np.minimum(code, 0x7E)]).astype(f4)


def _mx_error(x, s, w):
    q = decode_mini(encode_mini(x * _inverse(s)[:, None], E2M1, "down"), E2M1)
    return (w * (x.astype(np.float64) - q.astype(np.float64) * s[:, None]) ** 2).sum(axis=1)


def _mx_exponent(x, drop, g=None, refine=False, no_clip=False):
    """The shared exponent of a block: that of its largest value less drop, or (no_clip) the least under which 6 holds it."""
    top = np.abs(x).max(axis=1)
    base = e8m0(top) - drop
    if no_clip:
        goal = top / f4(6)
        base = e8m0(goal)
        base = base + (e8m0_value(np.clip(base, 0, 254)) < goal)
    e = np.where((top > 0) & np.isfinite(top), np.clip(base, 0, 254), 0)
    if refine:
        w = np.ones(x.shape) if g is None else np.maximum(g, 1e-12)
        best = _mx_error(x, e8m0_value(e), w)
        start = e
        for step in (-1, 1):
            other = np.clip(start + step, 0, 254)
            err = _mx_error(x, e8m0_value(other), w)
            better = (err < best) & (top > 0)
            e, best = np.where(better, other, e), np.where(better, err, best)
    return e


def _mxfp4(x, g=None, refine=False, no_clip=False):
    e = _mx_exponent(x, 2, g, refine, no_clip)
    return e, encode_mini(x * _inverse(e8m0_value(e))[:, None], E2M1, "down")


def enc_mxfp4(x, g=None, refine=False, no_clip=False):
    e, q = _mxfp4(x, g, refine, no_clip)
    return _join(e[:, None], _nibbles(q.astype(np.int32)))


def dec_mxfp4(b):
    return decode_mini(_unnibbles(b[:, 1:]), E2M1) * e8m0_value(b[:, 0])[:, None]


def enc_mxfp4_ocp(x, g=None, refine=False, no_clip=False):
    e, q = _mxfp4(x, g, refine, no_clip)
    return _join(_adjacent(q.astype(np.int32)), e[:, None])


def dec_mxfp4_ocp(b):
    return decode_mini(_unadjacent(b[:, :16]), E2M1) * e8m0_value(b[:, 16])[:, None]


def enc_mxfp8(x, g=None):
    e = _mx_exponent(x, 8)
    return _join(encode_mini(x * _inverse(e8m0_value(e))[:, None], E4M3), e[:, None])


def dec_mxfp8(b):
    return decode_mini(b[:, :32], E4M3) * e8m0_value(b[:, 32])[:, None]


def enc_nvfp4_gguf(x, g=None):
    parts = _sub(x, 16)
    s = ue4m3(np.abs(parts).max(axis=1) / f4(6))
    inv = _inverse(ue4m3_value(s))
    q = encode_mini(parts * inv[:, None], E2M1, "down").astype(np.int32)
    return _join(s.reshape(len(x), 4), _nibbles(q).reshape(len(x), 32))


def dec_nvfp4_gguf(b):
    s = ue4m3_value(b[:, :4]).reshape(-1)
    q = _unnibbles(np.ascontiguousarray(b[:, 4:]).reshape(-1, 8))
    return (decode_mini(q, E2M1) * s[:, None]).reshape(len(b), 64)


def nvfp4(x: np.ndarray, scale: float, g=None, refine: bool = False) -> np.ndarray:
    """Rows of 16-value blocks under a tensor scale: eight bytes of codes and an E4M3 scale each."""
    b = x.reshape(-1, 16)
    code = encode_mini(np.abs(b).max(axis=1) / f4(6) / f4(scale), E4M3)
    if refine:
        w = np.ones(b.shape) if g is None else np.maximum(np.broadcast_to(g, x.shape).reshape(-1, 16), 1e-12)
        start, best = code.astype(np.int32), _mx_error(b, E4M3[code].astype(f4) * f4(scale), w)
        for step in (-3, -2, -1, 1, 2, 3):
            other = np.clip(start + step, 0, 0x7E)
            err = _mx_error(b, E4M3[other].astype(f4) * f4(scale), w)
            better = (err < best) & (np.abs(b).max(axis=1) > 0)
            code, best = np.where(better, other, code).astype(np.uint8), np.where(better, err, best)
    q = encode_mini(b * _inverse(E4M3[code].astype(f4) * f4(scale))[:, None], E2M1, "down").astype(np.int32)
    return _join(_adjacent(q), code[:, None]).reshape(len(x), -1)


def nvfp4_values(raw: np.ndarray, scale: float) -> np.ndarray:
    b = np.ascontiguousarray(raw).reshape(-1, 9)
    return (decode_mini(_unadjacent(b[:, :8]), E2M1) * (E4M3[np.minimum(b[:, 8], 0x7E)].astype(f4) * f4(scale))[:, None]).reshape(len(raw), -1)


def fp8(x: np.ndarray, scale: np.ndarray, name: str = "FP8_E4M3") -> np.ndarray:
    return encode_mini(x * _inverse(scale), E4M3 if name == "FP8_E4M3" else E5M2)


def fp8_values(raw: np.ndarray, scale: np.ndarray, name: str = "FP8_E4M3") -> np.ndarray:
    return decode_mini(raw, E4M3 if name == "FP8_E4M3" else E5M2) * scale


def enc_float(kind):
    def run(x, g=None):
        if kind == "BF16":
            bits = np.ascontiguousarray(x).view(np.uint32)
            bits = (bits + np.uint32(0x7FFF) + (bits >> np.uint32(16) & np.uint32(1))) >> np.uint32(16)
            return np.ascontiguousarray(bits.astype("<u2")).view(np.uint8).reshape(len(x), -1)
        return np.ascontiguousarray(x.astype("<f2" if kind == "F16" else "<f4")).view(np.uint8).reshape(len(x), -1)

    return run


def dec_float(kind):
    def run(b):
        if kind == "BF16":
            return (np.ascontiguousarray(b).view("<u2").astype(np.uint32) << np.uint32(16)).view(f4)
        return np.ascontiguousarray(b).view("<f2" if kind == "F16" else "<f4").astype(f4)

    return run


# ---- sixteen-level formats -------------------------------------------------------------------

#: Fixed levels of IQ4.
LEVELS = np.array([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113], f4)


def nearest_level(x: np.ndarray) -> np.ndarray:
    """Place of the nearest level; a tie goes up."""
    return np.searchsorted((LEVELS[1:] + LEVELS[:-1]) / 2, x, "right").astype(np.int32)


def _iq4_search(x, w):
    top = _signed_max(x)
    live = np.abs(top) >= EPS
    best, scale = np.full(len(x), f4(-1), f4), np.zeros(len(x), f4)
    for trial in (0, *range(-7, 0), *range(1, 8)):
        inv = _divide(f4(trial) + LEVELS[0], top)
        q = LEVELS[nearest_level(inv[:, None] * x)]
        lx, l2 = _sum(w * q * x), _sum(w * q * q)
        better = live & (l2 > 0) & (lx * lx > best * l2)
        s = _divide(lx, l2)
        scale[better], best[better] = s[better], (s * lx)[better]
    return np.where(live, scale, 0).astype(f4)


def _iq4_weights(x, g, n):
    if g is None:
        return x * x
    sigma = f4(2) * _sum(x * x) / f4(n)
    return (g * np.sqrt(sigma[:, None] + x * x)).astype(f4)


def enc_iq4_nl(x, g=None):
    d = _iq4_search(x, _iq4_weights(x, g, 32))
    q = nearest_level(x * _inverse(_f16(d))[:, None])
    return _join(_half(d), _nibbles(np.where((d != 0)[:, None], q, 0)))


def dec_iq4_nl(b):
    return LEVELS[_unnibbles(b[:, 2:])] * _unhalf(b[:, :2])[:, None]


def enc_iq4_xs(x, g=None):
    n = len(x)
    scale = _iq4_search(_sub(x, 32), _sub(_iq4_weights(x, g, 256), 32)).reshape(n, 8)
    d = (-_signed_max(scale) / f4(32)).astype(f4)
    ls = np.clip(np.rint(_inverse(d)[:, None] * scale), -32, 31).astype(np.int32)
    fine = np.repeat(_f16(d)[:, None] * ls, 32, axis=1)
    q = nearest_level(x * _inverse(fine)).reshape(-1, 32)
    u = ls + 32
    high = np.zeros(n, np.int32)
    for j in range(8):
        high |= u[:, j] >> 4 << 2 * j
    low = u[:, 0::2] & 15 | (u[:, 1::2] & 15) << 4
    return _join(_half(d), np.ascontiguousarray(high.astype("<u2")).view(np.uint8).reshape(n, 2), low, _nibbles(q).reshape(n, 128))


def dec_iq4_xs(b):
    n = len(b)
    high = np.ascontiguousarray(b[:, 2:4]).view("<u2").astype(np.int32)[:, 0]
    low = b[:, 4:8].astype(np.int32)
    u = np.stack([low & 15, low >> 4], axis=2).reshape(n, 8)
    for j in range(8):
        u[:, j] |= (high >> 2 * j & 3) << 4
    q = _unnibbles(np.ascontiguousarray(b[:, 8:]).reshape(-1, 16)).reshape(n, 256)
    return LEVELS[q] * np.repeat(_unhalf(b[:, :2])[:, None] * (u - 32), 32, axis=1)


# ---- dispatch --------------------------------------------------------------------------------

ENCODERS: dict[str, Callable] = {
    "Q1_0": enc_q1_0, "Q2_0": enc_q2_0, "Q4_0": enc_q4_0, "Q4_1": enc_q4_1, "Q5_0": enc_q5_0, "Q5_1": enc_q5_1, "Q8_0": enc_q8_0, "Q8_1": enc_q8_1,
    "Q2_K": enc_q2_k, "Q3_K": enc_q3_k, "Q4_K": enc_q4_k, "Q5_K": enc_q5_k, "Q6_K": enc_q6_k, "Q8_K": enc_q8_k, "IQ4_NL": enc_iq4_nl, "IQ4_XS": enc_iq4_xs,
    "TQ1_0": enc_tq1_0, "TQ2_0": enc_tq2_0, "MXFP4": enc_mxfp4, "MXFP4_OCP": enc_mxfp4_ocp, "MXFP8": enc_mxfp8, "NVFP4_GGUF": enc_nvfp4_gguf,
    **{k: enc_float(k) for k in ("F32", "F16", "BF16")},
}
DECODERS: dict[str, Callable] = {
    "Q1_0": dec_q1_0, "Q2_0": dec_q2_0, "Q4_0": dec_q4_0, "Q4_1": dec_q4_1, "Q5_0": dec_q5_0, "Q5_1": dec_q5_1, "Q8_0": lambda b: dec_q8(b, 2), "Q8_1": lambda b: dec_q8(b, 4),
    "Q2_K": dec_q2_k, "Q3_K": dec_q3_k, "Q4_K": dec_q4_k, "Q5_K": dec_q5_k, "Q6_K": dec_q6_k, "Q8_K": dec_q8_k, "IQ4_NL": dec_iq4_nl, "IQ4_XS": dec_iq4_xs,
    "TQ1_0": dec_tq1_0, "TQ2_0": dec_tq2_0, "MXFP4": dec_mxfp4, "MXFP4_OCP": dec_mxfp4_ocp, "MXFP8": dec_mxfp8, "NVFP4_GGUF": dec_nvfp4_gguf,
    **{k: dec_float(k) for k in ("F32", "F16", "BF16")},
}
NEEDS_IMPORTANCE = ("IQ2_XXS", "IQ2_XS", "IQ1_S")


def quantize(name: str, x: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """Rows of values as rows of bytes; g is one importance per column."""
    from quantaloom.functions import codebooks

    block, size = BLOCK[name]
    rows, cols = x.shape
    if cols == 0 or cols % block:
        raise ValueError(f"{name}: {cols} columns are not whole blocks of {block}")
    if g is None and name in NEEDS_IMPORTANCE:
        raise ValueError(f"{name} needs importances")
    x = np.ascontiguousarray(x, f4)
    if name in FP8[:2]:
        limit = (E4M3 if name == "FP8_E4M3" else E5M2)[-1]
        return fp8(x, np.maximum(np.abs(x).max(axis=1, keepdims=True) / f4(limit), np.finfo(f4).tiny), name)
    if name == "NVFP4":
        raise ValueError("NVFP4 needs a tensor scale: use nvfp4()")
    weights = None if g is None else np.tile(np.asarray(g, f4).reshape(cols // block, block) if block > 1 else np.ones((1, 1), f4), (rows, 1) if block > 1 else (1, 1))
    if block == 1:
        return ENCODERS[name](x)
    encode = ENCODERS.get(name) or codebooks.ENCODERS[name]
    return encode(x.reshape(-1, block), weights).reshape(rows, cols // block * size)


def dequantize(name: str, raw: np.ndarray, cols: int) -> np.ndarray:
    """Rows of bytes as rows of values; formats with scales beside them are refused."""
    from quantaloom.functions import codebooks

    block, size = BLOCK[name]
    if name in ("NVFP4", *FP8[:2]):
        raise ValueError(f"{name} needs its scales")
    if block == 1:
        return DECODERS[name](np.ascontiguousarray(raw)).reshape(len(raw), cols)
    decode = DECODERS.get(name) or codebooks.DECODERS[name]
    return decode(np.ascontiguousarray(raw).reshape(-1, size)).astype(f4).reshape(len(raw), cols)


def roundtrip(name: str, x: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    x = np.ascontiguousarray(x, f4)
    if name in FP8[:2]:
        limit = (E4M3 if name == "FP8_E4M3" else E5M2)[-1]
        scale = np.maximum(np.abs(x).max(axis=1, keepdims=True) / f4(limit), np.finfo(f4).tiny)
        return fp8_values(fp8(x, scale, name), scale, name)
    if name == "NVFP4":
        top = float(np.abs(x).max(initial=0))
        scale = top / (6 * 448) if 0 < top < np.inf else 1.0
        return nvfp4_values(nvfp4(x, scale, g), scale)
    return dequantize(name, quantize(name, x, g), x.shape[1])


KNOWN = frozenset(ID)
