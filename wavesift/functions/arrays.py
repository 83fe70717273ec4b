"""Array helpers for image blocks: grids, masks, cropping, padding, binning."""

from __future__ import annotations

import numpy as np

from wavesift.functions.special import smooth_step


def expect(a, n: int) -> tuple:
    """A scalar or a sequence as an n-vector."""
    if np.isscalar(a):
        return (a,) * n
    a = tuple(a)
    if len(a) == 1:
        return a * n
    if len(a) < n:
        raise ValueError(f"{len(a)} values where {n} are expected")
    return a[:n]


def center_pixel(shape: tuple[int, ...], center) -> np.ndarray:
    """'fftshift': n // 2, 'geometric': n / 2 - 1/2, 'fft': 0, else the pixel modulo the shape."""
    sh = np.array(shape, float)
    if center == "fftshift":
        return sh // 2
    if center == "geometric":
        return sh / 2 - 0.5
    if center == "fft":
        return sh * 0
    return np.asarray(expect(center, len(shape)), float) % sh


def grids(shape: tuple[int, ...], psize=None, center="geometric", fft_like: bool = True) -> np.ndarray:
    """Coordinates along each axis from the centre, wrapped to [-n/2, n/2) where ``fft_like``, in units of ``psize``."""
    c = center_pixel(shape, center)
    g = np.indices(shape).astype(float) - c.reshape(-1, *(1,) * len(shape))
    if fft_like and center == "fft":
        n = np.array(shape).reshape(-1, *(1,) * len(shape))
        g = (g + n // 2) % n - n // 2
    return g if psize is None else g * np.array(expect(psize, len(shape))).reshape(-1, *(1,) * len(shape))


def rectangle(g: np.ndarray, dims=None, edge: float = 2.0) -> np.ndarray:
    """A rectangle of ``dims`` (half the field) with soft edges."""
    v, h = expect(dims, 2) if dims is not None else tuple(n / 2 for n in g.shape[-2:])
    return smooth_step(-np.abs(g[0]) + v / 2, edge) * smooth_step(-np.abs(g[1]) + h / 2, edge)


def ellipse(g: np.ndarray, dims=None, edge: float = 2.0) -> np.ndarray:
    v, h = expect(dims, 2) if dims is not None else tuple(n / 2 for n in g.shape[-2:])
    return smooth_step(0.5 - np.sqrt(g[0] ** 2 / v**2 + g[1] ** 2 / h**2), edge / np.sqrt(v * h))


def crop_pad(a: np.ndarray, planes, axes=None, fill=0.0, how: str = "scalar") -> np.ndarray:
    """Crop (negative) or pad (positive) either end of the last axes; fill: scalar, mirror, periodic, project."""
    planes = np.atleast_2d(planes).astype(int)
    axes = range(a.ndim - len(planes), a.ndim) if axes is None else axes
    mode = {"scalar": "constant", "mirror": "symmetric", "periodic": "wrap", "project": "edge"}[how]
    for axis, (lo, hi) in zip(axes, planes, strict=True):
        n = a.shape[axis]
        a = np.take(a, np.arange(max(0, -lo), n - max(0, -hi)), axis=axis)
        width = [(0, 0)] * a.ndim
        width[axis] = (max(0, lo), max(0, hi))
        a = np.pad(a, width, mode=mode, **({"constant_values": fill} if mode == "constant" else {}))
    return a


def crop_pad_symmetric(a: np.ndarray, shape: tuple[int, int], center=None) -> tuple[np.ndarray, np.ndarray]:
    """Last two axes cropped or padded to ``shape`` about ``center``; and where that pixel went."""
    old, new = np.array(a.shape[-2:]), np.array(shape[-2:])
    c = old // 2 if center is None else np.round(center).astype(int)
    low, high = new // 2 - c, c - old + (new + 1) // 2
    return crop_pad(a, np.stack([low, high], axis=1)), c + low


def paste(a: np.ndarray, b: np.ndarray, offset=None) -> np.ndarray:
    """A copy of ``a`` with ``b`` laid over it at ``offset`` (of any sign); what falls outside is cut off."""
    if a.ndim != b.ndim:
        raise ValueError(f"{b.ndim} axes do not fit on {a.ndim}")
    to, of = [], []
    for n, m, o in zip(a.shape, b.shape, [0] * a.ndim if offset is None else offset, strict=True):
        low, high = max(o, 0), max(min(o + m, n), max(o, 0))
        to.append(slice(low, high))
        of.append(slice(low - o, high - o))
    out = a.copy()
    out[tuple(to)] = b[tuple(of)]
    return out


def orient(a: np.ndarray, orientation: int, center=None):
    """Bit 4 transposes the last two axes, bit 2 flips up-down, bit 1 left-right; the centre moves along."""
    c = None if center is None else list(center)
    if orientation & 4:
        a = np.swapaxes(a, -1, -2)
        c = c and c[::-1]
    if orientation & 2:
        a = a[..., ::-1, :]
        c = c and [a.shape[-2] - 1 - c[0], c[1]]
    if orientation & 1:
        a = a[..., ::-1]
        c = c and [c[0], a.shape[-1] - 1 - c[1]]
    return a if center is None else (a, np.array(c))


def rebin(a: np.ndarray, k: int) -> np.ndarray:
    """Mean over k by k blocks of the last two axes."""
    h, w = a.shape[-2:]
    if h % k or w % k:
        raise ValueError(f"{(h, w)} cannot be binned by {k}")
    return a.reshape(*a.shape[:-2], h // k, k, w // k, k).mean(axis=(-3, -1))


def mass_center(a: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Centroid over the last two axes."""
    w = a if mask is None else a * mask
    g = np.indices(a.shape[-2:])
    return np.array([(w * x).sum() for x in g]) / w.sum()


def diversify(modes: np.ndarray, noise: float | None = None, power: float = 0.1, seed: int = 0) -> np.ndarray:
    """Higher modes scaled to ``power`` of the first, with seeded complex noise."""
    out, rng = modes.astype(complex).copy(), np.random.default_rng(seed)
    for k in range(1, len(out)):
        if noise:
            out[k] = out[0] * (1 + noise * (rng.standard_normal(out[0].shape) + 1j * rng.standard_normal(out[0].shape)))
        out[k] *= np.sqrt(power / (k if k else 1))
    return out / np.sqrt((np.abs(out) ** 2).sum() / (np.abs(modes) ** 2).sum())
