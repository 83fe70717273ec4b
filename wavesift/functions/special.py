"""NumPy stand-ins for the numerical functions that operators need: erf, lgamma, Gaussian filter, shifts, zoom, deconvolution."""

from __future__ import annotations

import math

import numpy as np

erf = np.vectorize(math.erf, otypes=[float])
lgamma = np.vectorize(math.lgamma, otypes=[float])


def smooth_step(x: np.ndarray, mfs: float) -> np.ndarray:
    """A step from 0 to 1 of width ``mfs``; sharp where that is 0."""
    return 0.5 * erf(2.35 * np.asarray(x, float) / mfs) + 0.5 if mfs else (np.asarray(x) > 0).astype(float)


def gaussian(x, std: float = 1.0, off: float = 0.0):
    return np.exp(-((np.asarray(x, float) - off) ** 2) / (2 * std**2)) / (std * math.sqrt(2 * math.pi))


def gauss_fwhm(x, fwhm: float = 1.0, off: float = 0.0):
    return gaussian(x, fwhm / (2 * math.sqrt(2 * math.log(2))), off)


def gaussian_2d(size: int, std_y: float = 1.0, std_x: float = 1.0, off_y: float = 0.0, off_x: float = 0.0) -> np.ndarray:
    """Normalised density on a centred grid."""
    k = np.arange(size) - size // 2
    g = np.outer(gaussian(k, std_y, off_y), gaussian(k, std_x, off_x))
    return g / g.sum()


def _taps(sigma: float) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    t = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return t / t.sum()


def gaussian_filter(a: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    """Separable Gaussian along the last axes, reflected at the edges; complex arrays, too."""
    sigmas = (sigma,) * a.ndim if np.isscalar(sigma) else tuple(sigma)
    out = a.astype(complex if np.iscomplexobj(a) else float)
    for axis, s in zip(range(a.ndim - len(sigmas), a.ndim), sigmas, strict=True):
        if s:
            taps, n = _taps(s), int(4 * s + 0.5)
            moved = np.moveaxis(out, axis, -1)
            padded = np.pad(moved, [(0, 0)] * (a.ndim - 1) + [(n, n)], mode="symmetric")
            windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * n + 1, axis=-1)
            out = np.moveaxis(windows @ taps, -1, axis)
    return out


def gaussian_filter_fft(a: np.ndarray, sigma: float) -> np.ndarray:
    """Periodic Gaussian filter of the last two axes in Fourier space."""
    fy, fx = (np.fft.fftfreq(n) for n in a.shape[-2:])
    k = np.exp(-2 * (math.pi * sigma) ** 2 * (fy[:, None] ** 2 + fx[None, :] ** 2))
    out = np.fft.ifft2(np.fft.fft2(a) * k)
    return out if np.iscomplexobj(a) else out.real


def fft_filter(a: np.ndarray, kernel: np.ndarray, pre=None, post=None) -> np.ndarray:
    x = a if pre is None else a * pre
    out = np.fft.ifft2(np.fft.fft2(x) * kernel)
    return out if post is None else out * post


def shift_subpixel(a: np.ndarray, shift: tuple[float, float], linear: bool = False) -> np.ndarray:
    """Last two axes moved by fractions of a pixel: bilinear with zeros outside, or by a Fourier ramp."""
    if not linear:
        fy, fx = (np.fft.fftfreq(n) for n in a.shape[-2:])
        out = np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fy[:, None] * shift[0] + fx[None, :] * shift[1])))
        return out if np.iscomplexobj(a) else out.real
    out = a
    for axis, s in ((-2, shift[0]), (-1, shift[1])):
        whole = math.floor(s)
        out = (1 - (s - whole)) * _moved(out, whole, axis) + (s - whole) * _moved(out, whole + 1, axis)
    return out


def _moved(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    out = np.zeros_like(a)
    size = a.shape[axis]
    if abs(n) < size:
        src, dst = [slice(None)] * a.ndim, [slice(None)] * a.ndim
        src[axis], dst[axis] = (slice(0, size - n), slice(n, size)) if n >= 0 else (slice(-n, size), slice(0, size + n))
        out[tuple(dst)] = a[tuple(src)]
    return out


def shift_zoom(a: np.ndarray, zoom: tuple[float, float], cen_old: tuple[float, float], cen_new: tuple[float, float]) -> np.ndarray:
    """Bilinear resampling: what was at cen_old is at cen_new, scaled by ``zoom``."""
    out = a
    for axis, z, old, new in zip((-2, -1), zoom, cen_old, cen_new, strict=True):
        n = out.shape[axis]
        at = (np.arange(n) - new) / z + old
        lo = np.floor(at).astype(int)
        f = at - lo
        shape = [1] * out.ndim
        shape[axis] = n
        parts = 0
        for k, w in ((lo, 1 - f), (lo + 1, f)):
            ok = (k >= 0) & (k < n)
            parts = parts + np.take(out, np.clip(k, 0, n - 1), axis=axis) * (w * ok).reshape(shape)
        out = parts
    return out


def richardson_lucy(data: np.ndarray, mtf: np.ndarray, steps: int) -> np.ndarray:
    """Deconvolution: u *= conv(data / (conv(u) + 1e-6)), ``steps`` times."""
    conv = lambda x: np.abs(np.fft.ifft2(np.fft.fft2(x) * mtf))
    u = conv(data)
    for _ in range(steps):
        u = u * conv(data / (conv(u) + 1e-6))
    return u


def phase_from_dpc(dpc_row: np.ndarray, dpc_col: np.ndarray) -> np.ndarray:
    """Phase from its two gradients by Fourier integration on a mirrored field."""
    def mirrored(a: np.ndarray, sign_r: int, sign_c: int) -> np.ndarray:
        top = np.concatenate([a, sign_c * a[..., ::-1]], axis=-1)
        return np.concatenate([top, sign_r * top[..., ::-1, :]], axis=-2)

    gr, gc = mirrored(dpc_row, -1, 1), mirrored(dpc_col, 1, -1)
    qr, qc = (2j * np.pi * np.fft.fftfreq(n) for n in gr.shape[-2:])
    den = np.abs(qr[:, None]) ** 2 + np.abs(qc[None, :]) ** 2
    den[0, 0] = 1
    num = np.conj(qr)[:, None] * np.fft.fft2(gr) + np.conj(qc)[None, :] * np.fft.fft2(gc)
    num[..., 0, 0] = 0
    return np.fft.ifft2(num / den).real[..., : dpc_row.shape[-2], : dpc_row.shape[-1]]


def ortho(modes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(relative powers, orthogonal modes), strongest first."""
    flat = modes.reshape(len(modes), -1)
    values, vectors = np.linalg.eigh(flat.conj() @ flat.T)
    order = np.argsort(values)[::-1]
    out = (vectors[:, order].T @ flat).reshape(modes.shape)
    power = (np.abs(out) ** 2).reshape(len(modes), -1).sum(axis=1)
    return power / power.sum(), out
