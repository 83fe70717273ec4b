"""Per-frame kernels. Arrays are (modes, n, n); intensities and masks (n, n)."""

from __future__ import annotations

import numpy as np

from wavesift.functions.propagate import fourier, inverse
from wavesift.functions.special import lgamma


def abs2(a: np.ndarray) -> np.ndarray:
    return a.real**2 + a.imag**2


def pairs(probe, patch):
    """Waves of every probe mode with every object mode, those of one probe mode side by side: (probe modes * object modes, n, n)."""
    return (probe[:, None] * patch[None]).reshape(-1, *np.broadcast_shapes(probe.shape[1:], patch.shape[1:]))


def object_sum(probe, waves, modes: int):
    """conj(P) psi summed over the probe modes, for each object mode."""
    return (np.conj(probe)[:, None] * waves.reshape(len(probe), modes, *waves.shape[1:])).sum(axis=0)


def probe_sum(patch, waves, modes: int):
    """conj(O) psi summed over the object modes, for each probe mode."""
    return (np.conj(patch)[None] * waves.reshape(modes, len(patch), *waves.shape[1:])).sum(axis=1)


def projection(psi, probe, patch, intensity, mask, a: float, b: float, c: float, pbound: float | None = None, fw=fourier, bw=inverse):
    """[x + a O + b F (c O + y)] psi with x = 1 - a - b, y = 1 - c. Returns (psi, err_fourier, err_exit).

    Within the power bound the Fourier constraint holds already, and the
    update takes no second transform.
    """
    po = pairs(probe, patch)
    f = fw((1 - c) * psi + c * po)
    model = np.sqrt(abs2(f).sum(axis=0))
    measured = np.sqrt(np.abs(intensity))
    off = model - measured
    err = (mask * off**2).sum() / max(mask.sum(), 1)
    if pbound is None or err > pbound:
        keep = 0.0 if pbound is None else np.sqrt(pbound / err)
        scale = 1 - mask + mask * (measured + off * keep) / (model + 1e-10)
        change = b * bw(scale * f) + a * po - (a + b) * psi
    else:
        change = (a + b * c) * (po - psi)
    return psi + change, float(err), float(abs2(change).mean(axis=(-2, -1)).sum())


def log_likelihood(probe, patch, intensity, mask, fw=fourier) -> float:
    model = abs2(fw(pairs(probe, patch))).sum(axis=0)
    return float((mask * (model - intensity) ** 2 / (intensity + 1)).sum() / intensity.size)


def step_update(target, other, change, a: float, b: float, power=None):
    """target += (a + b) conj(other) change / ((1 - a) max |other|^2 + a |other|^2), modes summed where shared."""
    own = abs2(other).sum(axis=0) if power is None else power
    norm = (1 - a) * own.max() + a * own
    return target + ((a + b) * np.conj(other) * change / norm).sum(axis=0, keepdims=target.shape[0] == 1)


def gradients(model: str, probe, patch, intensity, mask, float_intensity: bool = False, fw=fourier, bw=inverse):
    """(object gradient, probe gradient, cost) of one frame under a noise model; gradients are by mode."""
    f = fw(pairs(probe, patch))
    im = abs2(f).sum(axis=0)
    w = mask / (intensity + 1)
    if float_intensity and model != "poisson":
        im = im * ((w * im * intensity).sum() / max((w * im * im).sum(), 1e-30))
    if model == "gaussian":
        d = im - intensity
        cost, g = (w * d * d).sum(), w * d
    elif model == "poisson":
        im = im + 1e-6
        g = mask * (1 - intensity / im)
        cost = (mask * (im - intensity * np.log(im) + lgamma(intensity + 1))).sum()
    elif model == "euclid":
        amp, meas = np.sqrt(im) + 1e-10, np.sqrt(intensity)
        cost, g = (mask * (amp - meas) ** 2).sum(), mask * (1 - meas / amp)
    else:
        raise ValueError(f"no noise model {model!r}")
    x = bw(g * f)
    return 2.0 * object_sum(probe, x, len(patch)), 2.0 * probe_sum(patch, x, len(probe)), float(cost)


def line_coefficients(model: str, probe, patch, probe_h, patch_h, intensity, mask, fw=fourier) -> np.ndarray:
    """b0, b1, b2 of the cost along (probe + t probe_h, patch + t patch_h), to second order."""
    f = fw(pairs(probe, patch))
    g = fw(pairs(probe, patch_h) + pairs(probe_h, patch))
    h = fw(pairs(probe_h, patch_h))
    a0 = abs2(f).sum(axis=0)
    a1 = 2 * (f * np.conj(g)).real.sum(axis=0)
    a2 = (2 * (f * np.conj(h)).real + abs2(g)).sum(axis=0)
    if model == "gaussian":
        w, d = mask / (intensity + 1), a0 - intensity
        return np.array([(w * d * d).sum(), (2 * w * d * a1).sum(), (w * (a1 * a1 + 2 * d * a2)).sum()])
    if model == "poisson":
        a0 = a0 + 1e-6
        ratio = intensity / a0
        return np.array([(mask * (a0 - intensity * np.log(a0))).sum(), (mask * a1 * (1 - ratio)).sum(), (mask * (a2 * (1 - ratio) + 0.5 * ratio * a1 * a1 / a0)).sum()])
    amp, meas = np.sqrt(a0) + 1e-10, np.sqrt(intensity)
    return np.array([(mask * (amp - meas) ** 2).sum(), (mask * (1 - meas / amp) * a1).sum(), (mask * ((1 - meas / amp) * a2 + 0.25 * meas * a1 * a1 / amp**3)).sum()])


def cost_series(model: str, a0, intensity, mask) -> list[np.ndarray]:
    """Factors of 1, d, d^2, ... of a noise model's cost where the model intensity is a0 + d.

    Gaussian: exact. Poisson: to second order of the logarithm. Euclid: the square
    of the amplitude's second-order expansion.
    """
    if model == "gaussian":
        w = mask / (intensity + 1)
        return [w * (a0 - intensity) ** 2, 2 * w * (a0 - intensity), w]
    if model == "poisson":
        a0 = a0 + 1e-6
        return [mask * (a0 - intensity * np.log(a0)), mask * (1 - intensity / a0), mask * 0.5 * intensity / a0**2]
    if model == "euclid":
        amp, meas = np.sqrt(a0) + 1e-10, np.sqrt(intensity)
        return [mask * (amp - meas) ** 2, mask * (1 - meas / amp), mask * 0.25 * meas / amp**3, -mask / (8 * amp**4), mask / (64 * amp**6)]
    raise ValueError(f"no noise model {model!r}")


def line_coefficients_all(model: str, probe, patch, probe_h, patch_h, intensity, mask, fw=fourier) -> np.ndarray:
    """b0..b8 of the cost's series along the line; exact for the Gaussian model."""
    f, g, h = fw(pairs(probe, patch)), fw(pairs(probe, patch_h) + pairs(probe_h, patch)), fw(pairs(probe_h, patch_h))
    re = lambda x, y: (x * np.conj(y)).real.sum(axis=0)
    a0, d = re(f, f), [2 * re(f, g), re(g, g) + 2 * re(f, h), 2 * re(g, h), re(h, h)]
    out, power = np.zeros(9), {0: np.ones_like(a0)}
    for factor in cost_series(model, a0, intensity, mask):
        for k, x in power.items():
            out[k] += (factor * x).sum()
        grown: dict[int, np.ndarray] = {}
        for k, x in power.items():
            for j, y in enumerate(d, 1):
                if k + j <= 8:
                    grown[k + j] = grown.get(k + j, 0) + x * y
        power = grown
    return out


def fourier_metric(probe, patch, intensity, mask, fw=fourier) -> float:
    model = np.sqrt(abs2(fw(pairs(probe, patch))).sum(axis=0))
    return float((mask * (model - np.sqrt(intensity)) ** 2).sum() / max(mask.sum(), 1))


def best_shift(probe, obj, r: int, c: int, shifts, intensity, mask, metric=fourier_metric) -> tuple[int, int, float, float]:
    """The first of the integer shifts with the strictly least error: (dr, dc, error, error where it was)."""
    n = probe.shape[-1]
    here = metric(probe, obj[:, r : r + n, c : c + n], intensity, mask)
    best = (0, 0, here)
    for dr, dc in shifts:
        y, x = r + dr, c + dc
        if 0 <= y <= obj.shape[-2] - n and 0 <= x <= obj.shape[-1] - n:
            e = metric(probe, obj[:, y : y + n, x : x + n], intensity, mask)
            if e < best[2]:
                best = (dr, dc, e)
    return (*best, here)


def grid_shifts(reach: int) -> list[tuple[int, int]]:
    """All integer shifts within a disc, nearest first."""
    own = [(y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if 0 < y * y + x * x <= reach * reach]
    return sorted(own, key=lambda s: (s[0] ** 2 + s[1] ** 2, s))


def random_shifts(n: int, amplitude: float, reach: float, seed: int) -> list[tuple[int, int]]:
    """``n`` random integer shifts, one quadrant after another; those beyond ``reach`` are zero."""
    rng = np.random.default_rng(seed)
    signs = ((1, 1), (-1, -1), (1, -1), (-1, 1))
    own = []
    for k in range(n):
        y, x = (int(s * v) for s, v in zip(signs[k % 4], rng.integers(0, max(1, int(amplitude)) + 1, 2), strict=True))
        own.append((y, x) if y * y + x * x <= reach * reach else (0, 0))
    return own


def multislice(probe, slices, fw_between, intensity, mask, alpha: float = 1.0, beta: float = 1.0, fw=fourier, bw=inverse, bw_between=None):
    """One ePIE step through object slices: (probe, slices, error, light on each slice). Slices are updated from the last to the first."""
    waves, exits = [probe], []
    for k, s in enumerate(slices):
        exits.append(waves[-1] * s)
        if k < len(slices) - 1:
            waves.append(fw_between(exits[-1]))
    f = fw(exits[-1])
    model = np.sqrt(abs2(f).sum(axis=0))
    scale = 1 - mask + mask * np.sqrt(intensity) / (model + 1e-10)
    err = float((mask * (model - np.sqrt(intensity)) ** 2).sum() / max(mask.sum(), 1))
    target, out, lights = bw(scale * f), list(slices), [abs2(w).sum(axis=0) for w in waves]
    for k in range(len(slices) - 1, -1, -1):
        change = target - exits[k]
        wave = waves[k]
        out[k] = slices[k] + alpha * (np.conj(wave) * change).sum(axis=0) / abs2(wave).sum(axis=0).max()
        wave = wave + beta * np.conj(slices[k]) * change / abs2(slices[k]).max()
        if k:
            target = bw_between(wave)
    return wave, out, err, lights
