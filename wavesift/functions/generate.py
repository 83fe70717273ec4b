"""Procedural probes, objects, noise and detectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wavesift.functions.arrays import ellipse, grids, rectangle
from wavesift.functions.propagate import fourier, inverse
from wavesift.functions.special import gaussian_filter


def smooth_noise(shape: tuple[int, int], rms: float = 1.0, mfs: float = 2.0, seed: int = 0, rms_mod: float | None = None, mfs_mod: float = 2.0) -> np.ndarray:
    """Complex noise of unit mean modulus: smooth phases of ``rms``, and moduli of ``rms_mod``."""
    rng = np.random.default_rng(seed)

    def field(r: float, m: float) -> np.ndarray:
        x = gaussian_filter(rng.standard_normal(shape), m / 2.35) if m else rng.standard_normal(shape)
        return x * (r / (x.std() or 1))

    phase = field(rms, mfs)
    amplitude = 1.0 if rms_mod is None else np.abs(1 + field(rms_mod, mfs_mod))
    return amplitude * np.exp(1j * phase)


def aperture(shape: tuple[int, int], form: str = "circ", size=None, edge: float = 2.0, offset=(0.0, 0.0), rotate: float = 0.0, central_stop: float | None = None, diffuser: tuple[float, float] | None = None, seed: int = 0) -> np.ndarray:
    """A soft circle or rectangle in pixels, moved and turned, with an optional stop and diffuser."""
    g = grids(shape) - np.array(offset).reshape(2, 1, 1)
    c, s = np.cos(np.deg2rad(rotate)), np.sin(np.deg2rad(rotate))
    g = np.stack([c * g[0] + s * g[1], c * g[1] - s * g[0]])
    dims = np.array(shape) / 2 if size is None else size
    mask = {"circ": ellipse, "rect": rectangle}[form]
    a = mask(g, dims, edge)
    if central_stop:
        a = a * (1 - mask(g, np.array(dims) * central_stop, edge))
    return a * smooth_noise(shape, *diffuser, seed=seed) if diffuser else a.astype(complex)


def illumination(shape: tuple[int, int], photons: float = 1e8, defocus: float = 0.02, **pars) -> np.ndarray:
    """An aperture carried to the focus and a little beyond, scaled to a number of photons."""
    a = inverse(aperture(shape, **pars) * np.exp(1j * defocus * (grids(shape) ** 2).sum(axis=0)))
    return a * np.sqrt(photons / (np.abs(a) ** 2).sum())


def moon(n: int, photons: float = 1e8) -> np.ndarray:
    """A crescent-shaped probe with a curved phase."""
    g = grids((n, n))
    disc = ellipse(g, (n * 0.55, n * 0.55), n / 12)
    cut = ellipse(g - np.array([0, n * 0.16]).reshape(2, 1, 1), (n * 0.4, n * 0.4), n / 12)
    a = disc * (1 - 0.7 * cut) * np.exp(1j * 3 * (g**2).sum(axis=0) / (n / 2) ** 2)
    return a * np.sqrt(photons / (np.abs(a) ** 2).sum())


def flower(shape: tuple[int, int], petals: int = 7) -> np.ndarray:
    """A flower-shaped transmission: petals in modulus and phase, with fine rings."""
    g = grids(shape)
    r, phi = np.hypot(*g) / (min(shape) / 2), np.arctan2(g[0], g[1])
    wave = np.cos(petals * phi + 4 * r) * np.exp(-((r - 0.5) ** 2) / 0.15) + 0.4 * np.cos(25 * r)
    return (0.75 + 0.2 * wave) * np.exp(1j * 0.8 * np.sin(3 * wave + 2 * phi))


def tree(shape: tuple[int, int], depth: int = 6) -> np.ndarray:
    """A branching phase object."""
    out = np.zeros(shape)
    h, w = shape
    stack = [(h - 1.0, w / 2, -np.pi / 2, h / 3.2, depth)]
    while stack:
        y, x, a, length, d = stack.pop()
        k = np.linspace(0, 1, int(length * 2) + 2)
        yy, xx = (y + k * length * np.sin(a)).astype(int), (x + k * length * np.cos(a)).astype(int)
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        out[yy[ok], xx[ok]] = d / depth
        if d > 1:
            stack += [(y + length * np.sin(a), x + length * np.cos(a), a + t, length * 0.7, d - 1) for t in (-0.5, 0.45)]
    return np.exp(1j * gaussian_filter(out, 1.0))


def star(shape: tuple[int, int], spokes: int = 48, rings: int = 4, contrast: float = 1.0, edge: float = 0.5) -> np.ndarray:
    """A Siemens star with gaps between its rings."""
    g = grids(shape)
    r, phi = np.hypot(*g) / (min(shape) / 2), np.arctan2(g[0], g[1])
    a = (np.cos(spokes * phi) > 0) & (r < 0.95)
    gap = np.zeros(shape, bool)
    for k in range(1, rings + 1):
        gap |= np.abs(r - 0.95 * 2.0 ** (k - rings)) < 0.03 * 2.0 ** (k - rings)
    return gaussian_filter(contrast * (a & ~gap).astype(float), edge)


def transmission(thickness: np.ndarray, delta: float, beta: float, wavelength: float, fill: float = 1.0) -> np.ndarray:
    """exp(i k n d) of a thickness map and the refractive index 1 - delta + i beta."""
    k = 2 * np.pi / wavelength
    return fill * np.exp(-1j * k * delta * thickness - k * beta * thickness)


def init_object(shape: tuple[int, int], model: str = "fill", fill: complex = 1.0, noise: tuple[float, float] | None = None, seed: int = 0) -> np.ndarray:
    """A starting object: constant, flower, tree or star, with optional smooth noise."""
    base = {"fill": lambda: np.full(shape, fill, complex), "flower": lambda: flower(shape), "tree": lambda: tree(shape), "star": lambda: np.exp(1j * star(shape))}[model]()
    return base * smooth_noise(shape, *noise, seed=seed) if noise else base


@dataclass(frozen=True)
class Detector:
    """Blur, quantum efficiency, photon noise, saturation, gain and bit depth."""

    psf: float = 0.0
    quantum_efficiency: float = 1.0
    shot_noise: bool = True
    full_well: float = 2.0**32 - 1
    electrons_per_count: float = 1.0
    read_noise: float = 0.0
    dark: float = 0.0
    dtype: str = "uint32"
    beam_stop: float = 0.0

    def filter(self, intensity: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(counts, mask) of a stack of images; saturated pixels are masked."""
        rng = np.random.default_rng(seed)
        x = gaussian_filter(intensity, (self.psf, self.psf)) if self.psf else np.asarray(intensity, float)
        x = np.maximum(x, 0) * self.quantum_efficiency
        if self.shot_noise:
            x = rng.poisson(x).astype(float)
        if self.dark:
            x = x + rng.poisson(self.dark, x.shape)
        mask = x < self.full_well
        x = np.minimum(x, self.full_well)
        if self.read_noise:
            x = x + rng.normal(0, self.read_noise, x.shape)
        top = np.iinfo(self.dtype).max
        counts = np.clip(np.floor(x / self.electrons_per_count), 0, top)
        if self.beam_stop:
            mask = mask & (np.hypot(*grids(x.shape[-2:])) >= self.beam_stop)
        return counts.astype(self.dtype), mask


#: Detector models by name.
DETECTORS = {
    "generic_32bit": Detector(),
    "generic_16bit": Detector(full_well=2.0**16 - 1, dtype="uint16"),
    "photon_counter": Detector(full_well=2.0**20 - 1, quantum_efficiency=0.95),
    "ccd": Detector(psf=0.8, full_well=1e5, electrons_per_count=1.5, read_noise=3.0, dark=0.5, dtype="uint16"),
}


def diffraction(probe: np.ndarray, patch: np.ndarray) -> np.ndarray:
    """Far-field intensity of probe times object patch; modes add incoherently."""
    return (np.abs(fourier(probe * patch)) ** 2).reshape(-1, *patch.shape[-2:]).sum(axis=0)
