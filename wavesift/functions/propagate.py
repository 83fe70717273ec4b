"""Geometries and propagators."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from wavesift.functions.arrays import expect, grids
from wavesift.functions.units import kev_to_m


@dataclass(frozen=True)
class Geometry:
    """An experiment: energy [keV], distance [m], detector pixel, sample resolution, shape; far or near field.

    ``resolved`` fills in whichever of psize and resolution is missing: in the far
    field their product is wavelength x distance / shape, in the near field they
    are equal. Where both are given, ``misfit`` says how far they are apart.
    """

    energy: float = 6.2
    distance: float = 7.0
    shape: tuple[int, int] = (64, 64)
    psize: float | None = 172e-6
    resolution: float | None = None
    propagation: str = "farfield"
    resample: int = 1

    @property
    def wavelength(self) -> float:
        return kev_to_m(self.energy)

    def resolved(self) -> Geometry:
        if self.propagation == "nearfield":
            own = self.resolution or self.psize
            return replace(self, psize=own, resolution=own)
        lz = self.wavelength * self.distance / self.shape[0]
        if self.psize and not self.resolution:
            return replace(self, resolution=lz / self.psize)
        if self.resolution and not self.psize:
            return replace(self, psize=lz / self.resolution)
        return self

    @property
    def misfit(self) -> float:
        if not (self.psize and self.resolution) or self.propagation == "nearfield":
            return 0.0
        return self.wavelength * self.distance / (self.psize * self.resolution) - self.shape[0]

    def upsample(self, a: np.ndarray) -> np.ndarray:
        """Nearest neighbour, power kept."""
        k = self.resample
        return a if k == 1 else np.repeat(np.repeat(a, k, -1), k, -2) / k**2

    def downsample(self, a: np.ndarray) -> np.ndarray:
        """Block means."""
        from wavesift.functions.arrays import rebin

        return a if self.resample == 1 else rebin(a, self.resample)

    def propagator(self):
        g = self.resolved()
        return (NearField if g.propagation == "nearfield" else FarField)(g)


class FarField:
    """One FFT with the phases of the sample and detector planes."""

    def __init__(self, g: Geometry, phases: bool = True):
        sh, lz = g.shape, g.wavelength * g.distance
        sample, detector = (grids(sh, p, "fftshift", False) for p in (g.resolution, g.psize))
        self.pre = np.exp(1j * np.pi * (sample**2).sum(axis=0) / lz) if phases else 1.0
        self.post = np.exp(1j * np.pi * (detector**2).sum(axis=0) / lz) if phases else 1.0

    def fw(self, w: np.ndarray) -> np.ndarray:
        return self.post * fourier(self.pre * w)

    def bw(self, w: np.ndarray) -> np.ndarray:
        return np.conj(self.pre) * inverse(np.conj(self.post) * w)


class NearField:
    """Angular spectrum: two FFTs and a kernel."""

    def __init__(self, g: Geometry):
        f = np.meshgrid(*(np.fft.fftfreq(n, p) for n, p in zip(g.shape, expect(g.psize, 2), strict=True)), indexing="ij")
        a2 = (g.wavelength * f[0]) ** 2 + (g.wavelength * f[1]) ** 2
        self.kernel = np.exp(2j * np.pi * g.distance / g.wavelength * (np.sqrt(np.maximum(1 - a2, 0)) - 1))

    def fw(self, w: np.ndarray) -> np.ndarray:
        return np.fft.ifft2(np.fft.fft2(w) * self.kernel)

    def bw(self, w: np.ndarray) -> np.ndarray:
        return np.fft.ifft2(np.fft.fft2(w) * np.conj(self.kernel))


def fourier(w: np.ndarray) -> np.ndarray:
    """Centred orthonormal FFT of the last two axes."""
    return np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(w, axes=(-2, -1)), norm="ortho"), axes=(-2, -1))


def inverse(w: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(w, axes=(-2, -1)), norm="ortho"), axes=(-2, -1))


@dataclass(frozen=True)
class BraggGeometry:
    """Three-dimensional Bragg geometry: rocking steps of ``r3`` degrees about ``theta``."""

    energy: float = 15.0
    distance: float = 1.0
    psize: tuple[float, float, float] = (0.01, 55e-6, 55e-6)  # degrees, m, m
    shape: tuple[int, int, int] = (32, 64, 64)
    theta: float = 15.0

    @property
    def steps(self) -> tuple[float, float, float]:
        """dq3, dq1, dq2 in 1/m."""
        k = 2 * np.pi / kev_to_m(self.energy)
        d3 = np.deg2rad(self.psize[0]) * 2 * k * np.sin(np.deg2rad(self.theta))
        return float(d3), float(self.psize[1] * k / self.distance), float(self.psize[2] * k / self.distance)

    @property
    def resolution(self) -> tuple[float, float, float]:
        """dr3, dr1, dr2 in m."""
        d3, d1, d2 = self.steps
        t, n = np.deg2rad(self.theta), self.shape
        return float(2 * np.pi / (d3 * n[0] * np.cos(t))), float(2 * np.pi / (d1 * n[1] * np.cos(t))), float(2 * np.pi / (d2 * n[2]))

    def cartesian(self, r: np.ndarray, real: bool = True) -> np.ndarray:
        """Natural coordinates (3, ...) to cartesian ones (x, z, y)."""
        c, s = np.cos(np.deg2rad(self.theta)), np.sin(np.deg2rad(self.theta))
        if real:
            return np.stack([r[0] * c, r[1] + r[0] * s, r[2]])
        return np.stack([r[0] - r[1] * s, r[1] * c, r[2]])

    def natural(self, x: np.ndarray, real: bool = True) -> np.ndarray:
        c, s = np.cos(np.deg2rad(self.theta)), np.sin(np.deg2rad(self.theta))
        if real:
            r3 = x[0] / c
            return np.stack([r3, x[1] - r3 * s, x[2]])
        q1 = x[1] / c
        return np.stack([x[0] + q1 * s, q1, x[2]])

    def shear(self, a: np.ndarray, inverse_: bool = False) -> np.ndarray:
        """A natural volume on cartesian pixels: each plane along the first axis rolled along the second."""
        s = np.sin(np.deg2rad(self.theta)) * self.resolution[0] / self.resolution[1]
        sign = -1 if inverse_ else 1
        half = a.shape[0] // 2
        return np.stack([np.roll(p, sign * int(round((i - half) * s)), axis=0) for i, p in enumerate(a)])

    def fw(self, w: np.ndarray) -> np.ndarray:
        return np.fft.fftn(w, axes=(-3, -2, -1), norm="ortho")

    def bw(self, w: np.ndarray) -> np.ndarray:
        return np.fft.ifftn(w, axes=(-3, -2, -1), norm="ortho")

    def probe_extent(self) -> tuple[float, float]:
        """Height and width in m of the smallest beam that covers the field of view."""
        e3, e1, e2 = (n * d for n, d in zip(self.shape, self.resolution, strict=True))
        t = np.deg2rad(self.theta)
        return float(e1 * np.cos(t) + e3 * np.sin(2 * t)), float(e2)

    def probe_3d(self, wave: np.ndarray) -> np.ndarray:
        """A two-dimensional wavefield extended along the beam, on natural pixels."""
        return self.shear(np.repeat(wave[None], self.shape[0], axis=0), inverse_=True)
