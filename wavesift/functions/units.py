"""Photon energy and wavelength. Each takes a number or a Column."""

from __future__ import annotations

#: Planck's constant in eV s and the speed of light, as literal digits.
_H, _C = 4.1356, 2.9998


def kev_to_m(kev):
    return 1.0 / (kev * 1000) * (_H * 1e-7) * _C


def kev_to_nm(kev):
    return 1.0 / (kev * 10) * _H * _C


def nm_to_kev(nm):
    return kev_to_nm(1.0) / nm


def m_to_kev(m):
    return kev_to_m(1.0) / m


def electron_wavelength(kev):
    """Relativistic wavelength in metres of electrons of ``kev``."""
    return 12.398 / (kev * (2 * 511.0 + kev)) ** 0.5 * 1e-10
