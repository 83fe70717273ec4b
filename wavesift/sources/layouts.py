"""How positions and frames of a file belong together."""

from __future__ import annotations

import numpy as np


def scan_layout(data_shape: tuple[int, ...], slow: np.ndarray, fast: np.ndarray, box: tuple[tuple[float, float], tuple[float, float]] | None = None, skip: int = 1, keep: np.ndarray | None = None, order: np.ndarray | None = None) -> list[tuple[int, float, float]]:
    """(frame, slow, fast) of each frame that is used, from the shapes alone.

    Positions may be two grids, two lists of frames, or the two axes of a grid;
    data may be a grid or a list. A bounding box, a stride, a filter by frame and
    an explicit order pick from it, in this sequence.
    """
    slow, fast = np.asarray(slow, float), np.asarray(fast, float)
    frames = int(np.prod(data_shape))
    if slow.shape == fast.shape and slow.size == frames:
        y, x = slow.ravel(), fast.ravel()
    elif slow.ndim == fast.ndim == 1 and slow.size * fast.size == frames:
        y, x = np.repeat(slow, fast.size), np.tile(fast, slow.size)
    else:
        raise ValueError(f"positions of shapes {slow.shape} and {fast.shape} don't fit data of shape {data_shape}")
    used = np.arange(frames)
    if keep is not None:
        used = used[np.asarray(keep, bool).ravel()[used]]
    if box is not None:
        (y0, y1), (x0, x1) = box
        used = used[(y[used] >= y0) & (y[used] <= y1) & (x[used] >= x0) & (x[used] <= x1)]
    used = used[::skip]
    if order is not None:
        used = used[np.asarray(order)]
    return [(int(i), float(y[i]), float(x[i])) for i in used]


#: Facility connectors differ in names and corrections only; readers take these as keyword arguments.
LAYOUTS = {
    "generic": {"intensity": "entry/data", "slow": "entry/y", "fast": "entry/x"},
    "nexus": {"intensity": "entry1/instrument/detector/data", "slow": "entry1/instrument/y/data", "fast": "entry1/instrument/x/data"},
    "stepscan": {"intensity": "entry/measurement/detector/frames", "slow": "entry/measurement/sy", "fast": "entry/measurement/sx"},
    "flyscan": {"intensity": "entry/measurement/detector/frames", "slow": "entry/measurement/sy", "fast": "entry/measurement/buff_x"},
}
