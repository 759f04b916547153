"""Edits of grey images."""

import numpy as np


def warped(img, degrees=0.0, scale=1.0):
    """Turned about the middle and rescaled, bilinear, cut to what the image covers."""
    h, w = img.shape
    a = np.deg2rad(degrees)
    ratio = 1 / (abs(np.cos(a)) + abs(np.sin(a)))
    n, m = int(h * scale * ratio), int(w * scale * ratio)
    y, x = np.mgrid[:n, :m]
    y, x = (y - (n - 1) / 2) / scale, (x - (m - 1) / 2) / scale
    u = np.clip(np.cos(a) * x + np.sin(a) * y + (w - 1) / 2, 0, w - 1.001)
    v = np.clip(-np.sin(a) * x + np.cos(a) * y + (h - 1) / 2, 0, h - 1.001)
    i, j = v.astype(int), u.astype(int)
    f, g, p = v - i, u - j, img.astype(float)
    out = (p[i, j] * (1 - g) + p[i, j + 1] * g) * (1 - f) + (p[i + 1, j] * (1 - g) + p[i + 1, j + 1] * g) * f
    return np.rint(out).astype(np.uint8)


EDITS = {
    "noise of 12": lambda x, rng: np.clip(x + rng.normal(0, 12, x.shape), 0, 255).astype(np.uint8),
    "turned by 7 degrees": lambda x, rng: warped(x, 7),
    "turned by 22 degrees": lambda x, rng: warped(x, 22),
    "turned by 90 degrees": lambda x, rng: np.rot90(x).copy(),
    "scaled by 0.7": lambda x, rng: warped(x, 0, 0.7),
    "scaled by 1.4": lambda x, rng: warped(x, 0, 1.4),
    "turned by 45 degrees": lambda x, rng: warped(x, 45),
    "scaled by 0.8": lambda x, rng: warped(x, 0, 0.8),
    "scaled by 1.5": lambda x, rng: warped(x, 0, 1.5),
    "half": lambda x, rng: x[:, 10:60].copy(),
    "quarter": lambda x, rng: x[18:54, 18:54].copy(),
}
