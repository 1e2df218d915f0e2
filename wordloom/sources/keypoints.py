"""Scale-invariant keypoints and their descriptors (Lowe 2004) in NumPy."""

from __future__ import annotations

import numpy as np

# Fixed values of the published method.
SCALES, SIGMA, ASSUMED_BLUR, BORDER = 3, 1.6, 0.5, 5
CELLS, TURNS, CUT = 4, 8, 0.2


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, mirrored at the borders."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        x = np.pad(img, pad, mode="symmetric")
        img = sum(w * np.take(x, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k))
    return img


def pyramid(grey: np.ndarray) -> list[np.ndarray]:
    """Octaves of SCALES + 3 images each; the first is of twice the size."""
    h, w = grey.shape
    at = lambda n: np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    rows = np.stack([np.interp(x, np.arange(w), r) for r in grey])
    base = np.stack([np.interp(y, np.arange(h), c) for c in rows.T]).T
    base = blurred(base, np.sqrt(SIGMA**2 - (2 * ASSUMED_BLUR) ** 2))
    out = []
    while min(base.shape) >= 2 * BORDER + 3:
        layers = [base]
        for i in range(1, SCALES + 3):
            before, now = SIGMA * 2 ** ((i - 1) / SCALES), SIGMA * 2 ** (i / SCALES)
            layers.append(blurred(layers[-1], np.sqrt(now**2 - before**2)))
        out.append(np.stack(layers))
        base = layers[SCALES][::2, ::2]
    return out


def extrema(dog: np.ndarray, contrast: float, edge: float) -> list[tuple[float, float, float]]:
    """(layer, row, column) of refined extremes of one octave's differences."""
    mid = dog[1:-1, 1:-1, 1:-1]
    high, low = np.ones(mid.shape, bool), np.ones(mid.shape, bool)
    for a in range(3):
        for b in range(3):
            for c in range(3):
                if (a, b, c) != (1, 1, 1):
                    near = dog[a : a + mid.shape[0], b : b + mid.shape[1], c : c + mid.shape[2]]
                    high &= mid >= near
                    low &= mid <= near
    wanted = (np.abs(mid) > 0.5 * contrast / SCALES) & (high | low)
    found = []
    for s, y, x in np.argwhere(wanted) + 1:
        for _ in range(5):
            if not (0 < s < dog.shape[0] - 1 and BORDER <= y < dog.shape[1] - BORDER and BORDER <= x < dog.shape[2] - BORDER):
                break
            c = dog[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2]
            g = np.array([c[2, 1, 1] - c[0, 1, 1], c[1, 2, 1] - c[1, 0, 1], c[1, 1, 2] - c[1, 1, 0]]) / 2
            ss, yy, xx = c[2, 1, 1] + c[0, 1, 1] - 2 * c[1, 1, 1], c[1, 2, 1] + c[1, 0, 1] - 2 * c[1, 1, 1], c[1, 1, 2] + c[1, 1, 0] - 2 * c[1, 1, 1]
            sy, sx, yx = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4, (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4, (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
            try:
                off = -np.linalg.solve(np.array([[ss, sy, sx], [sy, yy, yx], [sx, yx, xx]]), g)
            except np.linalg.LinAlgError:
                break
            if np.abs(off).max() < 0.5:
                trace, det = yy + xx, yy * xx - yx * yx
                if abs(c[1, 1, 1] + g @ off / 2) * SCALES >= contrast and det > 0 and trace * trace * edge < (edge + 1) ** 2 * det:
                    found.append((s + off[0], y + off[1], x + off[2]))
                break
            if np.abs(off).max() > 1e3:
                break
            s, y, x = (np.array([s, y, x]) + np.rint(off).astype(int)).tolist()
    return found


def orientations(size: np.ndarray, turn: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """Peaks of the histogram of gradient directions around a point, of 36 steps, in radians."""
    r = int(round(4.5 * sigma))
    ys, xs = np.arange(max(1, int(y) - r), min(size.shape[0] - 1, int(y) + r + 1)), np.arange(max(1, int(x) - r), min(size.shape[1] - 1, int(x) + r + 1))
    if not len(ys) or not len(xs):
        return []
    d = (ys[:, None] - y) ** 2 + (xs[None, :] - x) ** 2
    w = np.exp(-d / (2 * (1.5 * sigma) ** 2)) * size[np.ix_(ys, xs)]
    hist = np.bincount(np.rint(turn[np.ix_(ys, xs)] * 36 / (2 * np.pi)).astype(int).ravel() % 36, weights=w.ravel(), minlength=36)
    hist = (6 * hist + 4 * (np.roll(hist, 1) + np.roll(hist, -1)) + np.roll(hist, 2) + np.roll(hist, -2)) / 16
    left, right = np.roll(hist, 1), np.roll(hist, -1)
    peaks = np.flatnonzero((hist > left) & (hist > right) & (hist >= 0.8 * hist.max()))
    return [float((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * hist[k] + right[k])) * 2 * np.pi / 36 % (2 * np.pi)) for k in peaks]


def descriptor(size: np.ndarray, turn: np.ndarray, y: float, x: float, sigma: float, angle: float) -> np.ndarray:
    """CELLS x CELLS histograms of TURNS directions relative to the angle, every gradient shared by its nearest cells and
    directions; unit length, cut, unit length, times 512."""
    width = 3 * sigma
    r = int(round(width * np.sqrt(2) * (CELLS + 1) / 2))
    ys, xs = np.arange(max(1, int(y) - r), min(size.shape[0] - 1, int(y) + r + 1)), np.arange(max(1, int(x) - r), min(size.shape[1] - 1, int(x) + r + 1))
    gy, gx = np.meshgrid(ys, xs, indexing="ij")
    dy, dx = (gy - y) / width, (gx - x) / width
    u, v = np.cos(angle) * dx + np.sin(angle) * dy, -np.sin(angle) * dx + np.cos(angle) * dy
    column, row = u + CELLS / 2 - 0.5, v + CELLS / 2 - 0.5
    inside = (row > -1) & (row < CELLS) & (column > -1) & (column < CELLS)
    row, column, u, v = row[inside], column[inside], u[inside], v[inside]
    w = size[gy, gx][inside] * np.exp(-(u * u + v * v) / (CELLS * CELLS / 2))
    t = ((turn[gy, gx][inside] - angle) % (2 * np.pi)) * TURNS / (2 * np.pi)
    lows = [np.floor(z).astype(int) for z in (row, column, t)]
    parts = [z - low for z, low in zip((row, column, t), lows)]
    hist = np.zeros((CELLS + 2, CELLS + 2, TURNS))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                share = w * np.where(a, parts[0], 1 - parts[0]) * np.where(b, parts[1], 1 - parts[1]) * np.where(c, parts[2], 1 - parts[2])
                np.add.at(hist, (lows[0] + a + 1, lows[1] + b + 1, (lows[2] + c) % TURNS), share)
    d = hist[1:-1, 1:-1].ravel()
    n = np.linalg.norm(d)
    if n == 0:
        return d
    d = np.minimum(d / n, CUT)
    return np.minimum(np.rint(512 * d / np.linalg.norm(d)), 255)


def keypoints(grey: np.ndarray, contrast: float = 0.04, edge: float = 10.0) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(row, column, scale, angle, descriptor) of an image of bytes, in places and scales of the image itself, in order of
    octave, layer, row and column."""
    out = []
    for o, layers in enumerate(pyramid(grey.astype(np.float64) / 255)):
        step, dog, known = 2.0 ** (o - 1), np.diff(layers, axis=0), {}
        for s, y, x in extrema(dog, contrast, edge):
            k = int(np.clip(round(s), 0, len(layers) - 1))
            if k not in known:
                gy, gx = np.gradient(layers[k])
                known[k] = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)
            sigma = SIGMA * 2 ** (s / SCALES)
            for angle in orientations(*known[k], y, x, sigma):
                out.append((y * step - 0.25, x * step - 0.25, sigma * step, angle, descriptor(*known[k], y, x, sigma, angle)))
    return out


def sift_descriptors(img: np.ndarray, contrast: float = 0.04, edge: float = 10.0, most: int = 0) -> np.ndarray:
    """(n, 128) descriptors of an image of blue, green, red bytes, perhaps none. most: only so many, of the largest scales
    (0: all)."""
    grey = img.astype(np.float64) @ np.array([0.114, 0.587, 0.299]) if img.ndim == 3 and img.shape[2] == 3 else img.reshape(img.shape[:2])
    found = keypoints(grey, contrast, edge)
    if most:
        found = sorted(found, key=lambda k: -k[2])[:most]
    return np.array([k[4] for k in found], np.float32).reshape(-1, 128)
