"""Pixel kernels on numpy arrays, to be run inside Arrow-fed UDFs. Raw frames are BG-ordered mosaics."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Luminance weights of red, green and blue.
RED, GREEN, BLUE = 0.30, 0.59, 0.11


def decode(content: bytes, width: int, height: int) -> np.ndarray | None:
    """A headerless 8-bit frame, or None if the size is wrong."""
    return np.frombuffer(content, np.uint8).reshape(height, width) if content is not None and len(content) == width * height else None


def _neighbours(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="reflect")
    out = np.zeros(a.shape)
    for dy in range(3):
        for dx in range(3):
            if kernel[dy, dx]:
                out += kernel[dy, dx] * p[dy : dy + a.shape[0], dx : dx + a.shape[1]]
    return out


def debayer(raw: np.ndarray) -> np.ndarray:
    """Bilinear colour (height, width, 3) in blue, green, red order."""
    h, w = raw.shape
    y, x = np.mgrid[:h, :w]
    cross = np.array([[0, 1, 0], [1, 4, 1], [0, 1, 0]]) / 4
    full = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) / 4
    masks = ((y % 2 == 0) & (x % 2 == 0), (y + x) % 2 == 1, (y % 2 == 1) & (x % 2 == 1))
    planes = [_neighbours(np.where(m, raw, 0).astype(float), k) for m, k in zip(masks, (full, cross, full))]
    return np.clip(np.stack(planes, axis=2) + 0.5, 0, 255).astype(np.uint8)


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.clip(bgr[..., 0] * BLUE + bgr[..., 1] * GREEN + bgr[..., 2] * RED + 0.5, 0, 255).astype(np.uint8)


def luminance_at(raw: np.ndarray, y: int, x: int) -> float:
    """Luminance of one mosaic place from its 2x2 cell."""
    y, x = y - y % 2, x - x % 2
    c = raw[y : y + 2, x : x + 2].astype(float)
    return BLUE * c[0, 0] + GREEN * (c[0, 1] + c[1, 0]) / 2 + RED * c[1, 1]


def mostly_black(raw: np.ndarray, scope_radius: float, samples: int = 40, dark: float = 20, most: int = 16, inset: float = 400) -> bool:
    """More than ``most`` of ``samples`` places on a ring inside the scope's rim are dark."""
    h, w = raw.shape
    r = scope_radius - inset
    angle = 2 * np.pi * np.arange(samples) / samples
    ys = np.clip(h / 2 + r * np.sin(angle), 0, h - 2).astype(int)
    xs = np.clip(w / 2 + r * np.cos(angle), 0, w - 2).astype(int)
    return sum(luminance_at(raw, y, x) < dark for y, x in zip(ys, xs)) > most


def mostly_white(img: np.ndarray, bright: int = 225) -> bool:
    return int((img > bright).sum()) * 2 > img.size


def is_2x(img: np.ndarray, least: float = 150) -> bool:
    """Centre on the diagonals much brighter than the corner region: the whole scope circle is in view."""
    h, w = img.shape
    t = np.linspace(0.35, 0.65, 20)
    ys, xs = (t * h).astype(int), (t * w).astype(int)
    middle = np.concatenate([img[ys, xs], img[ys, xs[::-1]]]).mean()
    return float(middle) - float(img[int(0.9 * h), int(0.9 * w)]) >= least


def is_4x(img: np.ndarray, least: float = 120) -> bool:
    h, w = img.shape
    c = img[h // 2 - 128 : h // 2 + 128, w // 2 - 128 : w // 2 + 128].mean()
    corners = [img[:64, :64], img[:64, -64:], img[-64:, :64], img[-64:, -64:]]
    return float(c) - float(np.mean([k.mean() for k in corners])) >= least


def resize_half(img: np.ndarray) -> np.ndarray:
    """Mean of 2x2 cells; an odd last row or column is repeated."""
    pad = [(0, img.shape[0] % 2), (0, img.shape[1] % 2)] + [(0, 0)] * (img.ndim - 2)
    a = np.pad(img, pad, mode="edge").astype(float)
    return np.clip((a[0::2, 0::2] + a[1::2, 0::2] + a[0::2, 1::2] + a[1::2, 1::2]) / 4 + 0.5, 0, 255).astype(img.dtype)


def resize(img: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, sample centres aligned."""
    h, w = max(1, round(img.shape[0] * scale)), max(1, round(img.shape[1] * scale))
    y = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, img.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = img.astype(float)
    out = a[y0][:, x0] * (1 - fy) * (1 - fx) + a[y1][:, x0] * fy * (1 - fx) + a[y0][:, x1] * (1 - fy) * fx + a[y1][:, x1] * fy * fx
    return np.clip(out + 0.5, 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out.astype(img.dtype)


def registration_image(raw: np.ndarray, scale: float = 0.25, crop: float = 0.5) -> np.ndarray:
    """Gray, scaled, and cropped to its centre."""
    g = resize(gray(debayer(raw)), scale)
    h, w = int(g.shape[0] * crop), int(g.shape[1] * crop)
    y, x = (g.shape[0] - h) // 2, (g.shape[1] - w) // 2
    return g[y : y + h, x : x + w]


def flat_field(calibration: np.ndarray) -> np.ndarray:
    """Gain image of a calibration frame."""
    return debayer(calibration).astype(np.float32) / 240


def correct(bgr: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Divided by the flat field, saturated."""
    return np.clip(bgr / np.maximum(field, 1e-6) + 0.5, 0, 255).astype(np.uint8)


def brighten(img: np.ndarray, power: float = 1.1) -> np.ndarray:
    return np.clip(np.power(img.astype(float), power) + 0.5, 0, 255).astype(np.uint8)


def sobel_energy(raw: np.ndarray) -> float:
    """Mean squared gradient of the green places on even rows and odd columns: a focus measure."""
    g = raw[0::2, 1::2].astype(float)
    s = np.array([1.0, 2.0, 1.0])
    gx = sum(s[k] * (g[k : g.shape[0] - 2 + k, 2:] - g[k : g.shape[0] - 2 + k, :-2]) for k in range(3))
    gy = sum(s[k] * (g[2:, k : g.shape[1] - 2 + k] - g[:-2, k : g.shape[1] - 2 + k]) for k in range(3))
    return float((gx * gx + gy * gy).mean())


def circle_mask(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return (y - (h - 1) / 2) ** 2 + (x - (w - 1) / 2) ** 2 <= (min(h, w) / 2) ** 2


def polygon_mask(h: int, w: int, points: list[tuple[float, float]]) -> np.ndarray:
    """Pixels whose centres lie inside, by crossing count."""
    y, x = np.mgrid[:h, :w] + 0.5
    inside = np.zeros((h, w), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def blit(tile: np.ndarray, frame: np.ndarray, at: tuple[int, int], mask: np.ndarray | None = None) -> np.ndarray:
    """``tile`` with the part of ``frame`` (its corner at (y, x) of the tile) that overlaps and is unmasked."""
    out = tile.copy()
    y, x = at
    y0, x0, y1, x1 = max(y, 0), max(x, 0), min(y + frame.shape[0], tile.shape[0]), min(x + frame.shape[1], tile.shape[1])
    if y0 >= y1 or x0 >= x1:
        return out
    part = frame[y0 - y : y1 - y, x0 - x : x1 - x]
    keep = np.ones(part.shape[:2], bool) if mask is None else mask[y0 - y : y1 - y, x0 - x : x1 - x]
    out[y0:y1, x0:x1][keep] = part[keep]
    return out


def parent_tile(children: dict[tuple[int, int], np.ndarray], size: int, channels: int) -> np.ndarray:
    """Half-size mosaic of up to four children, keyed by (row, column) in 0..1; missing ones are blank."""
    out = np.zeros((size, size, channels), np.uint8)
    h = size // 2
    for (r, c), t in children.items():
        out[r * h : (r + 1) * h, c * h : (c + 1) * h] = resize_half(t)
    return out


def cut_tiles(img: np.ndarray, size: int = 256) -> dict[tuple[int, int], np.ndarray]:
    """Whole image to (i, j) tiles, blank beyond its edges."""
    out = {}
    for j in range(-(-img.shape[0] // size)):
        for i in range(-(-img.shape[1] // size)):
            t = np.zeros((size, size, *img.shape[2:]), img.dtype)
            part = img[j * size : (j + 1) * size, i * size : (i + 1) * size]
            t[: part.shape[0], : part.shape[1]] = part
            out[i, j] = t
    return out


def assemble(tiles: dict[tuple[int, int], np.ndarray], size: int = 256) -> np.ndarray:
    """Mosaic of the tiles' bounding range."""
    lo = min(i for i, _ in tiles), min(j for _, j in tiles)
    hi = max(i for i, _ in tiles), max(j for _, j in tiles)
    one = next(iter(tiles.values()))
    out = np.zeros(((hi[1] - lo[1] + 1) * size, (hi[0] - lo[0] + 1) * size, *one.shape[2:]), one.dtype)
    for (i, j), t in tiles.items():
        out[(j - lo[1]) * size : (j - lo[1] + 1) * size, (i - lo[0]) * size : (i - lo[0] + 1) * size] = t
    return out


def remosaic(bgr: np.ndarray) -> np.ndarray:
    out = bgr[..., 1].copy()
    out[0::2, 0::2], out[1::2, 1::2] = bgr[0::2, 0::2, 0], bgr[1::2, 1::2, 2]
    return out


def color_gain(raw: np.ndarray, blue: float, green: float, red: float) -> np.ndarray:
    """Gains per mosaic colour, saturated."""
    g = np.full(raw.shape, green)
    g[0::2, 0::2], g[1::2, 1::2] = blue, red
    return np.clip(raw * g + 0.5, 0, 255).astype(np.uint8)


def split_colors(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Dense planes of the mosaic's four places."""
    return {"B": raw[0::2, 0::2], "G1": raw[0::2, 1::2], "G2": raw[1::2, 0::2], "R": raw[1::2, 1::2]}


def convolve_mosaic(raw: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Each colour plane convolved on its own."""
    out = np.zeros(raw.shape)
    for (y, x), plane in zip(((0, 0), (0, 1), (1, 0), (1, 1)), split_colors(raw).values()):
        k = kernel[::-1, ::-1]
        p = np.pad(plane.astype(float), [(k.shape[0] // 2,) * 2, (k.shape[1] // 2,) * 2], mode="edge")
        out[y::2, x::2] = sum(k[a, b] * p[a : a + plane.shape[0], b : b + plane.shape[1]] for a in range(k.shape[0]) for b in range(k.shape[1]))
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def estimate_kernel(sharp: np.ndarray, blurred: np.ndarray, size: int = 3) -> np.ndarray:
    """Least-squares kernel that turns one image into another, by normal equations over valid places."""
    h = size // 2
    rows = [sharp[a : sharp.shape[0] - size + 1 + a, b : sharp.shape[1] - size + 1 + b].ravel().astype(float) for a in range(size) for b in range(size)]
    x = np.stack(rows, 1)
    y = blurred[h : blurred.shape[0] - h, h : blurred.shape[1] - h].ravel().astype(float)
    k = np.linalg.lstsq(x.T @ x, x.T @ y, rcond=None)[0].reshape(size, size)
    return k[::-1, ::-1]


def motion_kernel(length: int, degrees: float) -> np.ndarray:
    """Line kernel of a given length and direction, summing to one."""
    n = length + 1 - length % 2
    k, c = np.zeros((n, n)), n // 2
    for t in np.linspace(-(length - 1) / 2, (length - 1) / 2, 4 * length):
        k[int(round(c - t * np.sin(np.radians(degrees)))), int(round(c + t * np.cos(np.radians(degrees))))] += 1
    return k / k.sum()


def add_noise(img: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    return np.clip(img + np.random.default_rng(seed).normal(0, sigma, img.shape) + 0.5, 0, 255).astype(np.uint8)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(dy, dx, response): cyclic shift that takes ``a`` to ``b``, by phase correlation under a Hann window."""
    w = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    f = np.conj(np.fft.fft2(a * w)) * np.fft.fft2(b * w)
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    dy, dx = np.unravel_index(int(r.argmax()), r.shape)
    h, w_ = a.shape
    return int(dy - h * (dy > h // 2)), int(dx - w_ * (dx > w_ // 2)), float(r.max())


def log_spectrum(img: np.ndarray) -> np.ndarray:
    return np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(img.astype(float)))))


def threshold_bits(img: np.ndarray, share: float = 0.5) -> tuple[int, np.ndarray]:
    """Percentile threshold from the histogram, and the image above it packed eight pixels a byte, lowest bit first."""
    cum = np.cumsum(np.bincount(img.ravel(), minlength=256))
    level = int(np.argmax(cum >= share * img.size))
    return level, np.packbits(img.ravel() > level, bitorder="little")


def corners(img: np.ndarray, most: int = 500, cell: int = 16) -> np.ndarray:
    """(x, y, response) of Harris corners, the strongest of each cell: a plain detector where none is given."""
    g = img.astype(float)
    gy, gx = np.gradient(g)
    box = lambda a: _neighbours(a, np.ones((3, 3)) / 9)
    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    r = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    out = []
    for y in range(0, img.shape[0], cell):
        for x in range(0, img.shape[1], cell):
            c = r[y : y + cell, x : x + cell]
            dy, dx = np.unravel_index(int(c.argmax()), c.shape)
            if c[dy, dx] > 0:
                out.append((x + dx, y + dy, c[dy, dx]))
    out.sort(key=lambda p: (-p[2], p[1], p[0]))
    return np.array(out[:most], float).reshape(-1, 3)


def zbuffer(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per pixel the layer with the strictly highest score, first wins: [(pixels, scores), ...]."""
    best = np.zeros(layers[0][1].shape)
    out = np.zeros_like(layers[0][0])
    for pixels, score in layers:
        more = score > best
        out[more], best[more] = pixels[more], score[more]
    return out


def quality_score(h: int, w: int, shape: str = "dome") -> np.ndarray:
    """Score by distance from the centre: dome, cone, or a donut that peaks half-way out."""
    y, x = np.mgrid[:h, :w]
    d = np.minimum(np.hypot((y - (h - 1) / 2) / (h / 2), (x - (w - 1) / 2) / (w / 2)), 1)
    if shape == "dome":
        return np.sqrt(1 - d * d)
    return 1 - d if shape == "cone" else 1 - np.abs(2 * d - 1)


def swap_rgb(bgra: np.ndarray) -> np.ndarray:
    return bgra[..., 2::-1]


def normalise(rgb: np.ndarray, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, scaled for image models."""
    return ((rgb.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def seed_point(mask: np.ndarray, box: int = 9) -> tuple[int, int]:
    """Place best inside a mask: highest box mean after an erosion, the first on ties."""
    p = np.pad(mask.astype(float), box // 2)
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    mean = s[box:, box:] - s[:-box, box:] - s[box:, :-box] + s[:-box, :-box]
    eroded = np.where(mask > 0, mean[: mask.shape[0], : mask.shape[1]], -1)
    y, x = np.unravel_index(int(eroded.argmax()), mask.shape)
    return int(y), int(x)


def per_frame(kernel, width: int, height: int):
    """A pandas UDF body that decodes each frame and applies ``kernel``; wrongly sized frames give null."""

    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if (a := decode(c, width, height)) is None else kernel(a))

    return run


def merge_masks(old: np.ndarray, new: np.ndarray, replace: bool = False) -> np.ndarray:
    """Union by pixel maximum, or the new mask alone."""
    return new.copy() if replace else np.maximum(old, new)


def flatten_layer(tiles: dict[tuple[int, int], np.ndarray], scale: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Gray image and coverage mask of a layer's tiles, scaled for feature extraction."""
    img = assemble(tiles, size)
    return resize(gray(img[..., :3]), scale), resize((img[..., :3].max(axis=2) > 0).astype(np.uint8) * 255, scale)
