"""Image features in NumPy and the Arrow UDF that makes them all from one decode.

Images are H x W x 3 uint8 in BGR order.  Kernels (luma, HSV, resizing, blur, edges) are our own, so hashes
compare within this engine.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

MIN_SIDE = 10
SIDE = 128


# Decoding (S10-S12)


def _png(data: bytes) -> np.ndarray | None:
    """8-bit grey, RGB, palette or alpha PNG, not interlaced, to H x W x channels (RGB order)."""
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if not head or head[2] != 8 or head[6]:
        return None
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, channels)
    img = out.reshape(h, w, channels)
    return palette[img[:, :, 0]] if head[3] == 3 and palette is not None else img


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step).astype(np.int64), 0).astype(np.uint8).ravel()
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for x in range(len(out)):
        a = out[x - step] if x >= step else 0
        c = up[x - step] if x >= step else 0
        if kind == 3:
            guess = (a + up[x]) // 2
        else:
            p = a + up[x] - c
            guess = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
        out[x] = (out[x] + guess) & 255
    return out.astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray | None:
    offset, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits not in (24, 32):
        return None
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[offset : offset + stride * abs(h)], np.uint8).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """Bytes to BGR; alpha goes over white; None if undecodable or 10 pixels or less on a side."""
    try:
        if not data:
            return None
        img = _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _bmp(data) if data[:2] == b"BM" else _other(data)
    except Exception:  # noqa: BLE001  broken files are invalid images
        return None
    if img is None or min(img.shape[:2]) <= MIN_SIDE:
        return None
    if img.shape[2] in (2, 4):
        alpha = img[:, :, -1:].astype(np.float64) / 255
        img = np.rint(255 * (1 - alpha) + img[:, :, :-1] * alpha).astype(np.uint8)
    if img.shape[2] == 1:
        img = np.repeat(img, 3, 2)
    return np.ascontiguousarray(img[:, :, ::-1])


def _other(data: bytes) -> np.ndarray | None:
    """Other formats, if an imaging library is there."""
    try:
        import io

        from PIL import Image
    except ImportError:
        return None
    return np.array(Image.open(io.BytesIO(data)).convert("RGBA"))


def encode_png(img: np.ndarray) -> bytes:
    """BGR, BGRA or grey to PNG."""
    img = img[:, :, None] if img.ndim == 2 else img
    c = img.shape[2]
    rgb = img[:, :, [2, 1, 0, 3][:c]] if c > 2 else img
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.hstack([np.zeros((len(img), 1), np.uint8), rgb.reshape(len(img), -1)])
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


# Kernels (I24)


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    """Area weights that turn n samples into m (linear interpolation when enlarging)."""
    out = np.zeros((m, n))
    for i in range(m):
        if m <= n:
            lo, hi = i * n / m, (i + 1) * n / m
            for j in range(int(lo), min(n, int(np.ceil(hi)))):
                out[i, j] = min(hi, j + 1) - max(lo, j)
        else:
            x = min(max((i + 0.5) * n / m - 0.5, 0), n - 1)
            out[i, int(x)] += 1 - x % 1
            out[i, min(n - 1, int(x) + 1)] += x % 1
    return out / out.sum(1, keepdims=True)


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    a, b = _weights(img.shape[0], h), _weights(img.shape[1], w)
    return a @ img.astype(np.float64) @ b.T if img.ndim == 2 else np.stack([a @ img[:, :, c].astype(np.float64) @ b.T for c in range(img.shape[2])], 2)


def grey(img: np.ndarray) -> np.ndarray:
    return img.astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def hsv(img: np.ndarray) -> np.ndarray:
    """Hue in [0, 180), saturation and value in [0, 255]."""
    b, g, r = (img[:, :, i].astype(np.float64) for i in range(3))
    v, span = np.maximum(np.maximum(r, g), b), np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    safe = np.where(span == 0, 1, span)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(span == 0, 0, h) % 360
    return np.stack([np.minimum(np.rint(h / 2), 179.999) % 180, np.where(v == 0, 0, np.rint(255 * span / np.where(v == 0, 1, v))), v], 2)


def box_blur(img: np.ndarray, k: int) -> np.ndarray:
    pad = np.pad(img, k // 2, mode="reflect")
    s = np.pad(np.cumsum(np.cumsum(pad, 0), 1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g, 1, mode="edge")
    smooth = lambda x: x[:-2] + 2 * x[1:-1] + x[2:]
    return smooth(p[:, 2:] - p[:, :-2]), smooth((p[2:] - p[:-2]).T).T


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Gradient edges: thinned across the gradient, weak ones kept where they touch strong ones."""
    gx, gy = _sobel(g)
    mag, angle = np.abs(gx) + np.abs(gy), (np.rint(np.arctan2(gy, gx) / (np.pi / 4)) % 4).astype(int)
    p = np.pad(mag, 1)
    shift = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    thin = np.zeros(mag.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (angle == k) & (mag >= shift(dy, dx)) & (mag > shift(-dy, -dx))
    strong, weak = thin & (mag > high), thin & (mag > low)
    while True:
        q = np.pad(strong, 1)
        near = sum(q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) > 0
        new = strong | (weak & near)
        if (new == strong).all():
            return strong
        strong = new


def otsu(g: np.ndarray) -> np.ndarray:
    """Foreground by the threshold that parts the histogram best."""
    hist = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    n, s = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n)))
    return (g > between.argmax()).astype(np.uint8)


def _morph(b: np.ndarray, grow: bool) -> np.ndarray:
    """3 x 3 cross, as a small ellipse is."""
    p = np.pad(b, 1, constant_values=0 if grow else 1)
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return np.maximum.reduce(parts) if grow else np.minimum.reduce(parts)


@lru_cache(8)
def _dct(n: int) -> np.ndarray:
    d = np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(n)[:, None] / (2 * n)) * np.sqrt(2 / n)
    d[0] /= np.sqrt(2)
    return d


def dct2(g: np.ndarray) -> np.ndarray:
    d = _dct(len(g))
    return d @ g @ d.T


def _bits(x: np.ndarray) -> str:
    return "".join("1" if v else "0" for v in (x > np.median(x)).ravel())


def _unit(v: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return v / (np.linalg.norm(v) + eps)


def _spectrum(g: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fftshift(np.fft.fft2(g)))


def _centre(x: np.ndarray, n: int) -> np.ndarray:
    y, z = x.shape[0] // 2 - n // 2, x.shape[1] // 2 - n // 2
    return x[y : y + n, z : z + n]


# Features


def phash(img: np.ndarray) -> str:
    """256 bits as 64 hex digits."""
    return f"{int(_bits(dct2(resize(grey(img), 64, 64))[:16, :16]), 2):064x}"


def dct_hash(img: np.ndarray) -> str:
    """64 bits."""
    return _bits(dct2(resize(grey(img), 32, 32))[:8, :8])


def fft_hash(img: np.ndarray) -> str:
    """256 bits of the spectrum's centre."""
    return _bits(_centre(_spectrum(resize(grey(img), 64, 64)), 16))


def hsv_histogram(img: np.ndarray) -> np.ndarray:
    """I4: ten bins each of hue, saturation and value, each summing to 1."""
    x, out = hsv(img), []
    for c, top in enumerate((180, 256, 256)):
        h = np.bincount(np.minimum(x[:, :, c].ravel() * 10 / top, 9).astype(int), minlength=10).astype(np.float64)
        out.append(h / (h.sum() + 1e-7))
    return np.concatenate(out)


def palette(img: np.ndarray, n: int = 5) -> dict:
    """I8: colours of the fullest hue bins in ascending order of fullness, and the first ten bins of each histogram."""
    x = hsv(img)
    h = np.bincount((x[:, :, 0].ravel() / 5).astype(int), minlength=36)[:36]
    sv = [np.bincount((x[:, :, c].ravel() / 8).astype(int), minlength=32)[:32] for c in (1, 2)]
    colors = [_hsv_to_rgb(int(b) * 5, 128, 200) for b in np.argsort(h, kind="stable")[-n:]]
    return {"dominant_colors": colors, "color_count": len(colors), "hist_h": h[:10].tolist(), "hist_s": sv[0][:10].tolist(), "hist_v": sv[1][:10].tolist()}


def _hsv_to_rgb(h: float, s: float, v: float) -> tuple[int, int, int]:
    c, x = v * s / 255, h * 2 / 60
    m, y = v - c, c * (1 - abs(x % 2 - 1))
    r, g, b = ((c, y, 0), (y, c, 0), (0, c, y), (0, y, c), (y, 0, c), (c, 0, y))[int(x) % 6]
    return round(r + m), round(g + m), round(b + m)


def composition(img: np.ndarray) -> dict:
    """Text or symbol by the density of edges in the middle, and the layout."""
    h, w = img.shape[:2]
    density = float(edges(grey(img))[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4].mean())
    text = 1.0 if density < 0.1 else 0.3
    return {"text_score": text, "symbol_score": 1 - text, "edge_density": density, "layout": "horizontal" if w > 1.5 * h else "square"}


def fft_features(img: np.ndarray) -> np.ndarray:
    """1024 low frequencies, logarithmic, of unit length."""
    return _unit(np.log(_centre(_spectrum(resize(grey(img), SIDE, SIDE) / 255), 32) + 1e-8).ravel())


def _polar(spectrum: np.ndarray, radii: np.ndarray, angles: np.ndarray) -> np.ndarray:
    cy, cx = spectrum.shape[0] // 2, spectrum.shape[1] // 2
    y = (cy + np.outer(radii, np.sin(angles))).astype(int).clip(0, spectrum.shape[0] - 1)
    x = (cx + np.outer(radii, np.cos(angles))).astype(int).clip(0, spectrum.shape[1] - 1)
    return spectrum[y, x]


def fmt_signature(img: np.ndarray) -> np.ndarray:
    """The spectrum summed along 64 rays, of unit length."""
    s = _spectrum(resize(grey(img), SIDE, SIDE) / 255)
    return _unit(_polar(s, np.linspace(1, SIDE // 2 - 1, 32), np.linspace(0, 2 * np.pi, 64, endpoint=False)).sum(0))


def color_fmt(img: np.ndarray) -> np.ndarray:
    """Per channel the strongest angle at 16 logarithmic radii."""
    small = resize(img, SIDE, SIDE) / 255
    radii, angles = np.geomspace(1, SIDE // 2 - 1, 16), np.linspace(0, 2 * np.pi, 32, endpoint=False)
    return _unit(np.concatenate([_polar(_spectrum(small[:, :, c]), radii, angles).max(1) for c in range(3)]))


def saliency_fft(img: np.ndarray) -> np.ndarray:
    """Low frequencies of the image weighted by how much each place stands out."""
    g = grey(img)
    salient = 0.7 * np.abs(g - box_blur(g, 5).mean()) + 0.3 * edges(g) * 255
    salient = box_blur(salient / (salient.max() or 1), 3)
    return np.log(_centre(_spectrum(resize(salient * g / 255, SIDE, SIDE)), 32) + 1).ravel()


def hu_moments(img: np.ndarray) -> np.ndarray:
    """-log10 of the seven invariants of the cleaned foreground; 0 where an invariant is 0."""
    b = otsu(grey(img))
    b = _morph(_morph(_morph(_morph(b, True), False), False), True).astype(np.float64)
    y, x = np.mgrid[: b.shape[0], : b.shape[1]]
    m = b.sum()
    if not m:
        return np.zeros(7)
    dx, dy = x - (x * b).sum() / m, y - (y * b).sum() / m
    n = {(p, q): (dx**p * dy**q * b).sum() / m ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, c, d, e = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3], n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    s, t = n[2, 0] - n[0, 2], n[1, 1]
    h = np.array([
        n[2, 0] + n[0, 2], s**2 + 4 * t**2, d**2 + e**2, a**2 + c**2,
        d * a * (a**2 - 3 * c**2) + e * c * (3 * a**2 - c**2),
        s * (a**2 - c**2) + 4 * t * a * c,
        e * a * (a**2 - 3 * c**2) - d * c * (3 * a**2 - c**2),
    ])
    return np.array([-np.log10(abs(v)) if v else 0.0 for v in h])


def zernike(img: np.ndarray) -> np.ndarray:
    """42 angular means of the foreground up to order 5."""
    b = resize(otsu(grey(img)).astype(float), SIDE, SIDE)
    y, x = np.mgrid[:SIDE, :SIDE] - SIDE / 2
    angle = np.arctan2(y, x)
    out = []
    for n in range(6):
        for m in range(n + 1):
            out += [(b * np.cos(m * angle)).mean(), (b * np.sin(m * angle)).mean()]
    return np.array(out)


def lbp_stats(img: np.ndarray) -> np.ndarray:
    """I16: uniform local binary patterns of 24 points at radius 3: sum without the last bin, entropy, energy."""
    g = grey(img)
    h, w = g.shape
    bits = []
    for k in range(24):
        dy, dx = -3 * np.sin(2 * np.pi * k / 24), 3 * np.cos(2 * np.pi * k / 24)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        p = np.pad(g, 4, mode="edge")
        at = lambda a, b, p=p, y0=y0, x0=x0: p[4 + y0 + a : 4 + y0 + a + h, 4 + x0 + b : 4 + x0 + b + w]
        bits.append((1 - fy) * (1 - fx) * at(0, 0) + (1 - fy) * fx * at(0, 1) + fy * (1 - fx) * at(1, 0) + fy * fx * at(1, 1) >= g - 1e-9)
    b = np.array(bits)
    changes = (b != np.roll(b, 1, 0)).sum(0)
    hist = np.bincount(np.where(changes <= 2, b.sum(0), 25).ravel(), minlength=26) / g.size
    return np.array([hist[:-1].sum(), -(hist * np.log2(hist + 1e-10)).sum(), (hist**2).sum()])


def glcm_stats(img: np.ndarray) -> np.ndarray:
    """Contrast, correlation, energy and homogeneity of horizontal neighbours."""
    g = np.clip(resize(grey(img), 64, 64), 0, 255).astype(int)
    p = np.bincount((g[:, :-1] * 256 + g[:, 1:]).ravel(), minlength=65536).reshape(256, 256).astype(float)
    p = (p + p.T) / (2 * g[:, 1:].size)
    i, j = np.mgrid[:256, :256]
    mi = (p * i).sum()
    var = (p * (i - mi) ** 2).sum()
    corr = (p * (i - mi) * (j - mi)).sum() / var if var else 1.0
    return np.array([(p * (i - j) ** 2).sum(), corr, np.sqrt((p**2).sum()), (p / (1 + (i - j) ** 2)).sum()])


def gabor_stats(img: np.ndarray) -> np.ndarray:
    """Mean, spread and mean square of four filters' real responses."""
    g = resize(grey(img), 64, 64) / 255
    y, x = np.mgrid[-10:11, -10:11]
    out = []
    for f in (0.1, 0.3):
        for theta in (0, np.pi / 4):
            s = 0.56 / f
            kernel = np.exp(-(x**2 + y**2) / (2 * s * s)) / (2 * np.pi * s * s) * np.cos(2 * np.pi * f * (x * np.cos(theta) + y * np.sin(theta)))
            r = np.fft.irfft2(np.fft.rfft2(np.pad(g, 10, mode="reflect"), (104, 104)) * np.fft.rfft2(kernel, (104, 104)), (104, 104))[20:84, 20:84]
            out += [r.mean(), r.std(), (r**2).mean()]
    return np.array(out)


def rgb_moments(img: np.ndarray) -> np.ndarray:
    """Mean, spread and biased skewness of R, G and B over 255."""
    out = []
    for c in (2, 1, 0):
        v = img[:, :, c].astype(np.float64).ravel()
        s = v.std()
        out += [v.mean() / 255, s / 255, (((v - v.mean()) / s) ** 3).mean() / 255 if s else 0.0]
    return np.array(out)


def hsv_moments(img: np.ndarray) -> np.ndarray:
    """Mean and spread of hue, saturation and value over 255."""
    x = hsv(img).reshape(-1, 3)
    return np.stack([x.mean(0), x.std(0)], 1).ravel() / 255


def dominant_colors(img: np.ndarray, k: int = 3, rounds: int = 20, starts: int = 10) -> np.ndarray:
    """K colours of the pixels by seeded k-means, most frequent first: r, g, b and share of each."""
    px = img[:, :, ::-1].reshape(-1, 3).astype(np.float64)
    code, n = np.unique(px @ [65536.0, 256.0, 1.0], return_counts=True)  # a colour's pixels share distances and cluster
    u = np.stack([code // 65536, code // 256 % 256, code % 256])
    rng, best = np.random.default_rng(0), (np.inf, None, None)
    for _ in range(starts):
        c = px[rng.choice(len(px), k, replace=len(px) < k)]
        for _ in range(rounds):
            d = sum((x[:, None] - c[:, j]) ** 2 for j, x in enumerate(u))
            own = d.argmin(1)
            size = np.bincount(own, n, k)
            new = np.where(size[:, None] > 0, np.stack([np.bincount(own, n * x, k) for x in u], 1) / np.maximum(size, 1)[:, None], c)
            if np.allclose(new, c):
                break
            c = new
        if (loss := (n * d.min(1)).sum()) < best[0]:
            best = (loss, c, size / len(px))
    order = np.argsort(-best[2], kind="stable")
    return np.hstack([best[1][order], best[2][order, None]]).ravel()


def color_vector(img: np.ndarray) -> np.ndarray:
    """Means of R, G, B, saturation and value, over 255."""
    return np.concatenate([img.reshape(-1, 3).mean(0)[::-1], hsv(img).reshape(-1, 3).mean(0)[1:]]) / 255


@lru_cache(1)
def _projection(n: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(n, 64)))
    return q


def fused_hash(img: np.ndarray) -> np.ndarray:
    """64 bits from standardised hash, spectrum, moments and colours, by one fixed random projection."""
    scales = [_spectrum(resize(grey(img), n, n)).ravel()[:8] for n in (16, 32, 64, 128)]
    parts = [np.array([int(b) for b in dct_hash(img)[:32]], float), fft_features(img)[:64], fmt_signature(img)[:32], hu_moments(img), rgb_moments(img)[[0, 3, 6, 1, 4, 7]], np.concatenate(scales)]
    v = np.concatenate([(p - p.mean()) / (p.std() + 1e-8) for p in parts])
    y = v @ _projection(len(v))
    return (y > np.median(y)).astype(np.uint8)


@lru_cache(1)
def _brief() -> np.ndarray:
    return np.clip(np.rint(np.random.default_rng(0).normal(0, 5, (256, 4))), -12, 12).astype(int)


def orb(img: np.ndarray, most: int = 100, levels: int = 8, scale: float = 1.2) -> np.ndarray:
    """At most ``most`` oriented binary descriptors (n x 32 bytes) of corners over a pyramid."""
    g, found = grey(img), []
    for level in range(levels):
        f = scale**-level
        h, w = int(g.shape[0] * f), int(g.shape[1] * f)
        if min(h, w) < 31:
            break
        s = resize(g, h, w)
        gx, gy = _sobel(s)
        a, b, c = box_blur(gx * gx, 7), box_blur(gy * gy, 7), box_blur(gx * gy, 7)
        score = a * b - c * c - 0.04 * (a + b) ** 2
        q = np.pad(score, 1, constant_values=-np.inf)
        peak = np.ones(score.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= score >= q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
        peak[:15] = peak[-15:] = peak[:, :15] = peak[:, -15:] = False
        smooth = box_blur(s, 5)
        for y, x in zip(*np.nonzero(peak & (score > 1e4)), strict=True):
            found.append((-score[y, x], level, y, x, smooth))
    found.sort(key=lambda t: t[:4])
    out = []
    yy, xx = np.mgrid[-7:8, -7:8]
    for _, _, y, x, s in found[:most]:
        patch = s[y - 7 : y + 8, x - 7 : x + 8]
        angle = np.arctan2((patch * yy).sum(), (patch * xx).sum())
        r = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        p, q = (np.clip(np.rint(_brief()[:, i : i + 2] @ r.T), -15, 15).astype(int) for i in (0, 2))
        at = lambda o, s=s, y=y, x=x: s[np.clip(y + o[:, 1], 0, s.shape[0] - 1), np.clip(x + o[:, 0], 0, s.shape[1] - 1)]
        out.append(np.packbits(at(p) < at(q)))
    return np.array(out, np.uint8).reshape(-1, 32)


def sift(img: np.ndarray, most: int = 100) -> np.ndarray:
    """At most ``most`` gradient-histogram descriptors (n x 128) of blobs over three scales."""
    g, found = grey(img), []
    for level, k in enumerate((3, 5, 9)):
        diff = np.abs(box_blur(g, k) - box_blur(g, 2 * k + 1)) if min(g.shape) > 2 * k + 1 else np.zeros_like(g)
        q = np.pad(diff, 1)
        peak = (diff > 3) & np.all([diff >= q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0)
        peak[:8] = peak[-8:] = peak[:, :8] = peak[:, -8:] = False
        found += [(-diff[y, x], level, y, x) for y, x in zip(*np.nonzero(peak), strict=True)]
    gx, gy = _sobel(g)
    mag, bins = np.hypot(gx, gy), ((np.arctan2(gy, gx) / (2 * np.pi) % 1) * 8).astype(int) % 8
    out = []
    for _, _, y, x in sorted(found)[:most]:
        m, b = mag[y - 8 : y + 8, x - 8 : x + 8], bins[y - 8 : y + 8, x - 8 : x + 8]
        cell = (np.arange(16) // 4)[:, None] * 4 + np.arange(16) // 4
        v = _unit(np.bincount((cell * 8 + b).ravel(), m.ravel(), 128))
        out.append(_unit(np.minimum(v, 0.2)))
    return np.array(out, np.float32).reshape(-1, 128)


def signature(descriptors: np.ndarray, spread: bool = False) -> np.ndarray:
    """Mean of the descriptors (with their spread behind it for I7); empty without any."""
    if not len(descriptors):
        return np.zeros(0)
    return np.concatenate([descriptors.mean(0), descriptors.std(0)]) if spread else descriptors.mean(0)


# Matching of keypoints

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def match_orb(a: np.ndarray, b: np.ndarray, most: int = 50) -> tuple[int, float]:
    """Mutual nearest neighbours closer than ``most`` bits, and their share of the smaller side."""
    if not len(a) or not len(b):
        return 0, 0.0
    d = _POP[a[:, None] ^ b[None]].sum(2, dtype=np.int64)
    near, back = d.argmin(1), d.argmin(0)
    mutual = back[near] == np.arange(len(a))
    good = int((mutual & (d[np.arange(len(a)), near] < most)).sum())
    return good, good / min(len(a), len(b))


def match_sift(a: np.ndarray, b: np.ndarray, ratio: float = 0.7) -> float:
    """Share of descriptors whose nearest neighbour is clearly nearer than the second."""
    if len(a) < 2 or len(b) < 2:
        return 0.0
    d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
    two = np.partition(d, 1, 1)[:, :2]
    return float((two[:, 0] < ratio * two[:, 1]).sum() / min(len(a), len(b)))


def correlation_max(a: np.ndarray, b: np.ndarray) -> float:
    """The largest linear cross-correlation."""
    n = 2 * len(a)
    return float(np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n).max())


# Optional, of the documentation only


def average_hash(img: np.ndarray) -> str:
    """Cells over the mean of all.  Colours of cells are whole numbers divided once, and sums go from left to right:
    a cell as bright as the mean is settled by its colours alone, as in a plain formula, not by the resizing."""
    scale = [n if n >= 8 else 16 for n in img.shape[:2]]  # makes every weight a whole number
    y, x = (np.rint(_weights(n, 8) * k) for n, k in zip(img.shape[:2], scale, strict=True))
    b, g, r = (y @ img[:, :, i].astype(np.float64) @ x.T / (scale[0] * scale[1]) for i in range(3))
    cells = (0.114 * b + 0.587 * g + 0.299 * r).ravel()
    return "".join("1" if v else "0" for v in cells > np.cumsum(cells)[-1] / 64)


def difference_hash(img: np.ndarray) -> str:
    g = resize(grey(img), 8, 9)
    return "".join("1" if v else "0" for v in (g[:, 1:] > g[:, :-1]).ravel())


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two images at 128 x 128."""
    x, y = (resize(grey(i), SIDE, SIDE) for i in (a, b))
    mx, my = box_blur(x, 7), box_blur(y, 7)
    vx, vy, cxy = box_blur(x * x, 7) - mx**2, box_blur(y * y, 7) - my**2, box_blur(x * y, 7) - mx * my
    return float((((2 * mx * my + 6.5025) * (2 * cxy + 58.5225)) / ((mx**2 + my**2 + 6.5025) * (vx + vy + 58.5225))).mean())


def edge_histogram(img: np.ndarray) -> np.ndarray:
    """Eight directions of the gradient, weighted by its strength."""
    gx, gy = _sobel(grey(img))
    h = np.bincount(((np.arctan2(gy, gx) / (2 * np.pi) % 1) * 8).astype(int).ravel() % 8, np.hypot(gx, gy).ravel(), 8)
    return h / (h.sum() or 1)


def hog(img: np.ndarray) -> np.ndarray:
    """1764 numbers: 8-pixel cells of a 64 x 64 image, nine directions, blocks of two by two of unit length."""
    gx, gy = _sobel(resize(grey(img), 64, 64))
    bins = ((np.arctan2(gy, gx) / np.pi % 1) * 9).astype(int) % 9
    cell = (np.arange(64) // 8)[:, None] * 8 + np.arange(64) // 8
    h = np.bincount((cell * 9 + bins).ravel(), np.hypot(gx, gy).ravel(), 576).reshape(8, 8, 9)
    return np.concatenate([_unit(h[y : y + 2, x : x + 2].ravel()) for y in range(7) for x in range(7)])


# All at once

G3_SCHEMA = """valid boolean, error string, phash string, phash_bucket string, phash_words array<long>, color_histogram array<double>,
orb_descriptors array<binary>, orb_keypoints_count int, composition struct<text_score:double,symbol_score:double,edge_density:double,layout:string>,
dct_hash string, fft_hash string"""
G2_SCHEMA = """valid boolean, error string, phash string, fft_features array<double>, fmt_signature array<double>, color_aware_fmt array<double>,
saliency_weighted_fft array<double>, hu_moments array<double>, zernike_moments array<double>, deep_fused_hash array<int>, lbp array<double>, glcm array<double>,
gabor array<double>, rgb_moments array<double>, hsv_moments array<double>, dominant_colors array<double>, sift_signature array<double>,
orb_signature array<double>, color_vector array<double>, sift_descriptors array<array<double>>, orb_descriptors array<binary>"""


def g3_features(data: bytes | None) -> dict:
    """Features of the production path; of an invalid image only ``valid`` and ``error``."""
    img = decode(data)
    if img is None:
        return {"valid": False, "error": "undecodable or too small"}
    h, o = phash(img), orb(img)
    return {
        "valid": True, "phash": h, "phash_bucket": h[:8], "phash_words": [int(h[i : i + 8], 16) for i in range(0, 64, 8)], "color_histogram": hsv_histogram(img).tolist(),
        "orb_descriptors": [r.tobytes() for r in o], "orb_keypoints_count": len(o), "composition": composition(img), "dct_hash": dct_hash(img), "fft_hash": fft_hash(img),
    }


def g2_features(data: bytes | None) -> dict:
    """Features of the research path, from a 128 x 128 image."""
    img = decode(data)
    if img is None:
        return {"valid": False, "error": "undecodable or too small"}
    img = np.clip(np.rint(resize(img, SIDE, SIDE)), 0, 255).astype(np.uint8)
    s, o = sift(img), orb(img, 50)
    lists = {
        "fft_features": fft_features(img), "fmt_signature": fmt_signature(img), "color_aware_fmt": color_fmt(img), "saliency_weighted_fft": saliency_fft(img), "hu_moments": hu_moments(img),
        "zernike_moments": zernike(img), "lbp": lbp_stats(img), "glcm": glcm_stats(img), "gabor": gabor_stats(img), "rgb_moments": rgb_moments(img), "hsv_moments": hsv_moments(img),
        "dominant_colors": dominant_colors(img), "sift_signature": signature(s, True), "orb_signature": signature(o), "color_vector": color_vector(img),
    }
    return {"valid": True, "phash": dct_hash(img), "deep_fused_hash": fused_hash(img).tolist(), "sift_descriptors": s.tolist(), "orb_descriptors": [r.tobytes() for r in o]} | {k: v.tolist() for k, v in lists.items()}


def with_features(images, features=g3_features, schema: str = G3_SCHEMA, content: str = "content"):
    """``images`` with a struct column of features, one decode an image.

    Byte-identical images are decoded once: features are made for distinct contents and joined back by hash.
    Contents are dealt out to all tasks: by their few bytes, which say nothing of the work, they would go to one.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType
    from pyspark.sql.types import _parse_datatype_string as parse_type

    keyed = images.withColumn("content_hash", F.sha2(content, 256))
    once = keyed.groupBy("content_hash").agg(F.first(content).alias(content))
    kind = StructType([*parse_type("content_hash string"), *parse_type(schema)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = [{"content_hash": h} | features(d) for h, d in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = once.select("content_hash", content).repartition(tasks, F.xxhash64("content_hash")).mapInArrow(run, kind)
    packed = made.select("content_hash", F.struct(*[c for c in made.columns if c != "content_hash"]).alias("features"))
    return keyed.join(packed, "content_hash")
