"""Numpy helpers on single images; Spark deals the images out. Those that say so
take stacks as well: images of one size along the axes before the last two, each
treated as alone. ``border`` rules are stated where they matter."""

from __future__ import annotations

import numpy as np

GRAY = (0.299, 0.587, 0.114)


def to_gray(bgr: np.ndarray) -> np.ndarray:
    """(H, W, 3) in blue, green, red order to uint8 luminance."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    return np.rint(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b).clip(0, 255).astype(np.uint8)


def crop(image: np.ndarray, box: tuple[int, int, int, int], least: tuple[int, int] = (0, 0)) -> np.ndarray:
    """A box, padded by its edge pixels to a least (height, width)."""
    x0, y0, x1, y1 = box
    part = image[max(0, y0) : y1, max(0, x0) : x1]
    pad = [(0, max(0, n - s)) for n, s in zip(least, part.shape[:2], strict=True)] + [(0, 0)] * (image.ndim - 2)
    return np.pad(part, pad, mode="edge") if part.size else part


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, edges held."""
    h, w = image.shape[:2]
    y = ((np.arange(height) + 0.5) * h / height - 0.5).clip(0, h - 1)
    x = ((np.arange(width) + 0.5) * w / width - 0.5).clip(0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    f = image.astype(np.float64)
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out


def resize_padded(image: np.ndarray, size: int) -> np.ndarray:
    """Aspect kept, centred on black."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    part = resize(image, max(1, int(h * scale)), max(1, int(w * scale)))
    out = np.zeros((size, size, *image.shape[2:]), dtype=image.dtype)
    top, left = (size - part.shape[0]) // 2, (size - part.shape[1]) // 2
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def mirrored(image: np.ndarray, before: tuple[int, int], after: tuple[int, int]) -> np.ndarray:
    """Padded by its mirror image, in which the edge pixel is left out. Takes stacks."""
    places = []
    for n, p, q in zip(image.shape[-2:], before, after, strict=True):
        period = max(1, 2 * (n - 1))
        at = np.arange(-p, n + q) % period
        places.append(np.minimum(at, period - at))
    return image[..., places[0][:, None], places[1]]


def filtered(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation, mirrored without the edge pixel. The
    image is moved and added up once for each weight. Takes stacks."""
    ky, kx = kernel.shape
    h, w = image.shape[-2:]
    padded = mirrored(image.astype(np.float64), (ky // 2, kx // 2), (ky // 2, kx // 2))
    out, part = np.zeros(image.shape), np.empty(image.shape)
    for y, x in zip(*np.nonzero(kernel), strict=True):
        out += np.multiply(padded[..., y : y + h, x : x + w], kernel[y, x], out=part)
    return out


def smoothed(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """As filtered by the outer product of symmetric weights: down, then across."""
    (h, w), n = image.shape, len(weights)
    padded = mirrored(image.astype(np.float64), (n // 2, n // 2), (n // 2, n // 2))
    down = sum(weights[k] * padded[k : k + h] for k in range(n))
    return sum(weights[k] * down[:, k : k + w] for k in range(n))


SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
LAPLACE = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])


def edges(gray: np.ndarray) -> np.ndarray:
    """Gradient magnitude scaled to 255."""
    m = np.hypot(filtered(gray, SOBEL), filtered(gray, SOBEL.T))
    return np.zeros(gray.shape, np.uint8) if m.max() <= 0 else np.rint(m * 255 / m.max()).astype(np.uint8)


def equalised(gray: np.ndarray, clip: float = 4.0, grid: int = 4) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: a mapping per tile
    with its histogram clipped, blended bilinearly between tile centres."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            tile = gray[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * tile.size / 256)
            extra = np.maximum(counts - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, top) + extra / 256) * 255 / tile.size
    fy = ((np.arange(h) + 0.5) * grid / h - 0.5).clip(0, grid - 1)
    fx = ((np.arange(w) + 0.5) * grid / w - 0.5).clip(0, grid - 1)
    i, j = np.floor(fy).astype(int)[:, None], np.floor(fx).astype(int)[None, :]
    i1, j1 = np.minimum(i + 1, grid - 1), np.minimum(j + 1, grid - 1)
    a, b = fy[:, None] - i, fx[None, :] - j
    out = (maps[i, j, gray] * (1 - b) + maps[i, j1, gray] * b) * (1 - a) + (maps[i1, j, gray] * (1 - b) + maps[i1, j1, gray] * b) * a
    return np.rint(out.clip(0, 255)).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between classes, first one."""
    c = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, total, mass = np.cumsum(c), c.sum(), np.cumsum(c * np.arange(256))
    high = total - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return int(np.argmax(np.nan_to_num(between, nan=-1.0, posinf=-1.0)))


def foreground(gray: np.ndarray) -> np.ndarray:
    """Otsu mask; flipped when over half is white."""
    mask = gray > otsu(gray)
    return ~mask if mask.mean() > 0.5 else mask


def shifted(image: np.ndarray, dy: int, dx: int, fill: float = 0) -> np.ndarray:
    out = np.full_like(image, fill)
    h, w = image.shape[:2]
    if abs(dy) < h and abs(dx) < w:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = image[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    return out


def centred(gray: np.ndarray) -> np.ndarray:
    """Moved so that the foreground's centroid is in the middle; edges repeat."""
    y, x = np.nonzero(foreground(gray))
    if not len(y):
        return gray
    h, w = gray.shape[:2]
    dy, dx = int(round(h / 2 - y.mean())), int(round(w / 2 - x.mean()))
    return gray[(np.arange(h) - dy).clip(0, h - 1)][:, (np.arange(w) - dx).clip(0, w - 1)]


def best_shift(gray: np.ndarray, template: np.ndarray, most: int = 10) -> tuple[int, int]:
    """The shift within ``most`` pixels with the highest normalised
    cross-correlation; the smallest where several are. Sums over what stays in
    the image come from running sums; only the product is taken anew."""
    g, t = gray.astype(float), template - template.mean()
    (h, w), tt = g.shape, float((t * t).sum())
    running = [np.pad(v, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1) for v in (g, g * g)]
    best, at = -2.0, (0, 0)
    for dy, dx in sorted(((a, b) for a in range(-most, most + 1) for b in range(-most, most + 1)), key=lambda s: (abs(s[0]) + abs(s[1]), s)):
        score = 0.0
        if abs(dy) < h and abs(dx) < w:
            y0, y1, x0, x1 = max(0, -dy), h - max(0, dy), max(0, -dx), w - max(0, dx)
            total, squares = (float(s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]) for s in running)
            spread = squares - total * total / (h * w)
            if spread > 1e-9 * squares and tt > 0:
                score = float(np.einsum("ij,ij->", g[y0:y1, x0:x1], t[y0 + dy : y1 + dy, x0 + dx : x1 + dx])) / np.sqrt(spread * tt)
        if score > best + 1e-12:
            best, at = score, (dy, dx)
    return at


def gaussian_line(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-x * x / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    w = gaussian_line(size, sigma)
    return np.outer(w, w)


def ssim_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = gaussian_line(11, 1.5)
    a, b = a.astype(float), b.astype(float)
    ma, mb = smoothed(a, k), smoothed(b, k)
    va, vb, cov = smoothed(a * a, k) - ma * ma, smoothed(b * b, k) - mb * mb, smoothed(a * b, k) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def structural_score(gray: np.ndarray, template: np.ndarray, mask: np.ndarray) -> float:
    """1 - first percentile of the similarity inside the foreground."""
    return 0.0 if mask.sum() < 10 else float(1 - np.percentile(ssim_map(gray, template)[mask], 1))


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set pixel to the nearest unset one;
    separable, by columns and then by rows. Without unset pixels: infinite."""
    h, w = mask.shape
    g = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        np.minimum(g[y], g[y - 1] + 1, out=g[y])
    for y in range(h - 2, -1, -1):
        np.minimum(g[y], g[y + 1] + 1, out=g[y])
    # whole numbers, which single precision holds exactly below 2**24
    kind = np.float32 if h * h + w * w < 1 << 24 else np.float64
    g2 = np.ascontiguousarray((g * g).astype(kind).T)[..., None]
    apart = ((np.arange(w)[:, None] - np.arange(w)) ** 2).astype(kind)
    out = np.full((h, w), np.inf, dtype=kind)
    for k in range(w):
        np.minimum(out, g2[k] + apart[k], out=out)
    return np.sqrt(out.astype(np.float64))


def morphology(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a square; beyond the image counts as neutral."""
    p = size // 2
    (h, w), join = mask.shape, np.logical_or if grow else np.logical_and
    padded = np.pad(mask.astype(bool), ((p, size - 1 - p),) * 2, constant_values=not grow)
    down = padded[:h].copy()
    for k in range(1, size):
        join(down, padded[k : k + h], out=down)
    out = down[:, :w].copy()
    for k in range(1, size):
        join(out, down[:, k : k + w], out=out)
    return out


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return morphology(morphology(mask, size, True), size, False)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return morphology(morphology(mask, size, False), size, True)


def shape_score(gray: np.ndarray, template_mask: np.ndarray) -> float:
    """p99 of the difference of the distances to the nearest foreground pixel,
    inside the grown template."""
    a, b = distance_transform(~foreground(gray)), distance_transform(~template_mask)
    area = morphology(template_mask, 9, True)
    d = np.abs(a - b)[area]
    return float(np.percentile(d[np.isfinite(d)], 99)) if np.isfinite(d).any() else 0.0


def labelled(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Component numbers from 1 in scan order of their first pixel, 0 outside.
    Runs of each row are linked to those that they touch in the next row."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    width, reach = w + 2, int(diagonal)
    first = np.searchsorted(row * width + end, (row + 1) * width + begin - reach, side="right")
    last = np.searchsorted(row * width + begin, (row + 1) * width + end + reach, side="left")
    number = np.maximum(0, last - first)
    a = np.repeat(np.arange(len(row)), number)
    b = np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    root = np.arange(len(row))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    out = np.zeros(mask.shape, dtype=np.int64)
    out[mask.astype(bool)] = np.repeat(np.cumsum(root == np.arange(len(root)))[root], end - begin)
    return out


def regions(mask: np.ndarray, heat: np.ndarray, least: int, most: int = 10) -> list[dict]:
    """Four-neighbour regions of at least an area, by falling score."""
    label = labelled(mask)
    y, x = np.nonzero(label)
    if not len(y):
        return []
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order], x[order]
    starts = np.flatnonzero(np.diff(label[y, x], prepend=0))
    area = np.diff(np.append(starts, len(y)))
    low = lambda v: np.minimum.reduceat(v, starts)
    high = lambda v: np.maximum.reduceat(v, starts)
    rows = zip(low(x), low(y), high(x), high(y), high(heat[y, x]), area, strict=True)
    out = [{"x": int(a), "y": int(b), "w": int(c - a) + 1, "h": int(d - b) + 1, "score": float(s), "area_px": int(n)} for a, b, c, d, s, n in rows if n >= least]
    return sorted(out, key=lambda r: (-r["score"], r["y"], r["x"]))[:most]


def as_one(stack: np.ndarray) -> np.ndarray:
    """Masks below each other with an empty row between: no component is of two."""
    return np.pad(stack, ((0, 0), (0, 1), (0, 0))).reshape(-1, stack.shape[2])


def members(label: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Pixels of the components with these numbers; 0 is none."""
    held = np.zeros(int(label.max(initial=0)) + 1, dtype=bool)
    held[numbers] = True
    held[0] = False
    return held[label]


def border_connected(mask: np.ndarray, side: str, border: int = 8) -> np.ndarray:
    """Eight-neighbour components that reach a band along the left or right border."""
    label = labelled(mask, diagonal=True)
    return members(label, label[:, :border] if side == "L" else label[:, -border:])


def hysteresis(low: np.ndarray, high: np.ndarray, side: str, border: int = 8) -> np.ndarray:
    """Eight-neighbour components of the low mask that hold a seed: a pixel of
    a component of the high mask that reaches the border's band. Takes stacks."""
    if low.ndim == 3:
        n, h, w = low.shape
        return hysteresis(as_one(low), as_one(high), side, border).reshape(n, h + 1, w)[:, :h]
    label = labelled(low, diagonal=True)
    return members(label, label[border_connected(high, side, border)])


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square, mirrored without the edge pixel, by running sums. Takes stacks."""
    p = size // 2
    padded = mirrored(image.astype(float), (p, p), (size - 1 - p, size - 1 - p))
    s = np.zeros((*padded.shape[:-2], padded.shape[-2] + 1, padded.shape[-1] + 1))
    np.cumsum(np.cumsum(padded, axis=-2), axis=-1, out=s[..., 1:, 1:])
    return (s[..., size:, size:] - s[..., :-size, size:] - s[..., size:, :-size] + s[..., :-size, :-size]) / size**2


def local_std(gray: np.ndarray, size: int) -> np.ndarray:
    g = gray.astype(float)
    return np.sqrt(np.maximum(box_mean(g * g, size) - box_mean(g, size) ** 2, 0))


def column_profile(gray: np.ndarray, kind: str = "mean", trim: float = 0.05) -> np.ndarray:
    """One value per column: trimmed mean of gray, gradient, texture or edges (of
    one image; the others take stacks)."""
    g = gray.astype(float)
    values = {"mean": lambda: g, "gradient": lambda: np.abs(filtered(g, SOBEL)), "texture": lambda: local_std(g, 5), "binary_edge": lambda: (edges(gray) >= 50).astype(float)}[kind]()
    h = values.shape[-2]
    k = 0 if kind == "binary_edge" else max(1, int(h * trim))
    s = np.sort(values, axis=-2)
    return s[..., k : h - k, :].mean(axis=-2) if h > 2 * k else s.mean(axis=-2)


def row_stretched(gray: np.ndarray) -> np.ndarray:
    low, high = np.percentile(gray, 10, axis=1, keepdims=True), np.percentile(gray, 90, axis=1, keepdims=True)
    return ((gray - low) / np.maximum(high - low, 1e-6)).clip(0, 1)


#: Shares of darkness and smoothness in the slot score.
SLOT = (0.7, 0.3)


def row_percentiles(image: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Interpolated percentiles of each row, as columns; those of bytes from a
    histogram of every row, without sorting."""
    h, w = image.shape
    if image.dtype != np.uint8:
        return list(np.percentile(image, [100 * s for s in shares], axis=1)[..., None].astype(np.float32))
    counts = np.bincount((np.arange(h, dtype=np.int32)[:, None] * 256 + image).ravel(), minlength=256 * h).reshape(h, 256).cumsum(axis=1)
    ranked = lambda k: (counts > k).argmax(axis=1)[:, None]
    places = [s * (w - 1) for s in shares]
    return [(ranked(int(p)) + (ranked(int(np.ceil(p))) - ranked(int(p))) * (p - int(p))).astype(np.float32) for p in places]


def percentile_of(image: np.ndarray, share: float) -> np.ndarray:
    """Interpolated percentile of all pixels, by selection. Takes stacks."""
    flat = image.reshape(*image.shape[:-2], -1)
    place = share * (flat.shape[-1] - 1)
    low, high = int(place), int(np.ceil(place))
    part = np.partition(flat, (low, high), axis=-1)
    return part[..., low] + (part[..., high] - part[..., low]) * (place - low)


def small_std(image: np.ndarray, size: int) -> np.ndarray:
    """As local_std, for small squares in single precision: sums over rows and
    columns by doubling. Takes stacks."""
    p = size // 2
    padded = mirrored(image, (p, p), (size - 1 - p, size - 1 - p))

    def sums(a: np.ndarray) -> np.ndarray:
        """Of ``size`` neighbouring rows."""
        out, done, step, power, n = None, 0, 1, a, a.shape[-2]
        while step <= size:
            if size & step:
                out = power[..., : n - size + 1, :] if out is None else out + power[..., done : done + n - size + 1, :]
                done += step
            step *= 2
            if step <= size:
                power = power[..., : -(step // 2), :] + power[..., step // 2 :, :]
        return out

    def sums_along(a: np.ndarray) -> np.ndarray:
        if size != 5:
            return sums(a.swapaxes(-1, -2)).swapaxes(-1, -2)
        s2 = a[..., :-1] + a[..., 1:]
        return s2[..., :-3] + s2[..., 2:-1] + a[..., 4:]

    middle = sums_along(sums(padded))
    middle *= np.float32(1 / size**2)
    out = sums_along(sums(padded * padded))
    out *= np.float32(1 / size**2)
    out -= middle * middle
    return np.sqrt(np.maximum(out, 0, out=out), out=out)


def column_medians(image: np.ndarray) -> np.ndarray:
    """Takes stacks."""
    by_column, half = np.ascontiguousarray(image.swapaxes(-1, -2)), image.shape[-2] // 2
    if image.shape[-2] % 2:
        return np.partition(by_column, half, axis=-1)[..., half]
    part = np.partition(by_column, (half - 1, half), axis=-1)
    return (part[..., half - 1] + part[..., half]) / 2


def slot_score(bright: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much each pixel looks like a groove, dark and smooth, and the column
    of the groove's centre. Brightness counts row by row from its 10th to its 90th
    percentile. Takes stacks."""
    low, high = (q.reshape(*bright.shape[:-1], 1) for q in row_percentiles(bright.reshape(-1, bright.shape[-1]), (0.1, 0.9)))
    level = ((bright.astype(np.float32) - low) * (1 / (high - low + 1e-6))).clip(0, 1)
    texture = small_std(level, 5)
    scale = (1 / (np.asarray(percentile_of(texture, 0.99), dtype=np.float64) + 1e-6)).astype(np.float32)[..., None, None]
    slot = (SLOT[0] + SLOT[1]) - SLOT[0] * level - SLOT[1] * (texture * scale).clip(0, 1)
    size = min(21, bright.shape[-1] // 4 * 2 + 1)
    x = np.arange(size) - (size - 1) / 2
    weights = np.exp(-x * x / (2 * (0.3 * ((size - 1) / 2 - 1) + 0.8) ** 2))
    weights /= weights.sum()
    return slot, np.apply_along_axis(lambda m: np.argmin(np.convolve(m, weights, mode="same")), -1, column_medians(level))


def left_boundary(image: np.ndarray, block: int = 8, threshold: float = 0.55, run: int = 3, envelope: int = 9, median: int = 5) -> np.ndarray:
    """Per block of rows the x at which, seen from the groove's centre to the
    left, the slot score first stays below a threshold for a run of pixels.
    Blocks without one are interpolated; then the innermost x of neighbouring
    blocks (the teeth's tips), and a median, with mirrored ends. An image of three
    channels counts by the largest."""
    return left_boundaries((image.max(axis=2) if image.ndim == 3 else image)[None], block, threshold, run, envelope, median)[0]


def left_boundaries(stack: np.ndarray, block: int = 8, threshold: float = 0.55, run: int = 3, envelope: int = 9, median: int = 5) -> np.ndarray:
    """left_boundary of each image of a stack."""
    count, h, w = stack.shape
    n = h // block
    if not n:
        return np.zeros((count, 0), dtype=np.int64)
    slot, centre = slot_score(stack)
    below = slot[:, : n * block].reshape(count, n, block, w).mean(axis=2) < threshold
    starts = np.zeros(below.shape, dtype=bool)
    starts[..., run - 1 :] = np.lib.stride_tricks.sliding_window_view(below, run, axis=2).all(axis=3) if w >= run else False
    starts &= np.arange(w) <= centre[:, None, None]
    found = np.where(starts.any(axis=2), w - np.argmax(starts[..., ::-1], axis=2), 0)
    for k in np.flatnonzero((found <= 0).any(axis=1) | ((found > 0).sum(axis=1) < 2)):
        valid = np.flatnonzero(found[k] > 0)
        if len(valid) < 2:
            found[k] = centre[k] // 2
        else:
            missing = np.flatnonzero(found[k] <= 0)
            found[k, missing] = np.interp(missing, valid, found[k, valid]).astype(np.int64)
    view = lambda v, size: np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (size // 2, size // 2)), mode="symmetric"), size, axis=1)
    return np.median(view(view(found, envelope).max(axis=2), median), axis=2).astype(np.int64)


def percentile_scaled(image: np.ndarray, low: float = 1, high: float = 99, stride: int = 4) -> np.ndarray:
    """To 0..1 between two order statistics of every stride-th pixel. Takes stacks."""
    sample = image.reshape(*image.shape[:-2], -1)[..., ::stride]
    at = [int(q / 100 * (sample.shape[-1] - 1)) for q in (low, high)]
    part = np.partition(sample, at, axis=-1)
    a, b = (part[..., k][..., None, None] for k in at)
    return ((image - a) / (b - a + 1e-6)).clip(0, 1)


#: Weights of texture, curvature and vertical gradient, and of
#: horizontal gradient beyond the vertical; shares of the way from the groove's
#: level to the border's at which a side's thresholds lie (high, low).
METAL, PENALTY = (0.42, 0.33, 0.25), 0.18
SIDES = {"L": (0.55, 0.35), "R": (0.62, 0.40)}


def metal_score(gray: np.ndarray, weights=METAL, penalty: float = PENALTY) -> np.ndarray:
    """Takes stacks."""
    g = filtered(gray.astype(float) / 255, gaussian_kernel(3, 0.6))
    texture, curvature, across, along = (percentile_scaled(p) for p in (local_std(g, 5), np.abs(filtered(g, LAPLACE)), np.abs(filtered(g, SOBEL)), np.abs(filtered(g, SOBEL.T))))
    score = weights[0] * texture + weights[1] * curvature + weights[2] * along - penalty * np.maximum(0, across - along)
    return score.clip(0, 1)


def side_thresholds(score: np.ndarray, border_share: float = 0.03, groove_share: float = 0.10) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(high, low) per side, from the 95th percentile of the middle columns and
    the median of the side's border columns. Takes stacks."""
    w = score.shape[-1]
    border, groove = max(6, int(round(w * border_share))), max(14, int(round(w * groove_share)))
    flat = lambda part: part.reshape(*part.shape[:-2], -1)
    middle = np.percentile(flat(score[..., max(0, w // 2 - groove // 2) : w // 2 + groove // 2]), 95, axis=-1)
    at = {"L": np.median(flat(score[..., :border]), axis=-1), "R": np.median(flat(score[..., w - border :]), axis=-1)}
    return {side: tuple(middle + share * (at[side] - middle) for share in shares) for side, shares in SIDES.items()}


def polygon_mask(polygons: list[list[list[float]]], height: int, width: int) -> np.ndarray:
    """Union of polygons by scan lines through pixel centres."""
    out = np.zeros((height, width), dtype=bool)
    for points in polygons:
        p = np.asarray(points, dtype=float)
        if len(p) < 3:
            continue
        a, b = p, np.roll(p, -1, axis=0)
        for y in range(max(0, int(p[:, 1].min())), min(height, int(np.ceil(p[:, 1].max())) + 1)):
            c = y + 0.5
            cross = (a[:, 1] <= c) != (b[:, 1] <= c)
            x = np.sort(a[cross, 0] + (c - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
            for x0, x1 in zip(x[::2], x[1::2], strict=True):
                out[y, max(0, int(np.ceil(x0 - 0.5))) : max(0, min(width, int(np.ceil(x1 - 0.5))))] = True
    return out


def polygon_area(points: np.ndarray, height: int, width: int) -> int:
    """Pixels of one polygon's mask, without an image: all scan lines at once."""
    a, b = points, np.roll(points, -1, axis=0)
    c = np.arange(max(0, int(a[:, 1].min())), min(height, int(np.ceil(a[:, 1].max())) + 1))[:, None] + 0.5
    cross = (a[:, 1] <= c) != (b[:, 1] <= c)
    rise = np.where(a[:, 1] == b[:, 1], 1.0, b[:, 1] - a[:, 1])
    x = np.sort(np.where(cross, a[:, 0] + (c - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise, np.inf), axis=1)
    ends = np.ceil(x[:, : x.shape[1] // 2 * 2] - 0.5).clip(0, width)
    return int((ends[:, 1::2] - ends[:, ::2]).sum())


def probability_mask(p: np.ndarray, height: int, width: int, threshold: float = 0.5, close: int = 5, open_: int = 3) -> np.ndarray:
    return opened(closed(resize(p.astype(float), height, width) > threshold, close), open_)


def augmented(image: np.ndarray, mask: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same flips and turns for both; brightness, contrast and noise for
    the image alone."""
    if rng.random() < 0.5:
        image, mask = image[:, ::-1], mask[:, ::-1]
    if rng.random() < 0.5:
        image, mask = image[::-1], mask[::-1]
    k = int(rng.integers(4))
    image, mask = np.rot90(image, k), np.rot90(mask, k)
    out = (image.astype(float) - 128) * rng.uniform(0.8, 1.2) + 128 + rng.uniform(-20, 20) + rng.normal(0, 2, image.shape)
    return np.rint(out.clip(0, 255)).astype(np.uint8), mask


#: Kind, share, least and largest size.
DEFECTS = (("cutout", 0.30, 3, 14), ("fade", 0.25, 10, 26), ("blob", 0.20, 2, 8), ("paste", 0.15, 6, 18), ("blur", 0.10, 8, 20))
CLEAN_SHARE = 0.2


def with_defect(gray: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, str]:
    """A synthetic defect with its mask and kind; a share stays clean."""
    out, mask = gray.astype(float).copy(), np.zeros(gray.shape, dtype=bool)
    if rng.random() < CLEAN_SHARE:
        return gray.copy(), mask, "clean"
    kind, _, least, most = DEFECTS[int(rng.choice(len(DEFECTS), p=[d[1] for d in DEFECTS]))]
    h, w = gray.shape
    size = int(min(rng.integers(least, most + 1), h, w))
    y, x = int(rng.integers(0, h - size + 1)), int(rng.integers(0, w - size + 1))
    box = (slice(y, y + size), slice(x, x + size))
    if kind == "cutout":
        out[box] = np.median(gray)
    elif kind == "fade":
        out[box] = out[box] * 0.4 + np.median(gray) * 0.6
    elif kind == "paste":
        sy, sx = int(rng.integers(0, h - size + 1)), int(rng.integers(0, w - size + 1))
        out[box] = gray[sy : sy + size, sx : sx + size]
    elif kind == "blur":
        out[box] = box_mean(gray, 5)[box]
    if kind == "blob":
        yy, xx = np.mgrid[:size, :size]
        disc = (yy - (size - 1) / 2) ** 2 + (xx - (size - 1) / 2) ** 2 <= (size / 2) ** 2
        out[box][disc] = rng.choice([0, 255])
        mask[box] = disc
    else:
        mask[box] = True
    return np.rint(out.clip(0, 255)).astype(np.uint8), mask, kind
