"""Small single-machine forms of the published formulas, for comparison only."""

from __future__ import annotations

import numpy as np


def hamming(code1, mask1, code2, mask2):
    usable = ~(mask1 | mask2).astype(bool)
    return (code1 != code2)[usable].mean() if usable.any() else -1.0


def shifted(bits, ky, kx):
    rows = np.arange(bits.shape[0])[:, None] - ky
    cols = (np.arange(bits.shape[1])[None, :] - 2 * kx) % bits.shape[1]
    inside = (rows >= 0) & (rows < bits.shape[0])
    return np.where(inside, bits[np.clip(rows, 0, bits.shape[0] - 1), cols], 1)


def ordered_minimum(values):
    """Minimum after the last -1; -1 when that is the last value."""
    dead = [i for i, v in enumerate(values) if v == -1]
    tail = values[dead[-1] + 1:] if dead else values
    return min(tail) if tail else -1.0


def roc(match, nonmatch, step=1):
    """Rates from the definition: ranks of the visited scores at or below each threshold."""
    seen = np.arange(0, len(match), step)
    m, n, size = np.array(match)[seen], np.array(nonmatch)[seen], len(match)

    def share(values, threshold):
        below = seen[(values >= 0) & (values <= threshold)]
        return (below.max() + 1) / size if len(below) else 0.0

    rows = []
    for j, a, b in zip(seen.tolist(), m.tolist(), n.tolist()):
        tar, far = share(m, a), share(n, a)
        rows.append((j, a, b, 1 - tar, far, 1 - far, tar))
    return rows


def smooth(image, sigma):
    half = int(6 * sigma + 1) // 2
    g = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma ** 2))
    g /= g.sum()
    padded = np.pad(image.astype(float), half)
    lines = sum(w * padded[:, k: k + image.shape[1]] for k, w in enumerate(g))
    return sum(w * lines[k: k + image.shape[0]] for k, w in enumerate(g))


def kept(old, new):
    """Positions kept when `new` of `old` lines are kept evenly."""
    if new > old // 2 + 1:
        gone = old - 1 - np.array(kept(old, old - new), int)
        return [i for i in range(old) if i not in set(gone.tolist())]
    out = []
    for i in range(old):
        if 2 * ((i + 1) * new - len(out) * old) > old:
            out.append(i)
    return out


def shrink(image, scaling):
    rows, cols = (kept(n, max(int(n * scaling + 5e-13), 1)) for n in image.shape)
    return image[np.ix_(rows, cols)]


def edges(image, sigma, scaling, vert, horz, high, low):
    """Edge map: smooth, shrink, gradient, gamma 1.9, thinning, hysteresis."""
    im = smooth(image, sigma)
    im = shrink(im, scaling) if scaling != 1 else im
    p = np.pad(im, 1)
    view = lambda dy, dx: p[1 + dy: p.shape[0] - 1 + dy, 1 + dx: p.shape[1] - 1 + dx]
    h, v = view(0, 1) - view(0, -1), view(1, 0) - view(-1, 0)
    d1, d2 = view(1, 1) - view(-1, -1), view(-1, 1) - view(1, -1)
    gx, gy = (h + (d1 + d2) / 2) * vert, (v + (d1 - d2) / 2) * horz
    g = np.hypot(gx, gy)
    angle = np.degrees(np.arctan2(-gy, gx)) % 180
    angle[gy == 0] = 0
    g = ((g - g.min()) / (g.max() - g.min())) ** (1 / 1.9)
    thin = np.zeros_like(g)
    for y in range(2, g.shape[0] - 2):
        for x in range(2, g.shape[1] - 2):
            a = np.radians(int(angle[y, x] + 1e-9))
            ox, oy = 1.5 * np.cos(a), 1.5 * np.sin(a)
            ox, oy = (0 if abs(ox) < 1e-9 else ox), (0 if abs(oy) < 1e-9 else oy)
            fx, fy = ox - np.floor(ox), oy - np.floor(oy)

            def look(dx, dy):
                t, b = g[int(y + np.floor(dy))], g[int(y + np.ceil(dy))]
                left, right = int(x + np.floor(dx)), int(x + np.ceil(dx))
                up = t[left] + fx * (t[right] - t[left])
                return up + fy * (b[left] + fx * (b[right] - b[left]) - up)

            if g[y, x] > look(ox, -oy) and g[y, x] > look(-ox, oy):
                thin[y, x] = g[y, x]
    return grow(thin, high, low)


def grow(values, high, low):
    """Hysteresis; the first and last row are reached but do not pass on."""
    n = values.size
    out = values > high
    number = np.arange(n).reshape(values.shape)
    passes = (number > values.shape[1]) & (number < n - values.shape[1] - 1)
    while True:
        p = np.pad(out & passes, 1)
        near = np.zeros_like(out)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                near |= p[dy: dy + out.shape[0], dx: dx + out.shape[1]]
        new = out | (near & (values > low))
        if (new == out).all():
            return out
        out = new


def digital_circle(radius):
    i = np.arange(int(radius / 1.4142) + 1)
    j = (radius * np.sqrt(1 - i * i / radius ** 2) + 0.5).astype(int)
    return {(s * a, t * b) for p, q in zip(i.tolist(), j.tolist()) for a, b in ((p, q), (q, p))
            for s in (1, -1) for t in (1, -1)}


def circle(image, r_low, r_high, scaling, high, low, vert, horz):
    mark = edges(image, 2.0, scaling, vert, horz, high, low)
    base, planes = int(r_low * scaling + 0.5), int((r_high - r_low) * scaling + 0.5)
    h, w = mark.shape
    best = (0, 0, 0, 0)
    for plane in range(planes):
        votes = np.zeros((h, w), int)
        for y, x in np.argwhere(mark):
            for dy, dx in digital_circle(base + plane + 1):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    votes[y + dy, x + dx] += 1
        if votes.max() > best[0]:
            x, y = np.argwhere(votes.T == votes.max())[0]
            best = (votes.max(), plane, y, x)
    back = lambda c: int(c / scaling + 5e-13)
    return back(best[2] + 1), back(best[3] + 1), back(base + best[1] + 1)
