"""Plain loops over one series, to compare the engine with."""

import math
import random


def walk(n, seed=0, symbol="A", start=50.0):
    rng = random.Random(seed)
    out, close = [], start
    for i in range(n):
        open_ = close
        close = max(0.5, close * (1 + rng.gauss(0, 0.02)))
        high, low = max(open_, close) * (1 + rng.random() * 0.01), min(open_, close) * (1 - rng.random() * 0.01)
        out.append((symbol, 1_000_000 + i * 86400, open_, high, low, close, float(rng.randint(0, 9) * 1000)))
    return out


def flat(n, symbol="F", price=10.0, volume=1.0):
    return [(symbol, 1_000_000 + i * 86400, price, price, price, price, volume) for i in range(n)]


def mean(x):
    return sum(x) / len(x)


def std(x):
    m = mean(x)
    return math.sqrt(sum((v - m) ** 2 for v in x) / len(x))


def smooth(xs, start, period, alpha=None):
    out = [None] * len(xs)
    if len(xs) < start + period:
        return out
    y = mean(xs[start : start + period])
    out[start + period - 1] = y
    for i in range(start + period, len(xs)):
        y = xs[i] * alpha + y * (1 - alpha) if alpha else (y * (period - 1) + xs[i]) / period
        out[i] = y
    return out


def true_ranges(rows):
    return [0.0] + [max(abs(b[3] - b[4]), abs(b[3] - a[5]), abs(b[4] - a[5])) for a, b in zip(rows, rows[1:])]


def bollinger(rows):
    c = [r[5] for r in rows]
    return [None if i < 19 else (mean(w := c[i - 19 : i + 1]) + 2 * std(w), mean(w), mean(w) - 2 * std(w)) for i in range(len(c))]


def keltner(rows):
    n = len(rows)
    e, a = smooth([r[5] for r in rows], 0, 20, 2 / 21), smooth(true_ranges(rows), 1, 10)
    return [None if i < 20 or n < 21 else (e[i] + 2 * a[i], e[i], e[i] - 2 * a[i]) for i in range(n)]


def macd(rows):
    c, n = [r[5] for r in rows], len(rows)
    if n < 35:
        return [None] * n
    a, b = smooth(c, 0, 12, 2 / 13), smooth(c, 0, 26, 2 / 27)
    dif = [0.0 if b[i] is None else a[i] - b[i] for i in range(n)]
    dea = smooth(dif, 25, 9, 0.2)
    return [None if dea[i] is None else (dif[i], dea[i], 2 * (dif[i] - dea[i])) for i in range(n)]


def kdj(rows):
    out, k, d = [None] * len(rows), 50.0, 50.0
    if len(rows) < 10:
        return out
    for i in range(8, len(rows)):
        h, low = max(r[3] for r in rows[i - 8 : i + 1]), min(r[4] for r in rows[i - 8 : i + 1])
        rsv = 50.0 if h - low < 1e-9 else (rows[i][5] - low) / (h - low) * 100
        k = rsv / 3 + k * 2 / 3
        d = k / 3 + d * 2 / 3
        out[i] = (k, d, 3 * k - 2 * d)
    return out


def adx(rows):
    n, out = len(rows), [None] * len(rows)
    if n < 29:
        return out
    up, dn = [0.0] * n, [0.0] * n
    for i in range(1, n):
        u, d = rows[i][3] - rows[i - 1][3], rows[i - 1][4] - rows[i][4]
        up[i], dn[i] = (u if u > d and u > 0 else 0.0), (d if d > u and d > 0 else 0.0)
    t, p, m = smooth(true_ranges(rows), 1, 14), smooth(up, 1, 14), smooth(dn, 1, 14)
    di = [(0.0, 0.0) if t[i] is None or t[i] <= 0 else (100 * p[i] / t[i], 100 * m[i] / t[i]) for i in range(n)]
    dx = [100 * abs(a - b) / (a + b) if a + b > 0 else 0.0 for a, b in di]
    s = smooth(dx, 14, 14)
    return [None if i < 28 else (s[i], *di[i]) for i in range(n)]


def rsi(rows):
    c = [r[5] for r in rows]
    ch = [0.0] + [b - a for a, b in zip(c, c[1:])]
    g, l_ = smooth([max(x, 0.0) for x in ch], 1, 2), smooth([max(-x, 0.0) for x in ch], 1, 2)
    return [None if l_[i] is None else (100.0 if l_[i] < 1e-9 else 100 - 100 / (1 + g[i] / l_[i]),) for i in range(len(c))]


def turtle(rows, totals, entry_z=1.5, step=0.5, stop=2.0, most=4, cooldown=3, lookback=60):
    out, s = [], None
    wait = 0
    for i in range(lookback, len(rows)):
        wait = max(0, wait - 1)
        x = totals[i]
        if x is None or not math.isfinite(x):
            continue
        win = [v for v in totals[i - lookback + 1 : i + 1] if v is not None and math.isfinite(v)]
        z, sd = 0.0, 1e-6
        if len(win) >= lookback // 3:
            sd = max(std(win), 1e-12)
            z = (x - mean(win)) / sd
        close = rows[i][5]
        if s and x < s["entry"] - stop * sd:
            out.append((rows[i][1], "Exit", 0, (close - s["price"]) / s["price"] * 100))
            s, wait = None, cooldown
        elif wait:
            continue
        elif s is None:
            if z > entry_z:
                s, wait = {"entry": x, "price": close, "units": 1, "last": x}, cooldown
                out.append((rows[i][1], "Entry", 1, None))
        elif x > s["last"] + step * sd and s["units"] < most:
            s["price"] = (s["price"] * s["units"] + close) / (s["units"] + 1)
            s.update(units=s["units"] + 1, last=x)
            wait = cooldown
            out.append((rows[i][1], "Add", s["units"], None))
    return out


def pairs(bars):
    """bars: (time, close, buys?, sells?): trades as (entry times, entry mean, sell time), the sell of a bar first."""
    open_, out = [], []
    for time, close, buy, sell in bars:
        if sell:
            out.append(([t for t, _ in open_], mean([c for _, c in open_]) if open_ else None, time))
            open_ = []
        if buy:
            open_.append((time, close))
    if open_:
        out.append(([t for t, _ in open_], mean([c for _, c in open_]), None))
    return out


def squeeze(rows, bands, kelts, macds, kdjs):
    out, open_ = [(False, False)] * len(rows), []
    width = [None if b is None else (b[0] - b[2]) / b[1] for b in bands]
    for i in range(50, len(rows)):
        if bands[i] is None or kelts[i] is None:
            continue
        close, vol, buy, sell = rows[i][5], rows[i][6], False, False
        if open_:
            stop = max(open_) - 1.5 * (kelts[i][0] - kelts[i][1]) / 2
            cross = lambda a, b: a is not None and b is not None and a[0] >= a[1] and b[0] < b[1]
            if close < bands[i][1] or close < stop or cross(kdjs[i - 1], kdjs[i]) or cross(macds[i - 1], macds[i]):
                sell, open_ = True, []
        recent = [r[6] for r in rows[i - 19 : i + 1]]
        if close > bands[i][0] and vol > 2 * mean(recent[-5:]) and vol > sorted(recent)[14]:
            if open_:
                buy = any(bands[j] is not None and rows[j][5] <= bands[j][0] for j in range(i - 4, i + 1))
            else:
                buy = width[i] < 0.85 * sum(w for w in width[i - 19 : i + 1] if w is not None) / 20
            if buy:
                open_.append(close)
        out[i] = (buy, sell)
    return out
