"""How many tables a dish has in a Chinese restaurant: draws from the law given its customers."""

import numpy as np

from .common import mix

#: Dishes of up to so many customers are drawn by the recursion for generalised Stirling numbers.
EXACT = 1000
#: Weights that a task holds at once.
HELD = 1 << 21


def uniforms(key: np.ndarray, *stream: int) -> np.ndarray:
    """A number in (0, 1) for each key; keys and streams name it, so it doesn't depend on where or when it is drawn."""
    x = key.astype(np.uint64)
    for s in stream:
        x = mix(x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, *stream: int) -> np.ndarray:
    """A Gamma(shape, 1) variate for each key: squeezed normals, shapes under 1 through shape + 1."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        u, v, w = (uniforms(key[left], *stream, turn + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        y = (1 + x / np.sqrt(9 * d[left])) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (y > 0) & (np.log(w) < x * x / 2 + d[left] * (1 - y + np.log(y)))
        out[left[good]] = d[left[good]] * y[good]
        left, turn = left[~good], turn + 3
    return np.where(low, out * uniforms(key, *stream, 1 << 20) ** (1 / np.maximum(shape, 1e-9)), out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    tail = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return tail - sum(np.log(x + i) for i in range(8))


class Tables:
    """Draws of the number of tables t of a dish with n customers: P(t) is proportional to S(n, t) * weight ** t.

    S(n, t) are generalised Stirling numbers of the discount: the sum, over all ways to
    seat n customers at t tables, of what the tables' sizes weigh. Up to EXACT customers
    they come from S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t). Beyond, from
    what they count: S(n, t) is n! / (t! discount^t) times the chance that t independent
    table sizes (Sibuya variables) add up to n. That chance is its saddle-point value,
    mended where tables are few by what the saddle point misses in the stable law that
    such sums approach. Both are tabulated once for each discount. At 1000 customers both
    ways differ by less than a thousandth of the probability.
    """

    def __init__(self, discount: float):
        self.discount = d = discount
        log_s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log_s[1, 1] = 0
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(1, EXACT):
                log_s[n + 1, 1 : n + 2] = np.logaddexp(log_s[n, : n + 1], np.where(t[: n + 1] <= n, np.log(n - d * t[: n + 1]) + log_s[n, 1 : n + 2], -np.inf))
        self.log_s = log_s
        # The stable density by Zolotarev's integral over the angle pi - e^v.
        v = np.linspace(-34, np.log(np.pi) - 1e-9, 6000)
        w = np.exp(v)
        angle = np.pi - w
        log_a = (np.log(np.sin(d * angle)) - np.log(np.sin(w))) / (1 - d) + np.log(np.sin((1 - d) * angle)) - np.log(np.sin(d * angle))
        self.log_x = np.linspace(-4 * (1 - d) / d, 34 / d, 1500)
        self.missed = np.empty(len(self.log_x))
        for i, x in enumerate(self.log_x):
            inner = log_a - np.exp(np.minimum(log_a - x * d / (1 - d), 700)) + v
            top = inner.max()
            s = (np.log(d) - x) / (1 - d)
            saddle = -np.exp(s + x) * (1 - d) / d - np.log(2 * np.pi * (1 - d)) / 2 - (x - s) / 2
            self.missed[i] = np.log(d / (1 - d) / np.pi) - x / (1 - d) + top + np.log(np.exp(inner - top).sum() * (v[1] - v[0])) - saddle
        # The saddle point, where tables are rho times the customers.
        log_y = np.linspace(-32 / (1 - d), np.log(30.0), 100_000)
        y = np.exp(log_y)
        q, e = -np.expm1(-y), np.exp(-y)
        log_q = np.where(y < 0.5, np.log(q), np.log1p(-np.minimum(e, 0.9)))
        rest = -np.expm1(d * log_q)  # 1 - q^d
        rho = rest / (d * np.exp((d - 1) * log_q - y))
        bend = np.log(np.maximum((1 - d) * e / q + 1 - 1 / rho, 1e-300))
        self.log_rho, self.value, self.bend = np.log(rho), rho * np.log(rest) + y, bend

    def log_law(self, n: np.ndarray, t: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """Log of a multiple of P(t), for many customers."""
        log_n, log_t = np.log(n), np.log(t)
        rho = log_t - log_n
        saddle = n * np.interp(rho, self.log_rho, self.value) - (log_n + np.interp(rho, self.log_rho, self.bend)) / 2
        # Where nearly all tables have one customer, the others are Poisson: n - t is a small number, and the saddle point's Stirling formula is mended.
        others = np.maximum(np.rint(n - t), 1)
        saddle += others * np.log(others) - others + np.log(2 * np.pi * others) / 2 - log_gamma(others + 1)
        saddle = np.where(n - t < 0.5, n * np.log(self.discount) + np.log(2 * np.pi) / 2, saddle)
        missed = np.interp(log_n - log_t / self.discount, self.log_x, self.missed)
        return t * (log_weight - np.log(self.discount)) - log_gamma(t + 1) + saddle + missed

    def _many(self, n: np.ndarray, log_weight: np.ndarray, u: np.ndarray, jitter: np.ndarray) -> np.ndarray:
        n, log_weight = n.astype(np.float64)[:, None], log_weight[:, None]
        rows = np.arange(len(n))
        grid = np.exp(np.linspace(0, 1, 64) * np.log(n))
        for _ in range(6):  # ever closer around the mode
            best = self.log_law(n, grid, log_weight).argmax(axis=1)
            low, high = grid[rows, np.maximum(best - 1, 0)], grid[rows, np.minimum(best + 1, 63)]
            mode = grid[rows, best]
            grid = low[:, None] + np.linspace(0, 1, 64) * (high - low)[:, None]
        mode = np.clip(np.rint(mode), 1, n[:, 0])
        top = self.log_law(n, mode[:, None], log_weight)[:, 0]
        reach = np.full(len(n), 8.0)
        for _ in range(60):
            sides = np.stack([mode - reach, mode + reach], axis=1)
            law = np.where((sides > 1) & (sides < n), self.log_law(n, np.clip(sides, 1, n), log_weight), -np.inf)
            near = law.max(axis=1) > top - 35
            if not near.any():
                break
            reach[near] *= 1.5
        low, high = np.maximum(np.floor(mode - reach), 1), np.minimum(np.ceil(mode + reach), n[:, 0])
        step = np.maximum(1, (high - low) / 511)
        grid = low[:, None] + np.arange(512) * step[:, None]
        law = np.where(grid <= high[:, None] + 1e-6, self.log_law(n, np.minimum(grid, n), log_weight), -np.inf)
        sums = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
        at = (sums < (u * sums[:, -1])[:, None]).sum(axis=1)
        t = grid[rows, at] + np.where(step > 1, (jitter - 0.5) * step, 0)
        return np.clip(np.rint(t), 1, n[:, 0]).astype(np.int64)

    def draw(self, n: np.ndarray, weight: np.ndarray, u: np.ndarray, jitter: np.ndarray) -> np.ndarray:
        """Tables of dishes of n customers each; u and jitter: numbers in (0, 1) that decide."""
        out = np.ones(len(n), np.int64)
        log_weight = np.log(np.maximum(weight, 1e-300))
        by = np.argsort(n, kind="stable")
        by = by[np.searchsorted(n[by], 2) :]
        edges = np.flatnonzero(np.r_[True, n[by][1:] != n[by][:-1]]) if len(by) else ()
        for a, b in zip(edges, [*edges[1:], len(by)]):
            m = int(n[by[a]])
            if m > EXACT:
                break
            t = np.arange(1, m + 1)
            for s in range(a, b, max(1, HELD // m)):
                rows = by[s : min(b, s + max(1, HELD // m))]
                law = self.log_s[m, 1 : m + 1] + log_weight[rows, None] * t
                sums = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
                out[rows] = 1 + (sums < (u[rows] * sums[:, -1])[:, None]).sum(axis=1)
        many = np.flatnonzero(n > EXACT)
        for s in range(0, len(many), HELD // 512):
            rows = many[s : s + HELD // 512]
            out[rows] = self._many(n[rows], log_weight[rows], u[rows], jitter[rows])
        return out
