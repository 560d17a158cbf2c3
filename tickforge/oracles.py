"""SQL that DuckDB answers the registered queries by, written apart from the Spark code.

CTES maps each table expression to its SQL; composed() puts those that a query needs,
in the order of the mapping, before it.
"""

import re

CTES: dict[str, str] = {}


def composed(select: str) -> str:
    """The query with every table expression that it needs, directly or not."""
    needed, todo = set(), [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = [n for n in CTES if n in words and n not in needed]
        needed.update(new)
        todo += [CTES[n] for n in new]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{CTES[n].strip()}\n)" for n in CTES if n in needed) + "\n" + select.strip() if needed else select


def smoothed(source: str, column: str, start: int, period: int, exponential: bool) -> str:
    """A recurrence over `column` from bar `start` on, begun by the mean of `period` values."""
    move = f"s.{column} * (2::DOUBLE / {period + 1}) + r.v * (1 - 2::DOUBLE / {period + 1})" if exponential else f"(r.v * {period - 1} + s.{column}) / {period}"
    return f"""
  SELECT symbol, {start + period - 1} AS i, avg({column}) AS v FROM {source}
  WHERE i BETWEEN {start} AND {start + period - 1} GROUP BY symbol HAVING count(*) = {period}
  UNION ALL
  SELECT s.symbol, s.i, {move} FROM {source}_at r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1"""


def recurrence(name: str, source: str, column: str, start: int, period: int, exponential: bool) -> None:
    CTES[name] = smoothed(source, column, start, period, exponential).replace(f"{source}_at r", f"{name} r")


def candles(table: str, symbol: str, ts: str, order: str, price: str, seconds: int) -> str:
    return f"""
  SELECT symbol, time, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, count(*)::DOUBLE AS volume
  FROM (SELECT {symbol} AS symbol, (floor(epoch({ts}) / {seconds}))::BIGINT * {seconds} AS time, {order} AS o, {price}::DOUBLE AS p FROM {table}
        WHERE {ts} IS NOT NULL AND {price} IS NOT NULL)
  GROUP BY symbol, time"""


CTES["hourly"] = candles("events", "event_type", "ts", "ts", "value", 3600)
CTES["daily"] = candles("orders", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", 86400)
CTES["c"] = """
  SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time) - 1)::INTEGER AS i, (count(*) OVER (PARTITION BY symbol))::INTEGER AS n
  FROM hourly"""
CTES["g"] = """
  SELECT *, lag(close) OVER b AS was, high - lag(high) OVER b AS up, lag(low) OVER b - low AS down, close - lag(close) OVER b AS change
  FROM c WINDOW b AS (PARTITION BY symbol ORDER BY i)"""
CTES["t"] = """
  SELECT *, greatest(abs(high - low), abs(high - was), abs(low - was)) AS tr,
    CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS ndm,
    CASE WHEN change > 0 THEN change ELSE 0 END AS gain, CASE WHEN change < 0 THEN -change ELSE 0 END AS loss
  FROM g WHERE i >= 1"""
CTES["bb"] = """
  SELECT symbol, time, i, n, close, volume, CASE WHEN i >= 19 THEN m + 2 * s END AS bb_upper, CASE WHEN i >= 19 THEN m END AS bb_middle, CASE WHEN i >= 19 THEN m - 2 * s END AS bb_lower
  FROM (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM c WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))"""
recurrence("ema12", "c", "close", 0, 12, True)
recurrence("ema20", "c", "close", 0, 20, True)
recurrence("ema26", "c", "close", 0, 26, True)
recurrence("atr10", "t", "tr", 1, 10, False)
CTES["kc"] = """
  SELECT c.symbol, c.time, c.i, v20.v + 2 * a.v AS kc_upper, CASE WHEN a.v IS NOT NULL THEN v20.v END AS kc_middle, v20.v - 2 * a.v AS kc_lower
  FROM c LEFT JOIN ema20 v20 ON v20.symbol = c.symbol AND v20.i = c.i AND c.n >= 21 AND c.i >= 20
  LEFT JOIN atr10 a ON a.symbol = c.symbol AND a.i = c.i AND c.n >= 21 AND c.i >= 20"""
CTES["dif_rows"] = "  SELECT a.symbol, a.i, a.v - b.v AS dif FROM ema12 a JOIN ema26 b ON a.symbol = b.symbol AND a.i = b.i"
recurrence("dea9", "dif_rows", "dif", 25, 9, True)
CTES["md"] = """
  SELECT c.symbol, c.time, c.i, CASE WHEN e.v IS NOT NULL THEN d.dif END AS dif, e.v AS dea, 2 * (d.dif - e.v) AS bar
  FROM c LEFT JOIN dif_rows d ON d.symbol = c.symbol AND d.i = c.i LEFT JOIN dea9 e ON e.symbol = c.symbol AND e.i = c.i AND c.n >= 35"""
recurrence("fast6", "c", "close", 0, 6, True)
recurrence("slow13", "c", "close", 0, 13, True)
CTES["dif_fast"] = "  SELECT a.symbol, a.i, a.v - b.v AS dif FROM fast6 a JOIN slow13 b ON a.symbol = b.symbol AND a.i = b.i"
recurrence("dea5", "dif_fast", "dif", 12, 5, True)
CTES["md_fast"] = """
  SELECT c.symbol, c.time, c.i, CASE WHEN e.v IS NOT NULL THEN d.dif END AS dif, e.v AS dea, 2 * (d.dif - e.v) AS bar
  FROM c LEFT JOIN dif_fast d ON d.symbol = c.symbol AND d.i = c.i LEFT JOIN dea5 e ON e.symbol = c.symbol AND e.i = c.i AND c.n >= 18"""
recurrence("gain9", "t", "gain", 1, 9, False)
recurrence("loss9", "t", "loss", 1, 9, False)
CTES["rs_long"] = """
  SELECT c.symbol, c.time, CASE WHEN b.v < 1e-9 THEN 100 ELSE 100 - 100 / (1 + a.v / b.v) END AS rsi
  FROM c LEFT JOIN gain9 a ON a.symbol = c.symbol AND a.i = c.i LEFT JOIN loss9 b ON b.symbol = c.symbol AND b.i = c.i"""
CTES["rsv"] = """
  SELECT symbol, i, n, CASE WHEN abs(h - l) < 1e-9 THEN 50 ELSE (close - l) / (h - l) * 100 END AS rsv
  FROM (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM c WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING)) WHERE i >= 8 AND n >= 10"""
CTES["kd"] = """
  SELECT DISTINCT symbol, 7 AS i, 50::DOUBLE AS k, 50::DOUBLE AS d FROM rsv
  UNION ALL
  SELECT s.symbol, s.i, s.rsv / 3 + r.k * 2 / 3, (s.rsv / 3 + r.k * 2 / 3) / 3 + r.d * 2 / 3 FROM kd r JOIN rsv s ON s.symbol = r.symbol AND s.i = r.i + 1"""
CTES["kdj"] = "  SELECT c.symbol, c.time, c.i, kd.k, kd.d, 3 * kd.k - 2 * kd.d AS j FROM c LEFT JOIN kd ON kd.symbol = c.symbol AND kd.i = c.i AND c.i >= 8"
recurrence("atr14", "t", "tr", 1, 14, False)
recurrence("pdm14", "t", "pdm", 1, 14, False)
recurrence("ndm14", "t", "ndm", 1, 14, False)
CTES["di"] = """
  SELECT a.symbol, a.i, CASE WHEN a.v > 0 THEN 100 * p.v / a.v ELSE 0 END AS pdi, CASE WHEN a.v > 0 THEN 100 * m.v / a.v ELSE 0 END AS mdi
  FROM atr14 a JOIN pdm14 p ON p.symbol = a.symbol AND p.i = a.i JOIN ndm14 m ON m.symbol = a.symbol AND m.i = a.i"""
CTES["dx"] = "  SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM di"
recurrence("adx14", "dx", "dx", 14, 14, False)
CTES["ad"] = """
  SELECT c.symbol, c.time, c.i, c.n, a.v AS adx, x.pdi AS plus_di, x.mdi AS minus_di
  FROM c LEFT JOIN adx14 a ON a.symbol = c.symbol AND a.i = c.i AND c.i >= 28 AND c.n >= 29
  LEFT JOIN di x ON x.symbol = a.symbol AND x.i = a.i"""
recurrence("gain2", "t", "gain", 1, 2, False)
recurrence("loss2", "t", "loss", 1, 2, False)
CTES["rs"] = """
  SELECT c.symbol, c.time, c.i, CASE WHEN l.v < 1e-9 THEN 100 WHEN l.v IS NOT NULL THEN 100 - 100 / (1 + g2.v / l.v) END AS rsi
  FROM c LEFT JOIN gain2 g2 ON g2.symbol = c.symbol AND g2.i = c.i LEFT JOIN loss2 l ON l.symbol = c.symbol AND l.i = c.i"""
CTES["regimes"] = """
  SELECT symbol, CASE WHEN n < 60 THEN '数据不足' WHEN adx < 15 AND bw < bw_ma * 0.75 THEN '窄幅整理' WHEN adx < 20 THEN '震荡市'
    WHEN adx > 25 AND slope > 0.003 AND bw > bw_ma THEN '单边牛市' WHEN adx > 25 AND slope < -0.003 AND bw > bw_ma THEN '单边熊市'
    WHEN adx > 30 AND adx < was THEN '趋势衰竭' ELSE '震荡市' END AS regime
  FROM (SELECT symbol, n, adx, coalesce(was, adx) AS was, bw, CASE WHEN bands >= 20 THEN bw20 ELSE bw END AS bw_ma,
      CASE WHEN ma_was > 0 THEN (ma - ma_was) / ma_was ELSE 0 END AS slope
    FROM (SELECT b.symbol, max(b.n) AS n, coalesce(arg_max(ad.adx, b.i) FILTER (ad.adx IS NOT NULL), 0) AS adx,
        arg_max(ad.adx, b.i) FILTER (ad.adx IS NOT NULL AND b.i <= b.n - 4) AS was,
        coalesce(arg_max(bw, b.i) FILTER (bw IS NOT NULL), 0.02) AS bw, count(bw) AS bands, avg(bw) FILTER (b.i >= b.n - 20) AS bw20,
        avg(b.close) FILTER (b.i >= b.n - 10) AS ma, avg(b.close) FILTER (b.i BETWEEN b.n - 13 AND b.n - 4) AS ma_was
      FROM (SELECT *, (bb_upper - bb_lower) / bb_middle AS bw FROM bb) b JOIN ad ON ad.symbol = b.symbol AND ad.i = b.i GROUP BY b.symbol))"""
CTES["ind"] = """
  SELECT bb.*, kc_upper, kc_middle, kc_lower, dif, dea, bar, k, d, j, lag(k) OVER b AS pk, lag(d) OVER b AS pd, lag(j) OVER b AS pj,
    lag(dif) OVER b AS pdif, lag(dea) OVER b AS pdea, lag(bar) OVER b AS pbar
  FROM bb JOIN kc USING (symbol, i) JOIN md USING (symbol, i) JOIN kdj USING (symbol, i) WINDOW b AS (PARTITION BY bb.symbol ORDER BY bb.i)"""

CTES["sqi"] = """
  SELECT symbol, time, i, close, bb_middle, coalesce(i >= 50 AND bb_upper IS NOT NULL AND kc_upper IS NOT NULL, false) AS ready,
    coalesce(bw < 0.85::DOUBLE * sum(bw) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) / 20, false) AS squeezed,
    coalesce(close > bb_upper AND volume > 2 * avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING)
      AND volume > list_sort(list(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))[14 + 1], false) AS surge,
    coalesce(max((close <= bb_upper)::INTEGER) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) = 1, false) AS pulled,
    coalesce(pk >= pd AND k < d, false) OR coalesce(pdif >= pdea AND dif < dea, false) AS death, 0.75::DOUBLE * (kc_upper - kc_middle) AS stop
  FROM (SELECT *, (bb_upper - bb_lower) / bb_middle AS bw FROM ind)"""
CTES["sqm"] = """
  SELECT symbol, time, i, false AS buys, false AS sells, NULL::DOUBLE AS highest FROM sqi WHERE i = 0
  UNION ALL
  SELECT symbol, time, i, surge AND starts, sells, CASE WHEN surge AND starts THEN greatest(close, held) ELSE held END
  FROM (SELECT *, CASE WHEN sells THEN NULL ELSE highest END AS held, ready AND CASE WHEN sells OR highest IS NULL THEN squeezed ELSE pulled END AS starts
    FROM (SELECT q.*, r.highest, q.ready AND r.highest IS NOT NULL AND coalesce(q.close < q.bb_middle OR q.close < r.highest - q.stop OR q.death, false) AS sells
      FROM sqm r JOIN sqi q ON q.symbol = r.symbol AND q.i = r.i + 1))"""
CTES["sqz"] = "  SELECT symbol, time, buys AS squeeze_buy, sells AS squeeze_sell FROM sqm"

def _count(*conditions: str) -> str:
    return " + ".join(f"coalesce(({c})::INTEGER, 0)" for c in conditions)


_NEAR = "i >= 50 AND bb_lower IS NOT NULL AND kc_lower IS NOT NULL AND "
CTES["ev"] = f"""
  SELECT symbol, bb_time AS time, i, close,
    {_count('pk <= pd AND k > d', 'k < 20 AND k > pk')} AS kdj_buy, {_count('pk >= pd AND k < d', 'j > 100 AND k < pk')} AS kdj_sell,
    {_count('pj < 0 AND j > pj', 'pj < -5 AND j > pj')} AS j_buy, {_count('pj > 100 AND j < pj', 'pj > 105 AND j < pj')} AS j_sell,
    {_count('pdif <= pdea AND dif > dea AND dif > -0.02', 'pbar <= 0 AND bar > 0')} AS macd_buy,
    {_count('pdif >= pdea AND dif < dea AND dif < 0.02', 'pbar >= 0 AND bar < 0')} AS macd_sell,
    {_count(_NEAR + 'close <= kc_lower * 1.02::DOUBLE', _NEAR + 'close <= bb_lower * 1.02::DOUBLE', _NEAR + 'close >= kc_middle * 0.99::DOUBLE AND close <= kc_middle * 1.01::DOUBLE')} AS sr_buy,
    {_count(_NEAR + 'close >= kc_upper * 0.98::DOUBLE', _NEAR + 'close >= bb_upper * 0.98::DOUBLE')} AS sr_sell
  FROM (SELECT *, time AS bb_time FROM ind)"""
CTES["cf"] = """
  SELECT symbol, time, i, close, j_buy, j_sell,
    list_distinct_kept(bp) AS buy_tags, list_distinct_kept(sp) AS sell_tags
  FROM (SELECT *,
      (CASE WHEN kdj_buy > 0 AND max(macd_buy) OVER w > 0 THEN ['kdj↑', 'macd↑'] ELSE [] END || CASE WHEN kdj_buy > 0 AND max(sr_buy) OVER w > 0 THEN ['kdj↑', '支撑'] ELSE [] END
       || CASE WHEN macd_buy > 0 AND max(sr_buy) OVER w > 0 THEN ['macd↑', '支撑'] ELSE [] END) AS bp,
      (CASE WHEN kdj_sell > 0 AND max(macd_sell) OVER w > 0 THEN ['kdj↓', 'macd↓'] ELSE [] END || CASE WHEN kdj_sell > 0 AND max(sr_sell) OVER w > 0 THEN ['kdj↓', '压力'] ELSE [] END
       || CASE WHEN macd_sell > 0 AND max(sr_sell) OVER w > 0 THEN ['macd↓', '压力'] ELSE [] END) AS sp
    FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING))"""
_KEPT = "list_filter({0}, lambda x, p: list_position({0}, x) = p)"
CTES["cf"] = CTES["cf"].replace("list_distinct_kept(bp)", _KEPT.format("bp")).replace("list_distinct_kept(sp)", _KEPT.format("sp"))
CTES["trade_rows"] = f"""
  SELECT coalesce(b.symbol, s.symbol) AS symbol, coalesce(b.grp, s.grp) AS grp, buy_time, entry, buys, {_KEPT.format("raw")} AS buy_tags, sell_time, exit, sell_tags,
    (exit - entry) / entry * 100 AS pnl_pct
  FROM (SELECT symbol, sells AS grp, min(time) AS buy_time, avg(close) AS entry, count(*) AS buys, flatten(list(buy_tags ORDER BY time)) AS raw
        FROM (SELECT *, sum((len(sell_tags) > 0)::INTEGER) OVER (PARTITION BY symbol ORDER BY i) AS sells FROM cf) WHERE len(buy_tags) > 0 GROUP BY symbol, sells) b
  FULL JOIN (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS grp, time AS sell_time, close AS exit, sell_tags FROM cf WHERE len(sell_tags) > 0) s
    ON s.symbol = b.symbol AND s.grp = b.grp"""
CTES["rule_rows"] = """
  SELECT symbol, 0 AS part, grp AS place, 0 AS sub, sell_time AS time, 'Sell' AS kind, exit AS price, '卖(' || array_to_string(sell_tags, ' & ') || ')' AS tags, NULL::DOUBLE AS pnl_pct FROM trade_rows WHERE buy_time IS NULL
  UNION ALL SELECT symbol, 1, grp, 0, buy_time, 'Buy', entry, '买(' || array_to_string(buy_tags, ' & ') || ')', pnl_pct FROM trade_rows WHERE buy_time IS NOT NULL AND sell_time IS NOT NULL
  UNION ALL SELECT symbol, 1, grp, 1, sell_time, 'Sell', exit, '卖(' || array_to_string(sell_tags, ' & ') || ')', NULL FROM trade_rows WHERE buy_time IS NOT NULL AND sell_time IS NOT NULL
  UNION ALL SELECT symbol, 2, grp, 0, buy_time, 'Buy', entry, '买(' || array_to_string(buy_tags, ' & ') || ')', NULL FROM trade_rows WHERE sell_time IS NULL
  UNION ALL SELECT symbol, 3, i, 0, time, 'Buy', close, 'KDJ J超卖(买)', NULL FROM (SELECT *, unnest(range(j_buy)) FROM cf)
  UNION ALL SELECT symbol, 4, i, 0, time, 'Sell', close, 'KDJ J超买(卖)', NULL FROM (SELECT *, unnest(range(j_sell)) FROM cf)"""
CTES["rule_out"] = "  SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY part, place, sub))::INTEGER AS seq, time, kind, price, tags, pnl_pct FROM rule_rows"

_FRAMES = ", ".join(f"w{k} AS (PARTITION BY symbol ORDER BY i ROWS {k - 1} PRECEDING)" for k in (5, 10, 12, 14, 20, 26))
_RATIO = "CASE WHEN abs({1}) > 1e-12 THEN ({0}) / ({1}) END".format
CTES["f0"] = f"""
  SELECT *, lag(close, 1) OVER b AS c1, lag(close, 5) OVER b AS c5, lag(close, 10) OVER b AS c10, lag(close, 20) OVER b AS c20,
    CASE WHEN i >= 4 THEN avg(close) OVER w5 END AS m5, CASE WHEN i >= 11 THEN avg(close) OVER w12 END AS m12, CASE WHEN i >= 19 THEN avg(close) OVER w20 END AS m20,
    CASE WHEN i >= 25 THEN avg(close) OVER w26 END AS m26, CASE WHEN i >= 4 THEN avg(volume) OVER w5 END AS v5, CASE WHEN i >= 19 THEN stddev_pop(close) OVER w20 END AS s20,
    CASE WHEN low > 1e-9 THEN high / low - 1 ELSE 0 END AS hl, lead(close, 5) OVER b AS c_ahead
  FROM c WINDOW b AS (PARTITION BY symbol ORDER BY i), {_FRAMES}"""
CTES["f1"] = f"""
  SELECT *, lag(v5, 5) OVER b AS v5_5, coalesce({_RATIO('close - c1', 'c1')}, 0) AS r1, coalesce(abs(close - c1), 0) AS d1
  FROM f0 WINDOW b AS (PARTITION BY symbol ORDER BY i)"""
CTES["f"] = f"""
  SELECT symbol, time, i, n, close, CASE WHEN close > 1e-12 THEN (c_ahead - close) / close END AS ahead,
    {_RATIO('close - c5', 'c5')} AS ret_5d, {_RATIO('close - c5', 'c5')} AS ret_20d, m12 - m26 AS macd_dif, {_RATIO('close - m20', 'm20')} AS ma_disp_20,
    {_RATIO('CASE WHEN i >= 13 THEN avg(d1) OVER w14 END', 'close')} AS atr_pct, {_RATIO('2 * s20', 'm20')} AS bb_width,
    CASE WHEN i >= 9 THEN stddev_pop(hl) OVER w10 END AS hl_vol, CASE WHEN i >= 19 THEN stddev_pop(r1) OVER w20 END AS ret_std,
    {_RATIO('v5', 'volume')} AS vol_ratio, CASE WHEN abs(v5) > 1e-9 THEN (v5 - v5_5) / v5 END AS vol_trend, m5 - m20 AS ma_cross, {_RATIO('close - c10', 'c10')} AS slope_10
  FROM f1 WINDOW {_FRAMES}"""

#: Names, categories and directions of the factors.
FACTORS = {
    "ret_5d": ("momentum", 1),
    "ret_20d": ("momentum", 1),
    "macd_dif": ("momentum", 1),
    "ma_disp_20": ("momentum", 1),
    "atr_pct": ("volatility", -1),
    "bb_width": ("volatility", 0),
    "hl_vol": ("volatility", -1),
    "ret_std": ("volatility", -1),
    "vol_ratio": ("volume", 0),
    "vol_trend": ("volume", 1),
    "ma_cross": ("trend", 1),
    "slope_10": ("trend", 1),
}
CTES["fl"] = "\n  UNION ALL ".join(
    f"SELECT symbol, time, i, n, ahead, '{f}' AS factor, '{c}' AS category, {d} AS direction, {f} AS x FROM f" for f, (c, d) in FACTORS.items()
)
CTES["ic0"] = """
  SELECT *, xx - avg(xx) OVER p AS u, yy - avg(yy) OVER p AS v
  FROM (SELECT *, CASE WHEN ahead IS NOT NULL THEN x END AS xx, CASE WHEN x IS NOT NULL THEN ahead END AS yy FROM fl) WINDOW p AS (PARTITION BY symbol, factor)"""
CTES["ic1"] = """
  SELECT symbol, factor, time, i, n, count(u) OVER w AS m, sum(u) OVER w AS su, sum(v) OVER w AS sv, sum(u * u) OVER w AS suu, sum(v * v) OVER w AS svv, sum(u * v) OVER w AS suv,
    max(u) OVER w <= min(u) OVER w OR max(v) OVER w <= min(v) OVER w AS flat
  FROM ic0 WINDOW w AS (PARTITION BY symbol, factor ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""
CTES["ic"] = """
  SELECT symbol, factor, time, i, CASE WHEN i >= 60 AND i < n - 5 AND m >= 20 THEN
    CASE WHEN flat OR sqrt(greatest(suu - su * su / m, 0) * greatest(svv - sv * sv / m, 0)) < 1e-15 THEN 0
    ELSE least(greatest((suv - su * sv / m) / sqrt(greatest(suu - su * su / m, 0) * greatest(svv - sv * sv / m, 0)), -1), 1) END END AS ic FROM ic1"""
CTES["fe"] = """
  SELECT symbol, factor, ic_mean, ir, abs(ir) > 0.3 OR abs(ic_mean) > 0.02 AS is_valid, CASE WHEN abs(ir) > 0.3 OR abs(ic_mean) > 0.02 THEN abs(ic_mean) ELSE 0 END AS weight
  FROM (SELECT symbol, factor, CASE WHEN k >= 20 THEN m ELSE 0 END AS ic_mean, CASE WHEN k >= 20 AND s > 1e-9 THEN m / s ELSE 0 END AS ir
    FROM (SELECT symbol, factor, count(ic) FILTER (p <= 60) AS k, avg(ic) FILTER (p <= 60) AS m, stddev_pop(ic) FILTER (p <= 60) AS s
      FROM (SELECT *, count(ic) OVER (PARTITION BY symbol, factor ORDER BY i DESC) AS p FROM ic) GROUP BY symbol, factor))"""
CTES["wz"] = """
  SELECT fl.symbol, fl.factor, category, direction, time, i, x, m, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS w
  FROM fl JOIN (SELECT symbol, factor, len(l) AS m, l[(floor((len(l) - 1) * 0.01::DOUBLE))::BIGINT + 1] AS lo, l[(floor((len(l) - 1) * 0.99::DOUBLE))::BIGINT + 1] AS hi
    FROM (SELECT symbol, factor, list_sort(list(x) FILTER (x IS NOT NULL)) AS l FROM fl GROUP BY symbol, factor)) q ON q.symbol = fl.symbol AND q.factor = fl.factor"""
CTES["zs"] = """
  SELECT z0.symbol, z0.factor, category, time, i, weight, CASE WHEN m < 2 THEN w ELSE z * CASE WHEN direction <> 0 THEN direction ELSE sign(coalesce(ic_mean, 0)) END END AS z
  FROM (SELECT *, (w - avg(w) OVER p) / greatest(stddev_pop(w) OVER p, 1e-9) AS z FROM wz WINDOW p AS (PARTITION BY symbol, factor)) z0
  LEFT JOIN fe ON fe.symbol = z0.symbol AND fe.factor = z0.factor"""
_PART = "coalesce(sum(weight * z) FILTER (category = '{0}'), 0)"
CTES["sc"] = f"""
  SELECT c.symbol, c.time, c.i, c.n, c.close, momentum, volatility, volume_score, trend, momentum + volatility + volume_score + trend AS total
  FROM c LEFT JOIN (SELECT symbol, time, {_PART.format('momentum')} AS momentum, {_PART.format('volatility')} AS volatility, {_PART.format('volume')} AS volume_score, {_PART.format('trend')} AS trend
    FROM zs WHERE z IS NOT NULL AND coalesce(weight, 0) <> 0 GROUP BY symbol, time) s ON s.symbol = c.symbol AND s.time = c.time"""
CTES["sq"] = """
  SELECT symbol, time, close, total, momentum, volatility, volume_score, trend, up, down,
    list_sort(list(total) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)) AS past
  FROM (SELECT *, i >= 5 AND k >= 3 AND l > f AS up, i >= 5 AND k >= 3 AND l < f AS down
    FROM (SELECT *, count(total) OVER s AS k, first_value(total IGNORE NULLS) OVER s AS f, last_value(total IGNORE NULLS) OVER s AS l, count(total) OVER (PARTITION BY symbol) AS have
      FROM sc WINDOW s AS (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING)) WHERE total IS NOT NULL AND n >= 125 AND have >= 120)"""
CTES["qs"] = """
  SELECT symbol, time, CASE WHEN level IN ('p80', 'p60') THEN 'Buy' ELSE 'Sell' END AS kind, close AS price, 'quantile' AS rule, level,
    CASE level WHEN 'p80' THEN p80 WHEN 'p60' THEN p60 WHEN 'p20' THEN p20 ELSE p40 END AS bound, category, total
  FROM (SELECT *, CASE WHEN total > p80 AND up THEN 'p80' WHEN total > p60 AND total > 0 THEN 'p60' WHEN total < p20 AND down THEN 'p20' WHEN total < p40 AND total < 0 THEN 'p40' END AS level,
      CASE greatest(abs(momentum), abs(volatility), abs(volume_score), abs(trend)) WHEN abs(trend) THEN '趋势' WHEN abs(volume_score) THEN '量价' WHEN abs(volatility) THEN '波动'
        ELSE CASE WHEN momentum < 0 THEN '动量↓' ELSE '动量↑' END END AS category
    FROM (SELECT *, past[(floor((len(past) - 1) * 0.8::DOUBLE))::BIGINT + 1] AS p80, past[(floor((len(past) - 1) * 0.6::DOUBLE))::BIGINT + 1] AS p60,
        past[(floor((len(past) - 1) * 0.4::DOUBLE))::BIGINT + 1] AS p40, past[(floor((len(past) - 1) * 0.2::DOUBLE))::BIGINT + 1] AS p20 FROM sq WHERE len(past) >= 60))
  WHERE level IS NOT NULL"""
CTES["sl"] = "  SELECT *, lag(total, 1) OVER b AS t1, lag(total, 2) OVER b AS t2, lag(total, 4) OVER b AS t4 FROM sc WINDOW b AS (PARTITION BY symbol ORDER BY i)"
CTES["rv"] = """
  SELECT symbol, time, CASE WHEN total > 0 THEN 'Buy' ELSE 'Sell' END AS kind, close AS price, 'reversal' AS rule, NULL::VARCHAR AS level, t1 AS bound, NULL::VARCHAR AS category, total
  FROM sl WHERE i >= 3 AND n >= 5 AND ((t1 <= 0 AND total > 0 AND total > t1 AND t1 > t2) OR (t1 >= 0 AND total < 0 AND total < t1 AND t1 < t2))"""
CTES["dv0"] = """
  SELECT *, max(close) OVER w AS ph, min(close) OVER w AS pl, max(total) OVER w AS sh, min(total) OVER w AS lo, count(total) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) AS five
  FROM sl WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""
CTES["dv"] = """
  SELECT symbol, time, 'Sell' AS kind, close AS price, 'divergence' AS rule, NULL::VARCHAR AS level, sh AS bound, NULL::VARCHAR AS category, total
  FROM dv0 WHERE i >= 20 AND n >= 25 AND five = 5 AND close >= ph * 0.995::DOUBLE AND total < sh * 0.9::DOUBLE AND total < t4
  UNION ALL SELECT symbol, time, 'Buy', close, 'divergence', NULL, lo, NULL, total
  FROM dv0 WHERE i >= 20 AND n >= 25 AND five = 5 AND close <= pl * 1.005::DOUBLE AND total > lo * 1.1::DOUBLE AND total > t4"""
CTES["sg"] = """
  SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time, CASE rule WHEN 'quantile' THEN 0 WHEN 'reversal' THEN 1 ELSE 2 END, kind DESC))::INTEGER AS seq
  FROM (FROM qs UNION ALL FROM rv UNION ALL FROM dv)"""
CTES["pr"] = """
  SELECT *, CASE WHEN kind = 'Buy' THEN (leaves - price) / price * 100 END AS pnl_pct
  FROM (SELECT *, first_value(CASE WHEN kind = 'Sell' THEN price END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS leaves FROM sg)"""
CTES["zr"] = """
  SELECT symbol, time, i, close, total, s AS alpha_std, CASE WHEN total IS NOT NULL THEN (total - m) / s END AS alpha_z
  FROM (SELECT *, CASE WHEN i >= 60 AND count(total) OVER w >= 20 THEN greatest(stddev_pop(total) OVER w, 1e-12) END AS s, avg(total) OVER w AS m
    FROM sc WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 59 PRECEDING))"""
CTES["zrm"] = "  SELECT symbol, time, i, close, total, coalesce(alpha_std, 1e-6) AS s, coalesce(alpha_z, 0) AS z FROM zr WHERE i >= 60"
CTES["tt"] = """
  SELECT DISTINCT symbol, 59::BIGINT AS i, NULL::BIGINT AS time, NULL::VARCHAR AS action, NULL::DOUBLE AS pnl, 0 AS units, 0::DOUBLE AS entry, 0::DOUBLE AS price, 0::DOUBLE AS last, 0 AS wait, NULL::DOUBLE AS level,
    NULL::DOUBLE AS close, NULL::DOUBLE AS total, NULL::DOUBLE AS z, NULL::DOUBLE AS s FROM zrm
  UNION ALL
  SELECT symbol, i, time, a, CASE WHEN a = 'Exit' THEN (close - price) / price * 100 END,
    CASE a WHEN 'Exit' THEN 0 WHEN 'Entry' THEN 1 WHEN 'Add' THEN units + 1 ELSE units END,
    CASE a WHEN 'Exit' THEN 0 WHEN 'Entry' THEN total ELSE entry END,
    CASE a WHEN 'Exit' THEN 0 WHEN 'Entry' THEN close WHEN 'Add' THEN (price * units + close) / (units + 1) ELSE price END,
    CASE a WHEN 'Exit' THEN 0 WHEN 'Entry' THEN total WHEN 'Add' THEN total ELSE last END,
    CASE WHEN a IS NOT NULL THEN 3 ELSE waits END,
    CASE a WHEN 'Exit' THEN entry - 2 * s WHEN 'Entry' THEN 1.5 WHEN 'Add' THEN last + 0.5::DOUBLE * s END, close, total, z, s
  FROM (SELECT *, CASE WHEN total IS NULL THEN NULL WHEN units > 0 AND total < entry - 2 * s THEN 'Exit' WHEN waits > 0 THEN NULL
      WHEN units = 0 AND z > 1.5 THEN 'Entry' WHEN units > 0 AND units < 4 AND total > last + 0.5::DOUBLE * s THEN 'Add' END AS a
    FROM (SELECT q.symbol, q.i, q.time, q.close, q.total, q.s, q.z, r.units, r.entry, r.price, r.last, greatest(r.wait - 1, 0) AS waits
      FROM tt r JOIN zrm q ON q.symbol = r.symbol AND q.i = r.i + 1))"""
CTES["ta"] = """
  SELECT symbol, time, action, close AS price, total AS alpha_score, z AS alpha_z, s AS alpha_std, CASE WHEN action = 'Exit' THEN 0 ELSE units * 25.0 END::DOUBLE AS position_pct,
    units, 4 AS max_units, level, CASE WHEN action <> 'Exit' THEN tt.price END AS avg_entry, pnl AS pnl_pct FROM tt WHERE action IS NOT NULL"""
