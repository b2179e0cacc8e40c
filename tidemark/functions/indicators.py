"""Technical measurements as columns: for every bar of every symbol, over shared window frames.

A window gives null unless it has exactly its number of rows and none is null: a missing
measurement is neither zero nor a shorter window.  All frames share one partitioning and order, so Spark
sorts once.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date")


def tail(n: int, offset: int = 0) -> WindowSpec:
    """The n bars that end offset bars before the current one."""
    return by_symbol().rowsBetween(-(n - 1) - offset, -offset)


def upto() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def guarded(value: Column, x: str, n: int, offset: int = 0) -> Column:
    """value where the frame is full and x has no null in it."""
    w = tail(n, offset)
    return F.when((F.count(F.lit(1)).over(w) == n) & (F.count(x).over(w) == n), value)


def sma(x: str, n: int, offset: int = 0) -> Column:
    return guarded(F.avg(x).over(tail(n, offset)), x, n, offset)


def rolling_max(x: str, n: int) -> Column:
    return guarded(F.max(x).over(tail(n)), x, n)


def rolling_min(x: str, n: int) -> Column:
    return guarded(F.min(x).over(tail(n)), x, n)


def _steps(n: int) -> list[int]:
    """Factors of n, few and small: a window of n rows is made of blocks of blocks."""
    out = []
    while n > 1:
        f = next((f for f in (5, 4, 3, 2) if n % f == 0), None) or next(f for f in range(7, n + 1) if n % f == 0)
        out.append(f)
        n //= f
    return out or [1]


def _strict(pick):
    """pick (greatest or least), null if one is null."""
    return lambda xs: F.when(reduce(and_, [x.isNotNull() for x in xs]), pick(*xs)) if len(xs) > 1 else xs[0]


_JOINS = {"sum": lambda xs: reduce(add, xs), "max": _strict(F.greatest), "min": _strict(F.least)}


def with_rolling(rows: DataFrame, **want: tuple) -> DataFrame:
    """rows with name=(kind, x, n) or (kind, x, n, offset): what sma, rolling_max and the like give, for whole tables.

    A frame of n rows goes through n rows for every bar.  Here kinds mean, max and min of a bar put together the blocks that
    bars before it have already, by lags: 10 values for 60 rows, level by level, all of them over one sort.
    since_max is bars_since_max.

    Kinds deviation (of all) and sample_deviation take the differences to the current value.  As that is one of the n,
    their squares add up to at most n + 1 times those to the mean: taking the mean's part off costs no more
    than two digits at n = 60, and equal values give exactly 0.
    """
    w, own = by_symbol(), rows.columns
    levels: list[tuple[dict, dict]] = []  # of each level: the lags it takes, and what it makes of them

    def lag(level: int, x: str, k: int) -> Column:
        if not k:
            return F.col(x)
        levels.extend(({}, {}) for _ in range(level + 1 - len(levels)))
        levels[level][0][f"__lag_{x}_{k}"] = F.lag(x, k).over(w)
        return F.col(f"__lag_{x}_{k}")

    def block(level: int, x: str, backs: list[int], join: str, since: str | None) -> tuple[Column, Column]:
        """The join of x at some bars back, and (for since_max) how many bars back its latest maximum is."""
        values = [lag(level, x, b) for b in backs]
        made = _JOINS[join](values)
        if since is None:
            return made, made
        at = [F.when(v == made, (lag(level, since, b) if since else F.lit(0).cast("long")) + b) for v, b in sorted(zip(values, backs, strict=True), key=lambda p: p[1])]
        return made, F.when(made.isNotNull(), F.coalesce(*at))

    last: dict[str, Column] = {}
    deepest = max((len(_steps(n)) for _, _, n, *_ in want.values()), default=1) - 1
    for name, (kind, x, n, *offset) in want.items():
        shift = offset[0] if offset else 0
        if kind in ("deviation", "sample_deviation"):
            apart = [lag(deepest, x, j + shift) - lag(deepest, x, shift) for j in reversed(range(1, n))]
            squares = reduce(add, [d * d for d in apart]) - F.pow(reduce(add, apart), F.lit(2.0)) / n
            last[name] = F.sqrt(F.when(squares.isNotNull(), F.greatest(squares, F.lit(0.0))) / (n - 1 if kind == "sample_deviation" else n))
            continue
        join, steps, have, at, since = {"mean": "sum", "since_max": "max"}.get(kind, kind), _steps(n), 1, x, "" if kind == "since_max" else None
        for k, f in enumerate(steps):
            final = k == len(steps) - 1
            level = deepest if final else k
            made, back = block(level, at, [have * j + (shift if final else 0) for j in reversed(range(f))], join, since)
            have *= f
            if final:
                last[name] = made / n if kind == "mean" else back
            else:
                at = f"__{join}_{x}_{have}"
                levels[k][1][at] = made
                if since is not None:
                    since = f"__since_{x}_{have}"
                    levels[k][1][since] = back
    for lags, made in levels:
        rows = rows.withColumns(lags).withColumns(made).drop(*lags) if made else rows.withColumns(lags)
    return rows.withColumns(last).select(*own, *[x for x in want if x not in own])


def pct_change(x: str, k: int) -> Column:
    base = F.lag(x, k).over(by_symbol())
    return F.try_divide(F.col(x) - base, F.nullif(base, F.lit(0.0))) * 100


def bars_since_max(x: str, n: int, seq: str = "seq") -> Column:
    """Bars since the latest occurrence of the maximum of the last n; 0: now."""
    return guarded(F.col(seq) - F.max_by(seq, F.struct(x, seq)).over(tail(n)), x, n)


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    first = F.row_number().over(by_symbol()) == 1
    whole = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(first, F.col("high") - F.col("low")).when(before.isNotNull(), whole)


def whole_series_known(x: str) -> Column:
    """No null from the first bar on: what measures of a whole series ask for."""
    return F.count(F.when(F.col(x).isNull(), 1)).over(upto()) == 0


def with_bollinger(rows: DataFrame, x: str, n: int = 20, width: float = 2.0) -> DataFrame:
    """rows with bb_upper, bb_lower, bb_width and bb_percent."""
    rows = with_rolling(rows.withColumn("__known", whole_series_known(x)), __mid=("mean", x, n), __dev=("deviation", x, n))
    known, mid, dev = F.col("__known"), F.col("__mid"), F.col("__dev")
    upper, lower = mid + width * dev, mid - width * dev
    return rows.withColumns({"bb_upper": F.when(known, upper), "bb_lower": F.when(known, lower), "bb_width": F.when(known, F.try_divide(upper - lower, mid)), "bb_percent": F.when(known, F.try_divide(F.col(x) - lower, F.nullif(upper - lower, F.lit(0.0))))}).drop("__known", "__mid", "__dev")


def apart(x: str, mean: str) -> Column:
    """x less a mean of doubles; 0 where they differ by a part in 10^12 or less, which is what adding leaves of values that are equal."""
    gap = F.col(x) - F.col(mean)
    return F.when(F.abs(gap) <= F.abs(x) * 1e-12, 0.0).otherwise(gap)


def log_return(x: str) -> Column:
    before = F.lag(x).over(by_symbol())
    return F.when((F.col(x) > 0) & (before > 0), F.log(F.col(x) / before))


def realised_volatility(returns: str, n: int, yearly: bool = True, price: str = "close") -> Column:
    """Sample deviation of the last n log returns (a column made with log_return), yearly if asked for; null after a hole in the prices."""
    daily = F.when(whole_series_known(price), guarded(F.stddev_samp(returns).over(tail(n)), returns, n))
    return daily * F.sqrt(F.lit(252.0)) if yearly else daily


def ratio(x: str, of: str) -> Column:
    return F.try_divide(F.col(x), F.nullif(of, F.lit(0.0)))


def relative_volume(x: str, n: int) -> Column:
    """Now against the mean of the n bars before."""
    return F.try_divide(F.col(x), F.nullif(sma(x, n, 1), F.lit(0.0)))


def candle() -> dict[str, Column]:
    span = F.col("high") - F.col("low")
    body_top, body_low = F.greatest("open", "close"), F.least("open", "close")
    known = (span > 0) & F.col("close").isNotNull() & F.col("open").isNotNull()
    share = lambda x: F.when(known, F.try_divide(x, span) * 100)
    return {"body_pct": share(body_top - body_low), "upper_wick_pct": share(F.col("high") - body_top), "lower_wick_pct": share(body_low - F.col("low")), "clv": F.when(known, F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span))}


def up_streak(seq: str = "seq", price: str = "close") -> Column:
    """Length of the run of rising closes that ends now (needs column `rises`); null after a hole, and on the first bar."""
    return F.when(whole_series_known(price) & (F.col(seq) >= 2), F.col(seq) - F.coalesce(F.last(F.when(~F.col("rises"), F.col(seq)), ignorenulls=True).over(upto()), F.lit(0)))


# ------------------------------------------------------------------ folds over a series
def series(*columns: str):
    """Aggregates that lay a symbol's columns out as arrays in order of date."""
    return F.array_sort(F.collect_list(F.struct("trade_date", *columns)))


def ema_of(values: Column, n: int) -> Column:
    """EMA of an array: the mean of the first n, then folded with 2 / (n + 1); null with holes or too few."""
    alpha = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    ok = (F.size(values) >= n) & ~F.exists(values, lambda x: x.isNull())
    return F.when(ok, F.aggregate(rest, seed, lambda a, x: (x - a) * alpha + a))


def wilder_of(values: Column, n: int) -> Column:
    """Wilder's smoothing of an array: the mean of the first n, then (previous * (n - 1) + x) / n."""
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    ok = (F.size(values) >= n) & ~F.exists(values, lambda x: x.isNull())
    return F.when(ok, F.aggregate(rest, seed, lambda a, x: (a * (n - 1) + x) / n))


def changes_of(values: Column) -> Column:
    """Differences of neighbours of an array."""
    later = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(later, F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)


def rsi_of(values: Column, n: int = 14) -> Column:
    move = changes_of(values)
    gain = wilder_of(F.transform(move, lambda x: F.greatest(x, F.lit(0.0))), n)
    loss = wilder_of(F.transform(move, lambda x: F.greatest(-x, F.lit(0.0))), n)
    known = ~F.exists(values, lambda x: x.isNull())
    return F.when(known & gain.isNotNull(), F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, F.nullif(loss, F.lit(0.0))))))


# ------------------------------------------------------------------ recursive means on every bar
#: Bars that a fold goes through before their states are put aside: a path is laid down in pieces, so its cost is linear.
PIECE = 64


def bound(value: str, name: str, use: str) -> str:
    """SQL text: use, in which name stands for a value that is made once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def scan(values: str, first: str, step: str) -> str:
    """SQL text: the states of a fold after each element of an array: what aggregate gives at the end, for every place.

    step gives the next state of s (the state) and x (the element), with the type of first.  values is a name.
    """
    pieces = f"if(size({values}) > 0, transform(sequence(0, (size({values}) - 1) div {PIECE}), p -> slice({values}, int(p * {PIECE} + 1), {PIECE})), slice(array({values}), 1, 0))"
    # A piece's path begins with the state before it.
    own = f"aggregate(piece, array(element_at(element_at(done, -1), -1)), (own, x) -> concat(own, array({bound('element_at(own, -1)', 's', step)})))"
    path = f"aggregate({pieces}, array(array({first})), (done, piece) -> concat(done, array({own})))"
    return f"flatten(transform({bound(path, 'all', 'slice(all, 2, size(all) - 1)')}, own -> slice(own, 2, size(own) - 1)))"


def _mean(state: str, x: str, k: str, n: int, alpha: str) -> str:
    """A recursive mean as a state: a sum up to the n-th value, their mean there, folded with alpha after it."""
    return f"case when {k} < {n} then {state} + {x} when {k} = {n} then ({state} + {x}) / {n} else ({x} - {state}) * {alpha} + {state} end"


def _wilder(state: str, x: str, k: str, n: int) -> str:
    return f"case when {k} < {n} then {state} + {x} when {k} = {n} then ({state} + {x}) / {n} else ({state} * {n - 1} + {x}) / {n} end"


def recursive_means(bars: str) -> Column:
    """For an array of bars (high, low, close: doubles) in order: an array of EMA(12, 26), MACD(12, 26, 9), RSI(14), ATR(14), ADX and DI(14).

    A measure is null until it has its bars, and from the first hole in the prices it needs on.
    """
    zeros = ", ".join(f"'{n}', 0.0D" for n in ("e12", "e26", "gain", "loss", "tr", "up", "down"))
    first = f"named_struct('k', 0, 'closes', true, 'ranges', true, 'high', double(null), 'low', double(null), 'close', double(null), {zeros})"
    # Of this bar: its number, what is known up to it, and its moves against the bar before.
    now = (
        "named_struct('k', s.k + 1, 'closes', s.closes and x.close is not null, 'ranges', s.ranges and s.closes and x.close is not null and x.high is not null and x.low is not null, "
        "'move', x.close - s.close, 'rise', x.high - s.high, 'fall', s.low - x.low, 'tr', greatest(x.high - x.low, abs(x.high - s.close), abs(x.low - s.close)))"
    )
    later = lambda name, ok, x: f"'{name}', case when n.{ok} and n.k > 1 then {_wilder(f's.{name}', x, '(n.k - 1)', 14)} else 0.0D end"
    ema = lambda n: f"'e{n}', case when n.closes then {_mean(f's.e{n}', 'x.close', 'n.k', n, f'(2.0D / {n + 1})')} else 0.0D end"
    step = bound(
        now,
        "n",
        "named_struct('k', n.k, 'closes', n.closes, 'ranges', n.ranges, 'high', x.high, 'low', x.low, 'close', x.close, "
        + ", ".join([ema(12), ema(26), later("gain", "closes", "greatest(n.move, 0.0D)"), later("loss", "closes", "greatest(-n.move, 0.0D)"), later("tr", "ranges", "n.tr"), later("up", "ranges", "if(n.rise > n.fall and n.rise > 0, n.rise, 0.0D)"), later("down", "ranges", "if(n.fall > n.rise and n.fall > 0, n.fall, 0.0D)")])
        + ")",
    )
    # What the second fold takes: the MACD line, the directional shares and their index.
    whole = "if(s.ranges and s.k >= 15 and s.tr <> 0, 100 * {} / s.tr, null)"
    line = f"named_struct('s', s, 'macd', if(s.closes and s.k >= 26, s.e12 - s.e26, null), 'plus', {whole.format('s.up')}, 'minus', {whole.format('s.down')})"
    line = bound(line, "d", "named_struct('s', d.s, 'macd', d.macd, 'plus', d.plus, 'minus', d.minus, 'dx', case when d.plus + d.minus > 0 then 100 * abs(d.plus - d.minus) / (d.plus + d.minus) when d.plus is not null then 0.0D end)")
    second = f"named_struct('n', s.n + int(x.dx is not null), 'm', s.m + int(x.macd is not null), 'signal', if(x.macd is null, s.signal, {_mean('s.signal', 'x.macd', '(s.m + 1)', 9, '0.2D')}), 'adx', if(x.dx is null, s.adx, {_wilder('s.adx', 'x.dx', '(s.n + 1)', 14)}))"
    result = (
        "named_struct('ema_12', if(x.s.closes and x.s.k >= 12, x.s.e12, null), 'ema_26', if(x.s.closes and x.s.k >= 26, x.s.e26, null), 'macd', x.macd, "
        "'macd_signal', if(x.macd is not null and t.m >= 9, t.signal, null), 'macd_hist', if(x.macd is not null and t.m >= 9, x.macd - t.signal, null), "
        "'rsi_14', case when not (x.s.closes and x.s.k >= 15) then null when x.s.loss > 0 then 100.0D - 100.0D / (1.0D + x.s.gain / x.s.loss) when x.s.gain > 0 then 100.0D else 50.0D end, "
        "'atr_14', if(x.s.ranges and x.s.k >= 15, x.s.tr, null), 'adx_14', if(x.plus is not null and t.n >= 14, t.adx, null), 'plus_di_14', x.plus, 'minus_di_14', x.minus)"
    )
    lines = f"transform({bound(bars, 'series', scan('series', first, step))}, s -> {line})"
    return F.expr(bound(lines, "lines", f"zip_with(lines, {scan('lines', "named_struct('n', 0, 'm', 0, 'signal', 0.0D, 'adx', 0.0D)", second)}, (x, t) -> {result})"))


def with_recursive_means(bars: DataFrame, key: str = "symbol", order: str = "trade_date", dealt: bool = False) -> DataFrame:
    """bars with the columns of recursive_means: one shuffle by key, a fold over each key's bars in order, rows again.

    The shuffle has its number of partitions by name, since a fold takes some microseconds a bar: adaptive plans
    would merge partitions that are small in bytes.  dealt: bars lie by key already, in partitions of their maker's number.
    """
    rest = [x for x in bars.columns if x not in (key, order)]
    if not dealt:
        bars = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = bars.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("__bars"))
    means = recursive_means("transform(__bars, b -> named_struct('high', double(b.high), 'low', double(b.low), 'close', double(b.close)))")
    rows = rows.select(key, F.inline(F.zip_with("__bars", means, lambda b, m: F.struct(b.alias("b"), m.alias("m")))))
    return rows.select(key, "b.*", "m.*")
