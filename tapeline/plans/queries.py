"""Registered queries of the tape operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import folder, written
from ..functions.windows import in_chunks
from ..operators import backtest as bt
from ..operators import bars, barriers, features, labels, model, pbo, prepare, telemetry
from ..sources import io
from . import dataset, streams, tapes
from .streams import STREAMS
from .tapes import EVENT_BARS, LINEITEM_BARS, SIGNALS, THRESHOLD, TICKS_E, TICKS_L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(col: str, digits: int = 6, name: str | None = None, scale: float = 1.0):
    return (F.round(F.col(col) * scale, digits) + F.lit(0.0)).alias(name or col)  # no negative zero


def text(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
OHLCV = ("open", "high", "low", "close", "volume")

# Sources

HOURS = f"""hours AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2)"""


@query(f"WITH {TICKS_E}, {HOURS} SELECT symbol, {TS}, open, high, low, close, volume FROM hours")
def time_bars(spark, sf_dir):
    return io.time_bars(tapes.tape_events(spark, sf_dir)).select("symbol", text("ts"), *OHLCV)


@query(f"WITH {TICKS_E}, {HOURS} SELECT symbol, {TS}, open, high, low, close, volume FROM hours")
def wide_to_long(spark, sf_dir):
    hours = io.time_bars(tapes.tape_events(spark, sf_dir))
    wide = hours.groupBy("ts").pivot("symbol", ["click", "error", "purchase", "signup", "view"]).agg(*(F.first(c).alias(c) for c in OHLCV))
    return io.wide_to_long(wide, ["click", "view", "missing", "error", "purchase", "signup"]).select("symbol", text("ts"), *OHLCV)


@query(f"WITH {TICKS_E} SELECT symbol, count(DISTINCT date_trunc('milliseconds', ts)) AS n FROM ticks GROUP BY 1")
def normalize_pages(spark, sf_dir):
    t = tapes.tape_events(spark, sf_dir)
    page = F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("double"), *(F.col(c) for c in ("price",) * 4), F.col("volume"))
    both = F.array_distinct(F.array(F.floor((F.col("seq") - 1) / 1000), F.floor(F.col("seq") / 1000)))  # a page's last row begins the next
    pages = t.select("symbol", "seq", page.alias("row"), F.explode(both).alias("k")).groupBy("symbol", "k").agg(F.sort_array(F.collect_list("row")).alias("page"))
    return io.normalize_pages(pages).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id % 3 AS g, list(DISTINCT event_type) AS tickers FROM events GROUP BY 1)
SELECT unnest(tickers) AS symbol, CAST(CASE WHEN g = 0 THEN 0.001 ELSE 0.0005 END AS DOUBLE) AS fee, CAST(CASE WHEN g = 1 THEN 60 ELSE 730 END AS BIGINT) AS days FROM c""")
def universe(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = e.groupBy((F.col("user_id") % 3).alias("g")).agg(F.collect_set("event_type").alias("tickers"))
    c = c.select("tickers", *(F.lit(None).cast("string").alias(x) for x in ("start_date", "end_date", "interval")), F.when(F.col("g") == 0, 0.001).alias("transaction_fee_percent"), F.when(F.col("g") == 1, 60).cast("bigint").alias("data_window_days"))
    return io.universe(c).select("symbol", "fee", "days")


@query("""SELECT regexp_extract(s, '([^/]*)$', 1) AS symbol, count(*) AS n
FROM (SELECT CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'data/' || event_type ELSE event_type || '$' END AS s FROM events)
WHERE regexp_matches(regexp_extract(s, '([^/]*)$', 1), '^[\\^a-zA-Z0-9_.-]+$') GROUP BY 1""")
def valid_symbols(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("data/"), "event_type")).otherwise(F.concat("event_type", F.lit("$")))
    return io.valid_symbols(e.select(s.alias("symbol"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKS_E}, m AS (SELECT symbol, max(ts) AS l FROM ticks GROUP BY 1) SELECT symbol, count(*) AS n, min(seq) AS first_seq FROM ticks JOIN m USING (symbol) WHERE ts >= l - INTERVAL 7 DAY GROUP BY 1")
def lookback(spark, sf_dir):
    return io.lookback(tapes.tape_events(spark, sf_dir), 7).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(f"""WITH {TICKS_L}, u AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT -1 UNION ALL SELECT -2), c AS (SELECT symbol, count(*) AS n FROM ticks GROUP BY 1)
SELECT symbol, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no data' ELSE 'too few rows' END AS reason FROM u LEFT JOIN c USING (symbol) WHERE coalesce(n, 0) < 600""")
def coverage(spark, sf_dir):
    t = tapes.tape_lineitem(spark, sf_dir)
    more = t.sparkSession.range(2).select((-F.col("id") - 1).alias("symbol"))
    return io.coverage(t.select("symbol").unionByName(more), t, 600)


# Bars


@query(f"WITH {TICKS_L} SELECT symbol, seq, round(price * volume, 4) AS dollar_volume FROM ticks")
def dollar_volume(spark, sf_dir):
    return bars.with_dollar_volume(tapes.as_bars(tapes.tape_lineitem(spark, sf_dir))).select("symbol", "seq", r("dollar_volume", 4))


@query(f"WITH {TICKS_L}, {THRESHOLD} SELECT symbol, seq, bar_sum FROM thr")
def bar_threshold(spark, sf_dir):
    return bars.with_bar_threshold(tapes.tape_lineitem(spark, sf_dir)).select("symbol", "seq", "bar_sum")


BAR_COLS = f"SELECT symbol, seq, {TS}, open, high, low, close, volume FROM bars"


@query(f"{EVENT_BARS} {BAR_COLS}")
def dollar_bars(spark, sf_dir):
    return tapes.event_bars(spark, sf_dir).select("symbol", "seq", text("ts"), *OHLCV)


@query(f"{EVENT_BARS} {BAR_COLS}")
def dollar_bars_chunked(spark, sf_dir):
    out = bars.dollar_bars(tapes.tape_events(spark, sf_dir), chunk_rows=500)  # small, so that the test data's symbols fall into several
    return out.select("symbol", "seq", text("ts"), *OHLCV)


@query(f"{LINEITEM_BARS} {BAR_COLS}")
def dollar_bars_lineitem(spark, sf_dir):
    return tapes.lineitem_bars(spark, sf_dir).select("symbol", "seq", text("ts"), *OHLCV)


# Features

IMB = """imb AS (SELECT *, close - lag(close) OVER w AS d, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
rows AS MATERIALIZED (SELECT *, CASE WHEN d <> 0 THEN volume ELSE 0 END AS imbalance, ret / (close * volume + 1e-8) AS q FROM imb)"""


def over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"{LINEITEM_BARS}, {IMB} SELECT symbol, seq, CASE WHEN d > 0 THEN volume WHEN d = 0 THEN volume / 2 ELSE 0.0 END AS buy, CASE WHEN d < 0 THEN volume WHEN d = 0 THEN volume / 2 ELSE 0.0 END AS sell, imbalance FROM rows")
def volume_imbalance(spark, sf_dir):
    return features.volume_imbalance(tapes.lineitem_bars(spark, sf_dir)).select("symbol", "seq", "buy", "sell", "imbalance")


@query(f"{EVENT_BARS}, {IMB} SELECT symbol, seq, CASE WHEN seq >= 50 THEN round(sum(imbalance) OVER {over(50)} / sum(volume) OVER {over(50)}, 8) END AS vpin FROM rows")
def vpin(spark, sf_dir):
    return features.vpin(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", r("vpin", 8))


@query(ORACLE["vpin"])
def vpin_chunked(spark, sf_dir):
    out = in_chunks(tapes.event_bars(spark, sf_dir), features.vpin, 300, before=50)
    return out.select("symbol", "seq", r("vpin", 8))


@query(f"{EVENT_BARS}, {IMB} SELECT symbol, seq, CASE WHEN seq >= 51 THEN round(avg(abs(q)) OVER {over(50)} * 1e6, 6) END AS amihud FROM rows")
def amihud(spark, sf_dir):
    return features.amihud(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", r("amihud", 6, scale=1e6))


@query(f"{EVENT_BARS}, {IMB} SELECT symbol, seq, CASE WHEN seq >= 51 THEN round(avg(q) OVER {over(50)} * 1e6, 6) END AS kyles_lambda FROM rows")
def kyles_lambda(spark, sf_dir):
    return features.kyles_lambda(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", r("kyles_lambda", 6, scale=1e6))


DF = """dfx AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS x FROM rows),
dfs AS (SELECT *, count(x) OVER f AS n, regr_sxx(d, x) OVER f AS sxx, regr_syy(d, x) OVER f AS syy, regr_sxy(d, x) OVER f AS sxy FROM dfx
  WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
dft AS (SELECT *, CASE WHEN n = 30 THEN (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / 28 / sxx) END AS t FROM dfs)"""


@query(f"{EVENT_BARS}, {IMB}, {DF} SELECT symbol, seq, round(t, 6) AS df_tstat FROM dft")
def df_tstat(spark, sf_dir):
    return features.df_tstat(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", r("df_tstat"))


@query(f"""{EVENT_BARS}, c AS (SELECT symbol, seq, close - avg(close) OVER (PARTITION BY symbol) AS y FROM bars),
x AS (SELECT symbol, seq, lag(y) OVER w AS x, y - lag(y) OVER w AS d FROM c WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
p AS MATERIALIZED (SELECT symbol, seq, sum(coalesce(x, 0)) OVER w AS px, sum(coalesce(d, 0)) OVER w AS pd, sum(coalesce(x * x, 0)) OVER w AS pxx, sum(coalesce(x * d, 0)) OVER w AS pxd, sum(coalesce(d * d, 0)) OVER w AS pdd
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
s AS (SELECT t.symbol, t.seq, t.seq - a.seq AS m, t.px - a.px AS sx, t.pd - a.pd AS sd, t.pxx - a.pxx AS sxx, t.pxd - a.pxd AS sxd, t.pdd - a.pdd AS sdd
  FROM p t JOIN p a ON a.symbol = t.symbol AND a.seq BETWEEN t.seq - 100 AND t.seq - 30 WHERE t.seq > 100),
v AS (SELECT *, sxx - sx * sx / m AS var, sxd - sx * sd / m AS cov, sdd - sd * sd / m AS dd FROM s),
b AS (SELECT symbol, seq, max(cov / var / sqrt((dd - cov * cov / var) / (m - 2) / var)) AS t FROM v GROUP BY 1, 2)
SELECT symbol, seq, round(t, 5) AS sadf FROM bars LEFT JOIN b USING (symbol, seq)""")
def sadf(spark, sf_dir):
    return features.sadf(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", r("sadf", 5))


def _ffd_rows(d: float) -> str:
    w = kernels.ffd_weights(d)
    last_first = ", ".join(f"{x!r}::DOUBLE" for x in reversed(w))
    return f"""{EVENT_BARS}, past AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {len(w) - 1} PRECEDING AND CURRENT ROW) AS y FROM bars),
full_past AS (SELECT symbol, seq, y FROM past WHERE len(y) = {len(w)}), f AS (SELECT symbol, seq, list_dot_product(y, [{last_first}]) AS y FROM full_past)"""


def _ffd_sql(d: float) -> str:
    return f"{_ffd_rows(d)} SELECT symbol, seq, round(y, 6) AS ffd FROM bars LEFT JOIN f USING (symbol, seq)"


@query(_ffd_sql(0.4))
def ffd_wide(spark, sf_dir):
    return features.ffd(tapes.event_bars(spark, sf_dir), 0.4).select("symbol", "seq", r("ffd"))


@query(_ffd_sql(0.9))
def ffd_narrow(spark, sf_dir):
    return features.ffd(tapes.event_bars(spark, sf_dir), 0.9).select("symbol", "seq", r("ffd"))


@query()
def adf_test(spark, sf_dir):
    return features.adf_test(tapes.event_bars(spark, sf_dir), features.D_GRID).select("symbol", "d", "n", r("t"), "lag", r("p"))


def _adf_sql(d: float) -> str:
    """Two lags by the normal equations of centred columns (Cramer's rule)."""
    names = ("y", "a", "b")
    cov = lambda p, q: f"covar_pop({p}, {q}) * count(*)"
    cells = ", ".join(f"{cov(p, q)} AS s{p}{q}" for i, p in enumerate(names) for q in names[i:]) + ", " + ", ".join(f"{cov(p, 'z')} AS c{p}" for p in names)
    return f"""v AS (SELECT symbol, seq, y AS w, lag(y) OVER o AS y0, lag(y, 2) OVER o AS y1, lag(y, 3) OVER o AS y2, count(*) OVER (PARTITION BY symbol) AS n FROM f WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
x AS (SELECT symbol, n, w - y0 AS z, y0 AS y, y0 - y1 AS a, y1 - y2 AS b FROM v WHERE y2 IS NOT NULL),
s AS (SELECT symbol, any_value(n) AS n, count(*) AS m, covar_pop(z, z) * count(*) AS szz, {cells} FROM x GROUP BY 1),
i AS (SELECT *, saa * sbb - sab * sab AS kyy, sab * syb - sya * sbb AS kya, sya * sab - saa * syb AS kyb, syy * sbb - syb * syb AS kaa, sya * syb - syy * sab AS kab, syy * saa - sya * sya AS kbb FROM s),
t AS (SELECT *, syy * kyy + sya * kya + syb * kyb AS det FROM i),
u AS (SELECT *, (kyy * cy + kya * ca + kyb * cb) / det AS b1, (kya * cy + kaa * ca + kab * cb) / det AS b2, (kyb * cy + kab * ca + kbb * cb) / det AS b3 FROM t)
SELECT symbol, CAST({d} AS DOUBLE) AS d, n, round(b1 / sqrt((szz - b1 * cy - b2 * ca - b3 * cb) / (m - 4) * kyy / det), 6) AS t FROM u WHERE n > 30"""


@query(f"{_ffd_rows(0.9)}, {_adf_sql(0.9)}")
def adf_two_lags(spark, sf_dir):
    return features.adf_test(tapes.event_bars(spark, sf_dir), [0.9], lag=2, chunk=400).filter("t is not null").select("symbol", "d", "n", r("t"))  # several chunks a symbol


@query()
def min_ffd(spark, sf_dir):
    return features.min_ffd(tapes.event_bars(spark, sf_dir))


# Barriers


@query(f"""{EVENT_BARS}, n AS (SELECT symbol, max(seq) AS n FROM bars GROUP BY 1),
st AS (SELECT symbol, unnest(range(60, n, 20)) AS start FROM n),
sl AS (SELECT b.symbol, st.start, b.seq, b.close, avg(b.close) OVER f AS z0, count(*) OVER f AS c FROM st JOIN bars b ON b.symbol = st.symbol AND b.seq - 1 >= st.start - 60 AND b.seq - 1 < st.start
  WINDOW f AS (PARTITION BY b.symbol, st.start ORDER BY b.seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
zz AS (SELECT *, CASE WHEN c = 15 THEN z0 END AS z FROM sl),
xx AS (SELECT *, lag(close) OVER w - lag(z) OVER w AS x FROM zz WINDOW w AS (PARTITION BY symbol, start ORDER BY seq)),
g AS (SELECT symbol, start, covar_samp(close, x) / var_samp(x) AS phi FROM xx WHERE z IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2)
SELECT symbol, start, round(phi, 6) AS phi, round(stddev_samp(close - z - phi * x), 6) AS sigma FROM xx JOIN g USING (symbol, start) WHERE z IS NOT NULL AND x IS NOT NULL GROUP BY symbol, start, phi""")
def ou_fit(spark, sf_dir):
    return barriers.ou_fit(barriers.rolling_slices(tapes.event_bars(spark, sf_dir))).select("symbol", "start", r("phi"), r("sigma"))


def embedding_paths(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("path_id"), F.col("embedding").cast("array<double>").alias("e"))
    p = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.round(F.aggregate(F.slice("e", F.lit(2), i), F.lit(0.0), lambda a, x: a + x), 9))
    return e.select("path_id", p.alias("p"))


@query("""WITH p AS (SELECT vec_id, list_transform(range(0, 15), lambda i: round(coalesce(list_sum(CAST(embedding[2:i+1] AS DOUBLE[])), 0), 9)) AS p FROM embeddings),
g AS (SELECT 0.5 + 0.25 * a AS pt, 0.5 + 0.25 * b AS sl FROM range(11) x(a), range(11) y(b)),
h AS (SELECT pt, sl, p, list_position(list_transform(p, lambda x: x >= pt * 0.125), true) AS up, list_position(list_transform(p, lambda x: x <= -sl * 0.125), true) AS low FROM p, g),
e AS (SELECT pt, sl, CASE WHEN coalesce(up, 0) > 0 AND (coalesce(low, 0) = 0 OR up < low) THEN pt * 0.125 WHEN coalesce(low, 0) > 0 THEN -sl * 0.125 ELSE p[15] END AS pnl FROM h),
s AS (SELECT pt, sl, CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END AS sharpe FROM e GROUP BY 1, 2)
SELECT CAST(pt AS DOUBLE) AS pt, CAST(sl AS DOUBLE) AS sl, round(sharpe, 6) AS sharpe, row_number() OVER (ORDER BY round(sharpe, 12) DESC, pt, sl) = 1 AS best FROM s""")
def barrier_grid(spark, sf_dir):
    return barriers.barrier_grid(embedding_paths(spark, sf_dir), 0.125).select("pt", "sl", r("sharpe"), "best")


PHIS = [-0.5, 0.0, 0.3, 0.7, 0.95]


@query(f"""WITH q AS (SELECT unnest({PHIS}) AS phi), e AS (SELECT vec_id, list_transform(embedding[1:14], lambda x: CAST(x AS DOUBLE) * 8) AS eps FROM embeddings),
p AS (SELECT phi, vec_id, list_transform(range(0, 15), lambda t: coalesce(list_sum(list_transform(range(1, t + 1), lambda s: pow(phi, t - s) * eps[s])), 0.0)) AS p FROM e, q),
g AS (SELECT CAST(0.5 + 0.25 * a AS DOUBLE) AS pt, CAST(0.5 + 0.25 * b AS DOUBLE) AS sl FROM range(11) x(a), range(11) y(b)),
h AS (SELECT phi, pt, sl, p, list_position(list_transform(p, lambda x: x >= pt), true) AS up, list_position(list_transform(p, lambda x: x <= -sl), true) AS low FROM p, g),
n AS (SELECT phi, pt, sl, CASE WHEN coalesce(up, 0) > 0 AND (coalesce(low, 0) = 0 OR up < low) THEN pt WHEN coalesce(low, 0) > 0 THEN -sl ELSE p[15] END AS pnl FROM h),
s AS (SELECT phi, pt, sl, CASE WHEN stddev_pop(pnl) > 1e-9 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END AS sharpe FROM n GROUP BY 1, 2, 3)
SELECT CAST(phi AS DOUBLE) AS phi, pt, sl, round(sharpe, 6) + 0.0 AS sharpe, row_number() OVER (PARTITION BY phi ORDER BY round(sharpe, 12) DESC, pt, sl) = 1 AS best FROM s""")
def ar_barriers(spark, sf_dir):
    """Barriers of autoregressive paths whose noise is the embeddings' first values, of deviation 1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noise = e.select(F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 14), lambda x: x * 8).alias("eps"))
    return barriers.ar_barriers(noise, PHIS).select("phi", "pt", "sl", r("sharpe"), "best")


@query()
def rolling_barriers(spark, sf_dir):
    return barriers.rolling_barriers(tapes.event_bars(spark, sf_dir)).select("symbol", "seq", "optimal_pt", "optimal_sl")


# Datasets

COLS = ["vpin", "amihud", "kyles_lambda", "df_tstat"]


def sd(c: str) -> str:
    return f"(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END)"


def feature_rows(spark, sf_dir):
    b = tapes.event_bars(spark, sf_dir)
    out = in_chunks(b, lambda part: features.df_tstat(features.kyles_lambda(features.amihud(features.vpin(part)))), features.CHUNK, before=51)
    out = out.select("symbol", "seq", "ts", "close", "vpin", *((F.col(c) * 1e6).alias(c) for c in ("amihud", "kyles_lambda")), "df_tstat")
    return prepare.chrono_split(written(prepare.complete_rows(out), "feature-rows"))  # read by the cut, the scaler and what follows


FEATURE_ROWS = f"""{EVENT_BARS}, {IMB}, {DF},
feats AS (SELECT symbol, seq, ts, close, CASE WHEN seq >= 50 THEN sum(imbalance) OVER {over(50)} / sum(volume) OVER {over(50)} END AS vpin,
  CASE WHEN seq >= 51 THEN avg(abs(q)) OVER {over(50)} * 1e6 END AS amihud, CASE WHEN seq >= 51 THEN avg(q) OVER {over(50)} * 1e6 END AS kyles_lambda, t AS df_tstat FROM dft),
clean AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM feats WHERE vpin IS NOT NULL AND amihud IS NOT NULL AND df_tstat IS NOT NULL),
cut AS (SELECT *, max(CASE WHEN k = CAST(floor(n * 0.8) AS BIGINT) THEN ts END) OVER (PARTITION BY symbol) AS cut_ts FROM clean),
parts AS MATERIALIZED (SELECT *, CASE WHEN ts < cut_ts THEN 'train' ELSE 'test' END AS split FROM cut)"""


@query(f"{FEATURE_ROWS} SELECT symbol, split, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM parts GROUP BY 1, 2")
def chrono_split(spark, sf_dir):
    return feature_rows(spark, sf_dir).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""{FEATURE_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY seq) AS i, count(*) OVER (PARTITION BY symbol, split) AS m FROM parts)
SELECT symbol, seq, split FROM k WHERE split = 'train' OR m <= 60 OR i > 60""")
def embargo(spark, sf_dir):
    return prepare.embargo(feature_rows(spark, sf_dir)).select("symbol", "seq", "split")


@query(f"""{FEATURE_ROWS} SELECT symbol, {", ".join(f"round(avg({c}), 5) AS mean_{c}, round({sd(c)}, 5) AS scale_{c}" for c in COLS)} FROM parts WHERE split = 'train' GROUP BY 1""")
def scaler(spark, sf_dir):
    f = prepare.fit_scaler(feature_rows(spark, sf_dir), COLS)
    return f.select("symbol", *(x for k, c in enumerate(COLS) for x in (F.round(F.col("mean")[k], 5).alias(f"mean_{c}"), F.round(F.col("scale")[k], 5).alias(f"scale_{c}"))))


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


@query(f"""{FEATURE_ROWS} SELECT symbol, {", ".join(f"round(covar_samp({COLS[i]}, {COLS[j]}) / {sd(COLS[i])} / {sd(COLS[j])}, 5) + 0.0 AS cov_{i}_{j}" for i, j in PAIRS)} FROM parts WHERE split = 'train' GROUP BY 1""")
def feature_cov(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    cov = prepare.feature_cov(prepare.apply_scaler(rows, prepare.fit_scaler(rows, COLS), COLS), COLS)
    return cov.select("symbol", *(r(f"cov_{i}_{j}", 5) for i, j in PAIRS))


def _pca_sql() -> str:
    """Jacobi rotations of the four features' correlations, one a step; the same scores from the vectors."""
    m = [f"covar_samp({COLS[min(i, j)]}, {COLS[max(i, j)]}) / {sd(COLS[i])} / {sd(COLS[j])}" for i in range(4) for j in range(4)]
    cols = "CASE WHEN j = q THEN s * {m}[i * 4 + p + 1] + c * {m}[i * 4 + q + 1] WHEN j = p THEN c * {m}[i * 4 + p + 1] - s * {m}[i * 4 + q + 1] ELSE {m}[i * 4 + j + 1] END"
    cells = lambda f: f"list_transform(range(16), lambda k: {f.replace('i *', '(k // 4) *').replace('j', '(k % 4)')})"
    rows = "CASE WHEN (k // 4) = q THEN s * h[p * 4 + k % 4 + 1] + c * h[q * 4 + k % 4 + 1] WHEN (k // 4) = p THEN c * h[p * 4 + k % 4 + 1] - s * h[q * 4 + k % 4 + 1] ELSE h[k + 1] END"
    scaled = ", ".join(f"({c} - avg({c}) FILTER (split = 'train') OVER w) / coalesce(nullif(stddev_pop({c}) FILTER (split = 'train') OVER w, 0), 1) AS z{k}" for k, c in enumerate(COLS))
    score = ", ".join("round(" + " + ".join(f"z{j} * v[{k + 1}][{j + 1}]" for j in range(4)) + f", 6) + 0.0 AS pca_{k + 1}" for k in range(4))
    return f"""{FEATURE_ROWS}, start AS (SELECT symbol, [{", ".join(m)}] AS a, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]::DOUBLE[] AS v FROM parts WHERE split = 'train' GROUP BY 1),
jac AS (SELECT symbol, 0 AS step, a::DOUBLE[] AS a, v FROM start UNION ALL
  SELECT symbol, step + 1, {f"list_transform(range(16), lambda k: {rows})"}, v FROM (
    SELECT symbol, step, p, q, c, s, {cells(cols.format(m="a"))} AS h, {cells(cols.format(m="v"))} AS v FROM (
      SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
        SELECT *, CASE WHEN a[p * 4 + q + 1] = 0 THEN 0 ELSE CASE WHEN tau < 0 THEN -1 ELSE 1 END / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
          SELECT *, (a[q * 5 + 1] - a[p * 5 + 1]) / nullif(2 * a[p * 4 + q + 1], 0) AS tau FROM (
            SELECT *, [0, 0, 0, 1, 1, 2][step % 6 + 1] AS p, [1, 2, 3, 2, 3, 3][step % 6 + 1] AS q FROM jac WHERE step < 48)))))),
vec AS (SELECT symbol, a[k * 5 + 1] AS value, [v[k + 1], v[k + 5], v[k + 9], v[k + 13]] AS e FROM jac, unnest(range(4)) AS u(k) WHERE step = 48),
sgn AS (SELECT symbol, value, list_transform(e, lambda x: x * CASE WHEN list_max(list_transform(e, lambda y: abs(y))) = list_max(e) THEN 1 ELSE -1 END) AS e FROM vec),
rot AS (SELECT symbol, list(e ORDER BY value DESC) AS v FROM sgn GROUP BY 1),
z AS (SELECT symbol, seq, split, {scaled} FROM parts WINDOW w AS (PARTITION BY symbol))
SELECT symbol, seq, split, {score} FROM z JOIN rot USING (symbol)"""


@query(_pca_sql())
def pca_scores(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    scaled = prepare.apply_scaler(rows, prepare.fit_scaler(rows, COLS), COLS)
    return prepare.apply_pca(scaled, prepare.fit_pca(prepare.feature_cov(scaled, COLS)), COLS).select("symbol", "seq", "split", *(r(f"pca_{k}") for k in range(1, 5)))


# Labels and models

LABELS = """lab AS (SELECT symbol, seq, close, close + 0.02 * close * 2.0 AS up, close - 0.02 * close * 2.0 AS low FROM src),
hit AS (SELECT l.symbol, l.seq, min(CASE WHEN n.close >= l.up THEN n.seq END) AS u, min(CASE WHEN n.close <= l.low THEN n.seq END) AS d
  FROM lab l LEFT JOIN src n ON n.symbol = l.symbol AND n.seq > l.seq AND n.seq <= l.seq + 15 GROUP BY 1, 2),
labelled AS MATERIALIZED (SELECT symbol, seq, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE 0 END AS label FROM hit)"""
SRC_L = f"{LINEITEM_BARS}, src AS (SELECT symbol, seq, close FROM bars)"


def labelled(df):
    return labels.triple_barrier(df.withColumns({"optimal_pt": F.lit(2.0), "optimal_sl": F.lit(2.0)}))


@query(f"{SRC_L}, {LABELS} SELECT symbol, seq, label FROM labelled")
def triple_barrier(spark, sf_dir):
    return labelled(tapes.lineitem_bars(spark, sf_dir)).select("symbol", "seq", "label")


@query(ORACLE["triple_barrier"])
def triple_barrier_chunked(spark, sf_dir):
    return in_chunks(tapes.lineitem_bars(spark, sf_dir), labelled, 100, after=15).select("symbol", "seq", "label")


@query(f"{SRC_L}, {LABELS} SELECT label + 1 AS cls, count(*) AS n FROM labelled GROUP BY 1")
def label_distribution(spark, sf_dir):
    return labels.label_distribution(labelled(tapes.lineitem_bars(spark, sf_dir)))


@query(f"""{LINEITEM_BARS}, {IMB}, src AS (SELECT symbol, seq, close FROM bars), {LABELS},
v AS (SELECT symbol, seq, CASE WHEN seq >= 50 THEN sum(imbalance) OVER {over(50)} / sum(volume) OVER {over(50)} END AS vpin FROM rows)
SELECT symbol, count(*) AS n, count(*) FILTER (label = 1) AS up, count(*) FILTER (label = -1) AS down, round(avg(vpin), 6) AS vpin FROM labelled JOIN v USING (symbol, seq) GROUP BY 1""")
def bar_label_mix(spark, sf_dir):
    """Dollar bars of the lineitem tape, their flow toxicity and labels, by symbol."""
    rows = labelled(features.vpin(tapes.lineitem_bars(spark, sf_dir)))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("up"), F.count(F.when(F.col("label") == -1, 1)).alias("down"), F.round(F.avg("vpin"), 6).alias("vpin"))


@query(f"{SRC_L} SELECT CASE WHEN b < 20 THEN 'test' WHEN b < 36 THEN 'calibration' ELSE 'train' END AS part, count(*) AS n FROM (SELECT (symbol * 31 + seq * 7919) % 100 AS b FROM src) GROUP BY 1")
def training_split(spark, sf_dir):
    rows = tapes.lineitem_bars(spark, sf_dir)
    return model.split_random(rows, F.pmod(F.col("symbol") * 31 + F.col("seq") * 7919, F.lit(100))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{LINEITEM_BARS}, sp AS (SELECT symbol, seq, ts, last_value(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS until FROM bars),
dy AS (SELECT CAST(ts AS DATE) AS day, count(*) AS k FROM sp GROUP BY 1), df AS (SELECT day, CAST(floor(coalesce(sum(k) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5 / sum(k) OVER ()) AS INTEGER) AS fold FROM dy),
fr AS (SELECT sp.*, fold FROM sp JOIN df ON CAST(sp.ts AS DATE) = df.day), spans AS (SELECT fold, min(ts) AS lo, max(ts) AS hi FROM fr GROUP BY 1),
tr AS (SELECT symbol, seq, s.fold FROM fr JOIN spans s ON fr.fold <> s.fold AND NOT (fr.ts <= s.hi AND fr.until >= s.lo))
SELECT fold, symbol, part, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT fold, symbol, seq, 'test' AS part FROM fr UNION ALL SELECT fold, symbol, seq, 'train' FROM tr) GROUP BY 1, 2, 3""")
def purged_folds(spark, sf_dir):
    rows = model.purged_folds(model.label_spans(tapes.lineitem_bars(spark, sf_dir).select("symbol", "seq", "ts")))
    return rows.groupBy("fold", "symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


PCA = ["pca_1", "pca_2", "pca_3", "pca_4"]


def _trained(spark, sf_dir):
    """Labelled rows of the dataset, its matrices and a model of its train side; 10 trees of depth 3 for the operator's 100 and 5."""
    rows, matrices = dataset.build(tapes.event_bars(spark, sf_dir))
    train = labels.label_classes(labels.triple_barrier(rows.filter("split = 'train'")))
    data = written(model.split_random(model.training_set(train, PCA)), "training")  # fitted on, and read for the report
    return matrices, data, model.fit_classifier(data, PCA, trees=10, depth=3)


@query()
def model_report(spark, sf_dir):
    _, data, fitted = _trained(spark, sf_dir)
    return model.classification_report(model.score(fitted.transform(data.filter("part = 'test'"))))


@query()
def latest_signals(spark, sf_dir):
    """Each symbol's newest complete bar, scaled and rotated by the matrices of the train side, and scored."""
    matrices, _, fitted = _trained(spark, sf_dir)
    newest = dataset.newest(prepare.complete_rows(dataset.with_features(tapes.event_bars(spark, sf_dir))))
    return model.latest_signals(model.score(fitted.transform(dataset.rotate(newest, matrices))))


@query()
def latest_signals_time(spark, sf_dir):
    """The newest hourly bar of each symbol, scored by the model of the dollar bars as it was saved and loaded again."""
    matrices, _, fitted = _trained(spark, sf_dir)
    path = folder(spark, "model")
    fitted.save(path, matrices)
    loaded, stored = model.Classifier.load(spark, path)
    newest = dataset.newest(prepare.complete_rows(dataset.with_features(tapes.event_hours(spark, sf_dir))))
    return model.latest_signals(model.score(loaded.transform(dataset.rotate(newest, stored))))


@query()
def stream_model_signals(spark, sf_dir):
    """The newest bar of each symbol after the tape's bars have gone through a stream of features, matrices and the model."""
    matrices, _, fitted = _trained(spark, sf_dir)
    return streams.scored_stream(tapes.event_bars(spark, sf_dir), fitted, matrices)


_FEATURES = " JOIN ".join([f"({ORACLE['vpin']}) AS v", *(f"({ORACLE[x]}) AS {x}_ USING (symbol, seq)" for x in ("amihud", "kyles_lambda", "sadf"))])


@query(f"SELECT symbol, seq, vpin, amihud, kyles_lambda, sadf FROM {_FEATURES}")
def stream_features(spark, sf_dir):
    rows = streams.stream_features(spark, sf_dir)
    return rows.select("symbol", "seq", r("vpin", 8), r("amihud", 6, scale=1e6), r("kyles_lambda", 6, scale=1e6), r("sadf", 5))


@query()
def feature_build(spark, sf_dir):
    """Rows of the whole dataset: four scores, barriers and the fractional close, by symbol and split."""
    rows, _ = dataset.build(tapes.event_bars(spark, sf_dir))
    return rows.select("symbol", "seq", "split", r("optimal_pt"), r("optimal_sl"), r("close_ffd"), *(r(c) for c in PCA))


@query(f"""{SRC_L}, {LABELS}, p AS (SELECT label + 1 AS cls, (symbol + seq) % 3 AS pred FROM labelled),
k AS (SELECT unnest([0, 1, 2]) AS k), b AS (SELECT k, count(*) FILTER (cls = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS pp, count(*) FILTER (cls = k) AS s FROM p, k GROUP BY 1),
m AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN s = 0 THEN 0 ELSE tp / s END AS r FROM b), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM m)
SELECT CAST(k AS VARCHAR) AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM f
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f""")
def classification_report(spark, sf_dir):
    rows = labels.label_classes(labelled(tapes.lineitem_bars(spark, sf_dir))).withColumn("prediction", F.pmod(F.col("symbol") + F.col("seq"), F.lit(3)).cast("int"))
    return model.classification_report(rows).select("name", r("precision"), r("recall"), r("f1"), "support")


@query(f"""WITH {SIGNALS} SELECT symbol, seq, round(round_even(least(greatest(bet, 0), 1) * 10, 0) / 10 * signal, 6) + 0.0 AS act,
round(round_even(least(greatest(bet, 0), 1) * 10, 0) / 10 * greatest(signal, 0), 6) + 0.0 AS act_long FROM sig""")
def size_bets(spark, sf_dir):
    s = tapes.signals(tapes.as_bars(tapes.tape_lineitem(spark, sf_dir)))
    s = model.size_bets(s).withColumnRenamed("act", "a")
    return model.size_bets(s, long_only=True).select("symbol", "seq", r("a", 6, "act"), r("act", 6, "act_long"))


@query(f"""WITH {SIGNALS}, z AS (SELECT symbol, seq, (prob - 0.5) / sqrt(prob * (1 - prob)) AS z FROM sig), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z)
SELECT symbol, seq, round(sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)), 6) AS size FROM t""")
def bet_size_from_prob(spark, sf_dir):
    s = tapes.signals(tapes.as_bars(tapes.tape_lineitem(spark, sf_dir)))
    return s.select("symbol", "seq", F.round(model.bet_size_from_prob(F.col("prob")), 6).alias("size"))


# Evaluation

WINDOWS = """wins AS (SELECT symbol, i AS win, i * (n // 5) AS start_row, least((i + 1) * (n // 5), n - 1) AS end_row FROM (SELECT symbol, count(*) AS n FROM sig GROUP BY 1), range(5) t(i)),
eps AS MATERIALIZED (SELECT s.*, win, s.seq - 1 - start_row AS step, end_row - start_row AS last_step,
  CAST(round_even(bet * 10, 0) / 10 * signal AS DOUBLE) AS act FROM sig s JOIN wins w ON w.symbol = s.symbol AND s.seq - 1 BETWEEN start_row AND end_row)"""
LEDGER = """st AS (
  SELECT e.symbol, e.win, CAST(-1 AS BIGINT) AS step, CAST(10000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS fee, CAST(0 AS DOUBLE) AS pv, CAST(10000 AS DOUBLE) AS value,
         false AS forced, CAST(0 AS DOUBLE) AS entry, CAST(0 AS BIGINT) AS entry_at, CAST(0 AS DOUBLE) AS atr FROM eps e WHERE e.step = 0 AND e.last_step > 0
  UNION ALL
  SELECT symbol, win, step, cash, shares, fee, pv, cash + shares * nxt, forced, entry, entry_at, atr FROM (
    SELECT symbol, win, step, pv, forced, nxt, fee,
      CASE WHEN a > 0 THEN cash - cash * a WHEN a < 0 THEN cash + (shares * -a * p - fee) ELSE cash END AS cash,
      CASE WHEN a > 0 THEN shares + (cash * a - fee) / p WHEN a < 0 THEN CASE WHEN shares - shares * -a <= 1e-6 THEN 0 ELSE shares - shares * -a END ELSE shares END AS shares,
      CASE WHEN a > 0 AND entry = 0 THEN p WHEN a < 0 AND shares - shares * -a <= 1e-6 THEN 0 ELSE entry END AS entry,
      CASE WHEN a > 0 AND entry = 0 THEN step WHEN a < 0 AND shares - shares * -a <= 1e-6 THEN 0 ELSE entry_at END AS entry_at,
      CASE WHEN a > 0 AND entry = 0 THEN 0.02 * p WHEN a < 0 AND shares - shares * -a <= 1e-6 THEN 0 ELSE atr END AS atr
    FROM (SELECT *, CASE WHEN a > 0 THEN cash * a * 0.0005 WHEN a < 0 THEN shares * -a * p * 0.0005 ELSE 0 END AS fee, cash + shares * p AS pv
      FROM (SELECT *, CASE WHEN forced THEN -1.0 ELSE act END AS a FROM (
        SELECT s.symbol, s.win, e.step, s.cash, s.shares, s.entry, s.entry_at, s.atr, e.close AS p, n.close AS nxt, e.act,
          s.shares > 0 AND s.entry > 0 AND (e.close >= s.entry + s.atr * 2.0 OR e.close <= s.entry - s.atr * 2.0 OR e.step - s.entry_at >= 15) AS forced
        FROM st s JOIN eps e ON e.symbol = s.symbol AND e.win = s.win AND e.step = s.step + 1 JOIN eps n ON n.symbol = s.symbol AND n.win = s.win AND n.step = s.step + 2
        WHERE s.value >= 1000))))),
led AS MATERIALIZED (SELECT st.*, e.ts FROM st JOIN eps e USING (symbol, win, step) WHERE st.step >= 0)"""
EQUITY = """ret AS (SELECT *, CASE WHEN pv > 0 THEN (value - pv) / pv ELSE 0 END * 100 AS g FROM led), rew AS (SELECT *, g + greatest(g, 0) * 0.5 AS reward FROM ret),
eq AS (SELECT *, sum(reward) OVER (PARTITION BY symbol, win ORDER BY step) + 10000 AS equity FROM rew),
eqd AS MATERIALIZED (SELECT *, coalesce(lag(equity) OVER w, 10000) AS prev_equity, greatest(max(equity) OVER w, 10000) AS peak FROM eq WINDOW w AS (PARTITION BY symbol, win ORDER BY step))"""
TRIPS = """ins AS (SELECT *, shares > 1e-6 AS inside, coalesce(lag(shares > 1e-6) OVER (PARTITION BY symbol, win ORDER BY step), false) AS was FROM eqd),
trip AS (SELECT *, sum(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, win ORDER BY step) AS trip FROM ins),
trips AS MATERIALIZED (SELECT symbol, win, CAST(trip AS BIGINT) AS trip, max(CASE WHEN inside AND NOT was THEN prev_equity END) AS entry_equity, max(CASE WHEN NOT inside AND was THEN equity END) AS exit_equity
  FROM trip GROUP BY 1, 2, 3 HAVING max(CASE WHEN NOT inside AND was THEN equity END) IS NOT NULL)"""
METRICS = """ends AS (SELECT symbol, win, max(step) + 1 AS step, sum(reward) AS profit, max((peak - equity) / peak * 100) AS max_drawdown, count(*) FILTER (fee > 0.01) AS trades,
  coalesce(sum(fee) FILTER (fee > 0.01), 0) AS fees, min(ts) AS first_ts FROM eqd GROUP BY 1, 2),
wr AS (SELECT symbol, win, avg(CASE WHEN exit_equity > entry_equity THEN 100.0 ELSE 0 END) AS win_rate FROM trips GROUP BY 1, 2),
days AS (SELECT n.*, e.ts AS last_ts, floor(epoch(e.ts) / 86400 - epoch(n.first_ts) / 86400) AS days, coalesce(win_rate, 0) AS win_rate FROM ends n JOIN eps e USING (symbol, win, step) LEFT JOIN wr USING (symbol, win)),
met AS MATERIALIZED (SELECT *, profit / 100 AS roi, CASE WHEN days <= 0 THEN 0 WHEN profit + 10000 <= 0 THEN -100 ELSE (pow((profit + 10000) / 10000, 365.25 / days) - 1) * 100 END AS cagr FROM days)"""
EVAL = "ev AS (SELECT symbol, avg(roi) AS roi, avg(cagr) AS cagr, avg(win_rate) AS win_rate, avg(max_drawdown) AS max_drawdown, sum(profit) AS profit, CAST(sum(trades) AS BIGINT) AS trades, sum(fees) AS fees FROM met GROUP BY 1)"
REPLAY = f"WITH RECURSIVE {SIGNALS}, {WINDOWS}, {LEDGER}"


def signal_rows(spark, sf_dir):
    return model.size_bets(tapes.signals(tapes.as_bars(tapes.tape_lineitem(spark, sf_dir))))


def episode_rows(spark, sf_dir):
    s = signal_rows(spark, sf_dir)
    out = bt.episodes(s, bt.eval_windows(s)).withColumn("agent", F.lit("sized"))
    return out.select(*bt.EPISODE, "step", "ts", "close", "act", "optimal_pt", "optimal_sl")


def equity_rows(spark, sf_dir):
    return bt.with_equity(bt.replay(episode_rows(spark, sf_dir)))


@query(f"WITH {SIGNALS}, {WINDOWS} SELECT symbol, win, start_row, end_row FROM wins")
def eval_windows(spark, sf_dir):
    return bt.eval_windows(signal_rows(spark, sf_dir)).select("symbol", F.col("win").cast("bigint").alias("win"), "start_row", "end_row")


@query(f"{REPLAY} SELECT symbol, win, step, round(cash, 4) AS cash, round(shares, 6) AS shares, round(fee, 6) AS fee, round(value, 4) AS value, forced FROM led")
def replay(spark, sf_dir):
    return bt.replay(episode_rows(spark, sf_dir)).select("symbol", F.col("win").cast("bigint").alias("win"), "step", r("cash", 4), r("shares"), r("fee"), r("value", 4), "forced")


@query(f"{REPLAY}, {EQUITY} SELECT symbol, win, step, round(reward, 6) + 0.0 AS reward, round(equity, 4) AS equity, round(equity / prev_equity - 1, 7) + 0.0 AS ret, round((peak - equity) / peak, 7) AS drawdown FROM eqd")
def equity_curve(spark, sf_dir):
    return equity_rows(spark, sf_dir).select("symbol", F.col("win").cast("bigint").alias("win"), "step", r("reward"), r("equity", 4), r("ret", 7), r("drawdown", 7))


@query(f"{REPLAY}, {EQUITY}, {TRIPS} SELECT symbol, win, trip, round(entry_equity, 4) AS entry_equity, round(exit_equity, 4) AS exit_equity, exit_equity > entry_equity AS won FROM trips")
def round_trips(spark, sf_dir):
    return bt.round_trips(equity_rows(spark, sf_dir)).select("symbol", F.col("win").cast("bigint").alias("win"), "trip", r("entry_equity", 4), r("exit_equity", 4), "won")


METRIC = ("roi", "cagr", "win_rate", "max_drawdown", "profit", "fees")


@query(f"{REPLAY}, {EQUITY}, {TRIPS}, {METRICS} SELECT symbol, win, {', '.join(f'round({c}, 4) AS {c}' for c in METRIC)}, trades FROM met")
def window_metrics(spark, sf_dir):
    e = written(episode_rows(spark, sf_dir), "episodes")  # replayed, and read for the last times
    return bt.window_metrics(bt.with_equity(bt.replay(e)), e).select("symbol", F.col("win").cast("bigint").alias("win"), *(r(c, 4) for c in METRIC), "trades")


def _evaluated(e):
    return bt.evaluate(bt.window_metrics(bt.with_equity(bt.replay(e)), e))


@query(f"{REPLAY}, {EQUITY}, {TRIPS}, {METRICS}, {EVAL} SELECT symbol, {', '.join(f'round({c}, 4) AS {c}' for c in METRIC)}, trades FROM ev")
def evaluation(spark, sf_dir):
    return _evaluated(written(episode_rows(spark, sf_dir), "episodes")).select("symbol", *(r(c, 4) for c in METRIC), "trades")


HOLD = "hold AS (SELECT symbol, avg(r) * 100 AS hold_roi FROM (SELECT symbol, win, arg_max(close, step) / arg_min(close, step) - 1 AS r FROM eps GROUP BY 1, 2) GROUP BY 1)"
BENCH = """bench AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 1),
bw AS MATERIALIZED (SELECT symbol, win, min(ts) AS a, max(ts) AS b FROM eps GROUP BY 1, 2), bwd AS (SELECT DISTINCT a, b FROM bw),
br AS MATERIALIZED (SELECT a, b, arg_min(close, ts) AS c0, arg_max(close, ts) AS c1 FROM bwd LEFT JOIN bench ON ts >= a AND ts < b GROUP BY 1, 2),
bro AS MATERIALIZED (SELECT a, b, coalesce((c1 / c0 - 1) * 100, 0) AS roi, CASE WHEN c0 IS NULL OR floor(epoch(b) / 86400 - epoch(a) / 86400) <= 0 THEN 0 ELSE (pow(c1 / c0, 365.25 / floor(epoch(b) / 86400 - epoch(a) / 86400)) - 1) * 100 END AS cagr FROM br)"""


def bench_windows(e):
    return e.groupBy("symbol", "win").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def bench_table(spark, sf_dir, windows):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("close"))
    return bt.assemble_benchmark([o], windows)


@query(f"WITH {SIGNALS}, {WINDOWS}, {HOLD} SELECT symbol, round(hold_roi, 5) AS hold_roi FROM hold")
def buy_and_hold(spark, sf_dir):
    return bt.buy_and_hold(episode_rows(spark, sf_dir)).select("symbol", r("hold_roi", 5))


@query(f"WITH {SIGNALS}, {WINDOWS}, {BENCH} SELECT strftime(a, '%Y-%m-%d') AS start_ts, strftime(b, '%Y-%m-%d') AS end_ts, round(roi, 5) AS bench_roi, round(cagr, 3) AS bench_cagr FROM bro")
def benchmark_returns(spark, sf_dir):
    w = bench_windows(episode_rows(spark, sf_dir))
    out = bt.benchmark_returns(w, bench_table(spark, sf_dir, w))
    return out.select(*(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start_ts", "end_ts")), r("bench_roi", 5), r("bench_cagr", 3))


@query(f"""{REPLAY}, {EQUITY}, {TRIPS}, {METRICS}, {EVAL}, {HOLD}, {BENCH}, bs AS (SELECT symbol, avg(roi) AS bench_roi FROM bw JOIN bro USING (a, b) GROUP BY 1)
SELECT symbol, trades, round_even(roi, 2) AS roi, round_even(win_rate, 2) AS win_rate, round_even(hold_roi, 2) AS hold_roi, round_even(bench_roi, 2) AS bench_roi,
       round_even(roi - hold_roi, 2) AS excess_hold, round_even(roi - bench_roi, 2) AS excess_bench FROM ev JOIN hold USING (symbol) JOIN bs USING (symbol)""")
def report(spark, sf_dir):
    e = written(episode_rows(spark, sf_dir), "episodes")  # four readers follow
    w = bench_windows(e)
    bench = w.join(bt.benchmark_returns(w, bench_table(spark, sf_dir, w)), ["start_ts", "end_ts"]).groupBy("symbol").agg(F.avg("bench_roi").alias("bench_roi"))
    return bt.report(_evaluated(e), bt.buy_and_hold(e), bench).select("symbol", "trades", "roi", "win_rate", "hold_roi", "bench_roi", "excess_hold", "excess_bench")


# Telemetry

TRUTH = """tr AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY seq) AS nx, round_even(bet * 10, 0) / 10 * signal AS act FROM sig),
truth AS MATERIALIZED (SELECT symbol, seq, signal, prob, CASE WHEN nx > close THEN 1 ELSE 0 END AS truth, CASE WHEN act > 0 THEN 1 ELSE 0 END AS pred, CASE WHEN signal > 0 THEN 1 ELSE 0 END AS raw FROM tr WHERE nx IS NOT NULL)"""


def cells(pred: str) -> str:
    return f"count(*) FILTER (truth = 1 AND {pred} = 1) AS tp, count(*) FILTER (truth = 0 AND {pred} = 0) AS tn, count(*) FILTER (truth = 0 AND {pred} = 1) AS fp, count(*) FILTER (truth = 1 AND {pred} = 0) AS fn"


def truth_rows(spark, sf_dir):
    return telemetry.direction_truth(signal_rows(spark, sf_dir))


@query(f"WITH {SIGNALS}, {TRUTH} SELECT symbol, {cells('pred')} FROM truth GROUP BY 1")
def confusion(spark, sf_dir):
    return telemetry.confusion(truth_rows(spark, sf_dir), ["symbol"])


@query(f"""WITH {SIGNALS}, {TRUTH}, c AS (SELECT symbol, {cells('pred')} FROM truth GROUP BY 1) SELECT symbol, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_metrics(spark, sf_dir):
    return telemetry.binary_metrics(telemetry.confusion(truth_rows(spark, sf_dir), ["symbol"])).select("symbol", *(r(c) for c in ("precision", "recall", "accuracy", "f1")))


@query(f"""WITH {SIGNALS}, {TRUTH}, p AS (SELECT symbol, truth, greatest(least(CASE WHEN signal > 0 THEN prob ELSE 0 END, 1 - 1e-15), 1e-15) AS p FROM truth)
SELECT symbol, round(avg(-CASE WHEN truth = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM p GROUP BY 1""")
def log_loss(spark, sf_dir):
    return telemetry.log_loss(truth_rows(spark, sf_dir), ["symbol"]).select("symbol", r("log_loss"))


@query(f"""WITH {SIGNALS}, {TRUTH}, a AS (SELECT symbol, {cells('pred')} FROM truth GROUP BY 1), b AS (SELECT symbol, {cells('raw')} FROM truth GROUP BY 1)
SELECT symbol, round(coalesce(a.tp / nullif(a.tp + a.fp, 0), 0) - coalesce(b.tp / nullif(b.tp + b.fp, 0), 0), 6) AS delta FROM a JOIN b USING (symbol)""")
def precision_delta(spark, sf_dir):
    rows = truth_rows(spark, sf_dir)
    both = rows.select("*", F.explode(F.array(F.lit("sized"), F.lit("raw"))).alias("agent")).withColumn("pred", F.when(F.col("agent") == "raw", (F.col("signal") > 0).cast("int")).otherwise(F.col("pred")))
    return telemetry.precision_delta(telemetry.binary_metrics(telemetry.confusion(both, ["agent", "symbol"])), "sized", "raw").select("symbol", r("delta"))


@query("""WITH p AS (SELECT (l_discount * 7 + l_tax * 3) AS prob FROM lineitem), e AS (SELECT min(prob) AS lo, max(prob) AS hi FROM p), b AS (SELECT unnest(range(1, 21)) AS bin),
n AS (SELECT least(floor((prob - lo) / (hi - lo) * 20) + 1, 20) AS bin, count(*) AS n FROM p, e GROUP BY 1) SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(n.n, 0) AS n FROM b LEFT JOIN n ON n.bin = b.bin""")
def prob_histogram(spark, sf_dir):
    return telemetry.prob_histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_discount") * 7 + F.col("l_tax") * 3).alias("prob")))


# Overfitting

PERF = """perf AS MATERIALIZED (SELECT user_id % 10 AS trial, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, round(avg(value - 50), 9) AS ret FROM events GROUP BY 1, 2),
times AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM perf)),
ch AS (SELECT t, CASE WHEN i < (n % 16) * (n // 16 + 1) THEN i // (n // 16 + 1) ELSE n % 16 + (i - (n % 16) * (n // 16 + 1)) // greatest(n // 16, 1) END AS chunk FROM times),
part AS MATERIALIZED (SELECT trial, chunk, count(*) AS n, sum(ret) AS a, sum(ret * ret) AS b FROM perf JOIN ch USING (t) GROUP BY 1, 2),
masks AS (SELECT m AS mask FROM range(65536) x(m) WHERE bit_count(m) = 8),
sums AS (SELECT mask, trial, sum(n) FILTER ((mask >> chunk) & 1 = 1) AS n1, sum(a) FILTER ((mask >> chunk) & 1 = 1) AS a1, sum(b) FILTER ((mask >> chunk) & 1 = 1) AS b1,
  sum(n) FILTER ((mask >> chunk) & 1 = 0) AS n0, sum(a) FILTER ((mask >> chunk) & 1 = 0) AS a0, sum(b) FILTER ((mask >> chunk) & 1 = 0) AS b0 FROM masks, part GROUP BY 1, 2),
sh AS (SELECT mask, trial, round(a1 / n1 / (sqrt(greatest(b1 / n1 - (a1 / n1) * (a1 / n1), 0)) + 1e-8), 9) AS i, round(a0 / n0 / (sqrt(greatest(b0 / n0 - (a0 / n0) * (a0 / n0), 0)) + 1e-8), 9) AS o FROM sums),
rk AS (SELECT mask, trial, row_number() OVER (PARTITION BY mask ORDER BY i DESC, trial) AS k, count(*) OVER (PARTITION BY mask) AS n, rank() OVER (PARTITION BY mask ORDER BY o) + (count(*) OVER (PARTITION BY mask, o) - 1) / 2 AS r FROM sh),
lg AS MATERIALIZED (SELECT mask, trial, r / (n + 1) AS omega, ln(r / (n + 1) / (1 - r / (n + 1))) AS logit FROM rk WHERE k = 1)"""


def perf_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint")
    return e.groupBy((F.col("user_id") % 10).alias("trial"), day.alias("t")).agg(F.round(F.avg(F.col("value") - 50), 9).alias("ret"))


@query(f"WITH {PERF} SELECT mask, trial, round(omega, 6) AS omega, round(logit, 6) AS logit FROM lg")
def pbo_logits(spark, sf_dir):
    return pbo.pbo_logits(perf_rows(spark, sf_dir)).select("mask", "trial", r("omega"), r("logit"))


@query(f"WITH {PERF} SELECT round(avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0 END), 6) AS pbo, count(*) AS combos FROM lg")
def backtest_overfitting(spark, sf_dir):
    return pbo.pbo(pbo.pbo_logits(perf_rows(spark, sf_dir))).select(r("pbo"), "combos")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {k: f for k, (f, _) in STREAMS.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {k: s for k, (_, s) in STREAMS.items()}
