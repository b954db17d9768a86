"""DuckDB statements that state each operator's result independently of the Spark code.

`CTES` holds named sub-queries; `statement` collects the ones a body needs. Output columns are described by a short
spec shared with the Spark side: s text, d date, t time, i integer, b boolean, f number (6 digits), g number (9 digits,
where a 6-digit rounding would often be a tie), m money (3 digits).
"""

from __future__ import annotations

import re

NEWS_COLS = (
    "news_id, ticker, title, summary, body, source, url, published_at, market_session, effective_date, "
    "is_sec_filing, content_hash"
)
TRAD = [
    "momentum_5d", "momentum_20d", "momentum_60d", "volatility_20d", "volume_change_5d", "rsi_14",
    "market_return_5d", "sector_return_5d", "beta",
]
NEWS = [
    "news_sentiment", "news_importance", "news_surprise", "news_risk", "news_revenue_impact", "news_margin_impact",
    "news_coverage", "news_ai_score",
]
FACTORS = TRAD + NEWS
FEATS = [f"z_{f}" for f in FACTORS if f != "news_coverage"]
HORIZONS = (1, 5, 10, 20)
LEXICON = {
    "positive": ["the", "growth"], "negative": ["of", "loss"], "risk": ["and", "warning"],
    "surprise": ["to", "guidance"], "revenue": ["in", "sales"], "margin": ["is", "cost"],
}


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def session_sql(ts: str) -> tuple[str, str]:
    """Session and effective date of a UTC time, as SQL."""
    local = f"timezone('America/New_York', timezone('UTC', {ts}))"
    day = f"CAST({local} AS DATE)"
    minute = f"(hour({local}) * 60 + minute({local}))"
    weekend = f"isodow({day}) >= 6"
    regular = f"({minute} >= 570 AND {minute} < 960)"
    session = f"CASE WHEN {weekend} THEN 'off_hours' WHEN {regular} THEN 'regular' ELSE 'pre_or_post_market' END"
    following = next_day_sql(day)
    effective = f"CASE WHEN NOT ({weekend}) AND {regular} THEN {day} ELSE {following} END"
    return session, effective


def next_day_sql(day: str) -> str:
    return f"CAST({day} + CASE isodow({day}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE)"


_session, _effective = session_sql("published_at")
BY = "PARTITION BY ticker ORDER BY date"


def ticker_sql(number: str) -> str:
    return f"'T' || lpad(CAST({number} AS VARCHAR), 10, '0')"


def frame(expr: str, back: int, skip: int = 0) -> str:
    return f"{expr} OVER ({BY} ROWS BETWEEN {back + skip - 1} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def gate(expr: str, counted: str, back: int, skip: int = 0) -> str:
    return f"CASE WHEN {frame(f'count({counted})', back, skip)} = {back} THEN {frame(expr, back, skip)} END"


def mom(n: int) -> str:
    return f"close / nullif(lag(close, {n}) OVER ({BY}), 0) - 1"


def corr_sql(x: str, y: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 3 "
        f"AND min({x}) FILTER ({y} IS NOT NULL) < max({x}) FILTER ({y} IS NOT NULL) "
        f"AND min({y}) FILTER ({x} IS NOT NULL) < max({y}) FILTER ({x} IS NOT NULL) THEN corr({y}, {x}) END"
    )


def clampq(x: str, low: str, high: str) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def hits(kind: str) -> str:
    return f"len(list_intersect(found, {quoted(LEXICON[kind])}))"


WORDS = sorted({w for ws in LEXICON.values() for w in ws})

CTES: dict[str, str] = {}
CTES["cells"] = """
SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2"""
CTES["units"] = f"""
SELECT date, {ticker_sql('k')} AS ticker, cents / (volume * 100.0::DOUBLE) AS unit, volume FROM cells
UNION ALL
SELECT date, 'SPY', CAST(sum(cents) AS BIGINT) / (CAST(sum(volume) AS BIGINT) * 100.0::DOUBLE),
       CAST(sum(volume) AS BIGINT) FROM cells GROUP BY date"""
CTES["closes"] = f"SELECT date, ticker, volume, {frame('avg(unit)', 20)} AS close FROM units"
CTES["prices_t"] = f"""
SELECT date, ticker, open, greatest(open, close) AS high, least(open, close) AS low, close, volume, close AS vwap,
       1.0::DOUBLE AS adj_factor, 'lineitem' AS source, false AS is_suspended, false AS is_imputed
FROM (SELECT *, lag(close) OVER ({BY}) AS open FROM closes)"""
CTES["flagged_t"] = f"""
SELECT * EXCLUDE (prev), coalesce(abs(close / nullif(prev, 0) - 1) > 0.5, false) AS suspicious_return
FROM (SELECT *, last_value(close IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM prices_t)"""
CTES["usable_t"] = "SELECT * FROM flagged_t WHERE close IS NOT NULL AND NOT suspicious_return"
CTES["members"] = """
SELECT s_suppkey AS k, s_name AS company, r_name, n_name,
       CASE WHEN s_suppkey % 7 = 0 THEN DATE '2000-06-30' END AS exit_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["universe_t"] = f"""
SELECT DATE '1995-01-02' AS date, {ticker_sql('k')} AS ticker, company,
       CAST(DATE '1995-01-02' + CAST(k % 5 * 90 AS INTEGER) AS DATE) AS entry_date, exit_date,
       r_name AS gics_sector, n_name AS gics_industry, 'suppliers' AS source FROM members
UNION ALL
SELECT DATE '1998-01-05', {ticker_sql('k')}, company, NULL, exit_date, n_name, n_name, 'suppliers'
FROM members WHERE k % 3 = 0"""
CTES["benchmark_t"] = "SELECT date, close AS spy_close FROM prices_t WHERE ticker = 'SPY'"
CTES["news0"] = f"""
SELECT 'n' || o_orderkey AS news_id, {ticker_sql('o_orderkey % (SELECT count(*) FROM supplier)')} AS ticker,
       o_orderpriority || ' ' || source AS title,
       CASE WHEN o_orderkey % 2 = 0 THEN text END AS summary, CASE WHEN o_orderkey % 2 = 1 THEN text END AS body,
       CASE WHEN o_orderkey % 10 = 0 THEN 'SEC EDGAR' ELSE source END AS source,
       CAST(NULL AS VARCHAR) AS url,
       CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) + INTERVAL 14 HOUR
         + to_minutes(CAST(o_orderkey % 360 AS INTEGER)) AS published_at,
       o_orderkey % 10 = 0 AS is_sec_filing, o_orderkey
FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents)"""
CTES["news_t"] = f"""
SELECT * EXCLUDE (o_orderkey), {_session} AS market_session, {_effective} AS effective_date,
       CASE WHEN o_orderkey % 4 <> 0 THEN sha256(title || '|' || source || '|' || coalesce(body, summary)) END AS content_hash
FROM news0"""
CTES["clean_t"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, effective_date, coalesce(content_hash, title || source)
                               ORDER BY published_at DESC, news_id) AS rn
  FROM news_t WHERE length(coalesce(body, summary, '')) >= 50 AND effective_date IS NOT NULL) WHERE rn = 1"""
CTES["tokens_t"] = f"""
SELECT *, list_distinct(list_filter(
            list_transform(string_split_regex(trim(txt, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'),
                           lambda w: trim(w, '.,:;!?()[]{{}}"''')),
            lambda w: list_contains({quoted(WORDS)}, w))) AS found
FROM (SELECT *, lower(title || ' ' || coalesce(summary, '')) AS txt FROM clean_t)"""
CTES["scored_t"] = f"""
SELECT *, {clampq('0.6::DOUBLE * sentiment + 0.1::DOUBLE * rev', '-1', '1')} AS revenue_impact,
       {clampq('0.5::DOUBLE * sentiment + 0.1::DOUBLE * mar - 0.1::DOUBLE * rsk', '-1', '1')} AS margin_impact
FROM (
  SELECT *, {clampq('(pos - neg) / 4.0::DOUBLE', '-1', '1')} AS sentiment,
         {clampq("0.25::DOUBLE + length(txt) / 800.0::DOUBLE + CASE WHEN is_sec_filing THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE * (pos + neg)", '0', '1')} AS importance,
         {clampq("0.1::DOUBLE + 0.2::DOUBLE * sur + CASE WHEN market_session IS DISTINCT FROM 'regular' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END", '0', '1')} AS surprise,
         {clampq('0.05::DOUBLE + 0.25::DOUBLE * rsk + 0.1::DOUBLE * neg', '0', '1')} AS risk,
         {clampq('0.55::DOUBLE + 0.1::DOUBLE * least(pos + neg + rsk + sur, 3)', '0', '0.9')} AS confidence
  FROM (SELECT *, {hits('positive')} AS pos, {hits('negative')} AS neg, {hits('risk')} AS rsk,
               {hits('surprise')} AS sur, {hits('revenue')} AS rev, {hits('margin')} AS mar FROM tokens_t))"""
CTES["news_raw_t"] = """
SELECT effective_date AS date, ticker,
  CASE WHEN sum(importance * confidence) = 0 THEN avg(sentiment) ELSE sum(sentiment * importance * confidence) / sum(importance * confidence) END AS news_sentiment,
  avg(importance) AS news_importance, max(surprise) AS news_surprise, max(risk) AS news_risk,
  CASE WHEN sum(importance * confidence) = 0 THEN avg(revenue_impact) ELSE sum(revenue_impact * importance * confidence) / sum(importance * confidence) END AS news_revenue_impact,
  CASE WHEN sum(importance * confidence) = 0 THEN avg(margin_impact) ELSE sum(margin_impact * importance * confidence) / sum(importance * confidence) END AS news_margin_impact,
  count(news_id) AS news_coverage
FROM scored_t GROUP BY 1, 2"""
CTES["news_f_t"] = """
SELECT *, 0.35::DOUBLE * news_sentiment + 0.2::DOUBLE * news_importance + 0.15::DOUBLE * news_surprise
          - 0.2::DOUBLE * news_risk + 0.1::DOUBLE * news_revenue_impact AS news_ai_score FROM news_raw_t"""
CTES["panel_t"] = """
SELECT p.*, u.gics_sector FROM usable_t p LEFT JOIN (
  SELECT ticker, gics_sector FROM universe_t QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1
) u USING (ticker)"""
CTES["pit_t"] = """
SELECT p.*, u.gics_sector FROM usable_t p JOIN universe_t u ON p.ticker = u.ticker
  AND p.date >= coalesce(u.entry_date, u.date) AND p.date <= coalesce(u.exit_date, DATE '9999-12-31')
QUALIFY row_number() OVER (PARTITION BY p.date, p.ticker ORDER BY u.date DESC, u.entry_date DESC NULLS LAST) = 1"""
CTES["market_t"] = f"""
SELECT date, close / nullif(lag(close, 5) OVER ({BY}), 0) - 1 AS market_return_5d,
       close / nullif(lag(close, 1) OVER ({BY}), 0) - 1 AS market_daily_return
FROM panel_t WHERE ticker = 'SPY'"""
CTES["returns_t"] = f"""
SELECT p.*, market_return_5d, market_daily_return, {mom(1)} AS daily_return,
       close - lag(close) OVER ({BY}) AS change
FROM panel_t p LEFT JOIN market_t USING (date)"""
CTES["rolled_t"] = f"""
SELECT date, ticker, gics_sector, market_return_5d, {mom(5)} AS momentum_5d, {mom(20)} AS momentum_20d,
  {mom(60)} AS momentum_60d,
  {gate('stddev_samp(daily_return)', 'daily_return', 20)} * sqrt(252::DOUBLE) AS volatility_20d,
  {gate('avg(volume)', 'volume', 5)} / nullif({gate('avg(volume)', 'volume', 5, 5)}, 0) - 1 AS volume_change_5d,
  100 - 100 / (1 + {gate('avg(CASE WHEN change IS NOT NULL THEN greatest(change, 0) END)', 'change', 14)}
    / nullif({gate('avg(CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END)', 'change', 14)}, 0)) AS rsi_14,
  {gate('covar_samp(daily_return, market_daily_return)', 'CASE WHEN daily_return IS NOT NULL AND market_daily_return IS NOT NULL THEN 1 END', 60)}
    / nullif({gate('var_samp(market_daily_return)', 'market_daily_return', 60)}, 0) AS beta
FROM returns_t"""
CTES["trad_t"] = """
SELECT *, CASE WHEN gics_sector IS NOT NULL THEN avg(momentum_5d) OVER (PARTITION BY date, gics_sector) END AS sector_return_5d
FROM rolled_t"""
CTES["merged_t"] = (
    "SELECT t.*, " + ", ".join(f"coalesce(n.{c}, 0)::DOUBLE AS {c}" for c in NEWS)
    + " FROM trad_t t LEFT JOIN news_f_t n USING (date, ticker)"
)
CTES["tails_t"] = "SELECT date, " + ", ".join(
    f"count({c}) AS n_{c}, quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in FACTORS
) + " FROM merged_t GROUP BY date"
CTES["moments_t"] = "SELECT date, " + ", ".join(
    f"avg(greatest(lo_{c}, least(hi_{c}, {c}))) FILTER ({c} IS NOT NULL) AS mean_{c}, "
    f"stddev_pop(greatest(lo_{c}, least(hi_{c}, {c}))) FILTER ({c} IS NOT NULL) AS std_{c}" for c in FACTORS
) + " FROM merged_t JOIN tails_t USING (date) GROUP BY date"
CTES["factor_t"] = "SELECT date, ticker, gics_sector, " + ", ".join(FACTORS) + ", " + ", ".join(
    # Interpolating equal values may move a quantile by a last bit; a deviation of zero says constant as well.
    f"CASE WHEN n_{c} < 2 OR lo_{c} = hi_{c} OR coalesce(std_{c}, 0) = 0 THEN 0 WHEN {c} IS NULL THEN NULL "
    f"ELSE (greatest(lo_{c}, least(hi_{c}, {c})) - mean_{c}) / nullif(std_{c}, 0) END AS z_{c}" for c in FACTORS
) + " FROM merged_t JOIN tails_t USING (date) JOIN moments_t USING (date)"
CTES["label_t"] = "SELECT date, ticker, " + ", ".join(
    f"lead(close, {h}) OVER ({BY}) / nullif(close, 0) - 1 AS stock_return_{h}d" for h in HORIZONS
) + " FROM flagged_t WHERE close IS NOT NULL"
CTES["spy_label_t"] = "SELECT date, " + ", ".join(
    f"stock_return_{h}d AS spy_return_{h}d" for h in HORIZONS
) + " FROM label_t WHERE ticker = 'SPY'"
CTES["dataset_t"] = "SELECT f.*, " + ", ".join(
    f"l.stock_return_{h}d, s.spy_return_{h}d, l.stock_return_{h}d - s.spy_return_{h}d AS future_excess_return_{h}d"
    for h in HORIZONS
) + " FROM factor_t f LEFT JOIN label_t l USING (date, ticker) LEFT JOIN spy_label_t s USING (date)"
CTES["kept_t"] = "SELECT * FROM dataset_t WHERE (" + " + ".join(
    f"({c} IS NOT NULL)::INT" for c in FEATS
) + f") / {len(FEATS)}::DOUBLE >= 0.8"
CTES["features_t"] = "SELECT * REPLACE (" + ", ".join(
    f"coalesce({c}, avg({c}) OVER (PARTITION BY date), 0) AS {c}" for c in FEATS
) + ") FROM kept_t"
CTES["labelled_t"] = "SELECT * FROM features_t WHERE future_excess_return_5d IS NOT NULL"
CTES["days_t"] = """
SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
FROM (SELECT DISTINCT date FROM labelled_t)"""
# 0-based cuts for at least 30 dates; the test data always has more.
CTES["cuts_t"] = """
SELECT n, n - f AS final_start, n - f - 5 AS test_end, n - f - 5 - v AS test_start, n - f - 10 - v AS val_end,
       n - f - 10 - 2 * v AS val_start, n - f - 15 - 2 * v AS train_end
FROM (SELECT n, greatest(1, floor(n * 0.10::DOUBLE))::INT AS f, greatest(1, floor(n * 0.15::DOUBLE))::INT AS v
      FROM (SELECT max(n) AS n FROM days_t))"""
CTES["split_t"] = """
SELECT date, CASE WHEN i < train_end THEN 'train' WHEN i >= val_start AND i < val_end THEN 'validation'
                  WHEN i >= test_start AND i < test_end THEN 'test' WHEN i >= final_start THEN 'final_holdout' END AS split
FROM days_t, cuts_t"""
CTES["scores_t"] = "SELECT *, momentum_5d AS pred FROM features_t"
CTES["predictions_t"] = "SELECT date, ticker, momentum_5d AS pred FROM features_t WHERE momentum_5d IS NOT NULL AND ticker NOT IN ('SPY', 'QQQ')"
CTES["ranked_t"] = """
SELECT *, rn <= k AS selected FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS rn,
         greatest(1, floor(count(*) OVER (PARTITION BY date) * 0.1::DOUBLE)) AS k FROM predictions_t)"""
CTES["grid_t"] = """
SELECT row_number() OVER (ORDER BY cap, exposure) - 1 AS candidate_id, cap, exposure
FROM (SELECT unnest([0.03, 0.04, 0.05])::DOUBLE AS cap), (SELECT unnest([0.7, 0.8, 0.85, 0.9, 0.95, 1.0])::DOUBLE AS exposure)"""
CTES["single_t"] = "SELECT 0 AS candidate_id, 0.05::DOUBLE AS cap, 1.0::DOUBLE AS exposure"


def fill_ctes(prefix: str, source: str, raw: str) -> None:
    """Capped weights by suffix sums: `<prefix>_w` adds column w to `source` (candidate_id, date, ticker, cap, exposure)."""
    CTES[f"{prefix}_a"] = f"""
SELECT *, row_number() OVER g - 1 AS j, count(*) OVER (PARTITION BY candidate_id, date) AS n,
       sum({raw}) OVER (PARTITION BY candidate_id, date ORDER BY {raw} DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
FROM {source} WINDOW g AS (PARTITION BY candidate_id, date ORDER BY {raw} DESC, ticker)"""
    CTES[f"{prefix}_b"] = f"""
SELECT *, least(exposure, n * cap) AS goal,
       s > 1e-12 AND least(exposure, n * cap) - j * cap > 1e-12
       AND coalesce((least(exposure, n * cap) - j * cap) * {raw} / nullif(s, 0) >= cap, false) AS hit FROM {prefix}_a"""
    CTES[f"{prefix}_c"] = f"""
SELECT *, coalesce(min(CASE WHEN NOT hit THEN j END) OVER (PARTITION BY candidate_id, date), n) AS kk FROM {prefix}_b"""
    CTES[f"{prefix}_w"] = f"""
SELECT * EXCLUDE (j, n, s, goal, hit, kk, sk), CASE WHEN j < kk THEN cap WHEN goal - kk * cap <= 1e-12 THEN 0
         WHEN coalesce(sk, 0) <= 1e-12 THEN least(cap, (goal - kk * cap) / nullif(n - kk, 0))
         ELSE (goal - kk * cap) * {raw} / sk END AS w
FROM (SELECT *, max(CASE WHEN j = kk THEN s END) OVER (PARTITION BY candidate_id, date) AS sk FROM {prefix}_c)"""


def portfolio_ctes(p: str, grid: str, ranked: str) -> None:
    """Raw, capped and refilled weights, and rebalance positions, for every candidate of `grid`."""
    CTES[f"{p}_sel"] = f"SELECT candidate_id, cap, exposure, date, ticker, pred, rn FROM {ranked}, {grid} WHERE selected"
    CTES[f"{p}_raw"] = f"""
SELECT *, x / sum(x) OVER (PARTITION BY candidate_id, date) AS raw FROM (
  SELECT *, pred - min(pred) OVER g + greatest(max(pred) OVER g - min(pred) OVER g, 1) * 1e-6::DOUBLE AS x
  FROM {p}_sel WINDOW g AS (PARTITION BY candidate_id, date))"""
    fill_ctes(f"{p}_f1", f"{p}_raw", "raw")
    CTES[f"{p}_keep"] = f"""
SELECT * EXCLUDE (w), w AS w1, CASE WHEN best >= 0.005 AND w >= 0.005 OR best < 0.005 AND pos = 1 THEN raw ELSE 0 END AS raw2
FROM (SELECT *, max(w) OVER (PARTITION BY candidate_id, date) AS best,
             row_number() OVER (PARTITION BY candidate_id, date ORDER BY raw DESC, ticker) AS pos FROM {p}_f1_w)"""
    fill_ctes(f"{p}_f2", f"{p}_keep", "raw2")
    CTES[f"{p}_longs"] = f"SELECT candidate_id, date, ticker, pred, rn, w FROM {p}_f2_w WHERE w > 0"
    CTES[f"{p}_pos"] = f"""
SELECT candidate_id, date, ticker, w FROM {p}_longs
QUALIFY (dense_rank() OVER (PARTITION BY candidate_id ORDER BY date) - 1) % 5 = 0"""


def backtest_ctes(p: str, predictions: str, tickers: str, market_only: str = "") -> None:
    """Panel, fills, accounts and positions for `<p>_pos`. `tickers` names a CTE with the panel's tickers."""
    CTES[f"{p}_panel"] = f"""
SELECT *, close / nullif(lag(close) OVER ({BY}), 0) - 1 AS r FROM flagged_t
WHERE close IS NOT NULL AND date BETWEEN (SELECT min(date) FROM {predictions}) AND (SELECT max(date) FROM {predictions})
  AND (ticker = 'SPY' OR ticker IN (SELECT ticker FROM {tickers}))"""
    CTES[f"{p}_d"] = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM {p}_panel)"
    CTES[f"{p}_sched"] = f"""
SELECT candidate_id, date AS signal_date, i, i + 1 AS f, nd,
       coalesce(lead(i) OVER (PARTITION BY candidate_id ORDER BY i) + 1, nd) AS e,
       row_number() OVER (PARTITION BY candidate_id ORDER BY i) AS k
FROM (SELECT DISTINCT candidate_id, date FROM {p}_pos) JOIN {p}_d USING (date)"""
    CTES[f"{p}_fills0"] = f"""
SELECT s.candidate_id, s.signal_date, s.f, s.e, s.k, d.date AS fill_date
FROM {p}_sched s JOIN {p}_d d ON d.i = s.f WHERE s.f < s.nd"""
    CTES[f"{p}_held"] = f"""
SELECT q.candidate_id, d.date, d.i, q.ticker, q.w, s.k, s.signal_date FROM {p}_pos q
JOIN {p}_fills0 s ON s.candidate_id = q.candidate_id AND s.signal_date = q.date
JOIN {p}_d d ON d.i >= s.f AND d.i < s.e"""
    CTES[f"{p}_tgt"] = f"""
SELECT s.candidate_id, s.k, q.ticker, q.w FROM {p}_pos q JOIN {p}_fills0 s ON s.candidate_id = q.candidate_id AND s.signal_date = q.date"""
    CTES[f"{p}_chg"] = f"""
SELECT c.candidate_id, c.k, c.ticker, c.from_w, c.to_w, c.to_w - c.from_w AS dw, s.signal_date, s.fill_date
FROM (SELECT coalesce(a.candidate_id, b.candidate_id) AS candidate_id, coalesce(a.k, b.k + 1) AS k,
             coalesce(a.ticker, b.ticker) AS ticker, coalesce(b.w, 0) AS from_w, coalesce(a.w, 0) AS to_w
      FROM {p}_tgt a FULL JOIN {p}_tgt b ON a.candidate_id = b.candidate_id AND a.k = b.k + 1 AND a.ticker = b.ticker) c
JOIN {p}_fills0 s ON s.candidate_id = c.candidate_id AND s.k = c.k"""
    CTES[f"{p}_to"] = f"SELECT candidate_id, fill_date AS date, sum(abs(dw)) AS turnover FROM {p}_chg GROUP BY 1, 2"
    CTES[f"{p}_g"] = f"""
SELECT h.candidate_id, d.date, sum(h.w * coalesce(x.r, 0)) AS g FROM {p}_held h JOIN {p}_d d ON d.i = h.i + 1
LEFT JOIN {p}_panel x ON x.date = d.date AND x.ticker = h.ticker GROUP BY 1, 2"""
    CTES[f"{p}_exp"] = f"SELECT candidate_id, date, sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure FROM {p}_held GROUP BY 1, 2"
    CTES[f"{p}_base"] = f"""
SELECT c.candidate_id, d.date, d.i, CASE WHEN d.i = 0 THEN 0 ELSE coalesce(g.g, 0) END AS g,
       CASE WHEN d.i = 0 THEN 0 ELSE coalesce(m.r, 0) END AS benchmark_return, coalesce(t.turnover, 0) AS turnover,
       coalesce(e.gross_exposure, 0) AS gross_exposure, coalesce(e.net_exposure, 0) AS net_exposure
FROM (SELECT DISTINCT candidate_id FROM {p}_pos) c CROSS JOIN {p}_d d
LEFT JOIN {p}_g g ON g.candidate_id = c.candidate_id AND g.date = d.date
LEFT JOIN {p}_to t ON t.candidate_id = c.candidate_id AND t.date = d.date
LEFT JOIN {p}_exp e ON e.candidate_id = c.candidate_id AND e.date = d.date
LEFT JOIN (SELECT date, r FROM {p}_panel WHERE ticker = 'SPY') m ON m.date = d.date"""
    CTES[f"{p}_val"] = f"""
SELECT *, 1000000::DOUBLE * product((1 + g) * (1 - turnover * 0.0015::DOUBLE)) OVER w AS portfolio_value,
       1000000::DOUBLE * product(1 + benchmark_return) OVER w AS benchmark_value
FROM {p}_base WINDOW w AS (PARTITION BY candidate_id ORDER BY date ROWS UNBOUNDED PRECEDING)"""
    CTES[f"{p}_acc"] = f"""
SELECT *, portfolio_value / prev - 1 AS strategy_return, prev * (1 + g) AS vr,
       portfolio_value / greatest(1000000::DOUBLE, peak) - 1 AS drawdown FROM (
  SELECT *, coalesce(lag(portfolio_value) OVER (PARTITION BY candidate_id ORDER BY date), 1000000::DOUBLE) AS prev,
         max(portfolio_value) OVER (PARTITION BY candidate_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {p}_val)"""
    CTES[f"{p}_trd"] = f"""
SELECT c.*, a.vr, a.vr * c.dw AS trade_value, a.vr * abs(c.dw) * 0.0015::DOUBLE AS transaction_cost,
       CASE WHEN c.dw > 0 THEN 'BUY' ELSE 'SELL' END AS side
FROM {p}_chg c JOIN {p}_acc a ON a.candidate_id = c.candidate_id AND a.date = c.fill_date WHERE abs(c.dw) > 1e-10"""
    CTES[f"{p}_fill"] = f"""
SELECT t.*, coalesce(CASE WHEN x.open > 0 THEN x.open ELSE x.close END, 0) AS fill_price
FROM {p}_trd t LEFT JOIN {p}_panel x ON x.date = t.fill_date AND x.ticker = t.ticker"""
    CTES[f"{p}_shr"] = f"""
SELECT *, CASE WHEN fill_price > 0 THEN trade_value / fill_price ELSE 0 END AS fill_shares FROM {p}_fill"""
    CTES[f"{p}_run"] = f"""
SELECT candidate_id, fill_date, ticker, sum(fill_shares) OVER (PARTITION BY candidate_id, ticker ORDER BY fill_date ROWS UNBOUNDED PRECEDING) AS shares
FROM {p}_shr"""
    CTES[f"{p}_cur"] = f"""
SELECT h.date AS as_of_date, h.ticker, coalesce(r.shares, 0) AS shares, coalesce(x.close, 0) AS market_price,
       a.portfolio_value * h.w AS market_value, h.w
FROM {p}_held h ASOF LEFT JOIN {p}_run r ON r.ticker = h.ticker AND r.fill_date <= h.date
LEFT JOIN {p}_panel x ON x.date = h.date AND x.ticker = h.ticker
JOIN {p}_acc a ON a.candidate_id = h.candidate_id AND a.date = h.date"""
    CTES[f"{p}_met"] = f"""
SELECT *, total_return - benchmark_return AS excess_return, pow(1 + total_return, 252.0::DOUBLE / days) - 1 AS cagr,
       pow(1 + benchmark_return, 252.0::DOUBLE / days) - 1 AS benchmark_cagr, coalesce(sd, 0) * sqrt(252::DOUBLE) AS annual_volatility,
       avg_ret / nullif(sd, 0) * sqrt(252::DOUBLE) AS sharpe FROM (
  SELECT candidate_id, arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1 AS total_return,
         arg_max(benchmark_value, date) / arg_min(benchmark_value, date) - 1 AS benchmark_return, count(*) AS days,
         stddev_samp(strategy_return) AS sd, avg(strategy_return) AS avg_ret, min(drawdown) AS max_drawdown,
         avg(turnover) AS avg_turnover, avg((strategy_return > 0)::INT) AS win_rate,
         arg_max(portfolio_value, date) AS final_portfolio_value, arg_max(benchmark_value, date) AS final_benchmark_value
  FROM {p}_acc GROUP BY candidate_id)"""


portfolio_ctes("bt", "single_t", "ranked_t")
backtest_ctes("bt", "predictions_t", "bt_pos")
CTES["pdays_t"] = """
SELECT date, row_number() OVER (ORDER BY date) - 1 < greatest(1, floor(count(*) OVER () * 0.7::DOUBLE)) AS tuning
FROM (SELECT DISTINCT date FROM predictions_t)"""
CTES["tune_t"] = "SELECT p.* FROM predictions_t p JOIN pdays_t USING (date) WHERE tuning"
CTES["tune_ranked_t"] = "SELECT r.* FROM ranked_t r JOIN pdays_t USING (date) WHERE tuning"
portfolio_ctes("sw", "grid_t", "tune_ranked_t")
backtest_ctes("sw", "tune_t", "predictions_t")


def sweep_sql(metrics: str) -> str:
    return f"""
SELECT g.candidate_id, g.cap AS max_weight, g.exposure AS target_exposure, m.total_return, m.benchmark_return,
       m.excess_return, m.cagr, m.sharpe, m.max_drawdown, m.avg_turnover, m.max_drawdown >= -0.1 AS feasible
FROM grid_t g JOIN {metrics} m USING (candidate_id)"""


CTES["sweep_t"] = sweep_sql("sw_met")
# Half of each cross-section: enough names for every exposure of the grid to be reached, so no two candidates tie.
CTES["half_t"] = """
SELECT *, rn <= greatest(1, floor(n * 0.5::DOUBLE)) AS selected FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM predictions_t)"""
portfolio_ctes("hf", "single_t", "half_t")
CTES["tune_half_t"] = "SELECT r.* FROM half_t r JOIN pdays_t USING (date) WHERE tuning"
portfolio_ctes("sx", "grid_t", "tune_half_t")
backtest_ctes("sx", "tune_t", "predictions_t")
CTES["wide_sweep_t"] = sweep_sql("sx_met")
CTES["best_t"] = """
SELECT * FROM wide_sweep_t WHERE sharpe IS NOT NULL ORDER BY feasible DESC,
  CASE WHEN feasible THEN sharpe ELSE -(abs(max_drawdown) - 0.1) END DESC,
  CASE WHEN feasible THEN total_return ELSE sharpe END DESC, candidate_id LIMIT 1"""
CTES["best_grid_t"] = "SELECT candidate_id, max_weight AS cap, target_exposure AS exposure FROM best_t"
CTES["hold_t"] = "SELECT p.* FROM predictions_t p JOIN pdays_t USING (date) WHERE NOT tuning"
CTES["hold_half_t"] = "SELECT r.* FROM half_t r JOIN pdays_t USING (date) WHERE NOT tuning"
portfolio_ctes("fu", "best_grid_t", "half_t")
backtest_ctes("fu", "predictions_t", "fu_pos")
portfolio_ctes("ho", "best_grid_t", "hold_half_t")
backtest_ctes("ho", "hold_t", "ho_pos")

_CASTS = {
    "s": "CAST({c} AS VARCHAR)", "d": "strftime({c}, '%Y-%m-%d')", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    "i": "CAST({c} AS BIGINT)", "b": "CAST({c} AS BOOLEAN)", "f": "round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE",
    "g": "round(CAST({c} AS DOUBLE), 9) + 0.0::DOUBLE", "m": "round(CAST({c} AS DOUBLE), 3) + 0.0::DOUBLE",
}


def columns_of(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def statement(spec: str, body: str) -> str:
    """A full statement: the CTEs `body` needs, then the output columns in canonical form."""
    names = set(CTES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\w+", text)) & names - needed:
            needed.add(word)
            visit(CTES[word])

    visit(body)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    select = ", ".join(f"{_CASTS[kind].format(c=name)} AS {name}" for name, kind in columns_of(spec))
    prefix = f"WITH {', '.join(parts)} " if parts else ""
    return f"{prefix}SELECT {select} FROM ({body}) AS result"
