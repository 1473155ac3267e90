"""Check SQL (DuckDB) for every query that SQL can express, written apart from the Spark jobs.

``_VIEWS`` are named building blocks with the blocks they read. A query is the chain of blocks it
needs, followed by its final SELECT. Doubles are rounded half up to 6 digits by plain arithmetic,
because the engines' own rounding functions treat an exact half differently.
"""

from __future__ import annotations

from pathlib import Path

from funnelworks.plans.forest import Forest

_CHANNEL_CASE = """CASE {k} WHEN 0 THEN 'Organic' WHEN 1 THEN 'Organic' WHEN 2 THEN 'Google Brand Search'
        WHEN 3 THEN 'Google Non-Brand Search' WHEN 4 THEN 'Google App Campaigns' WHEN 5 THEN 'Meta'
        WHEN 6 THEN 'TikTok' ELSE 'Referral' END"""


def _corr(x: str, y: str) -> str:
    """Correlation over complete pairs, NULL when either side is constant."""
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN stddev_samp({x}) {both} > 0 AND stddev_samp({y}) {both} > 0 "
        f"THEN floor(CAST(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) {both} AS DOUBLE) * 1e6 + 0.5) / 1e6 END"
    )


def _ratio(num: str, den: str, scale: str = "") -> str:
    factor = f"{scale} * " if scale else ""
    return f"CASE WHEN {den} > 0 THEN {factor}CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _round(*columns: str) -> str:
    return ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {c}" for c in columns)


def _big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def _fees(windows: str, start: str, end: str, name: str) -> str:
    """Per user: balance held from each transaction in the window to the next one or the window's end."""
    return f"""
        SELECT user_id, sum(CAST(running_balance_usd AS DOUBLE) * held_us / 86400000000.0 * (0.005 / 365.0)) AS {name}
        FROM (SELECT t.user_id, t.running_balance_usd,
                     date_diff('microsecond', t.transaction_timestamp,
                        coalesce(lead(t.transaction_timestamp) OVER (PARTITION BY t.user_id ORDER BY t.transaction_timestamp, t.tx_id), w.{end})) AS held_us
              FROM user_transactions t JOIN {windows} w ON t.user_id = w.user_id
              WHERE t.transaction_timestamp BETWEEN w.{start} AND w.{end})
        GROUP BY user_id"""



_NUMERIC = ["days_to_reg", "camp_CTR", "camp_CPM", "camp_CPC", "tx_count", "dep_sum", "dep_cnt", "wdr_sum", "wdr_cnt", "bal_max", "bal_mean",
            "bal_last", "net_flow", "age", "rev_0_14"]
_CATEGORICAL = ["platform", "channel", "campaign_id", "country", "reg_within_14d", "platform_norm", "channel_platform", "gender", "tracking_enabled"]
_FOREST = Forest.from_json((Path(__file__).parent / "forest.json").read_text()).sql()
_REPEATS = 5


def _r2(truth: str, predicted: str) -> str:
    return f"1 - sum(({truth} - {predicted}) * ({truth} - {predicted})) / nullif(var_pop({truth}) * count({truth}), 0)"


def _importance() -> str:
    """Each feature of the test rows taken from another row, as one list of rows per (feature, repeat)."""
    features = [*_NUMERIC, *_CATEGORICAL]
    moved = ", ".join(f"CASE WHEN f.feature = '{c}' THEN d.{c} ELSE t.{c} END AS {c}" for c in features)
    # The permutations of the library: their numbers depend on the number of test rows alone.
    factors = f"""SELECT r, size, list_filter(range(first, 2 * size + 2), lambda a: gcd(a, size) = 1)[1] % size AS a, (42 + 7919 * (r + 1)) % size AS b
        FROM (SELECT r, size, greatest(1, floor(size * ((42 + r) * 0.6180339887498949::DOUBLE - floor((42 + r) * 0.6180339887498949::DOUBLE))))::BIGINT AS first
              FROM range({_REPEATS}) x(r), (SELECT count(*) AS size FROM test_rows))"""
    return f"""
        SELECT feature, floor(CAST(avg(base - shuffled) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS importance_mean,
               floor(CAST(stddev_pop(base - shuffled) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS importance_std
        FROM (SELECT feature, r, {_r2('truth', 'p')} AS shuffled FROM
                (SELECT feature, r, truth, {_FOREST} AS p FROM
                  (SELECT f.feature, m.r, ln(1 + t.y_rev_14_H) AS truth, {moved}
                   FROM test_rows t, (SELECT unnest({features!r}) AS feature) f, ({factors}) m
                   JOIN test_rows d ON d.slot = (m.a * t.slot + m.b) % m.size))
              GROUP BY feature, r),
             (SELECT {_r2('truth', 'p')} AS base FROM (SELECT ln(1 + y_rev_14_H) AS truth, {_FOREST} AS p FROM test_rows))
        GROUP BY feature"""


# name -> (blocks it reads, SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "app_events": ((), f"""
        SELECT event_id, user_id, ts AS event_timestamp, CAST(ts AS DATE) AS event_date,
               CASE event_type WHEN 'view' THEN 'impression' WHEN 'signup' THEN 'install' WHEN 'purchase' THEN 'registration' ELSE event_type END AS event_name,
               {_CHANNEL_CASE.format(k='k % 8')} AS source,
               CASE WHEN k % 8 IN (0, 1, 7) THEN NULL ELSE 'cmp_' || CAST(k % 8 AS VARCHAR) || '_' || CAST(k % 3 AS VARCHAR) END AS campaign_id,
               CASE WHEN user_id % 5 < 2 THEN 'ios' ELSE 'android' END AS platform,
               CASE user_id % 4 WHEN 0 THEN 'NL' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'BE' END AS country
        FROM (SELECT *, CAST(trim(replace(replace(props, '{{"k":', ''), '}}', '')) AS INT) AS k FROM events)"""),
    "marketing_spend": ((), f"""
        SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS date,
               {_CHANNEL_CASE.format(k='(2 + l_suppkey % 6)')} AS channel,
               CASE WHEN l_suppkey % 6 = 5 THEN NULL ELSE 'cmp_' || CAST(2 + l_suppkey % 6 AS VARCHAR) || '_' || CAST(l_partkey % 3 AS VARCHAR) END AS campaign_id,
               CASE l_partkey % 3 WHEN 0 THEN 'Brand search NL' WHEN 1 THEN 'Prospecting video reach' ELSE 'Retargeting app install' END AS campaign_name,
               CAST(l_extendedprice / 100 AS DECIMAL(18,4)) AS spend,
               CAST(l_quantity * 100 AS BIGINT) AS impressions, CAST(l_quantity AS BIGINT) AS clicks
        FROM lineitem"""),
    "user_profiles": ((), """
        SELECT CAST(floor(c_custkey / 10.0) AS BIGINT) AS user_id, CAST(18 + c_custkey % 50 AS INT) AS age,
               CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
               CASE WHEN CAST(floor(c_custkey / 10.0) AS BIGINT) % 5 < 2 THEN 'ios' ELSE 'android' END AS platform,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN true WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE false END AS tracking_enabled
        FROM (SELECT min(c_custkey) AS c_custkey, min(c_nationkey) AS c_nationkey, arg_max(c_mktsegment, c_custkey) AS c_mktsegment
              FROM customer GROUP BY floor(c_custkey / 10.0))"""),
    "user_transactions": ((), """
        SELECT tx_id, user_id, transaction_timestamp, transaction_type, amount_usd,
               CAST(sum(CASE WHEN transaction_type = 'deposit' THEN amount_usd ELSE -amount_usd END)
                   OVER (PARTITION BY user_id ORDER BY transaction_timestamp, tx_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,4)) AS running_balance_usd
        FROM (SELECT o_orderkey AS tx_id, CAST(floor(o_custkey / 10.0) AS BIGINT) AS user_id,
                     CAST(DATE '2024-01-01' + CAST(o_orderkey % 360 AS INT) AS TIMESTAMP) AS transaction_timestamp,
                     CASE WHEN o_orderstatus = 'F' THEN 'withdrawal' ELSE 'deposit' END AS transaction_type,
                     CAST(o_totalprice / 100 AS DECIMAL(18,4)) AS amount_usd
              FROM orders)"""),
    "skan": ((), """
        SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS postback_date,
               CASE l_suppkey % 3 WHEN 0 THEN 'Google' WHEN 1 THEN 'Meta' ELSE 'TikTok' END AS network,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) END AS conversion_value, CAST(l_linenumber AS BIGINT) AS install_count
        FROM lineitem"""),
    # Channel performance.
    "installs_d": (("app_events",), """
        SELECT event_date, source AS channel, campaign_id, count(DISTINCT user_id) AS installs
        FROM app_events WHERE event_name = 'install' GROUP BY ALL"""),
    "registrations_d": (("app_events",), """
        SELECT event_date, source AS channel, campaign_id, count(DISTINCT user_id) AS registrations
        FROM app_events WHERE event_name = 'registration' GROUP BY ALL"""),
    "spend_d": (("marketing_spend",), """
        SELECT date AS event_date, channel, campaign_id, sum(spend) AS spend, sum(impressions) AS impressions,
               sum(clicks) AS clicks, min(campaign_name) AS campaign_name
        FROM marketing_spend GROUP BY date, channel, campaign_id"""),
    "keys": (("installs_d", "registrations_d", "spend_d"), """
        SELECT event_date, channel, campaign_id FROM spend_d
        UNION SELECT event_date, channel, campaign_id FROM installs_d
        UNION SELECT event_date, channel, campaign_id FROM registrations_d"""),
    "panel": (("keys",), """
        SELECT k.event_date, k.channel, k.campaign_id, s.campaign_name, coalesce(s.spend, 0) AS spend,
               coalesce(s.impressions, 0) AS impressions, coalesce(s.clicks, 0) AS clicks,
               coalesce(i.installs, 0) AS installs, coalesce(r.registrations, 0) AS registrations
        FROM keys k
        LEFT JOIN spend_d s ON k.event_date IS NOT DISTINCT FROM s.event_date AND k.channel IS NOT DISTINCT FROM s.channel AND k.campaign_id IS NOT DISTINCT FROM s.campaign_id
        LEFT JOIN installs_d i ON k.event_date IS NOT DISTINCT FROM i.event_date AND k.channel IS NOT DISTINCT FROM i.channel AND k.campaign_id IS NOT DISTINCT FROM i.campaign_id
        LEFT JOIN registrations_d r ON k.event_date IS NOT DISTINCT FROM r.event_date AND k.channel IS NOT DISTINCT FROM r.channel AND k.campaign_id IS NOT DISTINCT FROM r.campaign_id"""),
    "reg_users": (("app_events",), """
        SELECT user_id, event_timestamp AS reg_date, source AS channel, coalesce(campaign_id, '__NO_CAMPAIGN__') AS campaign_id
        FROM app_events WHERE event_name = 'registration'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp NULLS LAST, event_id) = 1"""),
    "reg_windows": (("reg_users",), "SELECT user_id, reg_date, reg_date + INTERVAL 30 DAY AS window_end FROM reg_users"),
    "user_rev": (("user_transactions", "reg_windows"), _fees("reg_windows", "reg_date", "window_end", "revenue_30d")),
    "reg_rev": (("reg_users", "user_rev"), """
        SELECT r.user_id, r.channel, r.campaign_id, coalesce(u.revenue_30d, 0.0) AS revenue_30d
        FROM reg_users r LEFT JOIN user_rev u ON r.user_id = u.user_id"""),
    "campaign_rev": (("reg_rev",), """
        SELECT channel, campaign_id, count(*) AS reg_users, avg(revenue_30d) AS avg_rev_30d_per_reg, sum(revenue_30d) AS revenue_30d_total
        FROM reg_rev GROUP BY channel, campaign_id"""),
    "campaign_kpi": (("panel", "campaign_rev"), f"""
        SELECT *, {_ratio('CAC', 'avg_rev_30d_per_reg')} AS payback_months, {_ratio('revenue_30d_total', 'spend')} AS roas_30d
        FROM (SELECT p.*, {_ratio('spend', 'installs')} AS CPI, {_ratio('spend', 'registrations')} AS CAC,
                     {_ratio('registrations', 'installs')} AS install_to_reg_rate, {_ratio('clicks', 'impressions')} AS CTR,
                     {_ratio('spend', 'clicks')} AS CPC, {_ratio('spend', 'impressions', '1000')} AS CPM,
                     {_ratio('installs', 'clicks')} AS click_to_install, {_ratio('registrations', 'clicks')} AS click_to_reg,
                     coalesce(v.reg_users, 0) AS reg_users, coalesce(v.avg_rev_30d_per_reg, 0.0) AS avg_rev_30d_per_reg,
                     coalesce(v.revenue_30d_total, 0.0) AS revenue_30d_total
              FROM (SELECT channel, coalesce(campaign_id, '__NO_CAMPAIGN__') AS campaign_id, sum(spend) AS spend, sum(impressions) AS impressions,
                           sum(clicks) AS clicks, sum(installs) AS installs, sum(registrations) AS registrations
                    FROM panel GROUP BY 1, 2) p
              LEFT JOIN campaign_rev v ON p.channel IS NOT DISTINCT FROM v.channel AND p.campaign_id = v.campaign_id)"""),
    "channel_rev": (("reg_rev",), "SELECT channel, count(*) AS reg_users, avg(revenue_30d) AS avg_rev_30d_per_reg FROM reg_rev GROUP BY channel"),
    "channel_kpi": (("campaign_kpi", "channel_rev"), f"""
        SELECT *, reg_share - spend_share AS reg_minus_spend_share
        FROM (SELECT *, {_ratio('CAC', 'avg_rev_30d_per_reg')} AS payback_months, {_ratio('revenue_30d_total', 'spend')} AS roas_30d,
                     {_ratio('spend', 'sum(spend) OVER ()')} AS spend_share, {_ratio('registrations', 'sum(registrations) OVER ()')} AS reg_share
              FROM (SELECT p.*, {_ratio('spend', 'installs')} AS CPI, {_ratio('spend', 'registrations')} AS CAC,
                           {_ratio('registrations', 'installs')} AS install_to_reg_rate, {_ratio('clicks', 'impressions')} AS CTR,
                           {_ratio('spend', 'clicks')} AS CPC, {_ratio('spend', 'impressions', '1000')} AS CPM,
                           coalesce(v.reg_users, 0) AS reg_users, coalesce(v.avg_rev_30d_per_reg, 0.0) AS avg_rev_30d_per_reg
                    FROM (SELECT channel, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(installs) AS installs,
                                 sum(registrations) AS registrations, sum(revenue_30d_total) AS revenue_30d_total
                          FROM campaign_kpi GROUP BY channel) p
                    LEFT JOIN channel_rev v ON p.channel IS NOT DISTINCT FROM v.channel))"""),
    # Attribution gaps.
    "installs_u": (("app_events", "user_profiles"), """
        SELECT e.*, CASE WHEN p.tracking_enabled THEN 'Tracking ON' WHEN NOT p.tracking_enabled THEN 'Tracking OFF' ELSE 'Unknown' END AS tracking_bucket
        FROM app_events e LEFT JOIN user_profiles p
          ON e.user_id IS NOT DISTINCT FROM p.user_id AND e.platform IS NOT DISTINCT FROM p.platform
        WHERE e.event_name = 'install'"""),
    "by_tracking": (("installs_u",), """
        SELECT platform, tracking_bucket, count(DISTINCT user_id) AS installs, count(*) FILTER (WHERE source = 'Organic') AS organic_installs
        FROM installs_u WHERE platform IS NOT NULL GROUP BY platform, tracking_bucket"""),
    # Series.
    "installs_dps": (("app_events",), """
        SELECT event_date, platform, source, count(DISTINCT user_id) AS installs FROM app_events
        WHERE event_name = 'install' AND event_date IS NOT NULL AND platform IS NOT NULL AND source IS NOT NULL GROUP BY ALL"""),
    "organic_d": (("installs_dps",), """
        SELECT event_date, platform, organic_installs, paid_only,
               organic_installs / nullif(2 * organic_installs + paid_only, 0) AS share_published,
               organic_installs / nullif(organic_installs + paid_only, 0) AS share_fixed
        FROM (SELECT event_date, platform, coalesce(sum(installs) FILTER (WHERE source = 'Organic'), 0) AS organic_installs,
                     coalesce(sum(installs) FILTER (WHERE source <> 'Organic'), 0) AS paid_only
              FROM installs_dps GROUP BY event_date, platform)"""),
    "organic_ts": (("organic_d", "marketing_spend"), """
        SELECT o.event_date, o.platform, o.organic_installs, o.share_published AS organic_share, coalesce(CAST(s.total AS DOUBLE), 0.0) AS paid_spend_total
        FROM organic_d o LEFT JOIN (SELECT date, sum(spend) AS total FROM marketing_spend WHERE channel IS NOT NULL GROUP BY date) s ON o.event_date = s.date"""),
    "organic_z": (("organic_ts",), """
        SELECT event_date, platform, organic_share, paid_spend_total,
               CASE WHEN n >= 7 AND sd > 0 THEN (organic_share - mu) / sd END AS z_organic_share
        FROM (SELECT *, count(organic_share) OVER w AS n, avg(organic_share) OVER w AS mu, stddev_samp(organic_share) OVER w AS sd
              FROM organic_ts WINDOW w AS (PARTITION BY platform ORDER BY event_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""),
    "skan_d": (("skan",), """
        SELECT postback_date AS event_date, network, sum(install_count) AS install_count FROM skan
        WHERE postback_date IS NOT NULL AND network IS NOT NULL GROUP BY ALL"""),
    "skan_ts": (("skan_d", "app_events"), """
        SELECT coalesce(s.event_date, c.event_date) AS event_date, coalesce(s.n, 0) AS skan_installs_total, coalesce(c.n, 0) AS lastclick_paid_installs_total
        FROM (SELECT event_date, sum(install_count) AS n FROM skan_d GROUP BY event_date) s
        FULL JOIN (SELECT event_date, sum(u) AS n
                   FROM (SELECT event_date, source, count(DISTINCT user_id) AS u FROM app_events
                         WHERE event_name = 'install' AND platform = 'ios' AND source <> 'Organic' AND event_date IS NOT NULL GROUP BY event_date, source)
                   GROUP BY event_date) c ON s.event_date = c.event_date"""),
    "halo_ts": (("app_events", "marketing_spend"), """
        SELECT s.event_date, s.x, coalesce(o.y, 0) AS y
        FROM (SELECT date AS event_date, CAST(sum(spend) AS DOUBLE) AS x FROM marketing_spend GROUP BY date) s
        LEFT JOIN (SELECT event_date, count(DISTINCT user_id) AS y FROM app_events
                   WHERE event_name = 'install' AND source = 'Organic' GROUP BY event_date) o ON s.event_date = o.event_date"""),
    "halo_diff": (("halo_ts",), """
        SELECT event_date, x, y, x - lag(x) OVER (ORDER BY event_date) AS dx, y - lag(y) OVER (ORDER BY event_date) AS dy FROM halo_ts"""),
    "spend_w": (("marketing_spend",), """
        SELECT *, CAST(spend AS DOUBLE) / nullif(CAST(sum(spend) OVER (PARTITION BY week) AS DOUBLE), 0) AS spend_share
        FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS week, channel, sum(spend) AS spend FROM marketing_spend
              WHERE channel IS NOT NULL GROUP BY ALL)"""),
    "installs_w": (("app_events",), """
        SELECT CAST(date_trunc('week', event_timestamp) AS DATE) AS week, source, count(DISTINCT user_id) AS installs
        FROM app_events WHERE event_name = 'install' AND source IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY ALL"""),
    "paid_w": (("installs_w",), """
        SELECT week, source, installs, installs / sum(installs) OVER (PARTITION BY week) AS paid_install_share
        FROM installs_w WHERE source <> 'Organic'"""),
    "organic_w": (("installs_w",), """
        SELECT week, sum(installs) AS total_installs, coalesce(sum(installs) FILTER (WHERE source = 'Organic'), 0) AS organic_installs,
               coalesce(sum(installs) FILTER (WHERE source = 'Organic'), 0) / sum(installs) AS organic_share_all
        FROM installs_w GROUP BY week"""),
    "voice": (("spend_w", "paid_w", "organic_w"), """
        SELECT v.week, v.spend_share, v.paid_install_share, coalesce(o.organic_share_all, 0.0) AS organic_share_all
        FROM (SELECT coalesce(s.week, p.week) AS week, coalesce(s.spend_share, 0.0) AS spend_share, coalesce(p.paid_install_share, 0.0) AS paid_install_share
              FROM (SELECT * FROM spend_w WHERE channel = 'TikTok') s FULL JOIN (SELECT * FROM paid_w WHERE source = 'TikTok') p ON s.week = p.week) v
        LEFT JOIN organic_w o ON v.week = o.week"""),
    # Roles.
    "media": (("marketing_spend",), f"""
        SELECT *, {_ratio('clicks', 'impressions')} AS CTR, {_ratio('spend', 'clicks')} AS CPC, {_ratio('spend', 'impressions', '1000')} AS CPM
        FROM (SELECT channel, campaign_id, campaign_name, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks
              FROM marketing_spend GROUP BY ALL)"""),
    "funnel": (("campaign_kpi", "media"), f"""
        SELECT c.*, m.campaign_name, {_ratio('c.installs', 'c.clicks')} AS install_rate_per_click, {_ratio('c.registrations', 'c.clicks')} AS reg_rate_per_click
        FROM campaign_kpi c LEFT JOIN media m ON c.channel IS NOT DISTINCT FROM m.channel AND c.campaign_id = m.campaign_id
        WHERE c.registrations >= 20"""),
    "roles": (("funnel",), r"""
        SELECT *, CASE
            WHEN regexp_matches(n, '\bbrand\b|branded') AND contains(c, 'google') THEN 'Brand / demand-capture'
            WHEN regexp_matches(n, 'retarget|remarket|re-engage|reengage|crm') THEN 'Retargeting / re-engagement'
            WHEN regexp_matches(n, 'prospect|acq|acquisition|upper|awareness|reach|video|view') THEN 'Prospecting / upper-funnel'
            WHEN contains(c, 'non-brand') OR regexp_matches(n, 'non[- ]brand|generic|competitor') THEN 'Non-brand intent'
            WHEN regexp_matches(n, 'app campaign|uac|app|install') AND contains(c, 'google') THEN 'Automated app acquisition'
            ELSE 'Unclear / mixed' END AS campaign_role
        FROM (SELECT *, lower(coalesce(campaign_name, '')) AS n, lower(coalesce(channel, '')) AS c FROM funnel)"""),
    # Lifetime value.
    "eligible": (("app_events", "user_transactions"), """
        SELECT user_id, install_date, platform, channel, campaign_id, country
        FROM (SELECT user_id, event_timestamp AS install_date, platform, source AS channel, campaign_id, country FROM app_events WHERE event_name = 'install'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp NULLS LAST, event_id) = 1)
        WHERE install_date <= (SELECT max(transaction_timestamp) - INTERVAL 180 DAY FROM user_transactions)"""),
    "ltv_windows": (("eligible",), """
        SELECT user_id, install_date, install_date + INTERVAL 14 DAY AS end_14, install_date + INTERVAL 180 DAY AS end_h FROM eligible"""),
    "rev_14": (("user_transactions", "ltv_windows"), _fees("ltv_windows", "install_date", "end_14", "rev")),
    "rev_h": (("user_transactions", "ltv_windows"), _fees("ltv_windows", "install_date", "end_h", "rev")),
    "labels_u": (("eligible", "rev_14", "rev_h"), """
        SELECT *, greatest(rev_0_H - rev_0_14, 0.0) AS y_rev_14_H
        FROM (SELECT e.user_id, coalesce(a.rev, 0.0) AS rev_0_14, coalesce(b.rev, 0.0) AS rev_0_H
              FROM eligible e LEFT JOIN rev_14 a ON e.user_id = a.user_id LEFT JOIN rev_h b ON e.user_id = b.user_id)"""),
    "camp": (("marketing_spend",), f"""
        SELECT *, {_ratio('camp_clicks', 'camp_impressions')} AS camp_CTR, {_ratio('camp_spend', 'camp_clicks')} AS camp_CPC,
               {_ratio('camp_spend', 'camp_impressions', '1000')} AS camp_CPM
        FROM (SELECT channel, campaign_id, sum(spend) AS camp_spend, sum(impressions) AS camp_impressions, sum(clicks) AS camp_clicks
              FROM marketing_spend GROUP BY channel, campaign_id)"""),
    "reg_feat": (("eligible", "reg_users"), """
        SELECT user_id, install_date, reg_date, within AS reg_within_14d,
               CASE WHEN within THEN CAST(floor(date_diff('microsecond', install_date, reg_date) / 86400000000.0) AS BIGINT) END AS days_to_reg
        FROM (SELECT e.user_id, e.install_date, r.reg_date, coalesce(r.reg_date <= e.install_date + INTERVAL 14 DAY, false) AS within
              FROM eligible e LEFT JOIN reg_users r ON e.user_id IS NOT DISTINCT FROM r.user_id)"""),
    "tx_feat": (("user_transactions", "eligible"), """
        SELECT *, dep_sum - wdr_sum AS net_flow
        FROM (SELECT t.user_id, count(*) AS tx_count,
                     coalesce(sum(amount_usd) FILTER (WHERE transaction_type = 'deposit'), 0) AS dep_sum, count(*) FILTER (WHERE transaction_type = 'deposit') AS dep_cnt,
                     coalesce(sum(amount_usd) FILTER (WHERE transaction_type = 'withdrawal'), 0) AS wdr_sum, count(*) FILTER (WHERE transaction_type = 'withdrawal') AS wdr_cnt,
                     max(running_balance_usd) AS bal_max, CAST(sum(running_balance_usd) AS DOUBLE) / count(running_balance_usd) AS bal_mean,
                     last(running_balance_usd ORDER BY transaction_timestamp, tx_id) FILTER (WHERE running_balance_usd IS NOT NULL) AS bal_last
              FROM user_transactions t JOIN eligible e ON t.user_id = e.user_id
              WHERE t.transaction_timestamp BETWEEN e.install_date AND e.install_date + INTERVAL 14 DAY
              GROUP BY t.user_id)"""),
    "features": (("eligible", "reg_feat", "camp", "tx_feat", "user_profiles"), """
        SELECT e.user_id, e.install_date, e.platform, e.channel, e.campaign_id, e.country, r.reg_within_14d, r.days_to_reg, c.camp_CTR, c.camp_CPM, c.camp_CPC,
               lower(trim(coalesce(e.platform, 'nan'))) AS platform_norm, coalesce(e.channel, 'nan') || '__' || lower(trim(coalesce(e.platform, 'nan'))) AS channel_platform,
               coalesce(t.tx_count, 0) AS tx_count, coalesce(t.dep_sum, 0) AS dep_sum, coalesce(t.dep_cnt, 0) AS dep_cnt, coalesce(t.wdr_sum, 0) AS wdr_sum,
               coalesce(t.wdr_cnt, 0) AS wdr_cnt, coalesce(t.bal_max, 0) AS bal_max, coalesce(t.bal_mean, 0) AS bal_mean, coalesce(t.bal_last, 0) AS bal_last,
               coalesce(t.net_flow, 0) AS net_flow, p.age, p.gender, p.tracking_enabled
        FROM eligible e JOIN reg_feat r ON e.user_id IS NOT DISTINCT FROM r.user_id
        LEFT JOIN camp c ON e.channel IS NOT DISTINCT FROM c.channel AND e.campaign_id IS NOT DISTINCT FROM c.campaign_id
        LEFT JOIN tx_feat t ON e.user_id = t.user_id LEFT JOIN user_profiles p ON e.user_id IS NOT DISTINCT FROM p.user_id"""),
    "dataset": (("features", "labels_u"), """
        SELECT f.*, l.y_rev_14_H, l.rev_0_14,
               row_number() OVER (ORDER BY f.install_date, f.user_id) <= CAST(floor(0.8 * count(*) OVER ()) AS BIGINT) AS is_train
        FROM features f JOIN labels_u l ON f.user_id IS NOT DISTINCT FROM l.user_id"""),
    "test_rows": (("dataset",), """
        SELECT *, row_number() OVER (ORDER BY install_date, user_id) - 1 AS slot FROM dataset WHERE NOT is_train"""),
    "forest_scored": (("test_rows",), f"""
        SELECT user_id, channel, campaign_id, platform, reg_within_14d, y_true, y_pred, y_true - y_pred AS residual
        FROM (SELECT user_id, channel, campaign_id, platform, reg_within_14d, y_rev_14_H AS y_true, exp({_FOREST}) - 1 AS y_pred FROM test_rows)"""),
    "scored": (("dataset",), """
        SELECT user_id, channel, campaign_id, platform, reg_within_14d, y_rev_14_H AS y_true, rev_0_14 * 2 AS y_pred, y_rev_14_H - rev_0_14 * 2 AS residual
        FROM dataset WHERE NOT is_train"""),
    "by_network": (("skan_d", "app_events"), """
        SELECT coalesce(s.event_date, c.event_date) AS event_date, coalesce(s.network, c.network) AS network,
               coalesce(s.install_count, 0) AS skan_installs, coalesce(c.n, 0) AS lastclick_installs, coalesce(s.install_count, 0) - coalesce(c.n, 0) AS hidden_installs
        FROM skan_d s FULL JOIN
          (SELECT event_date, string_split(source, ' ')[1] AS network, count(DISTINCT user_id) AS n FROM app_events
           WHERE event_name = 'install' AND platform = 'ios' AND source <> 'Organic' AND event_date IS NOT NULL GROUP BY 1, 2) c
          ON s.event_date = c.event_date AND s.network = c.network"""),
    "spend_dc": (("marketing_spend",), """
        SELECT date AS event_date, channel, CAST(sum(spend) AS DOUBLE) AS spend FROM marketing_spend WHERE date IS NOT NULL AND channel IS NOT NULL GROUP BY ALL"""),
    "channel_ts": (("organic_d", "spend_dc"), """
        SELECT platform, channel, event_date, spend AS x, organic_installs FROM organic_d JOIN spend_dc USING (event_date) WHERE channel <> 'Organic'"""),
    "drops": (("spend_dc", "installs_dps"), """
        SELECT *, CASE WHEN ns >= 3 AND ms > 0 THEN spend / ms - 1 END AS spend_change, CASE WHEN ns >= 3 AND mi > 0 THEN installs / mi - 1 END AS installs_change
        FROM (SELECT *, count(*) OVER w AS ns, avg(spend) OVER w AS ms, avg(installs) OVER w AS mi
              FROM (SELECT s.event_date, s.channel, s.spend, coalesce(i.n, 0) AS installs FROM spend_dc s LEFT JOIN
                     (SELECT event_date, source, sum(installs) AS n FROM installs_dps WHERE source <> 'Organic' GROUP BY ALL) i
                     ON s.event_date = i.event_date AND s.channel = i.source)
              WINDOW w AS (PARTITION BY channel ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""),
    "registered": (("scored",), """
        SELECT channel, avg(y_pred) AS pred_mean, median(y_pred) AS pred_median, quantile_cont(y_pred, 0.75) AS pred_p75, quantile_cont(y_pred, 0.9) AS pred_p90,
               avg(CASE WHEN y_pred <= 1e-6 THEN 1.0 ELSE 0.0 END) AS share_zero_pred, count(*) AS n
        FROM scored WHERE channel IS NOT NULL AND reg_within_14d GROUP BY channel"""),
    "value": (("scored",), """
        SELECT channel, avg(y_pred) AS pred_mean, median(y_pred) AS pred_median, quantile_cont(y_pred, 0.75) AS pred_p75, quantile_cont(y_pred, 0.9) AS pred_p90,
               avg(CASE WHEN y_pred <= 1e-6 THEN 1.0 ELSE 0.0 END) AS share_zero_pred, count(*) AS n
        FROM scored WHERE channel IS NOT NULL GROUP BY channel"""),
    "over_cac": (("value", "channel_kpi"), """
        SELECT v.*, c.CAC, CASE WHEN c.CAC <> 0 THEN v.pred_mean / c.CAC END AS LTV_over_CAC, c.CAC = 0 AS is_free_channel
        FROM value v LEFT JOIN channel_kpi c ON v.channel = c.channel WHERE c.CAC IS NOT NULL"""),
}

_KPIS = ["CPI", "CAC", "install_to_reg_rate", "CTR", "CPC", "CPM", "payback_months", "roas_30d", "avg_rev_30d_per_reg", "revenue_30d_total"]
_COUNTS = ["impressions", "clicks", "installs", "registrations"]
_STAT_COUNTS = [*_COUNTS, "reg_users"]


def _lag_table(shift: str) -> str:
    """(platform, lag_days, corr) for 0..14 rows."""
    parts = [
        f"SELECT platform, CAST({k} AS BIGINT) AS lag_days, {_corr('x', 'y')} AS corr FROM "
        f"(SELECT platform, paid_spend_total AS x, {shift}(organic_installs, {k}) OVER (PARTITION BY platform ORDER BY event_date) AS y FROM organic_ts) GROUP BY platform"
        for k in range(15)
    ]
    return "\nUNION ALL ".join(parts)


def _halo_table() -> str:
    parts = [
        f"SELECT CAST({k} AS BIGINT) AS lag_days, {_corr('x', 'y')} AS corr, '{kind}' AS kind FROM "
        f"(SELECT {x} AS x, lead({y}, {k}) OVER (ORDER BY event_date) AS y FROM halo_diff)"
        for kind, x, y in (("raw", "x", "y"), ("diff", "dx", "dy")) for k in (0, 1, 3, 7)
    ]
    return "\nUNION ALL ".join(parts)


def _shift_table() -> str:
    parts = [
        f"SELECT CAST({k} AS BIGINT) AS shift_days, {_corr('x', 'y')} AS corr, floor(CAST(avg(abs(CAST(x - y AS DOUBLE))) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS mae FROM "
        f"(SELECT lag(skan_installs_total, {k}) OVER (ORDER BY event_date) AS x, lastclick_paid_installs_total AS y FROM skan_ts)"
        for k in range(5)
    ]
    return "\nUNION ALL ".join(parts)


def _regression_table() -> str:
    parts = [
        f"SELECT CAST({k} AS BIGINT) AS lag_days, floor(CAST(regr_slope(y, x) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS slope, floor(CAST(regr_intercept(y, x) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS intercept, "
        f"floor(CAST(regr_r2(y, x) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM "
        f"(SELECT x, CAST(lead(y, {k}) OVER (ORDER BY event_date) AS DOUBLE) AS y FROM halo_ts)"
        for k in (0, 1, 3, 7)
    ]
    return "\nUNION ALL ".join(parts)


# Declared types of the bound tables, as Spark names them.
_TYPES = {
    "app_events": {"event_id": "bigint", "user_id": "bigint", "event_timestamp": "timestamp_ntz", "event_name": "string",
                   "source": "string", "campaign_id": "string", "platform": "string", "country": "string"},
    "marketing_spend": {"date": "date", "channel": "string", "campaign_id": "string", "campaign_name": "string",
                        "spend": "decimal(18,4)", "impressions": "bigint", "clicks": "bigint"},
    "user_profiles": {"user_id": "bigint", "age": "int", "gender": "string", "platform": "string", "tracking_enabled": "boolean"},
    "user_transactions": {"tx_id": "bigint", "user_id": "bigint", "transaction_timestamp": "timestamp_ntz", "transaction_type": "string",
                          "amount_usd": "decimal(18,4)", "running_balance_usd": "decimal(28,4)"},
    "skan_attribution_ios": {"postback_date": "date", "network": "string", "conversion_value": "int", "install_count": "bigint"},
}


def _profile_table() -> str:
    parts = []
    for table, columns in _TYPES.items():
        view = "skan" if table == "skan_attribution_ios" else table
        parts += [
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, CAST(0 AS BIGINT) AS rejected, count(*) AS row_count FROM {view}"
            for c, t in columns.items()
        ]
    return "\nUNION ALL ".join(parts)


_FEATURE_SELECT = (
    "user_id, install_date, platform, channel, campaign_id, country, reg_within_14d, " + _big("days_to_reg") + ", "
    + _round("camp_CTR", "camp_CPM", "camp_CPC") + ", platform_norm, channel_platform, " + _big("tx_count", "dep_cnt", "wdr_cnt", "age") + ", "
    + _round("dep_sum", "wdr_sum", "bal_max", "bal_mean", "bal_last", "net_flow") + ", gender, tracking_enabled"
)
_VALUE_SELECT = "channel, " + _round("pred_mean", "pred_median", "pred_p75", "pred_p90", "share_zero_pred") + ", " + _big("n")

# name -> (blocks it reads, final SELECT)
_QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "table_profile": (("app_events", "marketing_spend", "user_profiles", "user_transactions", "skan"), _profile_table()),
    "installs_daily": (("installs_d",), "SELECT event_date, channel AS source, campaign_id, installs FROM installs_d"),
    "registrations_daily": (("registrations_d",), "SELECT event_date, channel AS source, campaign_id, registrations FROM registrations_d"),
    "spend_daily_campaign": (("spend_d",), f"SELECT event_date, channel, campaign_id, campaign_name, {_round('spend')}, {_big('impressions', 'clicks')} FROM spend_d"),
    "panel_keys": (("keys",), "SELECT * FROM keys"),
    "panel_daily_kpi": (("panel",), f"""
        SELECT event_date, channel, campaign_id, campaign_name, {_round('spend')}, {_big(*_COUNTS)},
               floor(CAST({_ratio('spend', 'installs')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CPI, floor(CAST({_ratio('spend', 'registrations')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CAC,
               floor(CAST({_ratio('clicks', 'impressions', '100')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CTR, floor(CAST({_ratio('spend', 'clicks')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CPC,
               floor(CAST({_ratio('spend', 'impressions', '1000')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CPM
        FROM panel"""),
    "first_registration": (("reg_users",), "SELECT * FROM reg_users"),
    "user_revenue_30d": (("user_rev",), f"SELECT user_id, {_round('revenue_30d')} FROM user_rev"),
    "revenue_by_campaign": (("campaign_rev",), f"SELECT channel, campaign_id, {_big('reg_users')}, {_round('avg_rev_30d_per_reg', 'revenue_30d_total')} FROM campaign_rev"),
    "campaign_stats": (("campaign_kpi",), f"""
        SELECT channel, campaign_id, {_round('spend', *_KPIS, 'click_to_install', 'click_to_reg')}, {_big(*_STAT_COUNTS)} FROM campaign_kpi"""),
    "channel_stats": (("channel_kpi",), f"""
        SELECT channel, {_round('spend', *_KPIS, 'spend_share', 'reg_share', 'reg_minus_spend_share')}, {_big(*_STAT_COUNTS)} FROM channel_kpi"""),
    "paid_channel_ranking": (("channel_kpi",), f"""
        SELECT channel, {_round('CAC', 'payback_months')} FROM channel_kpi WHERE channel IS DISTINCT FROM 'Organic' ORDER BY channel_kpi.CAC NULLS LAST, channel"""),
    "paid_channel_payback_ranking": (("channel_kpi",), f"""
        SELECT channel, {_round('CAC', 'payback_months')} FROM channel_kpi WHERE channel IS DISTINCT FROM 'Organic'
        ORDER BY channel_kpi.payback_months NULLS LAST, channel"""),
    "organic_paid_by_platform": (("app_events",), f"""
        SELECT *, floor(CAST(installs_organic / nullif(installs_total, 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_share,
               floor(CAST({_ratio('installs_organic', 'installs_paid')} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_to_paid_ratio
        FROM (SELECT platform, count(DISTINCT user_id) AS installs_total, count(DISTINCT user_id) FILTER (WHERE source = 'Organic') AS installs_organic,
                     count(DISTINCT user_id) FILTER (WHERE source IS DISTINCT FROM 'Organic') AS installs_paid
              FROM app_events WHERE event_name = 'install' AND platform IS NOT NULL GROUP BY platform)"""),
    "organic_share_by_tracking": (("by_tracking",), "SELECT *, floor(CAST(organic_installs / nullif(installs, 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_share FROM by_tracking"),
    "organic_share_pivot": (("by_tracking",), """
        SELECT platform,
               floor(CAST(coalesce(max(organic_installs / nullif(installs, 0)) FILTER (WHERE tracking_bucket = 'Tracking OFF'), 0.0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS "Tracking OFF",
               floor(CAST(coalesce(max(organic_installs / nullif(installs, 0)) FILTER (WHERE tracking_bucket = 'Tracking ON'), 0.0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS "Tracking ON",
               floor(CAST(coalesce(max(organic_installs / nullif(installs, 0)) FILTER (WHERE tracking_bucket = 'Unknown'), 0.0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS "Unknown"
        FROM by_tracking GROUP BY platform"""),
    "paid_mix_share": (("installs_u",), """
        SELECT platform, tracking_bucket, source, installs_paid,
               floor(CAST(installs_paid / sum(installs_paid) OVER (PARTITION BY platform, tracking_bucket) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS share_within_group
        FROM (SELECT platform, tracking_bucket, source, count(DISTINCT user_id) AS installs_paid FROM installs_u
              WHERE source <> 'Organic' AND platform IS NOT NULL GROUP BY ALL)
        ORDER BY platform, tracking_bucket, installs_paid DESC, source"""),
    "daily_installs": (("installs_dps",), "SELECT * FROM installs_dps"),
    "spend_daily_channel": (("marketing_spend",), f"""
        SELECT event_date, channel, {_round('spend')}, {_big('impressions', 'clicks')}
        FROM (SELECT date AS event_date, channel, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks
              FROM marketing_spend WHERE date IS NOT NULL AND channel IS NOT NULL GROUP BY date, channel)"""),
    "daily_installs_pivot": (("installs_dps",), "SELECT event_date, platform, " + ", ".join(
        f"CAST(coalesce(sum(installs) FILTER (WHERE source = '{s}'), 0) AS BIGINT) AS \"{s}\""
        for s in ("Google App Campaigns", "Google Brand Search", "Google Non-Brand Search", "Meta", "Organic", "Referral", "TikTok")
    ) + " FROM installs_dps GROUP BY event_date, platform"),
    "organic_share_daily": (("organic_d",), f"""
        SELECT event_date, platform, {_big('organic_installs')}, CAST(organic_installs + paid_only AS BIGINT) AS paid_installs, floor(CAST(share_published AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_share FROM organic_d"""),
    "organic_share_from_pivot": (("organic_d",), f"""
        SELECT event_date, platform, {_big('organic_installs')}, CAST(organic_installs + paid_only AS BIGINT) AS paid_installs, floor(CAST(share_published AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_share FROM organic_d"""),
    "organic_share_daily_fixed": (("organic_d",), f"""
        SELECT event_date, platform, {_big('organic_installs')}, CAST(paid_only AS BIGINT) AS paid_installs, floor(CAST(share_fixed AS DOUBLE) * 1e6 + 0.5) / 1e6 AS organic_share FROM organic_d"""),
    "lag_corr_spend_organic": (("organic_ts",), _lag_table("lag")),
    "lag_corr_spend_organic_forward": (("organic_ts",), _lag_table("lead")),
    "organic_share_scores": (("organic_z",), f"""
        SELECT event_date, platform, {_round('organic_share', 'z_organic_share', 'paid_spend_total')} FROM organic_z"""),
    "organic_share_anomalies": (("organic_z",), f"""
        SELECT event_date, platform, {_round('organic_share', 'z_organic_share', 'paid_spend_total')} FROM organic_z
        WHERE abs(z_organic_share) >= 2.0 ORDER BY organic_z.z_organic_share DESC, event_date, platform"""),
    "organic_share_extremes": (("organic_z",), f"""
        SELECT event_date, platform, {_round('organic_share', 'z_organic_share', 'paid_spend_total', 'abs_z')}
        FROM (SELECT *, abs(z_organic_share) AS abs_z FROM organic_z WHERE z_organic_share IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY platform ORDER BY abs(z_organic_share) DESC, event_date) <= 10) t
        ORDER BY t.abs_z DESC, event_date, platform"""),
    "skan_daily_network": (("skan_d",), f"SELECT event_date, network, {_big('install_count')} FROM skan_d"),
    "skan_series": (("skan_ts",), f"SELECT event_date, {_big('skan_installs_total', 'lastclick_paid_installs_total')} FROM skan_ts"),
    "skan_vs_lastclick": (("skan_ts",), """
        SELECT event_date, CAST(skan_installs_total AS BIGINT) AS skan_installs_total, CAST(lastclick_paid_installs_total AS BIGINT) AS lastclick_paid_installs_total,
               CAST(skan_installs_total - lastclick_paid_installs_total AS BIGINT) AS skan_minus_lastclick
        FROM skan_ts ORDER BY 4 DESC, event_date"""),
    "skan_shift_fit": (("skan_ts",), _shift_table()),
    "halo_series": (("halo_ts",), """
        SELECT event_date, floor(CAST(x AS DOUBLE) * 1e6 + 0.5) / 1e6 AS paid_spend_total, CAST(y AS BIGINT) AS organic_installs FROM halo_ts"""),
    "halo_lag_corr": (("halo_diff",), _halo_table()),
    "weekly_spend_share": (("spend_w",), f"SELECT week, channel, {_round('spend', 'spend_share')} FROM spend_w"),
    "weekly_paid_install_share": (("paid_w",), f"SELECT week, source, installs, {_round('paid_install_share')} FROM paid_w"),
    "weekly_organic_share": (("organic_w",), f"SELECT week, {_big('total_installs', 'organic_installs')}, {_round('organic_share_all')} FROM organic_w"),
    "share_of_voice": (("voice",), f"SELECT week, {_round('spend_share', 'paid_install_share', 'organic_share_all')} FROM voice"),
    "share_of_voice_delta_corr": (("voice",), f"""
        SELECT {_corr('s', 'o')} AS corr_spend_organic, {_corr('s', 'p')} AS corr_spend_install
        FROM (SELECT spend_share - lag(spend_share) OVER w AS s, paid_install_share - lag(paid_install_share) OVER w AS p,
                     organic_share_all - lag(organic_share_all) OVER w AS o
              FROM voice WINDOW w AS (ORDER BY week))"""),
    "campaign_media": (("media",), f"SELECT channel, campaign_id, campaign_name, {_round('spend', 'CTR', 'CPC', 'CPM')}, {_big('impressions', 'clicks')} FROM media"),
    "campaign_funnel": (("funnel",), f"""
        SELECT channel, campaign_id, campaign_name, {_big(*_STAT_COUNTS)},
               {_round('spend', *_KPIS, 'click_to_install', 'click_to_reg', 'install_rate_per_click', 'reg_rate_per_click')} FROM funnel"""),
    "campaign_roles": (("roles",), f"SELECT channel, campaign_id, campaign_name, {_round('spend')}, campaign_role FROM roles"),
    "role_mix": (("roles",), """
        SELECT channel, campaign_role, floor(CAST(CAST(s AS DOUBLE) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS role_spend,
               floor(CAST(CAST(s AS DOUBLE) / nullif(CAST(sum(s) OVER (PARTITION BY channel) AS DOUBLE), 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS role_spend_share
        FROM (SELECT channel, campaign_role, sum(spend) AS s FROM roles WHERE channel IS NOT NULL GROUP BY ALL)"""),
    "role_profile": (("roles",), f"""
        SELECT channel, campaign_role, {_big('campaigns')}, {_round('spend', 'CAC', 'payback', 'CPM', 'CTR', 'install_to_reg', 'roas_30d')}
        FROM (SELECT channel, campaign_role, count(DISTINCT campaign_id) AS campaigns, sum(spend) AS spend, avg(CAC) AS CAC, avg(payback_months) AS payback,
                     avg(CPM) AS CPM, avg(CTR) AS CTR, avg(install_to_reg_rate) AS install_to_reg, avg(roas_30d) AS roas_30d
              FROM roles WHERE channel IS NOT NULL GROUP BY channel, campaign_role)"""),
    "media_bubble": (("roles",), f"""
        SELECT channel, campaign_id, campaign_name, {_round('CPM', 'CTR')},
               floor(CAST(least(greatest(CAST(spend AS DOUBLE) / 2000.0, 10.0), 200.0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS bubble_size
        FROM roles WHERE CPM IS NOT NULL AND CTR IS NOT NULL"""),
    "eligible_installs": (("eligible",), "SELECT * FROM eligible"),
    "ltv_labels": (("labels_u",), f"SELECT user_id, {_round('rev_0_14', 'rev_0_H', 'y_rev_14_H')} FROM labels_u"),
    "campaign_media_features": (("camp",), f"""
        SELECT channel, campaign_id, {_round('camp_spend', 'camp_CTR', 'camp_CPC', 'camp_CPM')}, {_big('camp_impressions', 'camp_clicks')} FROM camp"""),
    "registration_features": (("reg_feat",), "SELECT user_id, install_date, reg_date, reg_within_14d, days_to_reg FROM reg_feat"),
    "tx_features_14d": (("tx_feat",), f"""
        SELECT user_id, {_big('tx_count', 'dep_cnt', 'wdr_cnt')}, {_round('dep_sum', 'wdr_sum', 'bal_max', 'bal_mean', 'bal_last', 'net_flow')} FROM tx_feat"""),
    "ltv_features": (("features",), f"SELECT {_FEATURE_SELECT} FROM features"),
    "ltv_dataset": (("dataset",), f"SELECT {_FEATURE_SELECT}, {_round('y_rev_14_H', 'rev_0_14')}, is_train FROM dataset"),
    "skan_by_network": (("by_network",), f"SELECT event_date, network, {_big('skan_installs', 'lastclick_installs', 'hidden_installs')} FROM by_network"),
    "skan_network_gap": (("by_network",), f"""
        SELECT network, {_big('skan_installs', 'lastclick_installs', 'hidden_installs')}, floor(CAST(CAST(hidden_installs AS DOUBLE) / nullif(skan_installs, 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS hidden_share
        FROM (SELECT network, sum(skan_installs) AS skan_installs, sum(lastclick_installs) AS lastclick_installs, sum(hidden_installs) AS hidden_installs FROM by_network GROUP BY network)"""),
    "mislabelled_organic": (("by_network", "app_events"), f"""
        SELECT event_date, {_big('organic_installs', 'hidden_installs')}, CAST(least(organic_installs, hidden_installs) AS BIGINT) AS mislabelled_installs,
               floor(CAST(CAST(least(organic_installs, hidden_installs) AS DOUBLE) / nullif(organic_installs, 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS mislabelled_share
        FROM (SELECT o.event_date, o.n AS organic_installs, coalesce(h.n, 0) AS hidden_installs
              FROM (SELECT event_date, count(DISTINCT user_id) AS n FROM app_events
                    WHERE event_name = 'install' AND platform = 'ios' AND source = 'Organic' AND event_date IS NOT NULL GROUP BY 1) o
              LEFT JOIN (SELECT event_date, sum(greatest(hidden_installs, 0)) AS n FROM by_network GROUP BY 1) h ON o.event_date = h.event_date)"""),
    "early_engagement_14d": (("eligible", "app_events"), """
        SELECT e.user_id, """ + ", ".join(f"count(*) FILTER (WHERE a.event_name = '{k}') AS {k}s_14d" for k in ("impression", "click", "install", "registration")) + """
        FROM eligible e LEFT JOIN app_events a ON e.user_id = a.user_id AND a.event_timestamp BETWEEN e.install_date AND e.install_date + INTERVAL 14 DAY GROUP BY e.user_id"""),
    "lag_corr_by_channel": (("channel_ts",), " UNION ALL ".join(
        f"SELECT platform, channel, CAST({k} AS BIGINT) AS lag_days, {_corr('x', 'y')} AS corr FROM "
        f"(SELECT platform, channel, x, lag(organic_installs, {k}) OVER (PARTITION BY platform, channel ORDER BY event_date) AS y FROM channel_ts) GROUP BY platform, channel"
        for k in range(15))),
    "paid_install_drops": (("drops",), f"""
        SELECT event_date, channel, {_round('spend')}, {_big('installs')}, {_round('spend_change', 'installs_change')},
               coalesce(abs(spend_change) <= 0.25 AND installs_change <= -0.25, false) AS is_drop FROM drops"""),
    "registered_value_fixed_score": (("registered",), f"SELECT {_VALUE_SELECT} FROM registered"),
    "ltv_over_cac_by_platform_fixed_score": (("scored", "channel_kpi"), f"""
        SELECT channel, platform, n, {_round('pred_mean', 'CAC')}, floor(CAST(pred_mean / CAC AS DOUBLE) * 1e6 + 0.5) / 1e6 AS LTV_over_CAC
        FROM (SELECT channel, platform, avg(y_pred) AS pred_mean, count(*) AS n FROM scored WHERE channel IS NOT NULL AND platform IS NOT NULL GROUP BY 1, 2)
        JOIN (SELECT channel, CAC FROM channel_kpi) USING (channel) WHERE CAC > 0"""),
    "installer_sketch_bounds": (("installs_w",), "SELECT week, source, installs, true AS within_bound FROM installs_w"),
    "amount_sketch_bounds": (("user_transactions",), """
        SELECT CAST(date_trunc('month', transaction_timestamp) AS DATE) AS month, transaction_type, count(amount_usd) AS n,
               true AS p50_within_bound, true AS p75_within_bound, true AS p90_within_bound
        FROM user_transactions WHERE transaction_timestamp IS NOT NULL GROUP BY 1, 2"""),
    "ltv_fill_values": (("dataset",), " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, floor(CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS median, NULL::VARCHAR AS mode, NULL::BIGINT AS levels "
         f"FROM dataset WHERE is_train HAVING count({c}) > 0" for c in _NUMERIC]
        + [f"SELECT '{c}', NULL::DOUBLE, level, levels FROM (SELECT CAST({c} AS VARCHAR) AS level, count(*) OVER () AS levels, count(*) AS n "
           f"FROM dataset WHERE is_train AND {c} IS NOT NULL GROUP BY 1 QUALIFY row_number() OVER (ORDER BY n DESC, level) = 1)" for c in _CATEGORICAL])),
    "ltv_scores_fixed_forest": (("forest_scored",), f"SELECT user_id, channel, campaign_id, platform, reg_within_14d, {_round('y_true', 'y_pred', 'residual')} FROM forest_scored"),
    "ltv_model_metrics_fixed_score": (("forest_scored",), f"""
        SELECT {_round('mae', 'rmse', 'r2_log')}, n FROM (
          SELECT avg(abs(residual)) AS mae, sqrt(avg(residual * residual)) AS rmse, {_r2('ln(1 + y_true)', 'ln(1 + y_pred)')} AS r2_log, count(*) AS n FROM forest_scored)"""),
    "median_model_mae_fixed_score": (("forest_scored",), f"SELECT {_round('mae')}, n FROM (SELECT avg(abs(residual)) AS mae, count(*) AS n FROM forest_scored)"),
    "ltv_feature_importance_fixed_score": (("test_rows",), _importance()),
    "residuals_by_channel_fixed_score": (("scored",), """
        SELECT channel, floor(CAST(avg(residual) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS mean_resid, floor(CAST(median(residual) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS median_resid, count(*) AS n
        FROM scored WHERE channel IS NOT NULL GROUP BY channel"""),
    "channel_value_fixed_score": (("value",), f"SELECT {_VALUE_SELECT} FROM value"),
    "ltv_over_cac_fixed_score": (("over_cac",), f"SELECT {_VALUE_SELECT}, {_round('CAC', 'LTV_over_CAC')}, is_free_channel FROM over_cac"),
    "skan_ios_value": (("features", "labels_u", "skan"), """
        SELECT network, CAST(sum(installs) AS BIGINT) AS installs, CAST(coalesce(sum(installs) FILTER (WHERE mean_value IS NOT NULL), 0) AS BIGINT) AS calibrated_installs,
               floor(CAST(sum(installs * mean_value) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS estimated_value,
               floor(CAST(sum(installs * mean_value) / nullif(coalesce(sum(installs) FILTER (WHERE mean_value IS NOT NULL), 0), 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS value_per_install
        FROM (SELECT network, conversion_value, sum(install_count) AS installs FROM skan GROUP BY ALL) s
        LEFT JOIN (SELECT CAST(least(63, floor(greatest(l.rev_0_14, 0.0))) AS INT) AS conversion_value, avg(l.rev_0_H) AS mean_value
                   FROM features f JOIN labels_u l ON f.user_id IS NOT DISTINCT FROM l.user_id WHERE f.platform = 'android' GROUP BY 1) c
          ON s.conversion_value = c.conversion_value
        GROUP BY network"""),
    "halo_regression": (("halo_ts",), _regression_table()),
    "channel_funnel_role": (("channel_kpi",), f"""
        SELECT channel, {_round('CPM', 'CTR', 'click_to_reg')}, floor(CAST(score AS DOUBLE) * 1e6 + 0.5) / 1e6 AS intent_score,
               CASE WHEN score >= 2.0 / 3 THEN 'bottom' WHEN score >= 1.0 / 3 THEN 'mid' ELSE 'top' END AS funnel_role
        FROM (SELECT *, (percent_rank() OVER (ORDER BY CPM NULLS FIRST) + percent_rank() OVER (ORDER BY CTR NULLS FIRST)
                         + percent_rank() OVER (ORDER BY click_to_reg NULLS FIRST)) / 3.0 AS score
              FROM (SELECT channel, CPM, CTR, {_ratio('registrations', 'clicks')} AS click_to_reg FROM channel_kpi WHERE channel IS DISTINCT FROM 'Organic'))"""),
    "predicted_payback_fixed_score": (("over_cac",), f"""
        SELECT channel, {_round('CAC', 'pred_mean')}, floor(CAST(CASE WHEN pred_mean <> 0 THEN CAC / (pred_mean / (166 / 30.0)) END AS DOUBLE) * 1e6 + 0.5) / 1e6 AS predicted_payback_months FROM over_cac"""),
    "campaign_triage_fixed_score": (("scored", "campaign_kpi"), """
        SELECT v.channel, v.campaign_id, floor(CAST(v.pred_mean AS DOUBLE) * 1e6 + 0.5) / 1e6 AS pred_mean, v.n, floor(CAST(c.CAC AS DOUBLE) * 1e6 + 0.5) / 1e6 AS CAC, floor(CAST(v.pred_mean / c.CAC AS DOUBLE) * 1e6 + 0.5) / 1e6 AS LTV_over_CAC
        FROM (SELECT channel, coalesce(campaign_id, '__NO_CAMPAIGN__') AS campaign_id, avg(y_pred) AS pred_mean, count(*) AS n FROM scored GROUP BY 1, 2) v
        JOIN campaign_kpi c ON v.channel IS NOT DISTINCT FROM c.channel AND v.campaign_id = c.campaign_id
        WHERE c.CAC > 0"""),
}


def _chain(needed: tuple[str, ...]) -> list[str]:
    """Needed blocks and all they read, each after its own inputs."""
    out: list[str] = []
    for name in needed:
        for block in [*_chain(_VIEWS[name][0]), name]:
            if block not in out:
                out.append(block)
    return out


def _sql(needed: tuple[str, ...], final: str) -> str:
    blocks = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in _chain(needed))
    return f"WITH {blocks}\n{final.strip()}"


ORACLES: dict[str, str] = {name: _sql(*query) for name, query in _QUERIES.items()}
