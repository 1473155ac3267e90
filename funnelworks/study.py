"""All reports of the study over one set of input tables.

    python -m funnelworks.study DATA [--format csv|parquet] [--write OUT] [report ...]

reads the five tables from DATA and shows the named reports (default: all), or writes them as
Parquet tables below OUT.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.operators import BalanceIndex, user_days, with_row_index
from funnelworks.plans import channel, extensions, gaps, ltv, model, roles, series
from funnelworks.sources import Tables, materialise, read_tables, table_profile


@dataclass(frozen=True)
class Settings:
    """What an analyst may want to change; the defaults are the published ones."""

    min_registrations: int = roles.MIN_REGISTRATIONS
    z_threshold: float = series.Z_THRESHOLD
    voice_channel: str = "TikTok"
    own_names: Sequence[str] = ()
    sources: Sequence[str] | None = None
    max_iter: int = model.MAX_ITER
    revenue_per_conversion_value: float = 1.0


class Study:
    """Frames that several reports share. All are lazy but the user-days, the balance index, the data set, the
    model and its scores, which are written or fitted when first needed and then reused.

    A report that looks at events or transactions from several sides reads the user-days and the index, so each of
    the two large tables is scanned once. With ``extract`` every report reads the user-days, so that a run of many
    reports needs one scan of all events.
    """

    def __init__(self, tables: Tables, settings: Settings = Settings(), extract: bool = False):
        self.settings = settings
        self.tables = tables
        self.events, self.spend, self.profiles, self.tx, self.skan = tables
        self.all_events = self.events
        if extract:
            self.events = self.days

    @cached_property
    def days(self) -> DataFrame:
        return materialise(user_days(self.events), "user-days")

    @cached_property
    def index(self) -> BalanceIndex:
        return ltv.account_index(self.tx, self.days).written()

    # Channel performance and roles.
    @cached_property
    def registrations(self) -> DataFrame:
        return channel.first_registration(self.days)

    @cached_property
    def user_revenue(self) -> DataFrame:
        return self.index.fees({"revenue_30d": ("reg_date", "reg_end")})

    @cached_property
    def campaign_revenue(self) -> DataFrame:
        return channel.revenue_by_campaign(channel.registered_revenue(self.registrations, self.user_revenue))

    @cached_property
    def campaigns(self) -> DataFrame:
        return channel.campaign_stats(channel.panel_rows(self.days, self.spend), self.campaign_revenue)

    @cached_property
    def channels(self) -> DataFrame:
        return channel.channel_stats(self.campaigns)

    @cached_property
    def funnel(self) -> DataFrame:
        return roles.campaign_funnel(self.campaigns, roles.campaign_media(self.spend), self.settings.min_registrations)

    @cached_property
    def roles(self) -> DataFrame:
        return roles.campaign_roles(self.funnel, self.settings.own_names)

    # Attribution gaps and series.
    @cached_property
    def install_users(self) -> DataFrame:
        return gaps.install_users(self.events, self.profiles)

    @cached_property
    def by_tracking(self) -> DataFrame:
        return gaps.organic_share_by_tracking(self.install_users)

    @cached_property
    def daily_installs(self) -> DataFrame:
        return series.daily_installs(self.events)

    @cached_property
    def organic(self) -> DataFrame:
        return series.organic_series(self.events, self.spend)

    @cached_property
    def postbacks(self) -> DataFrame:
        return series.skan_series(self.skan, self.events)

    @cached_property
    def by_network(self) -> DataFrame:
        return extensions.skan_by_network(self.skan, self.events)

    @cached_property
    def halo(self) -> DataFrame:
        return series.halo_series(self.events, self.spend)

    @cached_property
    def weekly_installs(self) -> DataFrame:
        return series.weekly_installs(self.events)

    @cached_property
    def voice(self) -> DataFrame:
        return series.share_of_voice(self.spend, self.events, self.settings.voice_channel)

    # Lifetime value.
    @cached_property
    def eligible(self) -> DataFrame:
        return ltv.eligible_installs(ltv.user_journeys(self.events), self.tx)

    @cached_property
    def matured(self) -> DataFrame:
        """The eligible users once more, from the user-days and the index."""
        return ltv.with_whole_window(ltv.user_journeys(self.days), self.index.last_instant())

    @cached_property
    def accounts(self) -> DataFrame:
        return ltv.with_whole_window(ltv.summary_of(self.index), self.index.last_instant()).drop("install_date")

    @cached_property
    def features(self) -> DataFrame:
        return ltv.ltv_features(self.matured, self.spend, self.accounts, self.profiles)

    @cached_property
    def data(self) -> DataFrame:
        return ltv.time_split(materialise(self.features.drop("rev_0_H"), "dataset"))

    @property
    def train(self) -> DataFrame:
        return self.data.filter("is_train")

    @property
    def test(self) -> DataFrame:
        return self.data.filter("NOT is_train")

    @cached_property
    def numbered_test(self) -> DataFrame:
        """Test rows with a dense ``row_index`` in order of time."""
        rest = F.xxhash64(*[c for c in self.test.columns if c not in ltv.KEYS])
        return with_row_index(self.test, [F.col("install_date").asc_nulls_last(), F.col("user_id").asc_nulls_last(), rest])

    @cached_property
    def model(self) -> model.LtvModel:
        return model.fit_ltv(self.train, max_iter=self.settings.max_iter)

    @cached_property
    def scored(self) -> DataFrame:
        return materialise(model.score(self.model, self.test), "scored")

    @cached_property
    def value(self) -> DataFrame:
        return model.channel_value(self.scored)

    @cached_property
    def over_cac(self) -> DataFrame:
        return model.ltv_over_cac(self.value, self.channels)

    def median_scored(self) -> DataFrame:
        fitted = model.fit_ltv(self.train, loss="absolute", max_iter=self.settings.max_iter)
        return model.score(fitted, self.test)

    def profile(self) -> DataFrame:
        named = [table_profile(df).withColumn("table_name", F.lit(name)) for name, df in self.tables._asdict().items()]
        return reduce(DataFrame.unionByName, named)


Report = Callable[[Study], DataFrame]

RELATIONAL: dict[str, Report] = {
    "table_profile": Study.profile,
    # Channel performance.
    "installs_daily": lambda s: channel.installs_daily(s.events),
    "registrations_daily": lambda s: channel.registrations_daily(s.events),
    "spend_daily_campaign": lambda s: channel.spend_daily_campaign(s.spend),
    "panel_keys": lambda s: channel.panel_keys(s.events, s.spend),
    "panel_daily_kpi": lambda s: channel.panel_daily_kpi(s.events, s.spend),
    "first_registration": lambda s: channel.first_registration(s.events),
    "user_revenue_30d": lambda s: s.user_revenue,
    "revenue_by_campaign": lambda s: s.campaign_revenue,
    "campaign_stats": lambda s: s.campaigns,
    "channel_stats": lambda s: s.channels,
    "paid_channel_ranking": lambda s: channel.paid_channel_ranking(s.channels),
    "paid_channel_payback_ranking": lambda s: channel.paid_channel_ranking(s.channels, by="payback_months"),
    # Attribution gaps.
    "organic_paid_by_platform": lambda s: gaps.organic_paid_by_platform(s.events),
    "organic_share_by_tracking": lambda s: s.by_tracking,
    "organic_share_pivot": lambda s: gaps.organic_share_pivot(s.by_tracking),
    "paid_mix_share": lambda s: gaps.paid_mix_share(s.install_users),
    # Series.
    "daily_installs": lambda s: s.daily_installs,
    "spend_daily_channel": lambda s: series.spend_daily_channel(s.spend),
    "daily_installs_pivot": lambda s: series.daily_installs_pivot(s.daily_installs, s.settings.sources),
    "organic_share_daily": lambda s: series.organic_share_daily(s.daily_installs),
    "organic_share_from_pivot": lambda s: series.organic_share_from_pivot(series.daily_installs_pivot(s.daily_installs, s.settings.sources)),
    "organic_share_daily_fixed": lambda s: series.organic_share_daily(s.daily_installs, organic_in_paid=False),
    "lag_corr_spend_organic": lambda s: series.lag_corr_spend_organic(s.organic),
    "lag_corr_spend_organic_forward": lambda s: series.lag_corr_spend_organic(s.organic, forward=True),
    "organic_share_scores": lambda s: series.organic_share_scores(s.organic),
    "organic_share_anomalies": lambda s: series.organic_share_anomalies(s.organic, s.settings.z_threshold),
    "organic_share_extremes": lambda s: series.organic_share_extremes(s.organic),
    "skan_daily_network": lambda s: series.skan_daily_network(s.skan),
    "skan_series": lambda s: s.postbacks,
    "skan_vs_lastclick": lambda s: series.skan_vs_lastclick(s.postbacks),
    "skan_shift_fit": lambda s: series.skan_shift_fit(s.postbacks),
    "halo_series": lambda s: s.halo,
    "halo_lag_corr": lambda s: series.halo_lag_corr(s.halo),
    "weekly_spend_share": lambda s: series.weekly_spend_share(s.spend),
    "weekly_paid_install_share": lambda s: series.weekly_paid_install_share(s.weekly_installs),
    "weekly_organic_share": lambda s: series.weekly_organic_share(s.weekly_installs),
    "share_of_voice": lambda s: s.voice,
    "share_of_voice_delta_corr": lambda s: series.share_of_voice_delta_corr(s.voice),
    # Roles.
    "campaign_media": lambda s: roles.campaign_media(s.spend),
    "campaign_funnel": lambda s: s.funnel,
    "campaign_roles": lambda s: s.roles.select("channel", "campaign_id", "campaign_name", "spend", "campaign_role"),
    "role_mix": lambda s: roles.role_mix(s.roles),
    "role_profile": lambda s: roles.role_profile(s.roles),
    "media_bubble": lambda s: roles.media_bubble(s.roles),
    # Lifetime value.
    "eligible_installs": lambda s: s.eligible.drop("reg_date"),
    "ltv_labels": lambda s: ltv.ltv_labels(s.matured, s.accounts),
    "campaign_media_features": lambda s: ltv.campaign_media_features(s.spend),
    "registration_features": lambda s: ltv.registration_features(s.eligible).select(
        "user_id", "install_date", "reg_date", "reg_within_14d", "days_to_reg"
    ),
    "tx_features_14d": lambda s: ltv.tx_features_14d(s.accounts),
    "ltv_features": lambda s: s.features.drop("rev_0_14", "rev_0_H", ltv.TARGET),
    "ltv_dataset": lambda s: s.data,
    "ltv_fill_values": lambda s: model.fill_table(s.train, *model.column_kinds(s.train, ltv.FEATURES)),
    # Methods described in words only.
    "skan_ios_value": lambda s: extensions.skan_ios_value(s.features, s.skan, s.settings.revenue_per_conversion_value),
    "skan_by_network": lambda s: s.by_network,
    "skan_network_gap": lambda s: extensions.skan_network_gap(s.by_network),
    "mislabelled_organic": lambda s: extensions.mislabelled_organic(s.by_network, s.events),
    "early_engagement_14d": lambda s: extensions.early_engagement(s.all_events, s.eligible),
    "lag_corr_by_channel": lambda s: extensions.lag_corr_by_channel(s.organic, series.spend_daily_channel(s.spend)),
    "paid_install_drops": lambda s: extensions.paid_install_drops(s.daily_installs, series.spend_daily_channel(s.spend)),
    "halo_regression": lambda s: extensions.halo_regression(s.halo),
    "channel_funnel_role": lambda s: extensions.channel_funnel_role(s.channels),
}

MODELLED: dict[str, Report] = {
    "ltv_model_metrics": lambda s: model.model_metrics(s.scored),
    "ltv_feature_importance": lambda s: model.permutation_importance(s.model, s.numbered_test),
    "residuals_by_channel": lambda s: model.residuals_by_channel(s.scored),
    "channel_value": lambda s: s.value,
    "ltv_over_cac": lambda s: s.over_cac,
    "median_model_mae": lambda s: model.mean_absolute_error(s.median_scored()),
    "predicted_payback": lambda s: extensions.predicted_payback(s.over_cac),
    "campaign_triage": lambda s: extensions.campaign_triage(s.scored, s.campaigns),
    "registered_value": lambda s: extensions.registered_value(s.scored),
    "ltv_over_cac_by_platform": lambda s: extensions.ltv_over_cac_by_platform(s.scored, s.channels),
}

REPORTS: dict[str, Report] = RELATIONAL | MODELLED


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="funnelworks.study", description="Reports of the acquisition study.")
    parser.add_argument("data", help="folder with the five tables")
    parser.add_argument("reports", nargs="*", help=f"of: {', '.join(REPORTS)}")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--write", metavar="OUT", help="write Parquet tables here instead of showing rows")
    args = parser.parse_args(argv)
    unknown = [r for r in args.reports if r not in REPORTS]
    if unknown:
        parser.error(f"unknown reports: {', '.join(unknown)}")

    spark = SparkSession.builder.appName("funnelworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = args.reports or list(REPORTS)
    study = Study(read_tables(spark, args.data, args.format), extract=len(names) > 1)
    for name in names:
        df = REPORTS[name](study)
        if args.write:
            df.write.mode("overwrite").parquet(f"{args.write.rstrip('/')}/{name}")
        else:
            print(name)
            df.show(30, truncate=False)


if __name__ == "__main__":
    main()
