"""The whole study from CSV files gives what it gives on the bound tables."""

from __future__ import annotations

import pytest

from funnelworks import study as study_module
from funnelworks.fixture.bindings import bound_tables
from funnelworks.fixture.queries import SETTINGS, comparable
from funnelworks.sources import read_tables
from funnelworks.study import REPORTS, Settings, Study
from tests.frames import rows

NAMES = ["panel_daily_kpi", "channel_stats", "organic_share_by_tracking", "organic_share_scores", "skan_vs_lastclick",
         "share_of_voice", "role_profile", "tx_features_14d", "ltv_labels", "ltv_features"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("study")
    for name, df in bound_tables(spark, sf_dir)._asdict().items():
        df.write.options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(str(out / f"{name}.csv"))
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_csv_study_equals_bound_study(spark, sf_dir, folder, name):
    from_csv = comparable(REPORTS[name](Study(read_tables(spark, folder), SETTINGS)))
    bound = comparable(REPORTS[name](Study(bound_tables(spark, sf_dir), SETTINGS)))
    if "user_id" in bound.columns:  # keys keep the file's type, which is text in CSV
        bound = bound.withColumn("user_id", bound.user_id.cast("string"))
    assert from_csv.columns == bound.columns and rows(from_csv) == rows(bound)


@pytest.mark.parametrize("name", ["channel_stats", "organic_share_daily", "ltv_features", "table_profile"])
def test_extract_changes_no_result(spark, sf_dir, name):
    tables = bound_tables(spark, sf_dir)
    plain, extracted = (comparable(REPORTS[name](Study(tables, SETTINGS, extract=e))) for e in (False, True))
    assert rows(extracted) == rows(plain)


def test_defaults_are_the_published_ones():
    s = Settings()
    assert (s.min_registrations, s.z_threshold, s.max_iter, s.voice_channel) == (200, 3.0, 100, "TikTok")


def test_command_line_writes_reports(spark, folder, tmp_path):
    study_module.main([folder, "weekly_organic_share", "halo_lag_corr", "--write", str(tmp_path)])
    assert spark.read.parquet(str(tmp_path / "halo_lag_corr")).count() == 8
    assert spark.read.parquet(str(tmp_path / "weekly_organic_share")).count() == 5


def test_command_line_refuses_unknown_reports(capsys):
    with pytest.raises(SystemExit):
        study_module.main(["nowhere", "no_such_report"])
    assert "no_such_report" in capsys.readouterr().err
