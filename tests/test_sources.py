from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import account_instants
from funnelworks.plans import channel
from funnelworks.sources import REJECTED, checkpoint_root, materialise, read_table, read_tables, table_profile
from funnelworks.sources.schemas import SCHEMAS
from funnelworks.study import Study
from tests.frames import rows, ts

FILES = {
    "app_events": """user_id,event_timestamp,event_name,source,campaign_id,platform,country
1,2024-01-01 10:00:00,install,Meta,m1,ios,NL
1,2024-01-01 11:00:00,registration,Meta,m1,ios,NL
2,garbage,install,Organic,,android,DE
""",
    # Column order differs from the declared one, and one column is not known.
    "marketing_spend": """channel,date,campaign_id,spend,impressions,clicks,campaign_name,note
Meta,2024-01-01,m1,12.5,1000,10,Prospecting,x
Meta,not a day,m1,1.25,100,1,Prospecting,y
""",
    "user_profiles": "user_id,platform,tracking_enabled,age,gender,registration_date\n1,ios,True,33,male,2024-01-01\n2,android,,oops,,\n",
    "user_transactions": "user_id,transaction_timestamp,transaction_type,amount_usd,running_balance_usd\n"
    + "".join(f"1,2024-01-02 00:00:00,deposit,1,{b}\n" for b in (30, 10, 20)),
    "skan_attribution_ios": "postback_date,network,install_count\n2024-01-03,Meta,5\n",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    return read_tables(spark, str(folder))


def test_types_and_bad_values(tables):
    assert rows(tables.app_events, "user_id", "event_timestamp", "campaign_id") == [
        ("1", ts("2024-01-01 10:00"), "m1"), ("1", ts("2024-01-01 11:00"), "m1"), ("2", None, None),
    ]
    assert rows(tables.user_profiles, "user_id", "tracking_enabled", "age") == [("1", True, 33), ("2", None, None)]
    assert dict(tables.marketing_spend.dtypes)["spend"] == "decimal(18,4)" and "note" in tables.marketing_spend.columns
    assert rows(tables.marketing_spend, "date") == [(None,), (ts("2024-01-01"),)]


def test_rows_of_one_instant_count_in_file_order(tables):
    assert float(account_instants(tables.user_transactions).first()["balance"]) == 20.0


def test_jobs_run_on_csv(tables):
    campaigns = Study(tables).campaigns
    meta = campaigns.filter("campaign_id = 'm1'").first()
    assert float(meta["spend"]) == 13.75 and meta["installs"] == 1 and meta["revenue_30d_total"] > 0


def test_parquet_round_trip(spark, tables, tmp_path):
    for name, df in tables._asdict().items():
        df.drop("event_id", "tx_id").write.parquet(str(tmp_path / f"{name}.parquet"))
    again = read_tables(spark, str(tmp_path), "parquet")
    assert rows(again.app_events, "user_id", "event_timestamp") == rows(tables.app_events, "user_id", "event_timestamp")
    assert float(account_instants(again.user_transactions).first()["balance"]) == 20.0


def test_part_files_with_another_header_are_refused(spark, tmp_path):
    folder = tmp_path / "skan_attribution_ios.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("postback_date,network,install_count\n2024-01-03,Meta,5\n")
    (folder / "b.csv").write_text("network,postback_date,install_count\nMeta,2024-01-03,5\n")
    with pytest.raises(Exception, match="header"):
        read_table(spark, str(folder), SCHEMAS["skan_attribution_ios"]).collect()


def test_filters_and_columns_reach_the_scan(spark, tables, tmp_path):
    tables.app_events.drop("event_id").write.parquet(str(tmp_path / "e.parquet"))
    e = read_table(spark, str(tmp_path / "e.parquet"), SCHEMAS["app_events"], "parquet")
    plan = channel.installs_daily(e)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_name,install)" in plan.split("PushedFilters")[1]
    assert "platform" not in plan.split("ReadSchema")[1] and "country" not in plan.split("ReadSchema")[1]


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="csv or parquet"):
        read_tables(spark, str(tmp_path), "xml")


def test_profile(tables):
    out = {r["column_name"]: (r["data_type"], r["non_null"], r["rejected"], r["row_count"]) for r in table_profile(tables.user_profiles).collect()}
    assert out["tracking_enabled"] == ("boolean", 1, 0, 2) and out["user_id"] == ("string", 2, 0, 2) and out["age"] == ("int", 1, 1, 2)
    assert REJECTED not in out


BAD = """date,channel,campaign_id,campaign_name,spend,impressions,clicks
2024-01-01,Meta,m1,a,"1,234.5",10,2.5
2024-01-02,Meta,m1,a,7,1.0,
someday,Meta,m1,a, ,,3
"""


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_values_that_do_not_parse_are_reported(spark, tmp_path, fmt):
    (tmp_path / "s.csv").write_text(BAD)
    path = str(tmp_path / "s.csv")
    if fmt == "parquet":
        spark.read.options(header=True).csv(path).write.parquet(str(tmp_path / "s.parquet"))
        path = str(tmp_path / "s.parquet")
    read = read_table(spark, path, SCHEMAS["marketing_spend"], fmt)
    got = {r["date"]: [tuple(x) for x in r[REJECTED] or []] for r in read.collect()}
    assert got == {ts("2024-01-01"): [("spend", "1,234.5"), ("clicks", "2.5")], ts("2024-01-02"): [], None: [("date", "someday")]}
    counts = {r["column_name"]: r["rejected"] for r in table_profile(read).collect()}
    assert counts == {"date": 1, "channel": 0, "campaign_id": 0, "campaign_name": 0, "spend": 1, "impressions": 0, "clicks": 1}
    assert channel.spend_daily_campaign(read).count() == 3  # the extra column is in no one's way


def test_values_that_do_not_parse_may_raise(spark, tmp_path):
    (tmp_path / "s.csv").write_text(BAD)
    read = read_table(spark, str(tmp_path / "s.csv"), SCHEMAS["marketing_spend"], on_bad="raise")
    assert dict(read.dtypes)["spend"] == "decimal(18,4)" and REJECTED not in read.columns
    assert read.filter("channel = 'TikTok'").select("campaign_id").count() == 0  # columns not asked for are not checked
    with pytest.raises(Exception, match="spend cannot hold 1,234.5"):
        read.select("spend").collect()
    with pytest.raises(ValueError, match="report or raise"):
        read_table(spark, str(tmp_path / "s.csv"), SCHEMAS["marketing_spend"], on_bad="ignore")


def test_materialised_tables_live_in_the_named_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    out = materialise(spark.range(5).withColumn("half", F.col("id") / 2), "numbers")
    assert out.count() == 5 and all(root in f for f in out.inputFiles())


def test_text_keys_and_gappy_integers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("user_id,platform,tracking_enabled,age,gender\nu-a1,ios,True,34.0,male\nu-b2,ios,,,\nu-c3,ios,,7.5,\n")
    read = read_table(spark, str(tmp_path / "p.csv"), SCHEMAS["user_profiles"])
    assert rows(read, "user_id", "age") == [("u-a1", 34), ("u-b2", None), ("u-c3", None)]
