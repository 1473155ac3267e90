"""Reports against their check SQL on random tables full of NULLs, ties and duplicates.

The binding blocks of the check SQL are replaced by these tables; everything after them stays.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest

from funnelworks.fixture import oracles
from funnelworks.fixture.queries import SETTINGS, comparable
from funnelworks.sources import Tables
from funnelworks.study import RELATIONAL, Study
from tests.check import canonical
from tests.frames import EVENTS, PROFILES, SPEND, TX

START = datetime(2024, 1, 1)
CHANNELS = ["Organic", "Meta", "TikTok", "Referral", "Google Brand Search", "Google Non-Brand Search", None]
NAMES = ["Brand search", "non-brand generic", "Retargeting reach", "UAC install", "", None]
# The profile lists the bound tables' own types; the pivot lists fixed sources.
SKIPPED = {"table_profile", "daily_installs_pivot"}
DUCK_TYPES = {"long": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "int": "INT", "date": "DATE"}


def some(rng, values, missing=0.1):
    return None if rng.random() < missing else rng.choice(values)


def random_tables(seed):
    rng = random.Random(seed)
    users = [*range(1, 25), *[1] * 12]  # user 1 owns a third

    def moment(days, step_hours):
        return START + timedelta(hours=rng.randrange(0, days * 24, step_hours))

    def campaign():
        return some(rng, ["c1", "c2", "c3"], 0.3)

    events = [
        (i, some(rng, users, 0.05), None if rng.random() < 0.03 else moment(30, 3), rng.choice(["install", "registration", "registration", "click"]),
         rng.choice(CHANNELS), campaign(), some(rng, ["ios", "android"]), some(rng, ["NL", "DE"]))
        for i in range(900)
    ]
    spend = [
        ((START + timedelta(days=rng.randrange(30))).date(), rng.choice(CHANNELS[1:]), campaign(), rng.choice(NAMES),
         Decimal(rng.randrange(0, 90000)) / 100, rng.randrange(0, 5) * 100, rng.randrange(0, 4))
        for _ in range(300)
    ]
    tx, balance = [], {}
    for i in range(1200):
        user = some(rng, users, 0.05)
        amount, kind = Decimal(rng.randrange(1, 9999)) / 100, rng.choice(["deposit", "withdrawal", "transfer"])
        balance[user] = balance.get(user, Decimal(0)) + (amount if kind == "deposit" else -amount)
        tx.append((i, user, None if rng.random() < 0.03 else moment(400, 24), kind, amount, None if rng.random() < 0.05 else balance[user]))
    profiles = [
        (some(rng, users, 0.05), some(rng, ["ios", "android"]), some(rng, [True, False], 0.3), some(rng, [20, 30, 40]), some(rng, ["female", "male"]))
        for _ in range(40)
    ]
    skan = [
        (None if rng.random() < 0.05 else (START + timedelta(days=rng.randrange(30))).date(), some(rng, ["Meta", "TikTok"]), rng.randrange(50), rng.randrange(9))
        for _ in range(120)
    ]
    return {
        "app_events": (EVENTS, events), "marketing_spend": (SPEND, spend), "user_profiles": (PROFILES, profiles), "user_transactions": (TX, tx),
        "skan": ("postback_date date, network string, conversion_value int, install_count long", skan),
    }


@pytest.fixture(scope="module", params=[1, 2])
def study_and_duck(spark, request):
    data = random_tables(request.param)
    con = duckdb.connect()
    for name, (schema, rows) in data.items():
        columns = [c.strip().split(" ") for c in schema.replace("decimal(18,4)", "DECIMAL(18,4)").replace("decimal(28,4)", "DECIMAL(28,4)").split(", ")]
        con.execute(f"CREATE TABLE raw_{name} ({', '.join(f'{c} {DUCK_TYPES.get(t, t)}' for c, t in columns)})")
        con.executemany(f"INSERT INTO raw_{name} VALUES ({', '.join('?' * len(columns))})", rows)
    frames = {name: spark.createDataFrame(rows, schema).repartition(3) for name, (schema, rows) in data.items()}
    tables = Tables(*[frames[n] for n in ("app_events", "marketing_spend", "user_profiles", "user_transactions", "skan")])
    return Study(tables, SETTINGS), con


@pytest.mark.parametrize("name", [n for n in RELATIONAL if n not in SKIPPED])
def test_report(study_and_duck, monkeypatch, name):
    study, con = study_and_duck
    views = dict(oracles._VIEWS)
    for table in ("marketing_spend", "user_profiles", "user_transactions", "skan"):
        views[table] = ((), f"SELECT * FROM raw_{table}")
    views["app_events"] = ((), "SELECT *, CAST(event_timestamp AS DATE) AS event_date FROM raw_app_events")
    monkeypatch.setattr(oracles, "_VIEWS", views)
    cur = con.execute(oracles._sql(*oracles._QUERIES[name]))
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    df = comparable(RELATIONAL[name](study))
    assert canonical(df.columns, df.collect()) == theirs
    assert theirs
