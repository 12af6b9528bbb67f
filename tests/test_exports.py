"""The export's timeline against its SQL, and how many rows its plans make."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from spanweave.functions.units import UNIT
from spanweave.plans import catalogue


def rows_made(spark, since):
    """Rows put out by the largest node of all plans after the first ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList().iterator()
    while runs.hasNext():
        n = runs.next().executionId()
        values, nodes = store.executionMetrics(n), store.planGraph(n).allNodes().iterator()
        while n >= since and nodes.hasNext():
            metrics = nodes.next().metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_export_timeline_of_a_crowded_court(spark, tmp_path):
    r = random.Random(3)
    day = 1_700_000_000_000_000
    rows = [(40 * k + i, day + r.randrange(20 * UNIT), 10 * k + 2, "error" if i % 9 == 0 else "hit", r.randrange(5000) / 100) for k in range(40) for i in range(40)]
    rows += [(9000 + i, day + r.randrange(60 * UNIT), r.choice([4, 14]), "hit", 0.04 if i < 30 else 0.08 * r.randrange(3)) for i in range(40)]
    rows += [(9100 + i, day + i * UNIT, 7, "hit", 0.01) for i in range(6)]  # a court without a keyframe
    rows += [(9200 + i, t, None, "hit", v) for i, (t, v) in enumerate([(day, 0.08), (day + UNIT, 0.01), (day + 9 * UNIT, 0.08)])]
    rows += [(9300, None, 2, "hit", 0.08), (9301, None, 8, "hit", 0.08), (9302, day, 4, "hit", None), *[(9310 + i, day, 12, "hit", 0.08) for i in range(3)]]
    names = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64()}
    pq.write_table(pa.table({n: pa.array([x[i] for x in rows], kind) for i, (n, kind) in enumerate(names.items())}), tmp_path / "events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = db.sql(catalogue.ORACLE["export_timeline"]).fetchall()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = catalogue.QUERIES["export_timeline"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(x["n_frames"] for x in got) > 30 * len(rows)  # what a row for each frame of each span would be
    assert len(rows) <= rows_made(spark, since) < 6 * len(rows)
