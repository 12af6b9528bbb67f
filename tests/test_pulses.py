from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from spanweave.functions import dsp
from spanweave.plans import catalogue


def test_pcm_pulses_reads_every_stream(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array(range(1, 13), pa.int64()), "c_nationkey": pa.array([k % 4 for k in range(12)], pa.int32())}), tmp_path / "customer.parquet")
    want = Counter()
    for s in range(1, 13):
        t, h = dsp.pulses(dsp.synthetic(4.0, list(np.arange(0.2, 3.8, 0.8)), seed=s))
        want.update((s, round(float(a), 3), round(float(b), 6)) for a, b in zip(t, h, strict=True))
    assert Counter(map(tuple, catalogue.QUERIES["pcm_pulses"](spark, str(tmp_path)).collect())) == want and len({k[0] for k in want}) == 12
