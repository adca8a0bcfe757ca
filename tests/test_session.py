import os
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from lumisync.session import map_arrow


def test_workers_keep_no_unused_memory_between_tasks(spark):
    def used(pid):
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024

    def task(batches):
        before = used(os.getpid())
        held = [np.ones(64 << 10, np.uint8) for _ in range(3000)]
        sys.last_block = held[-1]  # it lies behind all others, so they stay with the allocator when freed
        most = used(os.getpid())
        del held
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), "before": before, "most": most}] * batch.num_rows)

    row, = map_arrow(spark.range(1, numPartitions=1), task, "pid long, before double, most double").collect()
    assert row.most > row.before + 150
    assert used(row.pid) < row.before + 75  # the worker is idle now
