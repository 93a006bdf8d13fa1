"""Every query and the pipeline on workers that have no copy of the package: the driver alone has it on its path."""

import os
import subprocess
import sys
from pathlib import Path

from llm_helpers import SF_SMALL

ROOT = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from chunkwise.session import get_spark
spark = get_spark(master="local[4]", shuffle_partitions=4, app="bare-workers")

def seen(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({{"found": [importlib.util.find_spec("chunkwise") is not None]}})

if any(r.found for r in spark.range(4).mapInPandas(seen, "found boolean").collect()):
    raise SystemExit("the workers have the package: nothing is tested")
import __spark_entry__ as entry
from chunkwise.llm.queries import QUERIES
for name in [*QUERIES, "pipeline"]:
    print(name, entry.queries()[name](spark, {data!r}).count(), flush=True)
"""


def test_workers_need_no_package(tmp_path):
    script = tmp_path / "bare.py"
    script.write_text(SCRIPT.format(root=ROOT, data=SF_SMALL))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(counts) == 14 and all(int(n) > 0 for n in counts.values())
