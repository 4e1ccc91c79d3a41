"""Runs the registered queries of the subpackage beside their SQL:  python tests/llm/compare_llm.py folder [name ...]"""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from layerweave.llm.queries import ORACLES, QUERIES  # noqa: E402
from layerweave.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, sql = local_session(8), connect(folder)
    for name in names:
        began = time.time()
        result = QUERIES[name](spark, folder).toPandas()
        took = time.time() - began
        verdict = compare(result, sql.sql(ORACLES[name]).df()) if name in ORACLES else "no SQL"
        print(name, len(result), f"{took:.1f}s", verdict or "agree", flush=True)
    spark.stop()
