"""riskweave: source-code security analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames.  See ``riskweave.operators`` for the
building blocks and ``riskweave.plans`` for whole flows and the query catalogue.
"""

from riskweave.operators.rules import LineRule, TreeRule, findings, scan
from riskweave.session import scratch_dir, spread, tune

__all__ = ["LineRule", "TreeRule", "findings", "scan", "scratch_dir", "spread", "tune"]
