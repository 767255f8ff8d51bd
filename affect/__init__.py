"""affect — Spark-native analytics for annotated conversational text.

Every operator is a function DataFrame -> DataFrame (or Column -> Column)
built from DataFrame / Spark SQL expressions, so Catalyst plans the work and
the same code runs on a laptop or a large cluster.

Sub-packages
------------
functions  column-level helpers (label cleaning, seeded draws, statistics tails)
sources    scans, sinks, report parsing and the adapter views over the test tables
operators  label structure, profile, text mining, adaptation, balancing,
           evaluation, experiment statistics
plans      composed jobs (corpus profile, adapt-and-balance, label preparation,
           experiment study)
streaming  the stateless column operators applied to streaming DataFrames
"""

from affect.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
