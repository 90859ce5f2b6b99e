"""horosphere: social event detection as Spark jobs.

Messages are cut into time blocks, turned into text + time vectors, mapped
into hyperbolic space, clustered per block and scored against known events.
Every stage is a DataFrame transformation; Python only runs inside Arrow
batches where numerics need numpy.
"""

from horosphere.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
