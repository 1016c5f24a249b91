"""lumitie: relative photometric self-calibration of sky surveys on Spark.

Every table is a DataFrame.  The packages are

* ``functions``  Column expressions (pixelisation, epochs, photometry, Chebyshev)
* ``operators``  DataFrame-to-DataFrame building blocks (top-k, exact quantiles,
  overlap graph, normal equations, conjugate gradients, sky match, regression)
* ``sources``    readers, sinks, staging tables and the test mapping
* ``plans``      the calibration phases and the validation and diagnostic reports
"""

from lumitie.config import Config, load_config

__all__ = ["Config", "load_config"]
