"""millrace: corpus preparation and run analytics as Spark DataFrame jobs."""

import sys as _sys

try:  # Ship our Python helpers inside task closures, so executors need no install.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
