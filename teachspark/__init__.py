"""teachspark: data work for fitting one next-token model to another, as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Send this package's worker code with each task (pickled by value).

    The Arrow maps (plug-in tokenizer, scorers, sampler) then run on
    executors that do not have the package installed.
    """
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to installed package
        pass


_ship_by_value()
