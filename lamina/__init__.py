"""Lamina: distributed mixed-effects analytics on PySpark DataFrames."""

import os

# The driver's matrices are small: threads of a BLAS cost more than they give, and compete with Spark's own.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")


def _one_thread() -> None:
    """The same for a BLAS that numpy has loaded before this package: by its own setter, where it has one."""
    import ctypes
    import sys

    if "numpy" not in sys.modules or not sys.platform.startswith("linux"):
        return
    with open("/proc/self/maps") as maps:
        libraries = {line.split()[-1] for line in maps if "openblas" in line}
    for path in libraries:
        library = ctypes.CDLL(path)
        for setter in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, setter):
                getattr(library, setter)(1)
                break


_one_thread()
