"""What the library runs with."""

from __future__ import annotations

import importlib.metadata
import os
import platform


def system_info() -> dict[str, str]:
    """Versions of Python, the platform and the libraries used; those not installed are told."""
    out = {"python": platform.python_version(), "platform": platform.platform(), "installed in": os.path.dirname(os.path.abspath(__file__))}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "not installed"
    return out


def show_info() -> None:
    for k, v in system_info().items():
        print(f"{k}: {v}")
