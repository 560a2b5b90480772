"""Make the package importable by Python workers (Arrow UDFs, applyInPandas).

The package is zipped once per Spark application and added with
``addPyFile``, the standard way to ship Python code to executors.
"""
from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="corvid-pyfiles-"), "corvid.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
