"""Source-code knowledge graphs as Spark DataFrames.

Snapshots and documents become typed property graphs (nodes and edges); the
operators build, validate, query, chunk, project and audit them.  Everything
is a lazy DataFrame program unless a docstring says otherwise.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile


def ship(spark) -> None:
    """Make this package importable on the executors of a session, once.

    Executors that were started without it on their path (any cluster, or a
    local session started elsewhere) get it as a zip file from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_codegraph_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codegraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "codegraph.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("codegraph", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._codegraph_shipped = True
