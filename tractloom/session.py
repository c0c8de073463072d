"""Sessions: settings that the engine expects, and shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes checkpoint() write to the folder in spark.checkpoint.dir. Without one, only a local master gets a folder of its own: a cluster's machines share none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            where = "/tmp/checkpoints/tractloom"
        sc.setCheckpointDir(where)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers once per application, so that their Python finds it wherever it was started."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="tractloom-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)
    return spark
