"""Small JSON records in a shared folder, replaced as a whole: a reader sees the old one or the new one."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to remove."""
    return _system(spark, path).delete(_path(spark, path), True)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Written beside the path first, then renamed over it in one step."""
    system, temp = _system(spark, path), f"{path}.{uuid.uuid4().hex}"
    out = system.create(_path(spark, temp), True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, default=str).encode()))
    finally:
        out.close()
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    qualified = lambda p: system.makeQualified(_path(spark, p))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(qualified(temp), qualified(path), options)


def read_json(spark: SparkSession, path: str) -> Any:
    """The record, or None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
