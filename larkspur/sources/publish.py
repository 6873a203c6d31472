"""Generated data that is either whole or not there.

A writer puts its files into a folder of its own and then publishes them: a
small manifest, written whole and renamed into place, names that folder. Readers
follow the manifest only, so files of a writer that was killed are never seen;
a generation that is published is left untouched by a rerun. Flags of a
generation are in its manifest, not in its data.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "published.json"  # Spark reads no file whose name begins with _


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    """Writes a file beside its place and renames it into it; False where it is there already and isn't to be replaced."""
    fs, p = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        fs.delete(p, False)
    if not replace and fs.exists(p) or not fs.rename(beside, p):
        fs.delete(beside, False)
        return False
    return True


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published under path; None without."""
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def publish(df: Callable[[], DataFrame], path: str, spark: SparkSession, partition_by: list[str] = (), summary: Callable[[DataFrame], dict] | None = None) -> dict:
    """Writes what df makes, unless path is published already: then nothing is computed or touched. The manifest has the data's folder, its rows, its columns and what summary says of the data as written. Of two writers at once the first to publish wins and the other's files go."""
    if found := manifest(spark, path):
        return found
    folder = f"data-{uuid.uuid4().hex}"
    made = df()
    made.write.partitionBy(*partition_by).parquet(f"{path}/{folder}") if partition_by else made.write.parquet(f"{path}/{folder}")
    back = spark.read.schema(made.schema).parquet(f"{path}/{folder}")
    said = {"folder": folder, "rows": back.count(), "columns": [f"{n} {t}" for n, t in back.dtypes], "summary": summary(back) if summary else {}, "flags": {}}
    if not _put(spark, f"{path}/{MANIFEST}", json.dumps(said, sort_keys=True, allow_nan=False), False):
        remove(spark, f"{path}/{folder}")
        return manifest(spark, path)
    return said


def read(spark: SparkSession, path: str) -> DataFrame:
    """The published data; an error without."""
    found = manifest(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/{found['folder']}")


def set_flag(spark: SparkSession, path: str, name: str, value) -> dict:
    """Changes one flag of what is published (as test_evaluated) and nothing else; an error where nothing is."""
    found = manifest(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published under {path}")
    if found["flags"].get(name) != value:
        found["flags"][name] = value
        _put(spark, f"{path}/{MANIFEST}", json.dumps(found, sort_keys=True, allow_nan=False), True)
    return found


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes what killed or outrun writers left under path; how many folders and files went."""
    found = manifest(spark, path)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0
    gone = 0
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name != MANIFEST and name != (found or {}).get("folder"):
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


def split_summary(df: DataFrame, split: str = "split", cls: str = "class_name", group: str = "group_id") -> dict:
    """A header of written splits: images and groups of each split, images of each class in it; keys in order."""
    rows = df.groupBy(split, cls).agg(F.count("*").alias("images")).collect()  # a row for each split and class
    groups = {r[0]: r["groups"] for r in df.select(split, group).distinct().groupBy(split).agg(F.count("*").alias("groups")).collect()}
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), str(r[1]))):
        s = out.setdefault(str(r[0]), {"images": 0, "groups": groups[r[0]], "classes": {}})
        s["images"] += r["images"]
        s["classes"][str(r[1])] = r["images"]
    return out
