"""Versioned folders: data is written beside what readers use, and a manifest switches them over in one step.

    <path>/data/v=<n>/...       folders of version n
    <path>/manifest/<n>.json    what version n consists of; the highest number counts

A manifest appears by renaming a finished file. Readers that have begun keep the version they have: folders that only
older manifests than the one before name are removed. One writer at a time."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The newest manifest, or that of a version; None if there is none."""
    have = _numbers(spark, path)
    if not have:
        return None
    _, target = _fs(spark, f"{path}/manifest/{number if number is not None else have[-1]:010d}.json")
    fs, _ = _fs(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def next_version(spark: SparkSession, path: str) -> int:
    have = _numbers(spark, path)
    return have[-1] + 1 if have else 0


def folder(path: str, version: int) -> str:
    return f"{path}/data/v={version}"


def switch(spark: SparkSession, path: str, content: dict, keeps: list[int]) -> None:
    """Make `content` (with its "version") the newest manifest. `keeps` are the versions whose folders it names; folders
    that neither it nor the manifest before names go, and so do older manifests."""
    before = manifest(spark, path)
    fs, tmp = _fs(spark, f"{path}/manifest/.{content['version']}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(json.dumps(content | {"keeps": sorted(set(keeps))}).encode())
    finally:
        out.close()
    if not fs.rename(tmp, _fs(spark, f"{path}/manifest/{content['version']:010d}.json")[1]):
        raise RuntimeError(f"version {content['version']} of {path} is there already: two writers?")
    wanted = {*keeps, *(before["keeps"] if before else [])}
    _, data = _fs(spark, f"{path}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        name = status.getPath().getName()
        if name.startswith("v=") and int(name.removeprefix("v=")) not in wanted:
            fs.delete(status.getPath(), True)
    for number in _numbers(spark, path)[:-2]:
        fs.delete(_fs(spark, f"{path}/manifest/{number:010d}.json")[1], False)
