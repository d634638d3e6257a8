"""Versioned warehouse folders.

Each build goes to a folder of its own under ``builds``; publishing it creates
one numbered marker file that names the folder. The marker is created
exclusively: of two publishers with one number the second takes the next, so the
order of the markers is the order of publishing. Readers take the build of the
last complete marker; a failed build leaves the published one as it was and a
reader never sees half of two builds."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ledgerlens.session import delete_path, file_system

KEEP = 2  # published builds kept: readers of the last but one may still run


class Markers:
    """Numbered text files in a folder, each created once and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def names(self) -> list[str]:
        fs, at = file_system(self.spark, self.folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, name: str) -> str:
        fs, at = file_system(self.spark, f"{self.folder}/{name}")
        size = fs.getFileStatus(at).getLen()
        if not size:
            return ""
        stream = fs.open(at)
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def last(self) -> tuple[int, str]:
        """(number, text) of the last complete marker; (0, "") if there is none.
        A marker without text is still being written."""
        for name in reversed(self.names()):
            if text := self.read(name):
                return int(name), text
        return 0, ""

    def create(self, number: int, text: str) -> bool:
        """False if the number is taken."""
        fs, at = file_system(self.spark, f"{self.folder}/{number:012d}")
        try:
            stream = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True


def new_build(out_dir: str) -> str:
    return f"{out_dir}/builds/{uuid.uuid4().hex}"


def publish(spark: SparkSession, out_dir: str, build: str) -> None:
    """Make ``build`` the current one and drop builds published long before."""
    markers = Markers(spark, f"{out_dir}/published")
    number = max([int(n) for n in markers.names()], default=0) + 1
    while not markers.create(number, build.rsplit("/", 1)[1]):
        number += 1
    old = [n for n in markers.names() if int(n) < number]
    for name in old[: max(0, len(old) + 1 - KEEP)]:
        folder = markers.read(name)
        delete_path(spark, f"{markers.folder}/{name}")
        if folder:
            delete_path(spark, f"{out_dir}/builds/{folder}")


def current(spark: SparkSession, out_dir: str) -> str:
    """Folder of the published build."""
    number, folder = Markers(spark, f"{out_dir}/published").last()
    if not number:
        raise FileNotFoundError(f"no published build in {out_dir}")
    return f"{out_dir}/builds/{folder}"


LEGS = "duplicate_cashout_legs"


def legs_path(spark: SparkSession, build: str) -> str:
    """Folder of a build's duplicate legs: the last refreshed set, or the one
    written with the build."""
    number, folder = Markers(spark, f"{build}/refreshed_legs/published").last()
    return f"{build}/refreshed_legs/{folder}" if number else f"{build}/{LEGS}"


def publish_legs(spark: SparkSession, build: str, folder: str) -> None:
    """Make a set written under ``refreshed_legs`` the build's current one."""
    markers = Markers(spark, f"{build}/refreshed_legs/published")
    number = max([int(n) for n in markers.names()], default=0) + 1
    while not markers.create(number, folder):
        number += 1
