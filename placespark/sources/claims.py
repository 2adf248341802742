"""Claims on files in a shared folder, so that of several workers one takes each file, and a crashed worker's files are taken over.

A claim is an empty file that only one worker can create, as old as its modification time. It ends with a mark that the file is done, set
after the work, or is taken over when it is older than `ttl` seconds: the old claim is renamed, which only one worker can, and a new
one is made. Done files are never claimed again.
Folder and files are reached by Hadoop's file systems; creating a file that must not exist is atomic there.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Fixed value: seconds after which an unfinished claim can be taken over.
TTL = 6 * 3600


class Claims:
    """The claims of one worker in `folder`."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = TTL, now: Callable[[], float] = time.time) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder, self.ttl, self.now = folder.rstrip("/"), ttl, now
        self.files.mkdirs(self.path(self.folder))

    def _at(self, file: str, kind: str) -> object:
        return self.path(f"{self.folder}/{hashlib.sha256(file.encode()).hexdigest()}.{kind}")

    def _create(self, at: object) -> bool:
        """Make an empty file; false where it is there already. Hadoop's local file system looks first and then creates, so the system is asked itself."""
        try:
            if self.files.getScheme() == "file":
                os.close(os.open(self.path.getPathWithoutSchemeAndAuthority(at).toString(), os.O_CREAT | os.O_EXCL))
                return True
            return self.files.createNewFile(at)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def is_done(self, file: str) -> bool:
        return self.files.exists(self._at(file, "done"))

    def claim(self, file: str) -> bool:
        """Whether this worker takes the file: it is neither done nor claimed, or its claim is too old."""
        if self.is_done(file):
            return False
        at = self._at(file, "claim")
        if self.files.exists(at):
            claimed = self.files.getFileStatus(at).getModificationTime() / 1000
            if self.now() - claimed < self.ttl or not self.files.rename(at, self.path(f"{self.folder}/_{uuid.uuid4().hex}")):
                return False
        return self._create(at) and not self.is_done(file)

    def finish(self, file: str) -> None:
        """Mark a file done; twice is once."""
        self._create(self._at(file, "done"))

    def work(self, files: Iterable[str], job: Callable[[str], None]) -> list[str]:
        """Run job for each file that this worker can claim, and mark it done after success; the files done. An error leaves its claim to age."""
        done = []
        for file in files:
            if self.claim(file):
                job(file)
                self.finish(file)
                done.append(file)
        return done
