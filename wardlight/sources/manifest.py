"""What a run has stored already, so that a run that was stopped goes on from there."""

import hashlib

from pyspark.sql import SparkSession


class RunManifest:
    """Marks of finished steps below a run's output folder.

    Steps count only for the inputs they were made from: the marks stand in a folder named by
    what identifies the inputs. A mark is set after its step's files are complete.
    """

    def __init__(self, spark: SparkSession, path: str, *inputs: str):
        digest = hashlib.sha256("\0".join(inputs).encode()).hexdigest()[:32]
        self._jvm = spark._jvm
        self._folder = f"{path}/_steps/{digest}"
        first = self._jvm.org.apache.hadoop.fs.Path(self._folder)
        self._files = first.getFileSystem(spark._jsc.hadoopConfiguration())

    def _mark(self, step: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{step}")

    def done(self, step: str) -> bool:
        return self._files.exists(self._mark(step))

    def finish(self, step: str) -> None:
        self._files.create(self._mark(step), True).close()
