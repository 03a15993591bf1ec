"""Session settings for reports, on a laptop or a cluster."""

import math

from pyspark.sql import SparkSession

_MB = 1024 * 1024
_SMALLEST_SPLIT = 128 * _MB
_LARGEST_SPLIT = 1024 * _MB
_SHUFFLE_PARTITION = 256 * _MB
_WAVES = 16


def report_options(input_bytes: int, cores: int, shuffled_share: float = 0.1) -> dict:
    """Spark settings for an input of this size.

    Splits grow with the input so that a scan takes some sixteen waves of tasks
    and not hundreds of thousands of tiny ones. The first shuffle is sized for the
    share of the input that reports really ship, a few columns after map-side
    combining, at about 256 MB per partition and never fewer than there are cores.
    Adaptive execution merges the small partitions and splits the skewed ones.
    """
    split = min(_LARGEST_SPLIT, max(_SMALLEST_SPLIT, input_bytes // (cores * _WAVES)))
    partitions = max(cores, math.ceil(input_bytes * shuffled_share / _SHUFFLE_PARTITION))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        # Recording the Python line of every column doubles the time a plan takes to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def build_session(
    app_name: str,
    input_bytes: int = 0,
    cores: int = 8,
    master: str | None = None,
    checkpoint_dir: str | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session with `report_options`.

    The last three arguments are for local runs; on a cluster they come from its
    own configuration.
    """
    # Without a known size a cluster keeps its own partition counts.
    options = report_options(input_bytes, cores)
    if not input_bytes and not master:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions"):
            del options[key]
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
