"""Reader and writer options, with the caller's settings laid over them."""

from collections.abc import Mapping

from pyspark.sql import SparkSession

# The connector's own options; every other property is the client's.
CONNECTOR = frozenset(
    name.lower()
    for name in (
        "assign subscribe subscribePattern topic includeHeaders startingOffsets startingTimestamp "
        "startingOffsetsByTimestamp startingOffsetsByTimestampStrategy endingOffsets endingTimestamp "
        "endingOffsetsByTimestamp failOnDataLoss kafkaConsumer.pollTimeoutMs fetchOffset.numRetries "
        "fetchOffset.retryIntervalMs maxOffsetsPerTrigger minOffsetsPerTrigger maxTriggerDelay minPartitions "
        "maxRecordsPerPartition groupIdPrefix kafka.group.id"
    ).split()
)


def client_option(name: str) -> str:
    """Spell a client property the way the connector wants it, behind ``kafka.``."""
    own = name.lower() in CONNECTOR or name.lower().startswith("kafka.")
    return name if own else f"kafka.{name}"


def properties_file(spark: SparkSession, path: str) -> dict[str, str]:
    """The client properties in a Java properties file, which may lie in any store Spark reaches; none if there is no file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(file):
        return {}
    properties, data = spark._jvm.java.util.Properties(), files.open(file)
    try:
        properties.load(data)
    finally:
        data.close()
    return {name: properties.getProperty(name) for name in properties.stringPropertyNames()}


def overlay(defaults: Mapping[str, str], user: Mapping[str, str] | None = None) -> dict[str, str]:
    """``defaults`` with the caller's properties on top; no properties is fine."""
    merged = dict(defaults)
    for name, value in (user or {}).items():
        merged[name if name in defaults else client_option(name)] = str(value)
    return merged
