"""The observation stream the two jobs start from."""

from dataclasses import replace
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from telewin.operators.records import rekey_by_resource, valid_records, with_rekeyed_partition
from telewin.settings import JobSettings
from telewin.sources.options import properties_file
from telewin.sources.payloads import (
    OPEN_RESPONSE,
    from_framed_avro,
    from_json_key,
    from_json_response,
    to_framed_avro,
    to_json_key,
    union_response,
)
from telewin.sources.topics import ARRIVED, observations_from, read_topic


Settings = TypeVar("Settings", bound=JobSettings)


def with_properties(spark: SparkSession, settings: Settings) -> Settings:
    """``settings`` with the client properties of their file among the options."""
    if settings.properties is None:
        return settings
    found = properties_file(spark, settings.properties)
    return replace(settings, options={**found, **settings.options}, properties=None)


def decoded(records: DataFrame, settings: JobSettings) -> DataFrame:
    """Topic rows as observations, by the payload format the settings name."""
    key, value = F.col("key"), F.col("value")
    on_bad = "fail" if settings.on_bad == "fail" else "null"
    key_shape = T.StructType.fromDDL(settings.key_fields)
    more = T.StructType.fromDDL(settings.value_fields) if settings.value_fields else T.StructType()
    value_shape = T.StructType([*OPEN_RESPONSE.fields, *more.fields])
    key = (
        from_framed_avro(key, settings.key_schemas, settings.key_reader_schema)
        if settings.key_schemas
        else from_json_key(key, key_shape, on_bad)
    )
    value = (
        union_response(
            from_framed_avro(value, settings.value_schemas, settings.value_reader_schema)
        )
        if settings.value_schemas
        else from_json_response(value, value_shape, on_bad)
    )
    return observations_from(records, key, value)


def rekeyed(obs: DataFrame, settings: JobSettings) -> DataFrame:
    """Records by device and resource, with the partition they are dealt to."""
    if settings.partitions is None:
        raise ValueError("an exact job needs the number of partitions of the input topic")
    by_resource = rekey_by_resource(obs, "fail" if settings.on_bad == "fail" else "null")
    key = F.col("key")
    data = to_framed_avro(key, *settings.rekeyed_key_schema) if settings.rekeyed_key_schema else to_json_key(key)
    return with_rekeyed_partition(by_resource, settings.partitions, data.cast("binary"))


def arrival_of(obs: DataFrame) -> str | None:
    """The column that orders records of several source partitions, if the source has it."""
    return ARRIVED if ARRIVED in obs.columns else None


def observations(
    spark: SparkSession, settings: JobSettings, streaming: bool = True
) -> DataFrame:
    """Valid observations of the source topic, as a stream or as a table."""
    records = read_topic(spark, settings.brokers, settings.topic, settings.options, streaming)
    return valid_records(decoded(records, settings), settings.on_bad)
