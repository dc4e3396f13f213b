"""Parameters of the two jobs, with their defaults."""

from collections.abc import Mapping
from dataclasses import dataclass, field

from telewin.operators.windows import HALF_MINUTE_MS, MINUTE_MS
from telewin.streaming.run import CADENCE, PRINTED


@dataclass(frozen=True)
class JobSettings:
    """What both jobs need."""

    # A folder in shared storage; by default the one the session names.
    checkpoint: str | None = None
    brokers: str = "localhost:9092"
    topic: str = "iot.server1.observations"
    # Writer schema text by registry id; empty means JSON payloads.
    key_schemas: Mapping[int, str] = field(default_factory=dict)
    value_schemas: Mapping[int, str] = field(default_factory=dict)
    key_reader_schema: str | None = None
    value_reader_schema: str | None = None
    # JSON payloads: the fields of a key, and those a response carries besides the known ones.
    key_fields: str = "ep string"
    value_fields: str | None = None
    # Connector and client properties laid over the built-in ones.
    options: Mapping[str, str] = field(default_factory=dict)
    # A Java properties file with more of them, which need not exist; ``options`` win over it.
    properties: str | None = None
    cadence: str = CADENCE
    on_bad: str = "drop"
    # Late records and NaN readings exactly as in a replay of the topic, in a table under the checkpoint.
    exact: bool = False
    # Partitions of the input topic, which re-keyed records are dealt to as well; ``exact`` needs it.
    partitions: int | None = None
    # Registry id and schema text of the re-keyed keys, which decide their partition; empty means JSON.
    rekeyed_key_schema: tuple[int, str] | None = None
    # With ``exact``: one update for each record, instead of one for each window and trigger.
    every_record: bool = False
    # Triggers between merges of an exact table.
    merge_every: int = 360


@dataclass(frozen=True)
class CountSettings(JobSettings):
    name: str = "device-counts"
    window_ms: int = MINUTE_MS
    # Rows of a trigger that are printed.
    printed: int = PRINTED
    # Count both levels in one query, or each in a query that reads the topic itself.
    one_read: bool = True


@dataclass(frozen=True)
class MaxSettings(JobSettings):
    name: str = "window-max"
    window_ms: int = HALF_MINUTE_MS
    output_topic: str = "analytics.server1.observations.maxper30sec"
    # Partitions of the output topic, so that windows of a key share one; a start needs it.
    output_partitions: int | None = None
    # Registry ids and schema text of the output; empty means JSON payloads.
    output_key_schema: tuple[int, str] | None = None
    output_value_schema: tuple[int, str] | None = None
