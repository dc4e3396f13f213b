"""Run a job: ``spark-submit run_job.py counts|max [brokers] [topic] [...] [--option name=value]``.

Every argument has a default, and a job goes on where its checkpoint ends.
Payloads are JSON unless schema files are given (``--value-schema 7=response.avsc``).
"""

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from telewin.plans import device_counts, window_max
from telewin.settings import CountSettings, JobSettings, MaxSettings

JOBS = {"counts": CountSettings, "max": MaxSettings}


def name_and_value(text: str) -> tuple[str, str]:
    name, found, value = text.partition("=")
    if not found:
        raise argparse.ArgumentTypeError(f"{text!r} is not name=value")
    return name, value


def id_and_schema(text: str) -> tuple[int, str]:
    """``id=file`` as a registry id and the schema text in the file."""
    number, path = name_and_value(text)
    return int(number), Path(path).read_text()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    for job, settings in JOBS.items():
        one = jobs.add_parser(job)
        one.add_argument("brokers", nargs="?", default=settings.brokers)
        one.add_argument("topic", nargs="?", default=settings.topic)
        if job == "max":
            one.add_argument("output_topic", nargs="?", default=MaxSettings.output_topic)
        one.add_argument("checkpoint", nargs="?", help="folder in shared storage")
        one.add_argument("--option", action="append", default=[], type=name_and_value)
        one.add_argument("--properties", help="a Java properties file of the client; need not exist")
        if job == "counts":
            one.add_argument("--printed", type=int, default=settings.printed, help="rows printed a trigger")
        for name in ("--key-schema", "--value-schema"):
            one.add_argument(name, action="append", default=[], type=id_and_schema)
        for name in ("--key-reader-schema", "--value-reader-schema"):
            one.add_argument(name, type=lambda path: Path(path).read_text())
        one.add_argument("--exact", action="store_true", help="late records and NaN as in a replay")
        one.add_argument("--every-record", action="store_true", help="with --exact: an update for each record")
        one.add_argument("--partitions", type=int, help="partitions of the input topic")
        one.add_argument("--merge-every", type=int, default=settings.merge_every)
        one.add_argument("--rekeyed-key-schema", type=id_and_schema)
        if job == "max":
            one.add_argument("--output-partitions", type=int)
            one.add_argument("--output-key-schema", type=id_and_schema)
            one.add_argument("--output-value-schema", type=id_and_schema)
    return out


def parse(args: Sequence[str]) -> tuple[str, JobSettings]:
    given = vars(parser().parse_args(args))
    job = given.pop("job")
    return job, JOBS[job](
        options=dict(given.pop("option")),
        key_schemas=dict(given.pop("key_schema")),
        value_schemas=dict(given.pop("value_schema")),
        **given,
    )


def main(args: Sequence[str]) -> None:
    job, settings = parse(args)
    spark = SparkSession.builder.appName(settings.name).getOrCreate()
    (device_counts if job == "counts" else window_max).start(spark, settings)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
