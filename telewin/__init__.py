"""Windowed analytics over keyed device telemetry, as Spark DataFrame transforms."""
