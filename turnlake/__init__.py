"""Turn analytics for AI coding-assistant usage telemetry, as Spark jobs.

Raw usage logs of many users become one table of *turns*; turns are
de-duplicated, correlated across sources, attributed to capture sessions,
totalled, scored and graded for trust.  Every operator is a plain
``DataFrame -> DataFrame`` function keyed by ``capture_id`` (one workspace on
one machine), so the whole fleet is processed in one job.
"""

__version__ = "0.1.0"
