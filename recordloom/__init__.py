"""recordloom: registry-record processing expressed as Spark DataFrame jobs.

Layout:
  functions/  column expressions (text, dates, serials)
  sources/    scans, intake normalisation, sinks, the driver-table mapping
  operators/  selection, joins, data-quality checks, numbering, ingest,
              rendering, write-back, reports
  plans/      composite pipelines and the query catalog
  streaming/  incremental pick-up of new records with Structured Streaming
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
