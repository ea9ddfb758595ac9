"""Contract analytics as Spark jobs: cleaning, detectors, reports, ingest."""
