"""newsflow: news-feed ingest, embedding, work accounting and telemetry as Spark DataFrame operators."""
