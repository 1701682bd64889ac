"""locusmill: DataFrame-to-DataFrame operators for genomics-style analysis on Spark."""
