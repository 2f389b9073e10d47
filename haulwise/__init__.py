"""Supply-chain risk analytics expressed as Spark DataFrame jobs."""
