"""Evidence-backed memory analytics as composable Spark DataFrame operators."""
