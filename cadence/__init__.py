"""Activity panels on Spark: aggregate event tables, label, sequence, forecast and evaluate."""
