"""tidegauge: log, metric, alert and corpus analytics on PySpark DataFrames."""
