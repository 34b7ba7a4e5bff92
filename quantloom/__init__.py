"""Panel analytics on Spark: cross-sectional factors, evaluation and risk as DataFrame plans."""
