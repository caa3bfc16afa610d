"""yelken: a Spark engine for local-news analytics. Subpackages: functions (Column -> Column),
operators (DataFrame -> DataFrame), sources, plans (whole runs), streaming, llm (training-data operators)."""
