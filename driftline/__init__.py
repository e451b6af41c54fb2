"""driftline: sensor time-series, events and state intervals as Spark DataFrame operators."""
