"""cadenza: streaming-dialogue analytics as Spark DataFrame plans."""
