"""tokenloom: text tokenization as DataFrame operators on Spark."""
