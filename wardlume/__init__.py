"""wardlume: accessibility analytics over large collections of documents, on Spark."""
