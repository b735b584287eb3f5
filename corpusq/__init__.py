"""corpusq: batch search, glossary and corpus-building operators on Spark DataFrames."""
