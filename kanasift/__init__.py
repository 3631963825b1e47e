"""Japanese text analysis over Spark tables: dictionaries, documents and tokens are DataFrames."""
