"""tessera: Spark operators for building, querying and auditing a text knowledge base."""
