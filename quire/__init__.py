"""quire: versioned document collections and the queries built on them, as Spark plans."""
