"""tessera: entity resolution and text retrieval as Spark DataFrame plans."""
