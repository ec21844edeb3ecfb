"""Search, lifecycle, graph and change operators over semi-structured records, as Spark DataFrame plans."""
