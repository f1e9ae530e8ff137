"""Code-evidence analytics on Spark: fact tables of a source snapshot, and the joins, rankings and graph queries over them."""
