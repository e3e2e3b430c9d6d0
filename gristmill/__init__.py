"""gristmill: data-processing operators written on the Spark DataFrame and SQL APIs."""
