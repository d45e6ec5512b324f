"""plait: exact signed-digit numbers and certified text orderings on PySpark."""
