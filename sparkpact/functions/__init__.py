"""Column helpers: values of unknown type, and text, number and date semantics that Spark's own functions don't have."""
