"""Training-data operators: one module per operator, plus the thin registered queries in ``registry``."""
