"""Record contracts for Spark: declare a record once, then decode, check and encode whole DataFrames."""

from . import operators as rules
from .errors import ContractError
from .plans import Config, Engine, array_of, field, union

__all__ = ["Config", "ContractError", "Engine", "array_of", "field", "rules", "union"]
