"""Privacy-preserving preparation of tabular training data on Spark DataFrames."""

from minim.spec import DatasetSpec, get_spec, register_spec

__all__ = ["DatasetSpec", "get_spec", "register_spec"]
__version__ = "0.1.0"
