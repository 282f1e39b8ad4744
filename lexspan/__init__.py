"""Byte-pair tokenisation over Spark DataFrames."""

from .encoding import Encoding, encoding_for_model, get_encoding, list_encoding_names
from .operators.train import train_encoding_from_iterator, train_mergeable_ranks_from_iterator

__version__ = "0.1.0"
__all__ = ["Encoding", "encoding_for_model", "get_encoding", "list_encoding_names", "train_encoding_from_iterator", "train_mergeable_ranks_from_iterator"]
