"""Fraud feature engineering, evaluation and modelling on Spark DataFrames."""

from txrisk.schema import Columns, transaction_view

__all__ = ["Columns", "transaction_view"]
