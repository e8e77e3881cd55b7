"""Ledgerloom: fund-flow analytics and training-data operators on Spark."""
