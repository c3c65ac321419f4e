"""Pseudonymisation, integrity verification and corpus preparation on Spark."""
