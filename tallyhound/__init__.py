"""Tallyhound: audit of operational ledgers (fuel, requests, invoices, contracts, devices) on Spark."""

__version__ = "0.1.0"
