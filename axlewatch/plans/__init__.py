"""Registered queries. Importing the package fills the registry."""
