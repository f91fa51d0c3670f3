"""Statements, their execution, and the planning of maintenance."""
