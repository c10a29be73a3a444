"""Queries over the driver's tables with the DuckDB SQL that states their answers."""
