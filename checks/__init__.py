"""Bound queries: every operator run over the driver tables, with the SQL its result must equal."""
