"""Planners, ledgers, diffs, and the queries over the test tables with their SQL."""
