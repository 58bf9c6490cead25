"""Catalyst expressions for log lines; no Python runs on executors here, but for one function named so."""
