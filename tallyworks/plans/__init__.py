"""Workloads over concrete tables: projections, detectors, registered queries."""
