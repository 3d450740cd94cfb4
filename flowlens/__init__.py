"""Packet forensics on Spark: captures, flows, detectors, alerts and their correlation as DataFrames."""

VERSION = "0.2.0"
