"""Diachronic wiki analytics on Spark: time travel, link networks, codecs and exports."""
