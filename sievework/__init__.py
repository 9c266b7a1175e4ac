"""Sievework: content intelligence over short posts and web pages, written as Spark jobs."""
