"""Registered queries, the inputs they derive, and their SQL oracles."""
