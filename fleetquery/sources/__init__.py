"""Readers of fleet data; every one has an explicit schema."""
