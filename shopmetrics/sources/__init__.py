"""Typed scans, staging, copying and publishing of datasets."""
